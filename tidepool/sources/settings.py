"""Question sets, denylists and profiles: small files, read on the driver."""

from __future__ import annotations

import hashlib
import json
import tomllib
from pathlib import Path

from tidepool.operators.decide import BUCKETS, NOULS

# Fixed values.
MOST_OPTIONS, MOST_LEVELS = 255, 10
DEFAULT_QUESTIONS = {
    "bucket": {"type": "choice", "options": dict.fromkeys(BUCKETS, "")},
    "persist": {"type": "score", "levels": ["drop", "park", "promote"]},
    **{n: {"type": "noul", "instructions": ""} for n in NOULS},
}
PROFILE_KEYS = {
    "vault": str, "journal": str, "denylist": str, "taxonomy": str, "model": str, "sensitive_paths": list, "excerpt_chars": (int, str),
    "workers": int, "max_usd": float, "include_sensitive": bool, "offline": bool, "local_triage": bool,
}


def question_set(path: str, need_vault_questions: bool = False) -> dict:
    """Questions by name in file order; a layout without `questions` and `type` is brought up to date."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text("utf-8")) or {}
    questions = raw.get("questions") if isinstance(raw, dict) else None
    if questions is None:
        questions = {}
        for name, q in raw.items():
            if isinstance(q, dict) and "type" not in q:
                q = {"type": "choice" if "options" in q else "score" if "levels" in q else "noul"} | q
            questions[name] = q if isinstance(q, dict) else {"type": "noul", "instructions": str(q)}
    for name, q in questions.items():
        kind = q.get("type")
        size = {"choice": (len(q.get("options") or ()), MOST_OPTIONS), "score": (len(q.get("levels") or ()), MOST_LEVELS), "noul": (1, 1)}.get(kind)
        if size is None or not 1 <= size[0] <= size[1]:
            raise ValueError(f"question {name!r}: unknown type, or too many or no answers")
    if need_vault_questions and not {"bucket", "persist", *NOULS} <= set(questions):
        raise ValueError("a vault needs the questions bucket, persist and " + ", ".join(NOULS))
    return questions


def payloads(questions: dict) -> dict:
    """What is sent with every note."""
    return {name: {k: v for k, v in q.items() if k in ("type", "instructions", "options", "levels")} for name, q in questions.items()}


def fingerprint(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes().replace(b"\r\n", b"\n")).hexdigest()[:12]


def review_choice(questions: dict, asked: str | None = None, declared: str | None = None) -> str | None:
    """The choice that the review floor is held against: asked for, declared, or the first of the file."""
    return asked or declared or next((n for n, q in questions.items() if q.get("type") == "choice"), None)


def denylist(path: str) -> tuple[list[str], list[str]]:
    """Names to redact, and those too short to be used."""
    lines = [x.strip() for x in Path(path).read_text("utf-8").splitlines()]
    names = [x for x in lines if x and not x.startswith("#")]
    return [n for n in names if len(n) >= 3], [n for n in names if len(n) < 3]


def digest_of(names: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:12]


def profile(path: str) -> dict:
    """Settings of a TOML file; unknown keys and wrong types are refused, paths are relative to the file."""
    raw = tomllib.loads(Path(path).read_text("utf-8"))
    for key, value in raw.items():
        kind = PROFILE_KEYS.get(key)
        if kind is None:
            raise ValueError(f"{path}: unknown key {key!r}")
        kinds = kind if isinstance(kind, tuple) else (kind, int) if kind is float else (kind,)
        if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds):
            raise ValueError(f"{path}: {key!r} has the wrong type")
    here = Path(path).parent
    return {k: str(here / v) if k in ("vault", "journal", "denylist", "taxonomy") else v for k, v in raw.items()}


def response_vote(answer: dict) -> dict:
    """A typed answer as a vote; a missing or mistyped part is an error, never a default."""

    def need(where: dict, key: str, kind: type | tuple) -> object:
        value = where[key]
        if not isinstance(value, kind) or isinstance(value, bool):
            raise TypeError(f"{key}: {type(value).__name__}")
        return value

    answers = need(answer, "answers", dict)
    bucket, persist = need(answers, "bucket", dict), need(answers, "persist", dict)
    number = (int, float)
    out = {
        "bucket": need(bucket, "choice", str), "bucket_probabilities": {k: float(v) for k, v in need(bucket, "probabilities", dict).items()},
        "bucket_confidence": float(need(bucket, "confidence", number)), "persist": float(need(persist, "value", number)),
        "persist_confidence": float(need(persist, "confidence", number)), "model": need(answer, "model", str), "input_tokens": need(answer, "input_tokens", int),
    }
    return out | {n: float(need(need(answers, n, dict), "value", number)) for n in NOULS}


def payload_json(questions: dict) -> str:
    return json.dumps(payloads(questions), ensure_ascii=False)
