"""What is sent, what needs no vote, and what follows from a vote."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidepool.functions import redaction as R
from tidepool.functions import text as T

# Fixed values.
BUCKETS = ("durable_memory", "project_decision", "code_note", "reference", "log_entry", "ephemeral", "junk", "needs_review")
NOULS = ("contains_secret", "looks_like_duplicate", "records_a_decision", "is_actionable", "safe_to_leave_in_git")
REVIEW_FLOOR, SECRET_THRESHOLD, JUNK_PERSIST = 0.55, 0.7, 0.5
STATE_VERSION = 1
OWN_KEY = "tidepool"
#: The keyword judge: first rule that fits wins. Bucket, probability of a secret, words.
KEYWORDS = (
    ("needs_review", 0.97, ("[key]", "secret", "sk-", "akia")),
    ("ephemeral", 0.02, ("tired", "coffee", "scratch", "todo later", "asdf")),
    ("junk", 0.01, ("lorem ipsum",)),
    ("log_entry", 0.03, ("nightly", "daily run", "run report", "digest")),
    ("project_decision", 0.03, ("we decided", "decision:")),
    ("code_note", 0.02, ("```", "benchmark", "pytest")),
    ("reference", 0.02, ("https://", "see also")),
)
DUPLICATE = "duplicate"
PERSIST = {"junk": 0.1, "ephemeral": 0.6, "needs_review": 1.1, "log_entry": 0.9, "code_note": 1.7, "project_decision": 1.9, "durable_memory": 2.0, "reference": 1.4}


def states(indexed: DataFrame, titles: DataFrame, names: list[str] | None = None, cap: int = T.EXCERPT_CAP, question_digest: str = "", model: str = "fixture") -> DataFrame:
    """indexed with state (all that may leave), own_hits, hits, truncated, payload_chars and key.

    Everything is redacted before anything is cut, every text on its own: path segments, keys and
    aliases too. What other notes' titles held is reported in hits and never moves this note.
    """
    df = indexed.join(titles, "rel", "left").withColumn("other_note_titles", F.coalesce("other_note_titles", F.array().cast("array<string>")))
    keys = F.filter(F.coalesce("keys", F.array().cast("array<string>")), lambda k: k != OWN_KEY)
    fields = {"_body": F.col("body"), "_title": F.col("title"), "_path": T.path_parts("rel"), "_keys": keys, "_aliases": F.col("aliases")}
    df = R.redacted_together(df, fields, names, "_own")
    parts = lambda c: F.filter(c, lambda x: x != "")
    own = F.col("_own")
    lent = F.array_distinct(F.flatten(F.transform(F.filter("other_note_titles", lambda t: F.contains(t, F.lit("["))), lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\[([A-Z_]+)\]"), F.lit(1)), lambda x: x))))
    from .index import graph_state

    state = F.struct(
        parts(F.col("_aliases")).alias("aliases"),
        T.excerpt(F.col("_body"), cap).alias("excerpt"),
        F.array_sort(parts(F.col("_keys"))).alias("frontmatter_keys"),
        graph_state().alias("graph"),
        F.col("other_note_titles"),
        F.array_join(parts(F.col("_path")), "/").alias("path"),
        F.col("_title").alias("title"),
    )
    drop = [c for c in df.columns if c.startswith("_")]
    df = df.withColumns({"own_hits": own, "hits": F.array_sort(F.array_union(own, lent)), "truncated": T.truncated(F.col("_body"), cap)})
    df = df.select("*", F.explode(F.array(state)).alias("state")).drop(*drop)
    wire = canonical(F.col("state"))
    return df.withColumns({"payload_chars": F.char_length(wire), "key": cache_key(wire, question_digest, model)})


def canonical(state: Column) -> Column:
    """JSON with sorted keys and nulls kept; the struct's fields are declared in that order."""
    return F.to_json(state, {"ignoreNullFields": "false"})


def cache_key(wire: Column, question_digest: str, model: str) -> Column:
    return F.left(F.sha2(F.concat_ws("\n", wire, F.lit(question_digest), F.lit(str(STATE_VERSION)), F.lit(model)), 256), F.lit(24))


def _vote(bucket: Column | str, confidence: float, top: float, persist: Column, persist_confidence: float, nouls: dict, model: str) -> Column:
    name = F.lit(bucket) if isinstance(bucket, str) else bucket
    return F.struct(
        name.alias("bucket"), F.create_map(name, F.lit(top)).alias("bucket_probabilities"), F.lit(confidence).alias("bucket_confidence"),
        persist.cast("double").alias("persist"), F.lit(persist_confidence).alias("persist_confidence"),
        *[(nouls[n] if isinstance(nouls[n], Column) else F.lit(float(nouls[n]))).cast("double").alias(n) for n in NOULS],
        F.lit(model).alias("model"), F.lit(0).cast("long").alias("input_tokens"),
    )


def local_rule() -> Column:
    """secret, empty, duplicate, or null: what is decided without a vote; the first that fits."""
    return F.when(R.acts_alone(F.col("own_hits")), "secret").when(F.col("empty"), "empty").when(F.col("exact_duplicate_of").isNotNull(), "duplicate")


def local_vote(rule: Column) -> Column:
    """The vote that a local rule stands for, of full confidence."""
    secret, duplicate = rule == "secret", rule == "duplicate"
    nouls = {
        "contains_secret": secret.cast("double"), "looks_like_duplicate": duplicate.cast("double"), "records_a_decision": 0.0,
        "is_actionable": 0.0, "safe_to_leave_in_git": (~secret).cast("double"),
    }
    return F.when(rule.isNotNull(), _vote(F.when(secret, "needs_review").otherwise("junk"), 1.0, 1.0, secret.cast("double"), 1.0, nouls, "local"))


def keyword_vote(title: Column, excerpt: Column) -> Column:
    """The offline judge: fixed scores by the first keyword rule that fits; each text is lowered and searched once."""
    return T.let(T.let(_searched(title, excerpt), lambda blob: _found(blob, excerpt)), _keyword_scores)


def keyword_voted(df: DataFrame, title: Column, excerpt: Column) -> DataFrame:
    """df with `vote`, the same; each step is a column of its own, which compiled code searches faster than a lambda's text.

    One pass in Arrow batches tells which texts hold any of the words; no other is lowered and searched for each.
    """
    df = df.withColumn("_any", _some_keyword(F.concat(title, F.lit(" "), excerpt)))
    df = df.select("*", F.explode(F.array(F.when(F.col("_any"), _searched(title, excerpt)).otherwise(""))).alias("_blob"))
    df = df.select("*", F.explode(F.array(_found(F.col("_blob"), excerpt))).alias("_found"))
    return df.select("*", F.explode(F.array(_keyword_scores(F.col("_found")))).alias("vote")).drop("_any", "_blob", "_found")


#: What a text must hold for a keyword rule to fit, or to speak of a duplicate.
SOME_KEYWORD = R.any_of((), [DUPLICATE, *(w for _, _, words in KEYWORDS for w in words)])


@F.arrow_udf(BooleanType())
def _some_keyword(texts: pa.Array) -> pa.Array:
    return pc.match_substring_regex(texts, SOME_KEYWORD)


def _searched(title: Column, excerpt: Column) -> Column:
    return F.concat(F.lower(title), F.lit(" "), F.lower(excerpt))


def _found(blob: Column, excerpt: Column) -> Column:
    """struct<bucket, duplicate> of a text in lower case."""
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(blob, F.lit(w)) for w in words])
    bucket = F
    for name, _, words in KEYWORDS:
        fits = has(words)
        if name == "junk":
            fits = fits | (F.ltrim(excerpt, F.lit(T.WHITE)) == "")
        if name == "log_entry":
            fits = fits & has(("scan", "report", "digest"))
        bucket = bucket.when(fits, name)
    return F.struct(bucket.otherwise("durable_memory").alias("bucket"), F.contains(blob, F.lit(DUPLICATE)).alias("duplicate"))


def _keyword_scores(x: Column) -> Column:
    bucket, secret, persist = x["bucket"], F.lit(0.04), F.lit(None)
    for name, p, _ in KEYWORDS:
        secret = F.when(bucket == name, p).otherwise(secret)
    for name, value in PERSIST.items():
        persist = F.when(bucket == name, value).otherwise(persist)
    decision = bucket == "project_decision"
    nouls = {
        "contains_secret": secret,
        "looks_like_duplicate": F.when(x["duplicate"], 0.12).otherwise(0.05),
        "records_a_decision": F.when(decision, 0.88).otherwise(0.2),
        "is_actionable": F.when(decision, 0.7).otherwise(0.3),
        "safe_to_leave_in_git": F.when(secret > 0.5, 0.1).otherwise(0.8),
    }
    return _vote(bucket, 0.8, 0.86, persist, 0.75, nouls, "fixture")


def action(vote: Column, own_hits: Column, git_unsafe: float | None = None) -> Column:
    """struct<action, reason, review, triggers>. Local credentials act first and on their own."""
    local = F.array_intersect(own_hits, F.array(*map(F.lit, R.HIGH_PRECISION)))
    none = F.array().cast("array<string>")
    out = lambda name, reason, review=False, triggers=none: F.struct(
        F.lit(name).alias("action"), reason.alias("reason"), F.lit(review).alias("review"), triggers.alias("triggers")
    )
    held = F.when(
        F.size(local) > 0,
        out("quarantine", F.concat(F.lit("local redaction hit: "), F.array_join(local, ", ")), False, F.transform(local, lambda h: F.concat(F.lit("local:"), h))),
    ).when(vote["contains_secret"] >= SECRET_THRESHOLD, out("quarantine", F.lit("contains_secret above threshold"), False, F.array(F.lit("contains_secret"))))
    if git_unsafe is not None:
        reason = F.lit(f"safe_to_leave_in_git at or below {git_unsafe}")
        held = held.when(vote["safe_to_leave_in_git"] <= git_unsafe, out("quarantine", reason, False, F.array(F.lit("safe_to_leave_in_git"))))
    return (
        held.when((vote["bucket"] == "needs_review") | (vote["bucket_confidence"] < REVIEW_FLOOR), out("frontmatter", F.lit("low confidence or explicit needs_review"), True))
        .when((vote["bucket"] == "junk") & (vote["persist"] < JUNK_PERSIST), out("frontmatter", F.lit("junk, low persist: marked only, never deleted")))
        .otherwise(out("frontmatter", F.lit("normal vote")))
    )


def local_action(rule: Column, own_hits: Column) -> Column:
    """The action of a local rule; a credential takes the way of a vote."""
    none = F.array().cast("array<string>")
    said = F.when(rule == "empty", F.lit("empty body or headings only: decided locally")).otherwise(
        F.concat(F.lit("exact duplicate of "), F.col("exact_duplicate_of"), F.lit(": decided locally"))
    )
    plain = F.struct(F.lit("frontmatter").alias("action"), said.alias("reason"), F.lit(False).alias("review"), none.alias("triggers"))
    return F.when(rule == "secret", action(local_vote(rule), own_hits)).when(rule.isNotNull(), plain)


def disposition(cached: Column, rule: Column) -> Column:
    """undecodable, error, locked, local, cached or fresh: what happens to a note, the first that fits."""
    return (
        F.when(F.col("status") != "scan", "skip").when(F.col("undecodable").isNotNull(), "undecodable").when(F.col("locked"), "locked")
        .when(rule.isNotNull(), "local").when(cached, "cached").otherwise("fresh")
    )


def stored_vote(row: Column) -> Column:
    """The vote that a row of an earlier run stands for; null where the row has none."""
    kept = [row[n].alias(n) for n in ("bucket", "bucket_probabilities")]
    return F.when(row.isNotNull(), F.struct(*kept, row["confidence"].alias("bucket_confidence"), row["persist"].alias("persist"), *[row[n].alias(n) for n in NOULS], row["model"].alias("model"), row["input_tokens"].alias("input_tokens")))


def rows(prepared: DataFrame, vote: Column, acted: Column, judge: Column, cached: bool = False, question_size: int = 0, taxonomy: str = "") -> DataFrame:
    """A result row per judged, cached or locally decided note; figures to three places.

    What identifies a note (path, hits, truncation, findings) is always its own, a cached vote's too.
    """
    r3 = lambda c: F.round(c, 3)
    p = vote["bucket_probabilities"]
    return prepared.select(
        F.lit("vote").alias("kind"), judge.alias("judge"), F.col("rel").alias("path"), "plan_ord", "folder", vote["bucket"].alias("bucket"),
        r3(vote["persist"]).alias("persist"), r3(vote["bucket_confidence"]).alias("confidence"),
        F.transform_values(p, lambda _, v: F.round(v, 3)).alias("bucket_probabilities"), T.margin(p).alias("bucket_margin"),
        *[r3(vote[n]).alias(n) for n in NOULS], "exact_duplicate_of", acted["action"].alias("action"), acted["reason"].alias("reason"),
        acted["triggers"].alias("quarantine_triggers"), F.col("hits").alias("redacted"), F.col("own_hits").alias("redacted_own"),
        F.when(acted["review"], vote["bucket"]).alias("suggested_bucket"),
        F.when(F.col("header_error").isNotNull(), F.array(F.lit("unreadable_frontmatter"))).otherwise(F.array().cast("array<string>")).alias("findings"),
        "age_source", "state.graph", "truncated", F.char_length("state.excerpt").alias("excerpt_chars"), vote["model"].alias("model"),
        vote["input_tokens"].alias("input_tokens"), "payload_chars", "key", F.lit(cached).alias("cached"), F.lit(question_size).alias("question_chars"), F.lit(taxonomy).alias("taxonomy"),
    )


def question_chars(payloads: dict) -> int:
    """Characters that the questions add to every note sent."""
    return len(json.dumps(payloads, sort_keys=True, ensure_ascii=False, separators=(",", ":")))
