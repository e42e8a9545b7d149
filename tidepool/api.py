"""The two entries of the library: a vault and a set of records."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import bill as B
from tidepool.operators import decide as D
from tidepool.operators import journal as J
from tidepool.operators import plan as P
from tidepool.plans import records as RP
from tidepool.plans import runner, scan
from tidepool.sources import notes, records, settings, sinks


class OverBudget(ValueError):
    """The estimate is above the limit; nothing was sent."""


def scan_vault(
    spark: SparkSession,
    vault: str,
    judge: Callable[[DataFrame], DataFrame] | None = None,
    questions: str | None = None,
    include_sensitive: bool = False,
    sensitive_parts: tuple[str, ...] = T.SENSITIVE_NAMES,
    denylist: list[str] | None = None,
    model: str = "fixture",
    excerpt_chars: int = T.EXCERPT_CAP,
    local_triage: bool = True,
    journal: str | None = None,
    resume: str | None = None,
    max_usd: float = 2.0,
    over_budget: bool = False,
    git_unsafe_below: float | None = None,
    workers: int = 16,
    today: str = scan.TODAY,
) -> tuple[DataFrame, dict]:
    """Rows of a vault and how the run ended.

    judge: takes fresh notes (rel, state) and adds `vote`; without one, keywords vote and nothing is
    spent. Only a judged run can be over its limit, and only one with a journal is run in waves.
    """
    asked = settings.question_set(questions, need_vault_questions=True) if questions else settings.DEFAULT_QUESTIONS
    planned = notes.read_notes(spark, vault, sensitive_parts, include_sensitive)
    cached, known = None, None
    if not include_sensitive:
        P.refuse_root(vault, vault, sensitive_parts)
    if journal and resume:
        runs = spark.read.json(f"{journal}/runs")
        chain = J.chain(runs, resume) if "resumed_from" in runs.columns else [resume]
        at = spark.createDataFrame(list(enumerate(chain)), "chain_pos int, run_id string")
        held = sinks.read_rows(spark, journal, in_flight=True).join(F.broadcast(at), "run_id")
        # rows have no line: within a run every path has one, so the path settles which vote of a key is served
        cached = J.cache(held.withColumn("line", F.col("path")))
        known = {r[0] for r in cached.select("model").distinct().collect() if r[0]}  # a row a model
    digest = settings.fingerprint(questions) if questions else ""
    prepared = scan.prepare(planned, today, denylist, excerpt_chars, cached, local_triage, vault.endswith(".md"), digest, model)
    if judge and not over_budget:
        estimate = B.bill(prepared, D.question_chars(settings.payloads(asked)), max_usd).first()
        if estimate["over_budget"]:
            raise OverBudget(B.refusal(estimate.asDict(), max_usd))
    decide = lambda df: scan.decided(df, judge, git_unsafe_below, D.question_chars(settings.payloads(asked)), digest)
    if not journal:
        return decide(prepared).unionByName(scan.skipped(planned, prepared), allowMissingColumns=True), {"reason": "done"}
    run_id = uuid.uuid4().hex[:12]
    end = runner.run(prepared, decide, journal, run_id, workers * 1000, max_usd if judge and not over_budget else None, known)
    sinks.append_rows(scan.skipped(planned, prepared), journal, run_id)
    header = {"taxonomy": digest, "state_version": D.STATE_VERSION, "model_requested": model, "excerpt_cap": T.effective_cap(excerpt_chars), "include_sensitive": include_sensitive}
    sinks.append_run(spark, journal, end | header | {"started": today, "resumed_from": resume or ""})
    return sinks.read_rows(spark, journal, run_id), end


def judge_records(spark: SparkSession, path: str, questions: str, denylist: list[str] | None = None, excerpt_chars: int = 16_000, review: str | None = None) -> DataFrame:
    """Rows of a JSON-lines file, judged offline: one answer for each distinct state."""
    asked = settings.question_set(questions)
    read = records.read_records(spark, path, denylist)
    return RP.judged(RP.prepare(read, denylist, excerpt_chars), asked, settings.review_choice(asked, review))
