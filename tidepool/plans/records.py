"""Records from JSON lines to rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.redaction import HIGH_PRECISION
from tidepool.operators import journal as J
from tidepool.sources import records as S

from .shared import materialised

# Fixed values.
REVIEW_FLOOR, SECRET_THRESHOLD = 0.55, 0.7


def prepare(records: DataFrame, names: list[str] | None = None, cap: int = 16_000) -> DataFrame:
    """States with disposition (held: a credential, never judged) and same_as."""
    out = S.states(records, names, cap)
    held = F.arrays_overlap("hits", F.array(*map(F.lit, HIGH_PRECISION)))
    out = out.withColumn("disposition", F.when(held, "held").otherwise("fresh"))
    return S.reused(out.filter("disposition = 'fresh'")).unionByName(out.filter("disposition = 'held'"), allowMissingColumns=True)


def fixture_answers(questions: dict) -> dict:
    """The offline judge's answer to any question set: first options, middle levels, no flags."""
    picks = {n: next(iter(q["options"])) for n, q in questions.items() if q["type"] == "choice"}
    levels = {n: (len(q["levels"]) - 1) / 2 for n, q in questions.items() if q["type"] == "score"}
    return {"choices": picks, "scores": levels, "nouls": {n: 0.05 for n, q in questions.items() if q["type"] == "noul"}}


#: What a judge of records gives for each: options picked, scores, flags, the model and what was spent.
VOTE = (
    "struct<choices: map<string, struct<pick: string, confidence: double>>, scores: map<string, struct<value: double, confidence: double>>,"
    " nouls: map<string, double>, model: string, input_tokens: bigint>"
)


def fixture_judge(questions: dict, confidence: float = 0.8) -> Callable[[DataFrame], DataFrame]:
    """The offline judge: adds the same vote to every record."""
    answer = fixture_answers(questions)
    vote = {
        "choices": {n: {"pick": p, "confidence": confidence} for n, p in answer["choices"].items()}, "scores": {n: {"value": v, "confidence": confidence} for n, v in answer["scores"].items()},
        "nouls": answer["nouls"], "model": "fixture", "input_tokens": 0,
    }
    return lambda df: df.withColumn("vote", F.from_json(F.lit(json.dumps(vote)), VOTE))


def answered(fresh: DataFrame, judge: Callable[[DataFrame], DataFrame], order: str = "id", error_stop: bool = True) -> DataFrame:
    """fresh with vote, same_as and tried: equal states are judged once, by the first of them that gets an answer.

    Of every key the first record by `order` leads. If the judge fails on it, it keeps no answer and the
    next of its key leads in the next round, until one is answered or none is left; the others take
    that one's answer and say whose it is. A round asks one record of each open key, so records that
    many share cost no more than those that few do, and a paid judge sees none twice: every round is
    written before the next. error_stop: as soon as over a fifth of fifty or more records sent have
    failed, nothing more is sent; records not sent then have no row (tried is false) and stay to be
    resumed.
    """
    left = fresh.drop("same_as", "vote")
    columns = left.columns
    sent = failed = 0
    none = F.lit(None)
    out: list[DataFrame] = []
    while True:
        leaders = left.groupBy("key").agg(F.min(F.struct(F.col(order).alias("o"), "id")).alias("_l")).select(F.col("_l.id").alias("id"))
        asked = materialised(judge(left.join(leaders, "id", "left_semi")).select(*columns, "vote"), "record-votes")
        round_ = asked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vote").isNull()).alias("bad")).first()
        sent, failed = sent + round_["n"], failed + round_["bad"]
        out.append(asked.select(*columns, "vote", none.cast("string").alias("same_as"), F.lit(True).alias("tried")))
        good = asked.filter("vote IS NOT NULL").select("key", "vote", F.col("id").alias("same_as"))
        rest = left.join(asked.select("id"), "id", "left_anti")
        out.append(rest.join(good, "key").select(*columns, "vote", "same_as", F.lit(True).alias("tried")))
        if not round_["bad"]:
            break
        left = rest.join(asked.filter("vote IS NULL").select("key"), "key", "left_semi")
        left = materialised(left, "record-twins")
        if left.isEmpty():
            break
        if error_stop and sent >= J.ERROR_WINDOW and failed > J.ERROR_SHARE * sent:
            out.append(left.select(*columns, none.cast(VOTE).alias("vote"), none.cast("string").alias("same_as"), F.lit(False).alias("tried")))
            break
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def judged(prepared: DataFrame, questions: dict, review: str | None = None, judge: Callable[[DataFrame], DataFrame] | None = None, fingerprint: str = "", cached: DataFrame | None = None, error_stop: bool = True) -> DataFrame:
    """A row per record. Equal states are judged once and the others have that answer and say whose it is.

    judge: takes fresh records (id, state, key, ...) and adds `vote` (VOTE) or null where it failed;
    without one the offline judge answers. Held records are rows of the local judge and are never
    judged. A record on which the judge fails gets an error row and the next of its equals is asked, see
    answered(). cached: key, vote of earlier runs; records whose key it has are served and never sent.
    """
    fresh = prepared.filter("disposition = 'fresh'")
    served = None
    if cached is not None:
        kept = cached.filter("vote IS NOT NULL").groupBy("key").agg(F.max_by("vote", "vote.input_tokens").alias("vote"))
        served = fresh.drop("same_as").join(kept, "key")
        fresh = fresh.join(kept.select("key"), "key", "left_anti")
    columns = [c for c in prepared.columns if c != "same_as"]
    every = answered(fresh, judge or fixture_judge(questions), error_stop=error_stop).filter("tried").select(*columns, "vote", "same_as", F.lit(False).alias("cached"))
    nothing = F.lit(None)
    if served is not None:
        every = every.unionByName(served.select(*columns, "vote", nothing.cast("string").alias("same_as"), F.lit(True).alias("cached")))
    held = prepared.filter("disposition = 'held'").select(*columns, nothing.cast(VOTE).alias("vote"), nothing.cast("string").alias("same_as"), F.lit(False).alias("cached"))
    every = every.unionByName(held)
    v, local = F.col("vote"), F.col("disposition") == "held"
    lead = F.element_at(v["choices"], F.lit(review)) if review else F.lit(None).cast("struct<pick: string, confidence: double>")
    labels = F.array_intersect("hits", F.array(*map(F.lit, HIGH_PRECISION)))
    secret = F.coalesce(F.element_at(v["nouls"], F.lit("contains_secret")) >= SECRET_THRESHOLD, F.lit(False))
    unsure = F.coalesce(lead["confidence"] < REVIEW_FLOOR, F.lit(False))
    none = F.array().cast("array<string>")
    out = lambda action, reason, sent, suggested, triggers: F.struct(
        F.lit(action).alias("action"), reason.alias("reason"), F.lit(sent).alias("review"), suggested.alias("suggested"), triggers.alias("quarantine_triggers")
    )
    no_pick = F.lit(None).cast("string")
    acted = (
        F.when(local, out("quarantine", F.concat(F.lit("local redaction hit: "), F.array_join(labels, ", ")), False, no_pick, F.transform(labels, lambda h: F.concat(F.lit("local:"), h))))
        .when(v.isNull(), out("error", F.lit("no answer"), False, no_pick, none))
        .when(secret, out("quarantine", F.lit("contains_secret above threshold"), False, no_pick, F.array(F.lit("contains_secret"))))
        .when(unsure, out("label", F.lit("low confidence: routed to a person"), True, lead["pick"], none))
        .otherwise(out("label", F.lit("normal vote"), False, no_pick, none))
    )
    shared = F.col("same_as").isNotNull() | F.col("cached")
    return every.withColumn("_a", acted).select(
        F.when(~local & v.isNull(), "error").otherwise("vote").alias("kind"), F.when(local, "local").otherwise("judged").alias("judge"), "id", F.lit(review).alias("review_choice"),
        lead["pick"].alias("pick"), lead["confidence"].alias("confidence"), v["choices"].alias("choices"), v["scores"].alias("scores"), v["nouls"].alias("nouls"), "_a.*",
        F.col("hits").alias("redacted"), F.when(local, "local").otherwise(v["model"]).alias("model"), F.when(local | shared, F.lit(0)).otherwise(v["input_tokens"]).cast("long").alias("input_tokens"),
        "payload_chars", F.lit(fingerprint).alias("taxonomy"), "key", "cached", "same_as",
    )
