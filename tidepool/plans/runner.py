"""Runs in waves: a spending limit, error stops and a journal that can be resumed.

Notes are dealt in plan order. Each wave is judged into a staging folder, cut at the row where the run
has to stop, and committed once; only then the next is begun. A driver or executors that are lost repeat
one wave at most, and half-written waves are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import bill as B
from tidepool.operators import journal as J
from tidepool.sources import sinks

from .shared import drop, materialised


def was_sent() -> Column:
    """Whether a row went to the judge in this run: what is served from the cache or decided locally did not."""
    fresh = (F.col("judge") != "local") & ~F.coalesce("cached", F.lit(False))
    return F.coalesce((F.col("kind") == "error") | ((F.col("kind") == "vote") & fresh), F.lit(False))


def stops(rows: DataFrame, order: str = sinks.ORDER, max_usd: float | None = None, known_models: set[str] | None = None, before: tuple[int, int, int] = (0, 0, 0), buckets: int = 64) -> DataFrame:
    """rows with sent, spent (dollars up to and with the row) and stop: why a run ends with this row, null if it goes on.

    rows: kind, judge, cached, model, input_tokens, error. before: rows sent, errors and tokens of
    earlier waves. Reasons, the first that holds: 402; error-rate, at an error with which over a fifth of
    fifty or more sent rows failed; meter, at a sent row that takes the cost above max_usd; model-drift,
    at a vote of a model that the cache has none of.
    """
    sent, failed = was_sent(), F.col("kind") == "error"
    tokens = F.when(sent, F.coalesce("input_tokens", F.lit(0))).otherwise(F.lit(0)).cast("long")
    df = rows.withColumns({"sent": sent, "_one": sent.cast("long"), "_bad": (sent & failed).cast("long"), "_tokens": tokens})
    df = B.running_totals(df, order, {"_one": "_n", "_bad": "_e", "_tokens": "_t"}, buckets)
    n, e, t = (F.col(c) + F.lit(b) for c, b in zip(("_n", "_e", "_t"), before, strict=True))
    spent = T.usd_for(t)
    reason = F.when(failed & F.coalesce(J.out_of_credits(F.col("error")), F.lit(False)), "402").when(failed & (n >= J.ERROR_WINDOW) & (e > J.ERROR_SHARE * n), "error-rate")
    if max_usd is not None:
        reason = reason.when(F.col("sent") & (F.col("_tokens") > 0) & (spent > max_usd), "meter")
    if known_models:
        reason = reason.when(F.col("sent") & ~failed & F.col("model").isNotNull() & ~F.col("model").isin(*known_models), "model-drift")
    return df.withColumns({"spent": spent, "stop": reason}).drop("_one", "_bad", "_n", "_e", "_t").withColumnRenamed("_tokens", "sent_tokens")


def first_stop(rated: DataFrame, order: str = sinks.ORDER) -> DataFrame:
    """cut, reason: the first row at which the run ends; nulls if it doesn't."""
    return rated.filter("stop IS NOT NULL").agg(F.min(F.struct(order, "stop")).alias("f")).select(F.col(f"f.{order}").alias("cut"), F.col("f.stop").alias("reason"))


def kept(rows: DataFrame, order: str = sinks.ORDER, max_usd: float | None = None, known_models: set[str] | None = None) -> DataFrame:
    """The rows of a run up to and with the one that ends it, with sent and spent."""
    rated = stops(rows, order, max_usd, known_models)
    end = F.broadcast(first_stop(rated, order))  # one row
    return rated.join(end, F.col("cut").isNull() | (F.col(order) <= F.col("cut")), "left_semi").drop("stop", "sent_tokens")


def dealt(prepared: DataFrame, size: int) -> tuple[DataFrame, int]:
    """prepared in waves of about `size` notes in plan order, as a table that is read a wave at a time, and their number."""
    n = max(1, -(-prepared.count() // size))
    ranged = prepared.repartitionByRange(n, sinks.ORDER).withColumn("wave", F.spark_partition_id())
    return materialised(ranged, "waves", by="wave"), n


def run(prepared: DataFrame, decide: Callable[[DataFrame], DataFrame], journal: str, run_id: str, wave_size: int = 10_000, max_usd: float | None = None, known_models: set[str] | None = None) -> dict:
    """Judge notes wave by wave; gives the footer: rows, errors, tokens, in_flight and why it stopped.

    prepared: rel, plan_ord and what decide needs. A run that was begun under run_id goes on after its
    last committed wave, with that wave's sums; what it has rows of is not judged again.
    """
    spark = prepared.sparkSession
    done = sorted((r.asDict() for r in sinks.commits(spark, journal, run_id).filter("wave >= 0").collect()), key=lambda c: c["wave"])  # a row a wave
    total = {k: sum(c[k] for c in done) for k in ("n_rows", "n_sent", "n_errors", "n_tokens", "n_in_flight")}
    reason = next((c["reason"] for c in done if c["reason"]), None)
    if reason is None:
        rest = prepared.drop("body")
        if done:
            rest = rest.join(sinks.read_rows(spark, journal, run_id).select(F.col("path").alias("rel")), "rel", "left_anti")
        waves, n = dealt(rest, wave_size)
        start = done[-1]["wave"] + 1 if done else 0
        for w in range(n):
            attempt = sinks.stage_wave(decide(waves.filter(F.col("wave") == w).drop("wave")), journal, run_id, start + w)
            rows = sinks.read_wave(spark, journal, run_id, start + w, attempt)
            none = {"error": "string", "judge": "string", "cached": "boolean", "model": "string", "input_tokens": "long", sinks.ORDER: "string"}
            rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in rows.columns})
            rated = stops(rows, sinks.ORDER, max_usd, known_models, (total["n_sent"], total["n_errors"], total["n_tokens"]), buckets=1)
            end = first_stop(rated).first()
            inside = F.lit(True) if end["cut"] is None else F.col(sinks.ORDER) <= end["cut"]
            sums = rated.agg(
                F.count_if(inside).alias("n_rows"), F.count_if(inside & F.col("sent")).alias("n_sent"), F.count_if(inside & F.col("sent") & (F.col("kind") == "error")).alias("n_errors"),
                F.coalesce(F.sum(F.when(inside, F.col("sent_tokens"))), F.lit(0)).alias("n_tokens"), F.count_if(~inside & F.col("sent")).alias("n_in_flight"),
            ).first()
            stands = sinks.commit_wave(spark, journal, {"run_id": run_id, "wave": start + w, "attempt": attempt, "cut": end["cut"], "reason": end["reason"]} | sums.asDict())
            total = {k: v + stands[k] for k, v in total.items()}
            if reason := stands["reason"]:
                break
        drop(waves)
    return {
        "run_id": run_id, "rows": total["n_rows"], "errors": total["n_errors"], "tokens": total["n_tokens"], "in_flight": total["n_in_flight"],
        "reason": reason or "done", "finished": reason is None,
    }
