"""Runs and their rows: latest rows, resuming, what changed between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.plans.shared import materialised

from .bill import running_totals

FINISHED = ("meter", "402", "error-rate", "interrupted")
# A 402 counts next to a status word or to what is to be paid.
OUT_OF_CREDITS = r"(?i)\b(?:http|status|error)\b[^\n]{0,24}?(?<![0-9])402(?![0-9])|(?<![0-9])402(?![0-9])[^\n]{0,24}?\b(?:payment|credits)"
ERROR_WINDOW, ERROR_SHARE = 50, 0.2


def latest(rows: DataFrame, key: str = "path", order: str = "line") -> DataFrame:
    """The last row of each key. An aggregate, not a window: rows of one key meet already reduced."""
    names = rows.columns
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_r"))
    return best.select(*[F.col(f"_r.`{n}`").alias(n) for n in names])


def chain(runs: DataFrame, name: str, most: int = 100) -> list[str]:
    """The run and those it resumed, newest first; stops at a run seen before. One small lookup a step."""
    out: list[str] = []
    while name and name not in out and len(out) < most:
        found = runs.filter(F.col("run_id") == name).select("resumed_from").first()
        if found is None:
            break
        out.append(name)
        name = found[0]
    return out


def chain_positions(runs: DataFrame, most: int = 100) -> DataFrame:
    """run_id, at, ancestor for every run: itself and the runs it resumed, newest first.

    Only runs that there are count; a chain ends at a run it has seen before, and after a hundred. A
    round a place: chains that go on meet the runs once more, and each round is written before the next.
    A recursive query would stop at the session's limit of rows.
    """
    links = materialised(runs.select("run_id", F.col("resumed_from").alias("next")), "runs")
    known = links.withColumnRenamed("run_id", "ancestor")
    step = links.select("run_id", F.lit(0).alias("at"), F.col("run_id").alias("ancestor"), "next", F.array("run_id").alias("seen"))
    out = step.select("run_id", "at", "ancestor")
    for at in range(1, most):
        further = step.filter("next IS NOT NULL").select("run_id", F.col("next").alias("ancestor"), "seen").join(known, "ancestor").filter(~F.array_contains("seen", F.col("ancestor")))
        step = materialised(further.select("run_id", F.lit(at).alias("at"), "ancestor", "next", F.array_append("seen", F.col("ancestor")).alias("seen")), "chain")
        if step.isEmpty():
            break
        out = out.unionByName(step.select("run_id", "at", "ancestor"))
    return out


def to_resume(runs: DataFrame) -> DataFrame:
    """The newest unfinished run that no other resumed; if there is none, the newest run."""
    taken = runs.filter("resumed_from IS NOT NULL").select(F.col("resumed_from").alias("run_id"))
    free = runs.join(taken, "run_id", "left_semi").select("run_id").withColumn("_taken", F.lit(True))
    rated = runs.join(free, "run_id", "left").withColumn("_open", F.coalesce(F.col("finished") == F.lit(False), F.lit(True)) & F.col("_taken").isNull())
    return rated.orderBy(F.desc("_open"), F.desc("started"), F.desc("run_id")).limit(1).drop("_open", "_taken")


def cache(rows: DataFrame) -> DataFrame:
    """Newest vote per key over a chain of runs (chain_pos 0 is the newest); local decisions are never served."""
    votes = rows.filter("kind = 'vote' AND judge <> 'local' AND key IS NOT NULL").withColumn("_o", F.struct((-F.col("chain_pos")).alias("c"), "line"))
    return latest(votes, "key", "_o").drop("_o")


def served(prepared: DataFrame, cached: DataFrame) -> DataFrame:
    """prepared with what the cache holds of its key; path and other facts stay the note's own."""
    kept = cached.select("key", F.struct(*[c for c in cached.columns if c != "key"]).alias("cached_row"))
    return prepared.join(kept, "key", "left").withColumn("is_cached", F.col("cached_row").isNotNull())


def to_retry(rows: DataFrame) -> DataFrame:
    """Paths whose latest row is an error."""
    return latest(rows).filter("kind = 'error'").select("path")


def out_of_credits(message: Column) -> Column:
    """Whether a message says that the account has no credits left."""
    told = F.lower(message)
    return F.regexp_like(message, F.lit(OUT_OF_CREDITS)) | (F.contains(told, F.lit("no available")) & F.contains(told, F.lit("credits")))


def error_stop(rows: DataFrame, order: str = "done_ord") -> DataFrame:
    """at: the first place where over a fifth of fifty or more sent notes had failed; null if none."""
    sent = rows.filter("kind IN ('vote', 'error')").select(order, F.lit(1).alias("one"), (F.col("kind") == "error").cast("int").alias("bad"))
    running = running_totals(sent, order, {"one": "n", "bad": "e"})
    return running.filter((F.col("n") >= ERROR_WINDOW) & (F.col("e") > ERROR_SHARE * F.col("n"))).agg(F.min(order).alias("at"))


def in_review(prefix: str) -> Column:
    c = lambda n: F.col(f"{prefix}.{n}")
    return (c("kind") == "vote") & c("suggested_bucket").isNotNull()


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """category, path, detail: every change between the latest rows of two runs.

    Both sides: path, kind, judge, bucket, confidence, action, exact_duplicate_of, suggested_bucket,
    truncated, findings, skipped. One full outer join on path makes all categories.
    """
    fields = ["path", "kind", "judge", "bucket", "confidence", "action", "exact_duplicate_of", "suggested_bucket", "truncated", "findings", "skipped"]
    a = before.select(F.struct(*fields).alias("a"), F.col("path").alias("pa"))
    b = after.select(F.struct(*fields).alias("b"), F.col("path").alias("pb"))
    j = a.join(b, F.col("pa") == F.col("pb"), "full_outer").withColumn("path", F.coalesce("pb", "pa"))
    both, new, gone = F.col("pa").isNotNull() & F.col("pb").isNotNull(), F.col("pa").isNull(), F.col("pb").isNull()
    votes = both & (F.col("a.kind") == "vote") & (F.col("b.kind") == "vote")
    n = lambda side: F.coalesce(F.size(f"{side}.findings"), F.lit(0))
    q = lambda side: F.coalesce(F.col(f"{side}.action") == "quarantine", F.lit(False))
    locked = lambda side: F.coalesce(F.col(f"{side}.skipped") == "locked", F.lit(False))
    rev = lambda side: F.coalesce(in_review(side), F.lit(False))
    cut = lambda side: F.coalesce(F.col(f"{side}.truncated"), F.lit(False))
    pointer = F.col("b.exact_duplicate_of")
    moved = {
        "bucket_changed": votes & (F.col("a.bucket") != F.col("b.bucket")),
        "into_review": (votes & rev("b") & ~rev("a")) | (new & rev("b") & ~q("b")),
        "out_of_review": votes & rev("a") & ~rev("b"),
        "quarantined": (both | new) & q("b") & ~q("a"),
        "released": both & q("a") & ~q("b"),
        "new_duplicates": (new & pointer.isNotNull()) | (votes & pointer.isNotNull() & ~pointer.eqNullSafe(F.col("a.exact_duplicate_of"))),
        "crossed_cap": votes & (cut("a") != cut("b")),
        "findings_fixed": both & (n("a") > 0) & (n("b") == 0),
        "findings_new": both & (n("a") == 0) & (n("b") > 0),
        "locked_since": (both | new) & locked("b") & ~locked("a"),
        "unlocked_since": both & locked("a") & ~locked("b"),
    }
    error = (both | new) & (F.col("b.kind") == "error")
    fired = [F.when(cond, F.lit(name)) for name, cond in moved.items()]
    names = F.filter(F.array(*fired, F.when(new, "new"), F.when(gone, "gone"), F.when(error, "errors_after")), lambda x: x.isNotNull())
    still = both & ~F.exists(F.array(*[F.coalesce(c, F.lit(False)) for c in moved.values()]), lambda x: x)
    names = F.when(still, F.concat(names, F.array(F.lit("unchanged")))).otherwise(names)
    # a new note has an entry for each of its findings
    each = F.when(new & (n("b") > 0), F.transform("b.findings", lambda _: F.lit("findings_new"))).otherwise(F.array().cast("array<string>"))
    detail = F.when(votes, F.concat_ws(" -> ", F.col("a.bucket"), F.col("b.bucket")))
    return j.select(F.explode(F.concat(names, each)).alias("category"), "path", detail.alias("detail"))


def findings_counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """finding, before, after."""
    side = lambda df, n: df.select(F.explode("findings").alias("finding"), F.lit(n).alias("side"))
    both = side(before, 0).unionByName(side(after, 1))
    return both.groupBy("finding").agg(F.count_if(F.col("side") == 0).alias("before"), F.count_if(F.col("side") == 1).alias("after"))


def header_changes(runs: DataFrame, one: str, two: str, fields: tuple[str, ...] = ("taxonomy", "state_version", "model_requested", "excerpt_cap", "denylist", "include_sensitive", "sensitive_parts")) -> DataFrame:
    """field, before, after: what two runs were started with and differ in."""
    wide = runs.filter(F.col("run_id").isin(one, two)).select("run_id", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", "value"))
    pair = wide.groupBy("field").agg(F.max(F.when(F.col("run_id") == one, F.col("value"))).alias("before"), F.max(F.when(F.col("run_id") == two, F.col("value"))).alias("after"))
    return pair.filter(~F.col("before").eqNullSafe(F.col("after")))


def kinds(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
