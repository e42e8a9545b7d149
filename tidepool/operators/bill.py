"""What a run will send and cost, and what it did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions import text as T


def bill(prepared: DataFrame, question_chars: int, max_usd: float = 2.0) -> DataFrame:
    """One row: notes by disposition, characters, tokens and dollars as a range, and whether that is over the limit.

    prepared: disposition, payload_chars, header_error, age_source. Headers that cannot be read and
    where ages come from are counted over all notes. Everything is summed in one pass.
    """
    fresh = F.col("disposition") == "fresh"
    kinds = ("fresh", "cached", "local", "locked", "skip", "undecodable")
    out = prepared.agg(
        *[F.count_if(F.col("disposition") == k).alias(f"n_{k}") for k in kinds],
        F.coalesce(F.sum(F.when(fresh, F.col("payload_chars"))), F.lit(0)).alias("note_chars"),
        F.count("header_error").alias("n_unreadable"),
        *[F.count_if(F.col("age_source") == source).alias(name) for source, name in (("mtime", "n_age_from_mtime"), ("frontmatter", "n_dated"), ("stamp", "n_stamp_dated"))],
    )
    out = out.withColumn("chars", F.col("note_chars") + question_chars * F.col("n_fresh"))
    low, high = T.tokens_for("chars", T.CHARS_PER_TOKEN[1]), T.tokens_for("chars", T.CHARS_PER_TOKEN[0])
    out = out.withColumns({"tokens_low": low, "tokens_high": high})
    out = out.withColumns({"usd_low": T.usd_for("tokens_low"), "usd_high": T.usd_for("tokens_high")})
    return out.withColumn("over_budget", F.col("usd_high") > max_usd)


def largest_folders(prepared: DataFrame, n: int = 5) -> DataFrame:
    """folder, chars, notes: the folders that send most."""
    sums = prepared.filter("disposition = 'fresh'").groupBy("folder").agg(F.sum("payload_chars").alias("chars"), F.count(F.lit(1)).alias("notes"))
    return sums.orderBy(F.desc("chars"), "folder").limit(n)


def records_bill(prepared: DataFrame) -> DataFrame:
    """Records to send: of equal keys only the first by id is sent, the others reuse its answer."""
    first = prepared.filter("disposition = 'fresh'").groupBy("key").agg(F.min(F.struct("id", "payload_chars")).alias("f"), F.count(F.lit(1)).alias("n"))
    return first.agg(F.count(F.lit(1)).alias("to_send"), F.coalesce(F.sum("f.payload_chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("reused"))


def range_starts(rows: DataFrame, order: str, buckets: int) -> list:
    """Where all but the first of so many ranges of about equal size begin."""
    if buckets < 2:
        return []
    if dict(rows.dtypes)[order] != "string":
        return sorted(set(rows.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001)))
    first = rows.select(order).repartitionByRange(buckets, order).groupBy(F.spark_partition_id()).agg(F.min(order).alias("f"))
    return sorted(r["f"] for r in first.collect() if r["f"] is not None)[1:]  # as many as buckets


def running_totals(rows: DataFrame, order: str, columns: dict[str, str], buckets: int = 64) -> DataFrame:
    """rows with the sums of columns up to and with each row, under new names.

    Sums run within ranges of the order, a number or a text, and the ranges' totals, as many as buckets,
    are added from a broadcast table, so no task sees all rows. Rows that share a place share a range.
    """
    starts = range_starts(rows, order, buckets)
    kind = float if dict(rows.dtypes)[order] != "string" else str
    bucket = F.size(F.filter(F.array(*[F.lit(kind(c)) for c in starts]), lambda c: c <= F.col(order))) if starts else F.lit(0)
    df = rows.withColumn("_b", bucket)
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not starts:
        return df.withColumns({n: F.sum(c).over(w) for c, n in columns.items()}).drop("_b")
    totals = df.groupBy("_b").agg(*[F.sum(c).alias(f"_{n}") for c, n in columns.items()])
    earlier = totals.alias("x").join(totals.alias("y"), F.expr("y._b < x._b"), "left").groupBy("x._b").agg(*[F.coalesce(F.sum(f"y._{n}"), F.lit(0)).alias(f"_{n}") for n in columns.values()])
    df = df.join(F.broadcast(earlier), "_b")
    return df.withColumns({n: F.col(f"_{n}") + F.sum(c).over(w) for c, n in columns.items()}).drop("_b", *[f"_{n}" for n in columns.values()])


def running_spend(rows: DataFrame, limit_usd: float, order: str = "done_ord", buckets: int = 64) -> DataFrame:
    """rows with spent (dollars up to and with this row) and after_stop: the meter stops after the row that takes it above the limit."""
    df = running_totals(rows, order, {"input_tokens": "_upto"}, buckets)
    spent, earlier = T.usd_for("_upto"), T.usd_for(F.col("_upto") - F.col("input_tokens"))
    return df.withColumns({"spent": spent, "after_stop": earlier > limit_usd}).drop("_upto")


def skipped(planned: DataFrame) -> DataFrame:
    """rule, notes: what the plan withholds."""
    return planned.filter("status <> 'scan'").groupBy("rule").agg(F.count(F.lit(1)).alias("notes"))


def text_of(billed: dict, withheld: int, folders: list[tuple[str, int, int]], max_usd: float | None, live: bool = False) -> str:
    """The bill in words: what a run sends, as a range, what it finds, and the ceiling."""
    b, lines = billed, []
    lines.append(
        f"  bill (estimate): {b['n_fresh']:,} notes {'to send' if live else 'a live run would send'}, {b['n_cached']:,} served from the journal, {b['n_local']:,} decided locally,"
        f" {b['n_locked']:,} locked, {withheld:,} skipped, {b['n_undecodable']:,} undecodable"
    )
    lines.append(
        f"    payload {b['note_chars']:,} chars + questions -> ~{b['tokens_low']:,} to {b['tokens_high']:,} input tokens"
        f" ({T.CHARS_PER_TOKEN[1]} down to {T.CHARS_PER_TOKEN[0]} chars/token), ~{T.usd_text(b['usd_low'])} to {T.usd_text(b['usd_high'])} at ${T.USD_PER_MILLION} per million"
    )
    if b["n_unreadable"] or b["n_undecodable"]:
        lines.append(f"    findings so far: {b['n_unreadable']:,} with a header that cannot be read, {b['n_undecodable']:,} not valid UTF-8 (never sent)")
    if b["n_age_from_mtime"]:
        aged = b["n_age_from_mtime"] + b["n_dated"] + b["n_stamp_dated"]
        lines.append(f"    age: {b['n_age_from_mtime']:,} of {aged:,} readable notes ({100 * b['n_age_from_mtime'] / aged:.0f}%) take their age from the file system")
    if max_usd is not None:
        lines.append(f"    ceiling {T.usd_text(max_usd)}: {'OVER' if b['over_budget'] else 'under'} at the pessimistic end")
    if folders:
        lines.append("    largest folders by payload:")
        lines += [f"      {folder:<40} {chars:>12,} chars {notes:>6,} notes" for folder, chars, notes in folders]
    return "\n".join(lines)


def refusal(billed: dict, max_usd: float) -> str:
    return (
        f"REFUSED: the pessimistic estimate of {T.usd_text(billed['usd_high'])} (~{billed['tokens_high']:,} input tokens; the optimistic end is {T.usd_text(billed['usd_low'])})"
        f" is over the ceiling of {T.usd_text(max_usd)}. Nothing was sent."
    )
