"""Line dedup by site-relative frequency, in DataFrame operations alone.

A line is boilerplate of a host if the pages of that host that contain it, divided by the host's
pages, exceed a ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_text

RATIO, MIN_PAGES = 0.05, 5
#: Tables of boilerplate up to this size go to every executor; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20
#: Beyond that, hosts with more than one in so many pages go to every executor; there are no more of them than that.
MOST_HOT = 500


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_id(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, fold_copies: bool = False) -> DataFrame:
    """host, line_id (64-bit hash of the line without the blanks around it), n_pages, n_host: the lines to drop.

    A line counts once a page, without the blanks around it; lines of blanks never count. Lines are told
    apart by their hash: of n different lines of a host two share one with probability n^2 / 2^65. Hosts may
    be null: those pages are one host. A host has few such lines: with n lines a page on average, at
    most n / ratio of them. Only counts of hashes are shuffled, one for each host, line and task.

    fold_copies: exact copies of a page on one host are one page, so that a page that was crawled
    often does not become boilerplate.
    """
    pages = df.select(F.col(host).alias("host"), whole_text(text).alias("text"))
    ids = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != ""), _line_id))
    if fold_copies:
        pages = pages.withColumn("page", F.xxhash64("text"))
        lines = pages.select("host", "page", F.explode(ids).alias("line_id")).distinct()
        pages = pages.select("host", "page").distinct()
    else:
        lines = pages.select("host", F.explode(ids).alias("line_id"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    counts = lines.groupBy("host", "line_id").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    same = counts["host"].eqNullSafe(totals["host"])
    return counts.join(totals, same).filter(F.col("n_pages") > F.lit(ratio) * F.col("n_host")).select(counts["host"], "line_id", "n_pages", "n_host")


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, fold_copies: bool = False) -> DataFrame:
    """df with boilerplate lines cut from `text`, and n_dropped; all other columns stay as they are.

    A null text stays null with 0 lines dropped; lines that stay keep their bytes and order. A page
    all of whose lines are boilerplate becomes the empty text. Repeated rows are each cleaned; a
    table of no rows gives no rows; a column n_dropped of df is replaced.
    """
    found = materialise(boilerplate(df, host, text, ratio, min_pages, fold_copies), "boilerplate")
    rest = df.drop("n_dropped")
    one, lines, pages, left = (_unused(rest, name) for name in ("_host", "_lines", "_pages", "_kept"))
    by_host = found.groupBy("host").agg(F.collect_list("line_id").alias(lines), F.max("n_host").alias(pages)).withColumnRenamed("host", one)
    same = F.col(host).eqNullSafe(F.col(one))
    if 64 * found.count() <= BROADCAST_BYTES:
        joined = rest.join(F.broadcast(by_host), same, "left")
    else:  # pages of the few hosts with most pages stay where they are
        large = F.col(pages) * MOST_HOT > df.count()
        often = rest.join(F.broadcast(by_host.filter(large)), same)
        others = rest.join(F.broadcast(by_host.filter(large).select(one)), same, "left_anti")
        joined = often.unionByName(others.join(by_host.filter(~large), same, "left"))
    kept = F.filter(lines_of(F.col(text)), lambda x: ~F.array_contains(F.col(lines), _line_id(x)))
    hit = F.col(lines).isNotNull() & F.col(text).isNotNull()
    out = joined.withColumn(left, F.when(hit, kept))
    n = F.when(hit, F.size(lines_of(F.col(text))) - F.size(left)).otherwise(0)
    return out.select(
        *[F.when(F.col(left).isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in rest.columns],
        n.cast("long").alias("n_dropped"),
    )
