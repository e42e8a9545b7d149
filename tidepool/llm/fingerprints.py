"""Document fingerprints by winnowing, in column expressions alone.

Every k code points are hashed; of each window of w hashes the smallest is kept, the rightmost one of
equals, with its position. Two texts that share k + w - 1 code points share a kept hash. Long texts
are hashed in blocks that overlap by k + w - 2 code points, which keeps the arrays short and gives the
same selections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, whole_text

K, W = 8, 16
#: Windows in a block; a gram's place in its block takes the low bits below its hash.
BLOCK = 1 << 15
BITS = 17


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


LOW = (1 << BITS) - 1


def _place(packed: Column) -> Column:
    return _long(LOW) - packed.bitwiseAND(_long(LOW))


def _minima(values: Column, w: int) -> Column:
    """The least of each window of w values, each once, in order; of fewer than w values the least of all.

    Minima of spans are doubled until they are w wide, so a value is compared about log2(w) times.
    """

    def wider(by: int):
        # past the end there is null, which least() passes over
        return lambda a: F.zip_with(a, F.slice(a, F.lit(by + 1), F.size(a)), lambda x, y: F.least(x, y))

    spans, reach = values, 1
    while reach < w:
        by = min(reach, w - reach)
        spans = let(spans, wider(by))
        reach += by
    return let(spans, lambda a: F.array_distinct(F.slice(a, F.lit(1), F.greatest(F.size(a) - (w - 1), F.lit(1)))))


def _of_block(block: Column, base: Column, k: int, w: int) -> Column:
    """Selections of one block as array<struct<p, h>>: place in the text and hash, by place.

    A block shorter than k is a single gram; one with less than w grams is a single window.
    """
    grams = F.when(F.char_length(block) < k, F.filter(F.array(block), lambda b: b != "")).otherwise(
        F.regexp_extract_all(block, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    )
    # the hash above, the falling place below: the least number is the least hash, rightmost of equals
    packed = F.transform(grams, lambda g, i: F.xxhash64(g).bitwiseAND(_long(~LOW)) + (_long(LOW) - i))
    return F.transform(_minima(packed, w), lambda v: F.struct((base + _place(v)).alias("p"), F.shiftright(v, BITS).alias("h")))


def selections(text: Column, k: int = K, w: int = W, block: int = BLOCK) -> Column:
    """All selections of a text as array<struct<p long, h long>>, by place; empty for an empty text."""
    reach = k + w - 1
    windows = F.greatest(F.char_length(text) - (reach - 1), F.lit(1))
    starts = F.sequence(F.lit(0), (windows - 1).cast("int"), F.lit(block))
    found = F.transform(starts, lambda s: _of_block(F.substring(text, s + 1, F.lit(block + reach - 1)), s.cast("long"), k, w))
    # the first window of a block may select what the last one before it did
    joined = lambda parts: let(F.flatten(parts), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["p"] != x["p"])))
    return let(found, lambda parts: F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(joined(parts)))


def rendered(kept: Column) -> Column:
    """The fingerprint as text: hash in hex, @, place; separated by blanks."""
    return F.lower(F.array_join(F.transform(kept, lambda x: F.concat(F.hex(x["h"]), F.lit("@"), x["p"].cast("string"))), " "))


def hashes(kept: Column) -> Column:
    return F.transform(kept, lambda x: x["h"])


def different(kept: Column) -> Column:
    """How many different hashes a fingerprint has."""
    return F.size(F.array_distinct(hashes(kept)))


def likeness(a: Column, b: Column, n_a: Column | None = None, n_b: Column | None = None) -> Column:
    """Shared part of two fingerprints' hashes (Jaccard); 1 for two empty ones. n_a, n_b: different() of them, if known."""
    one, two = (different(x) if n is None else n for x, n in ((a, n_a), (b, n_b)))
    return let(
        F.struct(F.size(F.array_intersect(hashes(a), hashes(b))).alias("i"), (one + two).alias("n")),
        lambda n: F.when(n["n"] == 0, F.lit(1.0)).otherwise(n["i"] / (n["n"] - n["i"])),
    )


def fingerprints(df: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, selections, fingerprint for every row; null text counts as empty."""
    kept = selections(whole_text(), k, w)
    out = df.select("doc_id", whole_text().alias("text")).withColumn("selections", kept)
    return out.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "selections", rendered(F.col("selections")).alias("fingerprint"))


def _within(kept: Column, chars: Column, k: int, w: int) -> Column:
    """Of a text's selections, those of the windows that lie in its first `chars` code points.

    A selection's first window follows from the one before: if that has a greater or equal hash,
    the new gram took over on entering; else the old one had to leave first.
    """
    reach = k + w - 1

    def first(a: Column, x: Column, i: Column) -> Column:
        before = F.get(a, i - 1)
        return F.when(i == 0, _long(0)).when(x["h"] <= before["h"], x["p"] - (w - 1)).otherwise(before["p"] + 1)

    # most lie so far from the end that their window must, or so far that it can't, be inside
    inside = F.filter(kept, lambda x, i: F.when(x["p"] + reach <= chars, F.lit(True)).when(x["p"] >= chars, F.lit(False)).otherwise(first(kept, x, i) + reach <= chars))
    return F.when(chars >= reach, inside).otherwise(F.slice(kept, 1, 0))


def _spliced(a: Column, a_kept: Column, a_chars: Column, b: Column, b_kept: Column, b_chars: Column, k: int, w: int) -> Column:
    """Selections of a's first a_chars code points followed by b's first b_chars.

    Only windows across the seam are hashed anew; the others are a's and b's own.
    """
    reach = k + w - 1
    x, y = F.least(a_chars, F.lit(reach - 1)), F.least(b_chars, F.lit(reach - 1))
    seam = F.concat(F.substring(a, (a_chars - x + 1).cast("int"), x.cast("int")), F.substring(b, F.lit(1), y.cast("int")))
    crosses = (x + y >= reach) | (a_chars + b_chars < reach)
    moved = lambda kept, by: F.transform(kept, lambda s: F.struct((s["p"] + by).alias("p"), s["h"].alias("h")))
    middle = F.when(crosses, moved(_of_block(seam, _long(0), k, w), a_chars - x)).otherwise(F.slice(a_kept, 1, 0))
    left, right = _within(a_kept, a_chars, k, w), moved(_within(b_kept, b_chars, k, w), a_chars)

    # a window across the seam may select what a's last or b's first window did; nothing else comes twice
    def joined(parts: Column) -> Column:
        last, first = F.try_element_at(parts["left"], F.lit(-1))["p"], F.get(parts["right"], F.lit(0))["p"]
        fresh = let(F.struct(last.alias("last"), first.alias("first")), lambda e: F.filter(middle, lambda s: ~s["p"].eqNullSafe(e["last"]) & ~s["p"].eqNullSafe(e["first"])))
        return F.concat(parts["left"], fresh, parts["right"])

    return let(F.struct(left.alias("left"), right.alias("right")), joined)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """df with bucket: ranges of falling doc_id, from 0; null ids come last."""
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else None
    cuts = sorted(set(cuts or []), reverse=True)
    if not cuts:
        return df.withColumn("bucket", F.lit(0))
    stride = max(1, int(len(cuts) ** 0.5))
    fine, coarse = (F.split(F.lit(",".join(map(str, c))), ",").cast("array<long>") for c in (cuts, cuts[stride - 1 :: stride]))  # constants
    whole = F.size(F.filter(coarse, lambda c: c > F.col("doc_id"))) * stride
    rest = F.size(F.filter(F.slice(fine, whole + 1, stride), lambda c: c > F.col("doc_id")))
    return df.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(whole + rest))


def edited_likeness(df: DataFrame, k: int = K, w: int = W, buckets: int | None = None) -> DataFrame:
    """Every document's fingerprint against that of its edited text and that of the next document.

    The next document is the one that follows by falling doc_id (null ids last, equal ids by text);
    after the last comes the first. The edited text has the document's last floor(n_chars / 2) code
    points replaced by as many first ones of the next document, or all it has. Null text counts as
    empty; a table of one row follows itself; columns besides doc_id and text are left out.

    Neighbours meet in ranges of doc_id, four for each shuffle partition, so that the ranges that fall
    into one partition add up to about as much everywhere. The cuts, and the greatest id of each
    range, are all that reaches the driver or every executor.
    """
    spark = df.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = _bucketed(df.select("doc_id", whole_text().alias("text")), buckets)
    tops = docs.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    if not tops:
        heads = docs.withColumn("last", F.lit(True))
    else:
        goes_to = {r["bucket"]: tops[i - 1]["bucket"] for i, r in enumerate(tops)}
        table = spark.createDataFrame([(r["bucket"], r["top"], goes_to[r["bucket"]]) for r in tops], "bucket int, top long, goes_to int")
        heads = (
            docs.join(F.broadcast(table), "bucket")
            .filter(F.col("doc_id").eqNullSafe(F.col("top")))
            .select("doc_id", "text", F.col("goes_to").alias("bucket"), F.lit(True).alias("last"))
        )
    rows = docs.withColumn("last", F.lit(False)).unionByName(heads)
    # selections take more room than the texts: they are made where neighbours have already met
    by = ["last", F.desc_nulls_last("doc_id"), "text"]
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", *by).withColumn("kept", selections(F.col("text"), k, w))
    rows = rows.withColumn("n_kept", different(F.col("kept")))
    order = Window.partitionBy("bucket").orderBy(*by)
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_kept": F.lead("kept").over(order), "next_n": F.lead("n_kept").over(order)}).filter(~F.col("last"))
    n = F.char_length("text")
    half = F.floor(n / 2)
    taken = F.least(half, F.char_length("next_text"))
    rows = rows.select(
        "doc_id", "text", "kept", "n_kept", "next_text", "next_kept", "next_n",
        n.cast("long").alias("n_chars"), (n - half).cast("long").alias("stay"), taken.cast("long").alias("taken"),
    )
    spliced = _spliced(F.col("text"), F.col("kept"), F.col("stay"), F.col("next_text"), F.col("next_kept"), F.col("taken"), k, w)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("stay").cast("int")), F.substring(F.col("next_text"), F.lit(1), F.col("taken").cast("int")))
    made = let(
        spliced,
        lambda e: F.struct(rendered(e).alias("edited_fingerprint"), likeness(F.col("kept"), e, F.col("n_kept")).alias("near_edited")),
    )
    return rows.select(
        "doc_id", "n_chars", F.sha2(edited, 256).alias("edited_sha256"), rendered(F.col("kept")).alias("fingerprint"),
        made.alias("made"), likeness(F.col("kept"), F.col("next_kept"), F.col("n_kept"), F.col("next_n")).alias("near_next"),
    ).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "made.edited_fingerprint", "made.near_edited", "near_next")
