"""Near duplicates by min-max hashing.

Every permutation gives two signature values, the least and the greatest hash of the set, so half as
many hashes are evaluated as values are banded. Sets that share a band are candidates; candidates are
linked only if the full sets are similar enough.

Equal sets are one class from the start. In a bucket, classes are held against one hub at a time, and
classes that are already connected never meet again; only what is still apart after the hub rounds is
compared in pairs. So a bucket of n near copies costs about n comparisons, whatever n is. Before any
text moves, a parity sketch bounds the difference of two sets from below, so that pairs that can't be
similar enough are dropped and none that is gets lost. Sketches meet distinct pairs, not every bucket
that a pair shares. What has no partner is told by bit maps of bounded size and is not shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_table, join_spread, materialise, maybe_in, memo, whole_text

BANDS, ROWS = 40, 6
SEED = 20_240_607
HUB_ROUNDS = 2
#: 64-bit words of the parity sketch.
SKETCH = 16
#: Pairs of one hub, and classes of one bucket, that are compared in one place.
PAIRS_IN_PLACE = 1000
#: Ids up to this size go to every executor; more are shuffled.
BROADCAST_ROWS = 500_000
#: A class of more than one in so many rows is joined by broadcast; there are no more such classes than that.
MOST_HOT = 500
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 256:
            self[word] = h
        return h


_words = _Words()


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `size` words; fewer words are one shingle.

    Words are runs of anything but ASCII white space, with A-Z in lower case.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _STEP + w[i : len(w) - k + 1 + i]
    return np.unique(_mixed(h))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band; the first half of the bands holds minima, the other maxima."""
    perms = bands * rows // 2
    a = _multipliers(perms)[:, None]
    low, high = np.full(perms, ~np.uint64(0)), np.zeros(perms, np.uint64)
    for i in range(0, len(shingles), 1024):
        v = a * shingles[i : i + 1024]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    signature = np.concatenate([low, high]).reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        h = _mixed(h * _STEP + signature[:, i])
    return h


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """A bit for each value of some hash bits: whether an odd number of shingles has it.

    Every shingle that only one of two sets has changes one bit, so two sketches differ in no more
    bits than the sets in shingles.
    """
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(df: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """key, n_shingles, node (digest of the set; null if it is empty), bands and sketch (arrays of long) of df (key, text)."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo("minhash", _words.clear)
        counts, nodes, found, sketches = [], [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py(), size)
            counts.append(len(s))
            nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            found.append(band_hashes(s, bands, rows).view(np.int64) if len(s) else None)
            sketches.append(parity_sketch(s) if len(s) else None)
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, sketches)]
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), *lists], ["key", "n_shingles", "node", "bands", "sketch"]
        )

    key = df.schema["key"].dataType.simpleString()
    return arrow_map(df, sign, f"key {key}, n_shingles long, node binary, bands array<long>, sketch array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, df: DataFrame, size: int, percent: int, made: list[DataFrame]) -> DataFrame:
    """Those of pairs (a, b) whose full sets reach the similarity. nodes: node, rep (a key that has it); df: key, text.

    A hub's text goes to as many places as its pairs need, so that no hub fills a task.
    """
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.lit(c == "a").alias("as_a"), F.lit(c == "b").alias("as_b")) for c in ("a", "b")])
    ends = pairs.select(F.inline(ends)).groupBy("node").agg(F.max("as_a").alias("as_a"), F.max("as_b").alias("as_b"))
    wanted = materialise(ends.join(nodes, "node").select("node", "rep", "as_a", "as_b"), "near-wanted")
    held = df.withColumnRenamed("key", "rep")
    if wanted.count() <= BROADCAST_ROWS:
        texts = held.join(F.broadcast(wanted), "rep")
    else:  # texts of other sets stay where they are
        texts = maybe_in(held, wanted, "rep", "asked").filter("asked").drop("asked").join(wanted, "rep")
    # a key may stand for several texts: the others fail the comparison of digests below
    one = texts.filter("as_a").select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    shares = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS_IN_PLACE).cast("int").alias("shares")).filter("shares > 1")
    shares = materialise(shares, "near-shares")
    made += [wanted, shares]
    # every share is more than PAIRS_IN_PLACE pairs, and so many rows are broadcast at most
    shares = F.broadcast(shares) if shares.count() <= BROADCAST_ROWS else shares
    share = F.pmod(F.xxhash64("a"), F.coalesce("shares", F.lit(1)))
    dealt = pairs.select("a", "b").join(shares, "b", "left").select("a", "b", share.alias("share"))
    two = texts.filter("as_b").select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(shares, "b", "left")
    two = two.select("b", "text_b", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)).cast("long") - 1)).alias("share"))
    both = dealt.join(one, "a").join(two, ["b", "share"]).select("a", "b", "text_a", "text_b")
    last: dict[bytes, np.ndarray | None] = {}

    def set_of(node: bytes, text: str) -> np.ndarray | None:
        s = shingle_set(text, size)
        return s if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == node else None

    def confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo("minhash", _words.clear)
        keep = []
        columns = (batch.column(c).to_pylist() for c in ("a", "b"))
        for a, b, x, y in zip(*columns, batch.column("text_a"), batch.column("text_b"), strict=True):
            p = set_of(a, x.as_py())
            if b not in last:
                last.clear()
            if last.get(b) is None:
                last[b] = set_of(b, y.as_py())
            q = last[b]
            if p is None or q is None:
                keep.append(False)
                continue
            shared = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(both, confirm, "a binary, b binary").distinct()


def contract(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Labels (node, comp) after joining what edges (a, b) connect; nodes without a label are their own.

    The labels given are deleted.

    Every end takes the least of itself and its neighbours, and the edges move to the new labels,
    until none is left; labels are digests, so that takes about the logarithm of a component's size.
    """
    if labels is None:
        ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        labels = materialise(ends.select("node", F.col("node").alias("comp")), "near-labels")
        moved = edges
    else:
        ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        fresh = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp"))
        given, labels = labels, materialise(labels.unionByName(fresh), "near-labels")
        drop_table(given)
        x, y = (labels.select(F.col("node").alias(n), F.col("comp").alias(f"{n}_comp")) for n in ("a", "b"))
        moved = edges.join(x, "a").join(y, "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    current = materialise(moved.filter(F.col("a") != F.col("b")).distinct(), "near-edges")
    while not current.isEmpty():
        ends = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.min("b").alias("n")).select("a", F.least("a", "n").alias("to"))
        least = materialise(least, "near-least")
        steps = least.select(F.col("a").alias("comp"), "to")
        labels_next = materialise(labels.join(steps, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "near-labels")
        x, y = (least.select(F.col("a").alias(n), F.col("to").alias(f"{n}_to")) for n in ("a", "b"))
        onward = current.join(x, "a").join(y, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        current_next = materialise(onward.filter(F.col("a") != F.col("b")).distinct(), "near-edges")
        for old in (labels, current, least):
            drop_table(old)
        labels, current = labels_next, current_next
    return labels


def _similar(n: Column, sketch: Column, n_b: Column, sketch_b: Column, percent: int) -> Column:
    """False only if the sets can't be similar enough, by their sizes or by what their sketches differ in."""
    apart = sum((F.bit_count(F.get(sketch, F.lit(i)).bitwiseXOR(F.get(sketch_b, F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    return (F.least(n, n_b) * 100 >= F.greatest(n, n_b) * percent) & (apart * (100 + percent) <= (n + n_b) * (100 - percent))


def _with_hub(left: DataFrame, turn: int) -> DataFrame:
    """a, b (the hub): the classes of every bucket with one of them, another one each turn."""
    hub = left.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "comp")).alias("hub"))
    return left.join(hub, "bucket").filter(F.col("comp") != F.col("hub.comp")).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))


def _fitting(pairs: DataFrame, sketches: DataFrame, percent: int, made: list[DataFrame]) -> DataFrame:
    """Those of pairs (a, b) that may be similar. sketches: node, n, sketch; hubs of many pairs go to every executor."""
    met = materialise(pairs, "near-met")
    hubs = met.groupBy("b").agg(F.count(F.lit(1)).alias("weight"))
    hubs = materialise(hubs.join(sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b"), "near-hubs")
    made += [met, hubs]
    both = join_spread(met, hubs, ["b"], "weight", met.count()).join(sketches.withColumnRenamed("node", "a"), "a")
    return both.filter(_similar(F.col("n"), F.col("sketch"), F.col("n_b"), F.col("sketch_b"), percent)).select("a", "b")


def _still_apart(left: DataFrame, percent: int) -> DataFrame:
    """a, b: what is still apart within a bucket and may be similar, by blocks of a bucket against blocks.

    The join gives only pairs that may be similar; blocks spread a large bucket over many tasks.
    """
    sizes = left.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PAIRS_IN_PLACE).cast("int").alias("blocks"))
    dealt = left.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = dealt.select("bucket", "node", "n", "sketch", "comp", F.col("block").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    other = dealt.select("bucket", "block", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"), F.col("sketch").alias("sketch_b"))
    fits = _similar(F.col("n"), F.col("sketch"), F.col("n_b"), F.col("sketch_b"), percent)
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bucket", "block")]
    met = every.alias("x").join(other.alias("y"), same[0] & same[1] & (F.col("node") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & fits)
    return met.select(F.col("node").alias("a"), "b")


def _components(df: DataFrame, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """key, n_shingles, component (the least key reachable; null if the key is) for every row of df (key, text)."""
    made: list[DataFrame] = []

    def table(rows_of: DataFrame, name: str) -> DataFrame:
        made.append(materialise(rows_of, name))
        return made[-1]

    signed = materialise(signatures(df, size, bands, rows), "near-signed")
    usable = signed.filter("node IS NOT NULL AND key IS NOT NULL")
    # a set that one row has is a class as it stands; only the others' bands are shuffled
    repeated = table(usable.groupBy("node").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("node"), "near-repeated")
    marked = maybe_in(usable, repeated, "node", "again")
    first = [F.first(c).alias(c) for c in ("bands", "sketch")]
    again = marked.filter("again").groupBy("node").agg(F.min("key").alias("rep"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), *first)
    single = marked.filter(~F.col("again")).select("node", F.col("key").alias("rep"), F.col("n_shingles").alias("n"), F.lit(1).cast("long").alias("copies"), "bands", "sketch")
    classes = table(single.unionByName(again), "near-classes")
    places = classes.select("node", F.explode("bands").alias("bucket"))
    shared = table(places.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket"), "near-shared")
    members = table(maybe_in(places, shared, "bucket", "meets").filter("meets").drop("meets").join(shared, "bucket"), "near-members")
    # a few more than those of the members
    sketches = table(maybe_in(classes.select("node", "n", "sketch"), members, "node", "meets").filter("meets").drop("meets"), "near-sketches")
    nodes = classes.select("node", "rep")

    labels: DataFrame | None = None
    tested: DataFrame | None = None
    left = members.withColumn("comp", F.col("node"))
    for turn in range(HUB_ROUNDS + 1):
        last = turn == HUB_ROUNDS
        pairs = _still_apart(left.join(sketches, "node"), percent) if last else _with_hub(left, turn)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("b").alias("hub")).dropDuplicates(["a", "b"])
        pairs = pairs.select(F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("hub").alias("b"))
        if tested is not None:
            either = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(either, ["a", "b"], "left_anti")
        pairs = table(pairs if last else _fitting(pairs, sketches, percent, made), "near-pairs")
        if pairs.isEmpty():
            if not last:
                continue
            break
        edges = table(_verified(pairs, nodes, df, size, percent, made), "near-links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = contract(labels, edges)
        if last:
            break
        # a bucket in one component stays so
        now = left.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        apart = now.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("bucket")
        left = table(now.join(apart, "bucket"), "near-left")
        if left.isEmpty():
            break

    # rows of one key with several texts connect their classes
    by_key = usable.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b")
    crossing = table(usable.join(by_key, "key").filter("node != a").select("a", F.col("node").alias("b")).distinct(), "near-crossing")
    if not crossing.isEmpty():
        labels = contract(labels, crossing)
    if labels is None:
        named = classes.select("node", F.col("rep").alias("component"), "copies")
    else:
        joined = nodes.join(labels, "node")
        linked = joined.join(joined.groupBy("comp").agg(F.min("rep").alias("component")), "comp").select("node", "component")
        named = classes.join(linked, "node", "left").select("node", F.coalesce("component", "rep").alias("component"), "copies")
    # only rows whose class has copies or links can belong to another key
    named = materialise(named.join(classes.select("node", "rep"), "node").filter("copies > 1 OR component != rep").select("node", "component", "copies"), "near-named")
    hot = F.broadcast(named.filter(F.col("copies") * MOST_HOT > usable.count()).drop("copies"))  # at most MOST_HOT classes
    slim = signed.select("key", "n_shingles", "node")
    often = slim.join(hot, "node")
    rest = slim.join(hot.select("node"), "node", "left_anti").join(named.drop("copies"), "node", "left")
    out = often.unionByName(rest.select(often.columns))
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component")
    out = materialise(out.select("key", "n_shingles", component), "near-components")
    for old in [*made, signed, named, *([labels] if labels is not None else [])]:
        drop_table(old)
    return out


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of df.

    Two documents are linked if 100 * shared >= percent * united for their sets of shingles of `size`
    words. component_id is the smallest doc_id reachable by links. Null, empty and blank texts have
    no shingles and are linked with nothing; nor is a row with a null doc_id, which has a null
    component_id and is kept. Rows that share a doc_id are one document. Only doc_id and text are
    read; a table of no rows gives no rows.

    Chance of missing a pair right at 80 %: (1 - 0.8 ** rows) ** bands, 5e-6 with the defaults.
    """
    slim = df.select(F.col("doc_id").cast("long").alias("key"), whole_text().alias("text"))
    found = _components(slim, size, percent, bands, rows)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("key")).alias("kept"))


def without_duplicates(df: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of df less all but one of each group of near duplicates, with all columns.

    Every row is a document of its own, rows without an id and rows that repeat an id too: of a group
    the row with the smallest doc_id stays, null ids last, and of equal ids any one. Rows without
    shingles are in no group and stay.
    """
    number = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.monotonically_increasing_id().alias("row"))
    keyed = materialise(df.withColumn("_key", number), "near-keyed")  # a row keeps its number from here on
    found = _components(keyed.select(F.col("_key").alias("key"), whole_text().alias("text")), size, percent, bands, rows)
    gone = materialise(found.filter("component != key").select(F.col("key.row").alias("_row")), "near-gone")
    numbered = keyed.withColumn("_row", F.col("_key.row"))
    if gone.count() <= BROADCAST_ROWS:
        return numbered.join(F.broadcast(gone), "_row", "left_anti").select(df.columns)
    # rows that certainly stay are not shuffled
    marked = maybe_in(numbered, gone, "_row", "_asked")
    kept = marked.filter(~F.col("_asked")).unionByName(marked.filter("_asked").join(gone, "_row", "left_anti"))
    return kept.select(df.columns)
