"""Removal of repeated byte strings through suffix arrays.

A byte goes if a string of `length` bytes covers it that also starts anywhere else in the corpus.

1.  Every window of `length` bytes picks one k-gram of its own, the one with the least hash, the
    rightmost of equals. Equal windows pick the same one at the same place, so only windows whose
    k-gram occurs again can repeat. The windows that share a pick are one fragment of the text.
2.  Fragments that are equal as a whole repeat in all their windows and are done. What is left of a
    k-gram's fragments is grouped by it.
3.  The fragments of a group are laid side by side as strings of 8-byte symbols, counted from the
    k-gram, and a suffix array of them is built. Windows can be equal only if they lie in suffixes
    that share 24 symbols, which are neighbours in it; these are compared byte by byte.

The array is built by linear grouping: suffixes are grouped by their Lyndon prefixes, groups are
processed from the greatest down with pointers to the previous smaller suffix, and then each group's
order is emitted from the order of what follows its prefix. Nothing is renamed or sorted recursively.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_HOT, arrow_map, drop_table, join_spread, materialise, maybe_in, whole_text

LENGTH, K = 200, 64
#: Windows are hashed in blocks of so many, whatever the text's length.
BLOCK = 1 << 20
#: Groups of more distinct fragments are resolved by counting windows over all tasks.
GROUP = 20_000
#: Symbols laid side by side for one array.
SYMBOLS = 40_000
BROADCAST_BYTES = 48 << 20
#: A cut as a row of its own: eight fields, two digests, the array around it, the hash table's entry.
CUT_BYTES = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = 22


def suffix_array(s: list[int]) -> list[int]:
    """The suffix array of s, whose last symbol must be its only least one."""
    n = len(s)
    order: list[int] = sorted(range(n), key=s.__getitem__)
    # sa: suffixes by group; at: a suffix's index there; start: its group's first index; size: by first index
    sa, at, start = order[:], [0] * n, [0] * n
    size = [0] * n
    first = 0
    for i, p in enumerate(order):
        if i and s[p] != s[order[i - 1]]:
            first = i
        at[p], start[p] = i, first
        size[first] += 1
    before = [-1] * n  # the previous suffix of a smaller group
    end = n
    while end > 0:
        low = start[sa[end - 1]]
        group = sorted(sa[low:end]) if end - low > 1 else sa[low:end]
        hits: dict[int, int] = {}
        for p in group:
            q = p - 1
            while q >= 0 and start[q] >= low:
                q = before[q]
            before[p] = q
            if q >= 0:
                hits[q] = hits.get(q, 0) + 1
        end = low
        if not hits:
            continue
        if len(hits) == 1:
            rounds = [list(hits)]
        else:
            times = defaultdict(list)
            for q, c in hits.items():
                times[c].append(q)
            rounds = [times[c] for c in sorted(times, reverse=True)]
        # a prefix that is followed by the group more often is greater: those leave their groups first
        for moved in rounds:
            touched: dict[int, int] = {}
            for q in moved:
                g = start[q]
                last = g + size[g] - 1 - touched.get(g, 0)
                other, i = sa[last], at[q]
                sa[i], sa[last] = other, q
                at[other], at[q] = i, last
                touched[g] = touched.get(g, 0) + 1
            for g, c in touched.items():
                if c == size[g]:
                    continue
                fresh = g + size[g] - c
                size[g] -= c
                size[fresh] = c
                for i in range(fresh, fresh + c):
                    start[sa[i]] = fresh
    slot = start[:]  # by group's first index: the next place to fill
    free = list(range(n))
    out = [-1] * n
    out[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = slot[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = 1
            p = before[p]
    return out


def common_prefixes(s: list[int], sa: list[int]) -> list[int]:
    """For each index the length that its suffix shares with the one before."""
    rank, out, h = [0] * len(s), [0] * len(s), 0
    for i, p in enumerate(sa):
        rank[p] = i
    for p in range(len(s)):
        if r := rank[p]:
            q = sa[r - 1]
            while s[p + h] == s[q + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def repeated_windows(fragments: list[tuple[bytes, int, bool]], length: int) -> list[list[int]]:
    """For each fragment (bytes, place of the k-gram, known to repeat) the windows that others have too.

    Windows of fragments that are known to repeat are left out of the result, but count for others.
    """
    m = len(fragments)
    need = (length - 7) // 8
    blocks, owners, firsts = [], [], []
    for f, (data, place, _) in enumerate(fragments):
        head = place % 8
        n = max(0, (len(data) - head) // 8)
        blocks.append(np.frombuffer(data, ">u8", n, head).astype(np.uint64))
        owners += [f] * n + [f]
        firsts += [*range(head, head + 8 * n, 8), -1]
    ranks = np.unique(np.concatenate(blocks), return_inverse=True)[1] + m
    text, used = [], 0
    for f, b in enumerate(blocks):
        text += ranks[used : used + len(b)].tolist()
        text.append(m - 1 - f)
        used += len(b)
    sa = suffix_array(text)
    shared = common_prefixes(text, sa)
    marks: list[list[int]] = [[] for _ in range(m)]
    i, n = 1, len(sa)
    while i < n:
        if shared[i] < need:
            i += 1
            continue
        j = i - 1
        while i < n and shared[i] >= need:
            i += 1
        seen: dict[bytes, list[tuple[int, int]]] = {}
        for p in sa[j:i]:
            f, at = owners[p], firsts[p]
            data = fragments[f][0]
            for t in range(max(0, at - 7), min(at, len(data) - length) + 1):
                seen.setdefault(data[t : t + length], []).append((f, t))
        for places in seen.values():
            if len(places) > 1:
                for f, t in places:
                    if not fragments[f][2]:
                        marks[f].append(t)
    return [sorted(set(x)) for x in marks]


def picks(data: np.ndarray, length: int, k: int) -> Iterator[tuple[int, int, int, int]]:
    """hash, first window, number of windows and place of each k-gram that windows pick, in blocks."""
    wide = length - k + 1
    total = len(data) - length + 1
    with np.errstate(over="ignore"):
        for begin in range(0, total, BLOCK):
            part = data[begin : min(begin + BLOCK, total) + length - 1]
            h, step, n = part.astype(np.uint64) + np.uint64(1), _STEP, 1
            rest, offset, out, shift = k, 0, None, None
            while True:  # by doubling, over the binary digits of k
                if rest & 1:
                    piece = h[offset:]
                    out, shift = (piece, step) if out is None else (out[: len(piece)] * step + piece, shift * step)
                    offset += n
                rest >>= 1
                if not rest:
                    break
                h, step, n = h[:-n] * step + h[n:], step * step, 2 * n
            g = out[: len(part) - k + 1]
            g = (g ^ (g >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            g = g ^ (g >> np.uint64(29))
            low = np.uint64((1 << _PLACE) - 1)
            least = (g & ~low) | (low - np.arange(len(g), dtype=np.uint64))
            reach = 1
            while reach < wide:
                s = min(reach, wide - reach)
                least = np.minimum(least[:-s], least[s:])
                reach += s
            change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            ends = np.append(change[1:], len(least))
            place = (low - (least[change] & low)).astype(np.int64)
            yield from zip(g[place].view(np.int64).tolist(), (change + begin).tolist(), (ends - change).tolist(), (place + begin).tolist(), strict=True)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _fragments(docs: DataFrame, length: int, k: int) -> DataFrame:
    """anchor, digest, key, first, n, place of all fragments."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, digests = [], []
        for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
            raw = text.as_buffer()
            if raw.size < length:
                continue
            data, key = memoryview(raw), key.as_py()
            for anchor, first, n, place in picks(np.frombuffer(raw, np.uint8), length, k):
                rows.append((anchor, key, first, n, place))
                digests.append(hashlib.blake2b(data[first : first + n + length - 1], digest_size=14, salt=(place - first).to_bytes(4, "little")).digest())
        if not rows:
            return None
        anchor, key, first, n, place = zip(*rows, strict=True)
        arrays = [pa.array(anchor, pa.int64()), pa.array(digests, pa.binary()), pa.array(key, pa.binary()), *(pa.array(x, pa.int32()) for x in (first, n, place))]
        return pa.RecordBatch.from_arrays(arrays, ["anchor", "digest", "key", "first", "n", "place"])

    return arrow_map(docs, cut, "anchor long, digest binary, key binary, first int, n int, place int")


def _with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (anchor, digest, key, first, n, place, known, many) with the fragments' bytes as data, once each."""
    by_key = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "digest", "first", "n", "place", "known", "many")).alias("cuts"))
    if wanted.count() * CUT_BYTES <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(by_key), "key")
    else:  # copies of a text meet before the shuffle, and texts without cuts stay where they are
        some = maybe_in(docs, wanted, "key", "_cut").filter("_cut").select("key", "text")
        joined = some.groupBy("key").agg(F.first("text").alias("text")).join(by_key, "key")
    # places are bytes of the UTF-8 text
    one = joined.select(F.encode("text", "utf-8").alias("raw"), F.explode("cuts").alias("c"))
    data = F.expr(f"substring(raw, c.first + 1, c.n + {length - 1})")
    cut = one.select("c.anchor", "c.digest", (F.col("c.place") - F.col("c.first")).alias("place"), "c.known", "c.many", data.alias("data"))
    return cut.groupBy("anchor", "digest").agg(*[F.first(c).alias(c) for c in ("place", "known", "many", "data")])


def _sorted_out(groups: DataFrame, length: int) -> DataFrame:
    """anchor, digest, first, n: runs of repeated windows (from the fragment's start), by suffix arrays."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of whole groups, and after them of the group that still grows
        whole, symbols = 0, 0

        def flush(rows: list[tuple]) -> pa.RecordBatch | None:
            found = repeated_windows([(d, p, k) for _, _, p, k, d in rows], length) if len(rows) > 1 else []
            out = []
            for (anchor, digest, *_), windows in zip(rows, found, strict=False):
                if windows:
                    w = np.array(windows)
                    cuts = np.flatnonzero(np.diff(w) != 1) + 1
                    out += [(anchor, digest, int(run[0]), len(run)) for run in np.split(w, cuts)]
            if not out:
                return None
            a, d, f, n = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, pa.binary()), pa.array(f, pa.int32()), pa.array(n, pa.int32())], ["anchor", "digest", "first", "n"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "place", "known", "data")), strict=True):
                if held and held[-1][0] != row[0]:
                    whole = len(held)
                    if symbols >= SYMBOLS:
                        if (out := flush(held)) is not None:
                            yield out
                        held, whole, symbols = [], 0, 0
                held.append(row)
                symbols += len(row[4]) // 8 + 1
        if held and (out := flush(held)) is not None:
            yield out

    near = groups.repartition("anchor").sortWithinPartitions("anchor", "digest")
    return near.select("anchor", "digest", "place", "known", "data").mapInArrow(resolve, "anchor long, digest binary, first int, n int")


def _counted_out(groups: DataFrame, length: int) -> DataFrame:
    """The same as _sorted_out() for groups of any size: windows are counted over all tasks."""
    windows = F.explode(F.sequence(F.lit(0), F.octet_length("data") - length)).alias("first")
    each = groups.select("anchor", "digest", "known", "data", windows)
    each = each.select("anchor", "digest", "known", "first", F.unhex(F.md5(F.expr(f"substring(data, first + 1, {length})"))).alias("w"))
    again = each.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor", "w")
    return each.filter(~F.col("known")).join(again, ["anchor", "w"]).select("anchor", "digest", "first", F.lit(1).alias("n"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP) -> DataFrame:
    """key, ranges (array<struct<start, end>>, apart and in order): the bytes of each text to remove.

    docs: key (digest of the text), text. Texts without any such byte are left out.
    """
    pieces = materialise(_fragments(docs, length, k), "suffix-fragments")
    again = materialise(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "suffix-again")
    shared = materialise(join_spread(pieces, again, ["anchor"], "c", pieces.count(), "left_semi"), "suffix-shared")
    for old in (pieces, again):
        drop_table(old)
    kinds = shared.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "first", "n", "place")).alias("one"))
    kinds = materialise(kinds, "suffix-kinds")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("d"), F.min("c").alias("least")).filter("d > 1 AND least = 1").select("anchor", "d")
    several = materialise(several, "suffix-several")
    wanted = join_spread(kinds, several, ["anchor"], "d", kinds.count()).select("anchor", "digest", "one.key", "one.first", "one.n", "one.place", (F.col("c") > 1).alias("known"), (F.col("d") > group).alias("many"))
    wanted = materialise(wanted, "suffix-wanted")
    groups = materialise(_with_bytes(docs, wanted, length), "suffix-groups")
    runs = _sorted_out(groups.filter("NOT many"), length)
    if not groups.filter("many").isEmpty():
        runs = runs.unionByName(_counted_out(groups.filter("many"), length))
    single = wanted.filter("NOT known").select("anchor", "digest", "key", F.col("first").alias("base"))
    found = runs.join(single, ["anchor", "digest"]).select("key", (F.col("base") + F.col("first")).alias("first"), "n")
    copied = kinds.filter("c > 1").select("anchor", "digest", "c")
    equal = join_spread(shared, copied, ["anchor", "digest"], "c", shared.count(), "left_semi").select("key", "first", "n")
    every = equal.unionByName(found).distinct()
    ranges = every.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("n") + (length - 1)).alias("end")))).alias("ranges"))

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for ranges in batch.column("ranges").to_pylist():
            merged: list[dict] = []
            for r in ranges:
                if merged and r["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], r["end"])
                else:
                    merged.append(dict(r))
            out.append(merged)
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, batch.schema.field("ranges").type)], ["key", "ranges"])

    merged = materialise(arrow_map(ranges, merge, "key binary, ranges array<struct<start int, end int>>"), "suffix-ranges")
    for old in (shared, kinds, several, wanted, groups):
        drop_table(old)
    return merged


def _beside(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs with the ranges of their key, null if it has none; texts without any and those that many rows have aren't shuffled."""
    none = F.lit(None).cast(ranges.schema["ranges"].dataType)
    marked = maybe_in(docs, ranges, "key", "_found")
    clean = marked.filter("NOT _found").drop("_found").withColumn("ranges", none)
    found = marked.filter("_found").drop("_found")
    rows = found.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    hot = F.broadcast(materialise(rows.filter(F.col("c") * MOST_HOT > docs.count()).select("key"), "suffix-hot"))
    often = found.join(F.broadcast(ranges.join(hot, "key", "left_semi")), "key")
    rest = found.join(F.broadcast(ranges.join(hot, "key", "left_semi").select("key")), "key", "left_anti").join(ranges, "key", "left")
    return clean.unionByName(often).unionByName(rest)


def remove_repeats(df: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of df; with_bytes adds kept (binary).

    Null text counts as empty; texts shorter than `length` keep all. Two rows of one text are each
    other's repeats, as are two places in one text, even if they overlap. A null id stays null. Only
    doc_id and text are read; a table of no rows gives no rows.
    """
    if not 8 <= k <= length - 7:
        raise ValueError("k must be at least 8 and leave room in a window")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    docs = docs.withColumn("key", _key(F.col("text")))
    ranges = repeated_ranges(docs.select("key", "text"), length, k, group)
    size = ranges.agg(F.coalesce(F.sum(F.size("ranges") * 32 + 128), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(ranges), "key", "left").select("doc_id", "text", "ranges")
    else:
        joined = _beside(docs, ranges).select("doc_id", "text", "ranges")

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, spans, digests, left = [], [], [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist(), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            at, kept = 0, []
            for r in ranges or ():
                kept.append(data[at : r["start"]])
                at = r["end"]
            kept = b"".join([*kept, data[at:]])
            sizes.append(len(data))
            removed.append(len(data) - len(kept))
            spans.append(len(ranges or ()))
            digests.append(hashlib.sha256(kept).hexdigest())
            left.append(kept if with_bytes else None)
        arrays = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_bytes:
            arrays.append(pa.array(left, pa.binary()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(arrays, names)

    return arrow_map(joined, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else ""))
