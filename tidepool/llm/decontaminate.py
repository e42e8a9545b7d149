"""Benchmark decontamination by the q-gram lemma.

Items are cut into overlapping segments. A text region within e edits of a segment of m characters
shares at least m - q + 1 - q * e of its q-grams, and these lie on at most e + 1 neighbouring
diagonals (place in the text less place in the segment). So shared q-grams are counted in bands of
2 * (e + 1) diagonals that overlap by half; bands that reach the bound are kept and verified by
alignment within the band.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, memo, slices, whole_text

Q, SEGMENT, STRIDE, EDIT_RATE = 12, 96, 48, 0.05
#: Of the benchmark, so much text is held against the documents at a time.
BLOCK_BYTES = 4 << 20
SCHEMA = "doc_id long, item_id long, start long, end long, edits long, n_segments long"
#: Characters that a worker takes at a time, which bounds its arrays.
PART = 1 << 16
_WORD, _GAP = re.compile(r"\w+"), re.compile(r"\W")
_TABLE_BITS = 22


def normalised(text: str) -> str:
    """Words in lower case with single spaces between them; long texts are taken in parts cut between words."""
    if len(text) <= PART:
        return " ".join(_WORD.findall(text)).lower()
    parts, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, min(at + PART, len(text)))
        end = gap.start() if gap else len(text)
        if words := _WORD.findall(text, at, end):
            parts.append(" ".join(words))
        at = end
    return " ".join(parts).lower()


def word_spans(text: str) -> list[tuple[int, int, int]]:
    """For each word its place in the normalised text, and its start and end in the text itself."""
    spans, at = [], 0
    for m in _WORD.finditer(text):
        spans.append((at, m.start(), m.end()))
        at += len(m[0].lower()) + 1
    return spans


def segments_of(text: str, segment: int = SEGMENT, stride: int = STRIDE) -> list[tuple[int, str]]:
    """Starts and texts: windows of `segment` characters, the last one at the end; a short text is one."""
    if len(text) <= segment:
        return [(0, text)]
    starts = [*range(0, len(text) - segment, stride), len(text) - segment]
    return [(s, text[s : s + segment]) for s in starts]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q code points at each place, by doubling."""
    base = np.uint64(0x9E3779B97F4A7C15)
    known: dict[int, tuple[np.ndarray, np.uint64]] = {1: (codes.astype(np.uint64) + np.uint64(7), base)}

    def of(n: int) -> tuple[np.ndarray, np.uint64]:
        if n not in known:
            (left, shift_left), (right, shift_right) = of(n - n // 2), of(n // 2)
            size = max(0, len(codes) - n + 1)
            with np.errstate(over="ignore"):
                known[n] = left[:size] * shift_right + right[n - n // 2 :][:size], shift_left * shift_right
        return known[n]

    h = of(q)[0]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Index:
    """The q-grams of all segments of a block of items."""

    q: int
    items: list[int]
    texts: list[str]
    edits: list[int]
    bounds: list[int]
    grams: np.ndarray
    first: np.ndarray
    seg: np.ndarray
    place: np.ndarray
    table: np.ndarray


def build(items: list[tuple[int, str]], q: int, segment: int, stride: int, rate: float) -> Index:
    seg_items, texts, edits, bounds = [], [], [], []
    hashes, segs, places = [], [], []
    for item, text in items:
        for _, part in segments_of(normalised(text), segment, stride):
            if len(part) < q:  # too short to tell
                continue
            e = int(rate * len(part))
            while e and len(part) - q + 1 - q * e < 1:
                e -= 1
            h = gram_hashes(_codes(part), q)
            hashes.append(h)
            segs.append(np.full(len(h), len(texts)))
            places.append(np.arange(len(h)))
            seg_items.append(item)
            texts.append(part)
            edits.append(e)
            bounds.append(len(part) - q + 1 - q * e)
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    grams, first = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[grams >> np.uint64(64 - _TABLE_BITS)] = True
    seg = np.concatenate(segs)[order] if segs else np.empty(0, np.int64)
    place = np.concatenate(places)[order] if places else np.empty(0, np.int64)
    return Index(q, seg_items, texts, edits, bounds, grams, np.append(first, len(flat)), seg, place, table)


def marks(index: Index, codes: np.ndarray) -> np.ndarray:
    """For each q-gram of a text whether the index may have it, by a table of hash bits; in parts."""
    out = np.zeros(max(0, len(codes) - index.q + 1), bool)
    for a in range(0, len(out), PART):
        b = min(a + PART, len(out))
        out[a:b] = index.table[gram_hashes(codes[a : b + index.q - 1], index.q) >> np.uint64(64 - _TABLE_BITS)]
    return out


def candidates(index: Index, codes: np.ndarray) -> list[tuple[int, int]]:
    """Segments and first diagonals of the bands that share enough q-grams with a text."""
    q = index.q
    if len(codes) < q or not len(index.grams):
        return []
    at = np.flatnonzero(marks(index, codes))
    if not len(at):
        return []
    # only the places that are marked are hashed again
    h = gram_hashes(codes[at[:, None] + np.arange(q)].ravel(), q)[::q]
    k = np.searchsorted(index.grams, h)
    k[k == len(index.grams)] = 0
    hit = index.grams[k] == h
    at, k = at[hit], k[hit]
    if not len(at):
        return []
    counts = index.first[k + 1] - index.first[k]
    flat = np.repeat(index.first[k] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    seg, diagonal = index.seg[flat], np.repeat(at, counts) - index.place[flat]
    width = np.asarray(index.edits)[seg] + 1
    # each hit lies in the band that begins in its own stretch of diagonals and in the one before
    band = np.floor_divide(diagonal, width)
    low = int(band.min()) - 1
    span = int(band.max()) - low + 1
    keys = np.concatenate([seg * span + (band - low), seg * span + (band - 1 - low)])
    found, n = np.unique(keys, return_counts=True)
    enough = n >= np.asarray(index.bounds)[found // span]
    return [(int(f // span), (int(f % span) + low) * (index.edits[f // span] + 1)) for f in found[enough]]


def banded(segment: np.ndarray, text: np.ndarray, first: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits between the segment and some region of the text along diagonals first to first + width.

    Gives edits, start and end of the region, or None if it takes more than `most`.
    """
    far = len(segment) + most + 1
    wide = width + 1
    lanes = np.arange(wide)

    def inside(row: int) -> np.ndarray:
        """Whether the text has a prefix that ends on each diagonal of this row."""
        ends = first + lanes + row
        return (ends >= 0) & (ends <= len(text))

    cost = np.where(inside(0), 0, far)
    start = first + lanes
    for row in range(1, len(segment) + 1):
        ends = first + lanes + row
        there = (ends >= 1) & (ends <= len(text))
        same = np.zeros(wide, bool)
        same[there] = text[ends[there] - 1] == segment[row - 1]
        here = np.where(there, cost + ~same, far)
        began = start.copy()
        # a character of the segment that the text lacks: from the next diagonal of the row before
        down = np.append(cost[1:] + 1, far)
        better = down < here
        here = np.where(better & inside(row), down, here)
        began = np.where(better, np.append(start[1:], 0), began)
        # characters of the text that the segment lacks: from diagonals to the left in this row
        least = np.minimum.accumulate(here - lanes) + lanes
        source = np.maximum.accumulate(np.where(here == least, lanes, 0))
        began = began[source]
        cost = np.where(inside(row), least, far)
        start = began
        if cost.min() > most:
            return None
    best = int(cost.argmin())
    return int(cost[best]), int(start[best]), first + best + len(segment)


def verified(index: Index, text: str, codes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """item, start, end (in the normalised text), edits and number of segments found, for each item."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    done: set[tuple[int, int, int]] = set()
    for seg, first in candidates(index, codes):
        part, most = index.texts[seg], index.edits[seg]
        width = 2 * (most + 1)
        at = text.find(part, max(0, first), max(0, first + width + len(part) + 1))
        if at >= 0:
            got = 0, at, at + len(part)
        else:
            got = banded(_codes(part), codes, first - 1, width + 1, most)
        if got and (seg, got[1], got[2]) not in done:
            done.add((seg, got[1], got[2]))
            found.setdefault(index.items[seg], []).append((seg, *got))
    out = []
    for item, hits in found.items():
        out.append((item, min(s for _, _, s, _ in hits), max(e for _, _, _, e in hits), min(d for _, d, _, _ in hits), len({s for s, *_ in hits})))
    return out


_held: dict[str, Index] = {}


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items (id, text) in blocks of about block_bytes, dealt by a hash of both."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield [(r["item_id"], r["text"]) for r in part]


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    q: int = Q,
    segment: int = SEGMENT,
    stride: int = STRIDE,
    rate: float = EDIT_RATE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, item_id, start, end, edits, n_segments: which documents hold which items, and where.

    A document holds an item if a region of it lies within rate * length edits of one of the item's
    segments, in words of lower case with single spaces between; a segment too short for the q-gram
    bound to hold with so many edits (under 24 characters with the defaults) must be there verbatim.
    start and end are code points of the
    text, from the first to the last segment found; edits are those of the best one. Null and empty
    texts and items hold nothing; items under q characters are too short to tell. A null id stays
    null; repeated rows give repeated results. Only doc_id, item_id and the two texts are read.

    The benchmark meets all documents in blocks of about block_bytes of text (or of one item), which
    is what every executor holds at a time.
    """
    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    out = None
    for items in _blocks(benchmark, block_bytes):
        found = arrow_map(slim, _searcher(_sent(df, items), q, segment, stride, rate), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    q: int = Q,
    segment: int = SEGMENT,
    stride: int = STRIDE,
    rate: float = EDIT_RATE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of df that hold no item of the benchmark, with all columns, in one pass and without a join.

    Each row is judged by its own text as contaminated() does, whatever its id: null and repeated ids
    change nothing. Rows that a block of the benchmark rejects are not held against the next ones.
    """
    for items in _blocks(benchmark, block_bytes):
        hits = _hits_of(_sent(df, items), q, segment, stride, rate)

        def clean(batch: pa.RecordBatch, hits=hits) -> pa.RecordBatch:
            bad = {i for i, _, _ in hits(batch.column("text"))}
            return batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        df = arrow_map(df, clean, df.schema)
    return df


def _sent(df: DataFrame, items: list[tuple[int, str]]):
    return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The first place and the texts of slices with about PART bytes, one text at least."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    at = 0
    for part in slices(batch, "text", PART):
        yield at, [t or "" for t in part.column("text").to_pylist()]
        at += part.num_rows


def _hits_of(sent, q: int, segment: int, stride: int, rate: float) -> Callable[[pa.Array], Iterator[tuple[int, str, tuple]]]:
    """A function from texts to (place, normalised text, hit) of those that hold an item, a hit as verified() gives it."""

    def search(texts: pa.Array) -> Iterator[tuple[int, str, tuple]]:
        memo("decontaminate", _held.clear)
        name, items = sent.value
        if name not in _held:
            _held.clear()
            _held[name] = build(items, q, segment, stride, rate)
        index = _held[name]
        least = min(index.bounds, default=1)
        for first, part in _parts(texts):
            # one pass over many texts: a gap of q odd characters keeps q-grams from crossing
            plain = [normalised(t) for t in part]
            joined = _codes(("\x00" * q).join(plain))
            marked = np.flatnonzero(marks(index, joined))
            at = 0
            for i, p in enumerate(plain, first):
                end = at + len(p)
                a, b = np.searchsorted(marked, (at, end))
                if b - a >= least:
                    for hit in verified(index, p, joined[at:end]):
                        yield i, p, hit
                at = end + q

    return search


def _searcher(sent, q: int, segment: int, stride: int, rate: float) -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
    hits = _hits_of(sent, q, segment, stride, rate)

    def search(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        docs, texts, rows = batch.column("doc_id"), batch.column("text"), []
        for i, group in groupby(hits(texts), key=itemgetter(0)):
            spans = word_spans(texts[i].as_py())
            places = np.array([s[0] for s in spans])
            for _, _, (item, start, stop, edits, n) in group:
                a = max(0, int(np.searchsorted(places, start, "right")) - 1)
                b = max(a, int(np.searchsorted(places, stop, "left")) - 1)
                rows.append((docs[i].as_py(), item, spans[a][1], spans[b][2], edits, n))
        if not rows:
            return None
        names = ["doc_id", "item_id", "start", "end", "edits", "n_segments"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return search
