"""Runs of repeated words by the linear method of Gusfield and Stoye.

A text is a string of words. Its Lempel-Ziv blocks give squares, two equal halves side by side, so that
the leftmost occurrence of every kind of square is one of them or a rotation to the right of one. From
each of these squares suffix links are walked as long as the next rotation is a square too, which
completes the vocabulary: every kind of square of the text. Each kind is a place in the suffix tree,
held as an interval of the suffix array; the leaves below are its occurrences. Occurrences of one
period at consecutive words are one run.

A batch of texts is worked on at once, in arrays. Words carry their text's number, so nothing is found
across texts. Names of factors of 1, 2, 4, ... words, by which suffixes are sorted, also tell how far two
places agree, to the right and to the left.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, let, slices, whole_text

MIN_EXPONENT, MIN_LENGTH = 4, 6
#: Bytes of text that are worked on at once; a longer text is a batch of its own.
BATCH_BYTES = 1_500_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Factors:
    """Sorted suffixes of a row of strings, and names of their factors.

    names[j][i] == names[j][k], i != k, exactly if 2**j words from i and from k on are equal and in one string.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        n = self.n = len(words)
        lengths = np.bincount(owner, minlength=int(owner[-1]) + 1 if n else 0)
        ends = np.cumsum(lengths)
        self.end, self.begin = ends[owner], (ends - lengths)[owner]
        keys = owner.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        self.suffixes = np.argsort(keys)
        name, slots = np.empty(n, np.int64), np.arange(n)
        slots = self._named(name, slots, keys[self.suffixes])
        self.names = [name]
        self.repeated = slots  # places, in suffix order, of the words that their string has more than once
        step = 1
        while len(slots):
            at = self.suffixes[slots]
            after = at + step
            inside = after < self.end[at]
            second = np.zeros(len(at), np.int64)
            second[inside] = name[after[inside]] + 1
            keys = name[at] * (n + 1) + second
            order = np.argsort(keys)
            self.suffixes[slots] = at[order]
            name = name.copy()
            slots = self._named(name, slots, keys[order])
            self.names.append(name)
            step *= 2
        self.place = np.empty(n, np.int64)
        self.place[self.suffixes] = np.arange(n)

    def _named(self, name: np.ndarray, slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Name the suffixes in the slots by the first slot of their key, and give the slots that share one."""
        if not len(slots):
            return slots
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        name[self.suffixes[slots]] = slots[first][np.cumsum(first) - 1]
        alone = first & np.concatenate((first[1:], [True]))
        return slots[~alone]

    def agree_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from a and from b on, for a < b in one string."""
        total = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for j in range(len(self.names) - 1, -1, -1):
            x, y = a[live] + total[live], b[live] + total[live]
            ok = y + (1 << j) <= self.end[a[live]]
            same = live[ok][self.names[j][x[ok]] == self.names[j][y[ok]]]
            total[same] += 1 << j
        return total

    def agree_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words that end just before a and before b, for a < b in one string."""
        total = np.zeros(len(a), np.int64)
        low = self.begin[b - 1] if len(b) else b
        for j in range(len(self.names) - 1, -1, -1):
            x, y = a - total - (1 << j), b - total - (1 << j)
            ok = np.flatnonzero(x >= low)
            same = ok[self.names[j][x[ok]] == self.names[j][y[ok]]]
            total[same] += 1 << j
        return total

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` words from a and from b on are equal; both lie in one string or any two."""
        j = np.frexp(length.astype(np.float64))[1] - 1
        out = np.ones(len(a), bool)
        for level in np.unique(j).tolist():
            at = np.flatnonzero(j == level)
            if level >= len(self.names):
                out[at] = a[at] == b[at]
                continue
            name, back = self.names[level], length[at] - (1 << level)
            x, y = a[at], b[at]
            ok = (x == y) | (name[x] == name[y])
            part = np.flatnonzero(ok & (x != y))
            tail = y[part] + length[at][part] <= self.end[y[part]]
            ok[part[~tail]] = False
            part = part[tail]
            ok[part] = name[x[part] + back[part]] == name[y[part] + back[part]]
            out[at] = ok
        return out


def _earlier(f: Factors) -> np.ndarray:
    """For each word the length of the longest factor from it on that begins earlier in its string too."""
    longest = np.zeros(f.n, np.int64)
    slots = f.repeated
    if not len(slots):
        return longest
    at = f.suffixes[slots]
    shared = np.zeros(len(at), np.int64)
    near = np.flatnonzero(f.names[0][at[1:]] == f.names[0][at[:-1]]) + 1
    low, high = np.minimum(at[near], at[near - 1]), np.maximum(at[near], at[near - 1])
    shared[near] = f.agree_after(low, high)
    found: dict[int, int] = {}
    held: list[tuple[int, int]] = []  # places whose neighbour with a smaller position to the right is not known yet
    for where, common in zip(at.tolist(), shared.tolist(), strict=True):
        while held:
            top, before = held[-1]
            if where < top:
                found[top] = max(before, common)
                common = min(before, common)
            elif common <= before:
                found[top] = before
            else:
                break
            held.pop()
        held.append((where, common))
    found.update(held)
    longest[np.fromiter(found.keys(), np.int64, len(found))] = np.fromiter(found.values(), np.int64, len(found))
    return longest


def blocks(f: Factors) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, those of all strings, and the end."""
    ahead = np.maximum(_earlier(f), 1).tolist()
    starts, at = [], 0
    while at < f.n:
        starts.append(at)
        at += ahead[at]
    return np.array([*starts, f.n], np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts a, b, ... the owners 0 a times, 1 b times, ... and the numbers from 0 within each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def covering_squares(f: Factors) -> tuple[np.ndarray, np.ndarray]:
    """Start and half's length of squares that cover the leftmost occurrences of all squares.

    Such an occurrence has its middle in a block and doesn't end in it, or begins at or before the
    block and reaches no further than the next one.
    """
    at = blocks(f)
    begin, after = at[:-1], at[1:]
    size = after - begin
    if not len(begin):
        return begin, begin
    word = f.names[0]
    last = after == f.end[begin]
    starts, halves = [], []
    # squares that hold the next block's first word in their second half
    inner = np.flatnonzero(~last)
    owner, k = _spread(size[inner])
    h, k = after[inner][owner], k + 1
    ok = word[h] == word[h - k]
    h, k = h[ok], k[ok]
    right, left = f.agree_after(h - k, h), f.agree_before(h - k, h)
    ok = left + right >= k
    starts.append(np.maximum(h - k - left, h - 2 * k + 1)[ok])
    halves.append(k[ok])
    # squares that hold the block's first word in their first half, with a word before it
    following = np.where(last, 0, np.append(size[1:], 0))
    owner, k = _spread(size + following)
    h, k = begin[owner], k + 1
    ok = h + k < f.end[h]
    owner, h, k = owner[ok], h[ok], k[ok]
    ok = (word[h] == word[h + k]) & (h > f.begin[h])
    owner, h, k = owner[ok], h[ok], k[ok]
    ok = word[h - 1] == word[h + k - 1]
    owner, h, k = owner[ok], h[ok], k[ok]
    right, left = f.agree_after(h, h + k), f.agree_before(h, h + k)
    start = np.maximum(h - left, h - k + 1)
    ok = (left + right >= k) & (start + k <= after[owner])
    starts.append(start[ok])
    halves.append(k[ok])
    return np.concatenate(starts), np.concatenate(halves)


def _primitive(f: Factors, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The smallest period of each square that divides its half."""
    half = half.copy()
    left = half.copy()  # what is left to be divided out
    prime = 2
    while len(live := np.flatnonzero(left > 1)):
        if prime * prime > left[live].max():
            factor = left[live]  # primes themselves
        else:
            factor = np.full(len(live), prime)
        divides = left[live] % factor == 0
        live, factor = live[divides], factor[divides]
        if not len(live):
            prime += 1
            continue
        left[live] //= factor
        part = half[live] // factor
        smaller = f.agree_after(start[live], start[live] + part) >= half[live]
        half[live[smaller]] = part[smaller]
    return half


def vocabulary(f: Factors) -> tuple[np.ndarray, np.ndarray]:
    """An occurrence and the half's length of every kind of square whose half is no repetition itself.

    A suffix link leads from the place of a square to that of its rotation; where the text goes on with
    the period, this is the suffix one word further. After as many steps as the half has words, the first
    square is reached again.
    """
    start, half = covering_squares(f)
    half = _primitive(f, start, half)
    pairs = np.unique(np.stack((start, half)), axis=1)
    start, half = pairs[0], pairs[1]
    if not len(start):
        return start, half
    # of covering squares in one run, a walk goes from the leftmost to the next one's start
    steps = np.minimum(half, f.agree_after(start, start + half) - half + 1)
    order = np.lexsort((start, half))
    start, half, steps = start[order], half[order], steps[order]
    nearby = (half[1:] == half[:-1]) & (start[1:] < start[:-1] + steps[:-1])
    steps[:-1] = np.where(nearby, start[1:] - start[:-1], steps[:-1])
    owner, rotation = _spread(steps)
    return start[owner] + rotation, half[owner]


def occurrences(f: Factors, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half's length of every occurrence of the squares: the leaves below their places in the suffix tree."""
    bounds = []
    for way in (-1, 1):
        near = f.place[start]
        far = np.full(len(start), -1 if way < 0 else f.n)
        while len(live := np.flatnonzero(np.abs(far - near) > 1)):
            middle = (near[live] + far[live]) // 2
            same = f.same(start[live], f.suffixes[middle], 2 * half[live])
            near[live[same]] = middle[same]
            far[live[~same]] = middle[~same]
        bounds.append(near)
    kinds = np.unique(np.stack((half, bounds[0], bounds[1])), axis=1)
    owner, leaf = _spread(kinds[2] - kinds[1] + 1)
    return f.suffixes[kinds[1][owner] + leaf], kinds[0][owner]


def runs_of(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs, by start and period, of two periods or more.

    words: numbers, equal where words are; owner: the number of the string of each, rising.
    """
    f = Factors(words, owner)
    start, half = occurrences(f, *vocabulary(f))
    if not len(start):
        return start, start, half
    order = np.lexsort((start, half))
    start, half = start[order], half[order]
    first = np.concatenate(([True], (half[1:] != half[:-1]) | (start[1:] != start[:-1] + 1)))
    last = np.concatenate((first[1:], [True]))
    begin, period = start[first], half[first]
    length = start[last] + 2 * period - begin
    order = np.lexsort((period, begin))
    return begin[order], length[order], period[order]


def periodic_runs(df: DataFrame, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start, then period), collapsed for every row of df.

    Words are what stands between blanks, tabs and line ends (9 to 13); a null text has none. A run is a
    stretch of words with a smallest period, at least min_length words and min_exponent (2 or more)
    periods long, that no neighbour extends. collapsed: the words, joined by one space, without those
    that a run holds after its first period. Rows are judged each on its own: repeated rows stay
    repeated, a null doc_id stays null, other columns are not read, and no rows give no rows. A text is
    held whole, with about 30 eight-byte numbers a word.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")

    def find(texts: list[str]) -> tuple[list[int], list[list[dict]], list[str]]:
        split = [t.encode().split() for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        ends = np.cumsum(sizes)
        words = [w for s in split for w in s]
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        begin, length, period = runs_of(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.repeat(np.arange(len(split)), sizes))
        wanted = length >= np.maximum(min_length, min_exponent * period)
        begin, length, period = begin[wanted], length[wanted], period[wanted]
        dropped = np.zeros(len(words) + 1, np.int64)
        np.add.at(dropped, begin + period, 1)
        np.add.at(dropped, begin + length, -1)
        keep = np.cumsum(dropped[:-1]) == 0
        at = np.searchsorted(ends, begin, "right")
        found: list[list[dict]] = [[] for _ in texts]
        first = ends - sizes
        for i, *run in zip(at.tolist(), (begin - first[at]).tolist(), length.tolist(), period.tolist(), strict=True):
            found[i].append(dict(zip(("start", "length", "period"), run, strict=True)))
        collapsed = []
        for i, s in enumerate(split):
            if found[i]:
                s = [w for w, k in zip(s, keep[first[i] : ends[i]].tolist(), strict=True) if k]
            collapsed.append(b" ".join(s).decode())
        return sizes.tolist(), found, collapsed

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, runs, collapsed = [], [], []
        for part in slices(batch, "text", BATCH_BYTES):
            for whole, more in zip((n, runs, collapsed), find(part.column("text").to_pylist()), strict=True):
                whole += more
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(collapsed)], ["doc_id", "n_words", "runs", "collapsed"])

    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return arrow_map(slim, over, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def recurring_text(doc_id: Column, text: Column) -> Column:
    """A text in ten made periodic from some word on, by the checksum of its id; a null id leaves it as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("long")

        def from_word(a: Column) -> Column:
            period = 1 + F.floor((n - a) / (3 + g % 8))
            places = F.transform(F.sequence(a, n - 1), lambda i: a + (i - a) % period)
            head = F.slice(w, F.lit(1), a.cast("int"))
            return F.array_join(F.concat(head, let(period, lambda p: F.transform(places, lambda i: F.get(w, i.cast("int"))))), " ")

        return F.when(n > 0, let(g % n, from_word)).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(words, rewritten)).otherwise(text)


def collapsed_runs(df: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256.

    Every text is first rewritten by recurring_text(). Of equally long runs that of the smallest start,
    then period, counts as the longest; without a run its columns are null and the digests are those of
    no lines and of all words.
    """
    rewritten = df.select("doc_id", recurring_text(F.col("doc_id"), whole_text()).alias("text"))
    found = periodic_runs(rewritten)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.reduce("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda s, r: F.when(s["length"] >= r["length"], s).otherwise(r))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
