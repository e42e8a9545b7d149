"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams of a language by rank; a document's own list is
compared with each profile by out-of-place distance, the sum of how far every n-gram is from its
place there, with a fixed distance for those that are missing. The nearest profile wins.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, held_out, slices, whole_text

LONGEST_GRAM, PROFILE = 3, 300
#: About so many rows of each language are learned from, taken by a hash of the text.
ROWS_PER_LANGUAGE = 4000
#: How fast the score falls with distance, as a share of the greatest distance.
SOFTNESS = 0.03
_WORD = re.compile(r"[^\W\d_]+")


def grams_of(word: str, longest: int = LONGEST_GRAM) -> list[str]:
    """n-grams of a word with a blank before and after; the blank alone is none."""
    padded = f" {word} "
    out, last = [c for c in padded if c != " "], list(padded)
    for n in range(2, longest + 1):
        last = list(map(add, last, padded[n - 1 :]))
        out += last
    return out


def words_of(text: str) -> Counter:
    found = Counter(_WORD.findall(text.lower()))
    if text.isascii():  # nothing but letters was found
        return found
    for w in [w for w in found if not w.isalpha() and not any(map(str.isalpha, w))]:
        del found[w]
    return found


def _order(gram: str) -> int:
    """Breaks ties between equally frequent n-grams, the same way everywhere."""
    return int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=5).digest(), "little")


def profiles(df: DataFrame, profile: int = PROFILE, rows: int = ROWS_PER_LANGUAGE, longest: int = LONGEST_GRAM) -> dict[str, list[str]]:
    """The most frequent n-grams of each language in df (text, lang), by falling count.

    Rows without lang or text teach nothing. About `rows` different texts of each language are learned
    from, drawn by their hash, or all if it has no more; copies count once, so that no text outweighs
    others and a language of few texts keeps them all. Only `profile` n-grams a language reach the driver.
    """
    known = df.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").withColumn("h", F.xxhash64("text"))
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not totals:
        return {}
    share = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(1.0, rows / n)))])
    sample = known.filter(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).dropDuplicates(["lang", "h"])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for word, n in words_of(text.as_py()).items():
                for g in grams_of(word, longest):
                    found[lang, g] = found.get((lang, g), 0) + n
        keys = list(found)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())],
            ["lang", "gram", "n"],
        )

    counts = arrow_map(sample, count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    out: dict[str, list[str]] = {lang: [] for lang in sorted(totals)}
    for r in ranked.filter(F.col("rank") <= profile).orderBy("lang", "rank").collect():
        out[r["lang"]].append(r["gram"])
    return {lang: grams for lang, grams in out.items() if grams}


class Ranker:
    """Out-of-place distances of texts to all profiles."""

    def __init__(self, found: dict[str, list[str]], profile: int, longest: int, most: int = 150_000):
        self.languages, self.found, self.profile, self.longest, self.most = list(found), found, profile, longest, most
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, np.ndarray] = {}
        self.ids: dict[str, int] = {}
        self.orders: list[int] = []
        self.order = np.empty(0, np.int64)
        self.places = np.empty((len(self.languages), 0), np.int32)
        for grams in self.found.values():
            for g in grams:
                self._id(g)
        self._grow()

    def _id(self, gram: str) -> int:
        if (i := self.ids.get(gram)) is None:
            i = self.ids[gram] = len(self.orders)
            self.orders.append(_order(gram))
        return i

    def _grow(self) -> None:
        """Places of n-grams in the profiles, -1 where they are missing; with room for more of them."""
        room = max(1024, 2 * len(self.orders))
        self.order = np.zeros(room, np.int64)
        self.order[: len(self.orders)] = self.orders
        self.places = np.full((len(self.languages), room), -1, np.int32)
        for row, grams in enumerate(self.found.values()):
            self.places[row, [self.ids[g] for g in grams]] = np.arange(len(grams))

    def distances(self, text: str) -> np.ndarray | None:
        """A share of the greatest possible distance for each language; None for a text without letters."""
        counts = words_of(text)
        if not counts:
            return None
        if len(self.orders) > self.most or len(self.words) > self.most:
            self.reset()
        known = len(self.orders)
        lists = []
        held, place = self.words.get, self.ids.get
        for word in counts:
            if (ids := held(word)) is None:
                grams = grams_of(word, self.longest)
                row = list(map(place, grams))
                ids = np.array([self._id(g) for g in grams] if None in row else row, np.int64)
                if len(word) <= 64:
                    self.words[word] = ids
            lists.append(ids)
        if len(self.orders) > len(self.order):
            self._grow()
        elif len(self.orders) > known:
            self.order[known : len(self.orders)] = self.orders[known:]
        flat = np.concatenate(lists)
        weights = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), list(map(len, lists)))
        n = np.bincount(flat, weights, minlength=1).astype(np.int64)
        present = np.flatnonzero(n)
        counts_of = n[present]
        if len(present) > self.profile:  # all that may be among the most frequent, ties with the last of them too
            least = np.partition(counts_of, len(present) - self.profile)[len(present) - self.profile]
            present, counts_of = present[counts_of >= least], counts_of[counts_of >= least]
        ranked = present[np.lexsort((self.order[present], -counts_of))][: self.profile]
        places = self.places[:, ranked]
        apart = np.where(places < 0, self.profile, np.abs(places - np.arange(len(ranked))))
        return apart.sum(axis=1) / (self.profile * len(ranked))


def identify(df: DataFrame, found: dict[str, list[str]], profile: int = PROFILE, longest: int = LONGEST_GRAM) -> DataFrame:
    """doc_id, lang_pred, score, distance for every row of df.

    lang_pred is `und` with score 0 and no distance if the text is null or has no letter, or if there
    is no profile. score is the nearest language's share of exp(-distance / SOFTNESS) over all; equal
    distances go to the language that sorts first. Only doc_id and text are read; repeated rows are
    judged alike.
    """

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranker = Ranker(found, profile, longest) if not _rankers else _rankers[0]
        _rankers[:] = [ranker]
        langs, scores, nearest = [], [], []
        for part in slices(batch, "text"):
            for text in part.column("text"):
                d = ranker.distances(text.as_py()) if found else None
                if d is None:
                    langs.append("und")
                    scores.append(0.0)
                    nearest.append(None)
                    continue
                i = int(d.argmin())
                langs.append(ranker.languages[i])
                scores.append(float(1 / np.exp((d[i] - d) / SOFTNESS).sum()))
                nearest.append(float(d[i]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(nearest, pa.float64())],
            ["doc_id", "lang_pred", "score", "distance"],
        )

    _rankers: list[Ranker] = []
    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return arrow_map(slim, predict, "doc_id long, lang_pred string, score double, distance double")


def language_id(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, distance: learned from the rows that are not held out."""
    found = profiles(df.filter(~held_out()))
    out = identify(df, found)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "distance")
