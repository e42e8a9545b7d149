"""Quality classification by nearest neighbours in a latent semantic space.

A text's words and the shapes of its tokens are hashed to weights; a truncated singular value
decomposition of labelled texts gives the latent space. Every document is held, by exact cosine in
blocks, against all labelled vectors, and the labels of the nearest vote with their similarity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held_out, memo, whole_text

#: Labelled rows per class; both the sample that is fitted and what every executor holds are bounded by it.
ROWS_PER_CLASS = 1500
DIMENSIONS, NEIGHBOURS, POWER = 48, 25, 4
WORDS, SHAPES = 4096, 512
WIDTH = WORDS + SHAPES + 1
SHAPE_WEIGHT = 2.0
THRESHOLD = 0.3
_CLASSES = [(re.compile(r"[^\W\d_a-zà-öø-ÿ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1+", re.S), r"\1")]


def shape_of(token: str) -> str:
    """Upper case, lower case and digit runs as one character each, other characters once a run."""
    for pattern, by in _CLASSES:
        token = pattern.sub(by, token)
    return token


class _Tokens(dict):
    """Word and shape places of tokens; emptied when full."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > 50_000:
            self.clear()
        word = crc32(re.sub(r"\W+", "", token.lower()).encode("utf-8", "surrogatepass")) % WORDS
        shape = WORDS + crc32(shape_of(token).encode("utf-8", "surrogatepass")) % SHAPES
        if len(token) <= 64:
            self[token] = word, shape
        return word, shape


_tokens = _Tokens()


def features(text: str) -> np.ndarray:
    """Square roots of the shares of words and shapes among a text's tokens, and of repeated tokens."""
    tokens = text.split()
    out = np.zeros(WIDTH, np.float32)
    if not tokens:
        return out
    counts = Counter(tokens)
    places = np.array(list(map(_tokens.__getitem__, counts)), np.int64)
    n = np.fromiter(counts.values(), np.float64, len(counts))
    for column in (0, 1):
        out += np.bincount(places[:, column], n, minlength=WIDTH).astype(np.float32)
    out[-1] = sum(map(eq, tokens, tokens[1:]))
    np.sqrt(out / len(tokens), out=out)
    out[WORDS:] *= SHAPE_WEIGHT
    return out


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequency by place
    axes: np.ndarray  # WIDTH x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, of length 1
    labels: np.ndarray
    neighbours: int

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weights) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity; 0 where there is nothing to compare."""
        near = np.maximum(self.latent(x) @ self.vectors.T, 0.0)
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.take_along_axis(near, top, axis=1).astype(np.float64) ** POWER
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-300), 0.0)


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS_PER_CLASS, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model | None:
    """A model from at most `rows` labelled rows of each class, taken by a hash of their ids; None without any.

    Rows of df that are held out teach nothing, nor do null labels and ids. An id with several labels
    or texts counts once for each.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out()).distinct()
    order = F.xxhash64(F.col("doc_id"), F.lit(8))
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(order, "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids: dict[int, list[int]] = {}
    for r in chosen.collect():
        ids.setdefault(r["doc_id"], []).append(r["label"])
    if not ids:
        return None
    pairs = [(i, c) for i, found in ids.items() for c in found]
    columns = [pa.array(x, kind) for x, kind in zip(zip(*pairs, strict=True), (pa.int64(), pa.int32()), strict=True)]
    small = df.sparkSession.createDataFrame(pa.table(columns, ["doc_id", "label"]))  # by Arrow: no Python worker reads it back
    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(F.broadcast(small), "doc_id")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "x"])

    got = sorted((r["doc_id"], r["label"], bytes(r["x"])) for r in arrow_map(slim, extract, "doc_id long, label int, x binary").collect())
    if not got:
        return None
    x = np.stack([np.frombuffer(b, np.float16).astype(np.float32) for _, _, b in got])
    y = np.array([label for _, label, _ in got], np.float64)
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    weighted = x * weights
    # randomised range finder with power iterations
    rank = min(dimensions, *weighted.shape)
    basis = np.linalg.qr(weighted.T @ np.random.default_rng(7).standard_normal((len(x), min(rank + 16, len(x)))).astype(np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
    right = np.linalg.svd(weighted @ basis, full_matrices=False)[2]
    axes = (basis @ right[:rank].T).astype(np.float32)
    model = Model(weights, axes, np.empty((0, 0), np.float32), y, neighbours)
    model.vectors = model.latent(x).astype(np.float32)
    return model


def score(df: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score for every row of df; 0 for null, empty and blank texts, and without a model.

    Only doc_id and text are read. Repeated rows are scored alike; a null id stays null.
    """
    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    of = _scorer(df, model)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(of(batch.column("text")), pa.float64())], ["doc_id", "score"])

    return arrow_map(slim, judge, "doc_id long, score double")


def _scorer(df: DataFrame, model: Model | None) -> Callable[[pa.Array], np.ndarray]:
    """A function from texts to their scores, for the executors."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def of(texts: pa.Array) -> np.ndarray:
        memo("quality", _tokens.clear)
        if sent.value is None:
            return np.zeros(len(texts))
        blocks = (texts.slice(start, 64) for start in range(0, len(texts), 64))
        return np.concatenate([sent.value.scores(np.stack([features(t.as_py() or "") for t in block])) for block in blocks])

    return of


def good(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that score at least the threshold, with all columns, in one pass and without a join.

    Each row is judged by its own text, whatever its id: null and repeated ids change nothing. A null
    text counts as empty and scores 0.
    """
    of = _scorer(df, fit(df, labels))
    return arrow_map(df, lambda batch: batch.filter(pa.array(of(batch.column("text")) >= threshold)), df.schema)


def quality(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labelled rows that are not held out."""
    out = score(df, fit(df, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
