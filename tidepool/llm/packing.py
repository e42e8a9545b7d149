"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are full sequences and then the powers of two
in the binary form of the rest. Each piece is a sequence of its own and pieces of equal length are one
bucket, so a batch drawn from a bucket has no padding and no sequence crosses documents.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, whole_text
from .encoding import pieces_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def binary_pieces(n: int, longest: int) -> list[int]:
    """Lengths that add up to n: as many of `longest` as fit, then powers of two, falling."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, tokenizer: str = "word_bpe_49k.json", longest: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    longest must be a power of two. Every document ends with end_id, so a null or empty text is one
    piece of length 1. bucket is the length's exponent; offset is 0, since a sequence holds one piece.
    with_ids adds token_ids (array<int>). sequence_id is unique among the rows of one result; it
    follows the order of the input's partitions. Only doc_id and text are read, a null doc_id stays
    null, repeated rows are packed each on its own, and no rows give no rows.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    tail = end_id.to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = pieces_of(tokenizer)
        docs, starts, lengths, sums, totals, ids = [], [], [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            packed = encoder.id_bytes(text.as_py()) + tail
            n = len(packed) // 4
            pieces = binary_pieces(n, longest)
            at = [0, *accumulate(pieces)][:-1]
            parts = [packed[4 * a : 4 * (a + k)] for a, k in zip(at, pieces, strict=True)]
            docs += [doc] * len(pieces)
            starts += at
            lengths += pieces
            sums += map(zlib.crc32, parts)
            totals += [n] * len(pieces)
            if with_ids:
                ids += [memoryview(p).cast("I").tolist() for p in parts]
        columns = [pa.array(c, pa.int64()) for c in (docs, starts, lengths, sums, totals)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("token_ids")
        return pa.RecordBatch.from_arrays(columns, names)

    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    pieces = arrow_map(slim, cut, SCHEMA + (", token_ids array<int>" if with_ids else ""))
    return pieces.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
    )
