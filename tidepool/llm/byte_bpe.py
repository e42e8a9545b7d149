"""Byte-level BPE by a sentencepiece model that is made from a file of ranks.

Every byte has a character of its own, so a token of any bytes is a piece of text. The pieces, scored by
their negative rank, are written as a sentencepiece model of type BPE without normalisation: it merges
the pair of the highest score first, leftmost among equals, as the ranks ask for. Texts are cut by the
ranks' pattern and each pre-token is encoded by the model; ids turn into bytes by the way back.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, memo, whole_text
from .encoding import MEMO_ENTRIES, Memo, packed, path_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Printable ASCII stands for itself, any other byte for a letter from 256 on.
LETTERS = [chr(b) if 0x21 <= b <= 0x7E else chr(0x100 + b) for b in range(256)]
BYTES = {ord(c): b for b, c in enumerate(LETTERS)}
#: No byte's letter is in these, so no text spells the piece that stands for anything unknown or for an id without token.
UNKNOWN, UNUSED = "⁇", "⁈"
#: Field numbers and values of the model file's format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
KIND_UNKNOWN, KIND_CONTROL = 2, 3
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, UNK_PIECE, MODEL_BPE = 3, 4, 40, 41, 42, 43, 45, 2
NAME, DUMMY_PREFIX, EXTRA_WHITE_SPACE, ESCAPE_WHITE_SPACE = 1, 3, 4, 5


def read_ranks(file: str = RANKS) -> dict[bytes, int]:
    """Tokens and their ranks, from lines of base64 and a number."""
    with open(path_of(file), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


#: A character that is nothing, which stands for those that only the newer library knows.
NOTHING = "\u0378"


@functools.cache
def newer_characters() -> str:
    """The letters and numbers that the pattern's library here knows and the ranks' own library does not.

    The two follow different versions of Unicode. The ranks' library encodes only what its pattern finds,
    so that with a pattern of one class it tells which characters it takes for such.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    odd: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        asked = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        odd ^= set(regex.findall(kind, every)) ^ set(bytes(asked.encode_ordinary(every)).decode())
    return "".join(sorted(odd))


def _number(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes | str) -> bytes:
    """One field of a protocol buffer."""
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    data = value.encode() if isinstance(value, str) else value
    return _number(number << 3 | 2) + _number(len(data)) + data


def spelled(token: bytes) -> str:
    return "".join(map(LETTERS.__getitem__, token))


def model_of(ranks: dict[bytes, int]) -> bytes:
    """The ranks as a sentencepiece model file: a piece's id is its rank, ids between ranks are never produced."""
    by_rank = {rank: token for token, rank in ranks.items()}
    if len(by_rank) < len(ranks) or min(by_rank, default=0) < 0:
        raise ValueError("ranks have to differ and not to be negative")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing}")
    size = max(by_rank) + 1
    if size >= 1 << 24:
        raise ValueError("scores have 24 bits")
    out = []
    for rank in range(size):
        if rank in by_rank:
            out.append(_field(PIECES, _field(PIECE, spelled(by_rank[rank])) + _field(SCORE, -float(rank))))
        else:
            out.append(_field(PIECES, _field(PIECE, f"{UNUSED}{rank}") + _field(SCORE, 0.0) + _field(KIND, KIND_CONTROL)))
    out.append(_field(PIECES, _field(PIECE, UNKNOWN) + _field(SCORE, 0.0) + _field(KIND, KIND_UNKNOWN)))
    trainer = [(MODEL_TYPE, MODEL_BPE), (VOCAB_SIZE, size + 1), (UNK_ID, size), (BOS_ID, -1), (EOS_ID, -1), (PAD_ID, -1), (UNK_PIECE, UNKNOWN)]
    normalizer = [(NAME, "identity"), (DUMMY_PREFIX, 0), (EXTRA_WHITE_SPACE, 0), (ESCAPE_WHITE_SPACE, 0)]
    out.append(_field(TRAINER, b"".join(_field(*f) for f in trainer)))
    out.append(_field(NORMALIZER, b"".join(_field(*f) for f in normalizer)))
    return b"".join(out)


class Codec:
    """Ids of texts and bytes of ids by one model."""

    def __init__(self, model: bytes, split: str, newer: str = "", memo_entries: int = MEMO_ENTRIES):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split, self.newer = regex.compile(split), dict.fromkeys(map(ord, newer), NOTHING)
        self.unlike = frozenset(newer)
        size = self.processor.get_piece_size() - 1
        pieces = self.processor.id_to_piece(list(range(size)))
        self.tokens = [None if p.startswith(UNUSED) else bytes(map(BYTES.__getitem__, map(ord, p))) for p in pieces]
        self.whole = {p: i for i, p in enumerate(pieces) if self.tokens[i] is not None}
        self.ids = Memo(self._encode, memo_entries)

    def _encode(self, pre_tokens: list[str]) -> list[bytes]:
        """A pre-token that is a token is that token, whatever merges would make of its bytes."""
        written = [spelled(t.encode()) for t in pre_tokens]
        found = [self.whole.get(w) for w in written]
        merged = iter(self.processor.encode([w for w, i in zip(written, found, strict=True) if i is None], num_threads=1))
        return [packed(next(merged) if i is None else [i]) for i in found]

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or self.unlike.isdisjoint(text):
            return self.split.findall(text)
        return [text[m.start() : m.end()] for m in self.split.finditer(text.translate(self.newer))]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(self.ids.values_of(self.pre_tokens(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for; an id without a token raises."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        try:
            return b"".join(map(self.tokens.__getitem__, numbers))
        except (IndexError, TypeError):
            raise ValueError("an id without a token") from None


@functools.cache
def _codec(model: bytes, split: str, newer: str) -> Codec:
    return Codec(model, split, newer)


def _codec_for(df: DataFrame, ranks: str) -> Callable[[], Codec]:
    """What gives executors the codec; the model, no larger than the file of ranks, is sent to them."""
    sent = df.sparkSession.sparkContext.broadcast((model_of(read_ranks(ranks)), pattern(), newer_characters()))

    def of() -> Codec:
        memo("byte_bpe", _codec.cache_clear)
        return _codec(*sent.value)

    return of


def encode(df: DataFrame, ranks: str = RANKS, text: str = "text") -> DataFrame:
    """df's doc_id with ids (array<int>) of the whole text, without special tokens; a null text has none.

    Repeated rows are encoded each, a null doc_id stays null, other columns are not read, and no rows
    give no rows.
    """
    codec = _codec_for(df, ranks)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [codec().encode(t.as_py()) for t in batch.column("text")]
        starts = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(found), "<i4")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return arrow_map(df.select("doc_id", whole_text(text).alias("text")), over, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, ranks: str = RANKS, ids: str = "ids") -> DataFrame:
    """df's doc_id with decoded (binary): the bytes that an array of ids stands for, empty for a null one.

    The bytes of ids that encode() gave are the text's; those of any others need not be UTF-8. A null
    id, or one without a token, raises.
    """
    codec = _codec_for(df, ranks)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [codec().decode(np.array(i.as_py(), "<u4").tobytes()) for i in batch.column("ids")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "decoded"])

    slim = df.select("doc_id", F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return arrow_map(slim, over, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(df: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row: texts are encoded and their ids decoded.

    A null text counts as empty, with 0 tokens. Only doc_id and text are read; a null doc_id stays
    null, repeated rows stay repeated, and no rows give no rows. Ids and bytes never leave the task.
    """
    codec = _codec_for(df, ranks)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, n, ids_sha, decoded_sha = codec(), [], [], []
        for text in batch.column("text"):
            ids = of.encode(text.as_py())
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(of.decode(ids)).hexdigest())
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return arrow_map(slim, over, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
