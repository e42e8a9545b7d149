"""Byte-level BPE against the library of the rank files."""

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidepool.llm import registry
from tidepool.llm.byte_bpe import RANKS, Codec, decode, encode, model_of, newer_characters, pattern, read_ranks, round_trip

from .test_tokens import ALPHABET, samples

SF = "/root/testdata/sf0.001"


def library(file):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(file), special_tokens={})


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@pytest.mark.parametrize("file", [RANKS, "byte_bpe_50k.tiktoken"])
def test_codec_equals_the_library(file):
    plain, codec = library(file), Codec(model_of(read_ranks(file)), pattern(), newer_characters(), 1000)
    r = random.Random(8)
    texts = samples(1200) + ["".join(r.choice("ab") for _ in range(3000)), "".join(chr(r.randrange(1, 0xD800)) for _ in range(4000))]
    for text in texts:
        want = plain.encode_ordinary(text)
        assert ids_of(codec, text) == want, repr(text)
        assert codec.decode(np.array(want, "<u4").tobytes()) == text.encode()
    # every token on its own
    for token, rank in read_ranks(file).items():
        assert codec.decode(np.array([rank], "<u4").tobytes()) == token
    with pytest.raises(ValueError):
        codec.decode(np.array([1 << 20], "<u4").tobytes())


def test_every_character_is_cut_as_the_library_cuts():
    plain, codec = library(RANKS), Codec(model_of(read_ranks()), pattern(), newer_characters())
    odd = []
    for start in range(0, sys.maxunicode + 1, 256):
        chars = [chr(c) for c in range(start, start + 256) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}a{c}{c}1{c}{c} {c}.{c}" for c in chars)
        if chars and ids_of(codec, text) != plain.encode_ordinary(text):
            odd += [c for c in chars if ids_of(codec, t := f"a{c}a{c}{c}1{c}{c} {c}.{c}") != plain.encode_ordinary(t)]
    assert odd == []


def test_ranks_with_gaps_and_bad_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 302, b"bc": 301}
    plain = tiktoken.Encoding("gaps", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    codec = Codec(model_of(ranks), r"\S+|\s+")
    for text in ("abc", "bcab", "xabcx bc", "⁇⁈300"):
        assert ids_of(codec, text) == plain.encode_ordinary(text)
    with pytest.raises(ValueError):
        codec.decode(np.array([299], "<u4").tobytes())
    with pytest.raises(ValueError):
        model_of({b"a": 0})
    with pytest.raises(ValueError):
        model_of(ranks | {b"zz": 300})


def test_query_equals_the_library(spark):
    plain = library(RANKS)
    got = {r.doc_id: r for r in registry.queries()["op12_byte_bpe"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = plain.encode_ordinary(row.text or "")
        r = got[row.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark):
    texts = [None, "", "word " * 40_000, "x" * 50_000, ALPHABET[20] * 3, "same", "same"]
    data = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", 2, "y"), (5, "same", 3, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, ids int, decoded string")
    plain = library(RANKS)
    want = sorted((repr(d), len(plain.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in data)
    assert sorted((repr(r.doc_id), r.n_tokens, r.decoded_sha256) for r in round_trip(df).collect()) == want
    coded = encode(df)
    assert sorted((repr(r.doc_id), r.ids) for r in coded.collect()) == sorted((repr(d), plain.encode_ordinary(t or "")) for d, t, *_ in data)
    back = decode(coded).collect()
    assert sorted((repr(r.doc_id), bytes(r.decoded)) for r in back) == sorted((repr(d), (t or "").encode()) for d, t, *_ in data)
    assert round_trip(df.limit(0)).collect() == [] and encode(df.limit(0)).collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in decode(null).collect()] == [b""]
