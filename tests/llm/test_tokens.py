"""Token counts and packing against the library itself."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidepool.llm.encoding import Pieces, path_of
from tidepool.llm.packing import binary_pieces, pack
from tidepool.llm.token_counts import token_counts

ALPHABET = list("aAbBzZ09 .,'\"!-_éÉßİıΣς中文😀") + ["  ", "\n", "\n\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "²", "½", "́", "'s", "'LL", "don't", "<|endoftext|>", "<|startoftext|>", "the", " The", "​", "\x00", "ª"]


def samples(n=1500, seed=3):
    r = random.Random(seed)
    out = ["", " ", "\n", "a" * 5000, "1" * 3000, "  lead", "trail  ", "x  y \n z"]
    for _ in range(n):
        simple = r.random() < 0.5
        letters = ALPHABET[:18] + ["  ", "\n", "the", " The", "'s", "don't", "½", "\xa0"] if simple else ALPHABET
        out.append("".join(r.choice(letters) for _ in range(r.randrange(1, 40))))
    return out


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_the_library(file):
    plain = Tokenizer.from_file(path_of(file))
    for entries in (500_000, 40):
        mine = Pieces(file, entries)
        for text in samples():
            want = plain.encode(text, add_special_tokens=False).ids
            assert mine.count(text) == len(want), repr(text)
            assert np.frombuffer(mine.id_bytes(text), "<u4").tolist() == want, repr(text)


def rows(spark):
    texts = [*samples(60), None, "word " * 9000]
    data = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (5, texts[5], "x", 1), (5, "same id", None, 2)]
    return data, spark.createDataFrame(data, "doc_id long, text string, content string, sequence_id int")


def test_token_counts_and_cache(spark, tmp_path):
    data, df = rows(spark)
    plain = Tokenizer.from_file(path_of("byte_bpe_50k.json"))
    cache = f"file://{tmp_path}/cache"
    for turn in range(2):
        got = sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, cache=cache).collect())
        counts = [(d, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in data]
        assert got == sorted((repr(d), b, n, n > 1024) for d, b, n in counts), turn
        stored = spark.read.parquet(cache)
        assert stored.count() == len({t or "" for _, t, *_ in data})
    # another tokenizer's counts don't come from these
    other = token_counts(df, "word_bpe_49k.json", cache=cache).collect()
    assert len(other) == len(data) and spark.read.parquet(cache).select("version").distinct().count() == 2
    assert token_counts(df.limit(0)).collect() == []


@pytest.mark.parametrize("few", [0, 300_000])
def test_a_warm_cache_gets_what_it_lacks(spark, tmp_path, monkeypatch, few):
    """Texts that the cache holds are not encoded again, whether those it lacks are few or many."""
    from tidepool.llm import token_counts as module

    monkeypatch.setattr(module, "FEW_MISSING", few)
    cache, plain = f"file://{tmp_path}/cache", Tokenizer.from_file(path_of("byte_bpe_50k.json"))
    hot = [(i, "one text that many rows have", "x", 1) for i in range(300)]
    schema = "doc_id long, text string, content string, sequence_id int"
    token_counts(spark.createDataFrame(hot[:5], schema), cache=cache).collect()
    df = spark.createDataFrame(hot + [(1000 + i, f"new {i % 7}", None, 2) for i in range(40)] + [(9, None, None, 3)], schema)
    got = {r.doc_id: r.n_tokens for r in token_counts(df, cache=cache).collect()}
    assert len(got) == 340 and got[1003] == len(plain.encode("new 3", add_special_tokens=False).ids) and got[299] == got[0] > 1
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == 9


def test_packing_round_trip(spark):
    data, df = rows(spark)
    plain = Tokenizer.from_file(path_of("word_bpe_49k.json"))
    got = pack(df, with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    ids = {}
    for r in sorted(got, key=lambda r: r.sequence_id):
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and 1 << r.bucket == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
        ids.setdefault(r.doc_id, {}).setdefault(r.start, []).append((r.token_ids, r.doc_tokens))
    for d, t, *_ in data:
        if d == 5:
            continue
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        have = [i for start in sorted(ids[d]) for i in ids[d][start][0][0]]
        assert have == want and ids[d][0][0][1] == len(want)
    assert pack(df.limit(0)).collect() == []


def test_binary_pieces():
    for n in [*range(1, 300), 4095, 4096, 4097, 123_457]:
        parts = binary_pieces(n, 64)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 64 for p in parts)
        assert len({p for p in parts if p < 64}) == len([p for p in parts if p < 64])
