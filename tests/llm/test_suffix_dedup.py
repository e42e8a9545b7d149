"""Suffix arrays and removal of repeats against plain versions."""

import hashlib
import random
from collections import Counter

import pytest

from tidepool.llm.suffix_dedup import common_prefixes, remove_repeats, repeated_windows, suffix_array


def test_suffix_array():
    r = random.Random(1)
    cases = [[0], [1, 0], [1, 1, 1, 0], [2, 1, 2, 1, 2, 1, 0], [1, 2, 3, 1, 2, 3, 1, 2, 0]]
    for _ in range(3000):
        cases.append([r.randrange(1, r.choice([2, 3, 5, 30]) + 1) for _ in range(r.randrange(1, 60))] + [0])
    cases.append([1, 2] * 2000 + [0])
    cases.append([r.randrange(1, 4) for _ in range(20_000)] + [0])
    for s in cases:
        sa = suffix_array(s)
        if len(s) < 100:
            assert sa == sorted(range(len(s)), key=lambda i: s[i:]), s
        assert sorted(sa) == list(range(len(s)))
        lcp = common_prefixes(s, sa)
        for i in range(1, len(sa)):
            a, b, h = sa[i - 1], sa[i], lcp[i]
            assert s[a : a + h] == s[b : b + h] and s[a + h] < s[b + h]


def test_windows_of_fragments():
    r = random.Random(2)
    for _ in range(60):
        base = bytes(r.choice(b"ab") for _ in range(120))
        frags = []
        for _ in range(r.randrange(2, 7)):
            a, b = r.randrange(0, 40), r.randrange(80, 121)
            data = bytearray(base[a:b])
            for _ in range(r.randrange(0, 3)):
                data[r.randrange(len(data))] = 99
            frags.append((bytes(data), 50 - a, r.random() < 0.2))
        seen = Counter((d[t : t + 32], t - p) for d, p, _ in frags for t in range(len(d) - 31))
        anywhere = Counter(d[t : t + 32] for d, p, _ in frags for t in range(len(d) - 31))
        for (d, p, known), got in zip(frags, repeated_windows(frags, 32), strict=True):
            want = {t for t in range(len(d) - 31) if seen[d[t : t + 32], t - p] > 1}
            assert known or want <= set(got) <= {t for t in range(len(d) - 31) if anywhere[d[t : t + 32]] > 1}
            assert not (known and got)


def plain(rows, length):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "on", "é", "er", "and", "x" * 7, "ing", "😀"])
    prose = lambda n: " ".join(word() + word() for _ in range(n))
    passages = [prose(length // 4) for _ in range(3)]
    rows = []
    for i in range(50):
        parts = [prose(r.randrange(0, 30))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            a = r.randrange(0, len(p) // 2)
            parts += [p[a : a + r.randrange(length // 2, 2 * length)], prose(r.randrange(0, 8))]
        rows.append((i, r.choice(["", " "]).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (3, rows[4][1]), (None, rows[5][1] + "!"), (200, None), (201, ""), (202, "z" * (3 * length)), (203, "ab" * 2 * length)]
    return rows


@pytest.mark.parametrize(("length", "k", "group"), [(40, 12, 20_000), (40, 12, 3), (200, 64, 20_000), (33, 8, 20_000)])
def test_removal(spark, length, k, group):
    rows = corpus(length, length)
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, key string")
    got = remove_repeats(df, length, k, group).collect()
    assert sorted((tuple(x) for x in got), key=repr) == plain(rows, length)


def test_removal_where_tables_are_too_large_to_send(spark, monkeypatch):
    """Texts that have nothing to remove stay where they are; a text of many rows is found all the same."""
    from tidepool.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
    rows = corpus(5, 40) + [(1000 + i, "one text that many rows have, long enough for a window") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1000, 3):
        monkeypatch.setattr(suffix_dedup, "MOST_HOT", hot)
        got = remove_repeats(df, 40, 12).collect()
        assert sorted((tuple(x) for x in got), key=repr) == plain(rows, 40)


def test_the_bounded_map_misses_no_key(spark):
    from tidepool.llm.common import maybe_in

    keys = spark.range(0, 40_000, 3).selectExpr("unhex(md5(string(id))) AS key")
    marked = maybe_in(spark.range(40_000).selectExpr("id", "unhex(md5(string(id))) AS key"), keys, "key", "may").collect()
    assert len(marked) == 40_000 and all(r.may for r in marked if r.id % 3 == 0) and sum(r.may for r in marked if r.id % 3) < 100
    assert not any(r.may for r in maybe_in(spark.range(9).selectExpr("id", "unhex(md5(string(id))) AS key"), keys.limit(0), "key", "may").collect())


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).collect() == []
