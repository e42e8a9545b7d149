"""Periodic runs against a search of every period at every word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidepool.llm import registry
from tidepool.llm.periodic_runs import Factors, blocks, periodic_runs, runs_of, vocabulary

SF = "/root/testdata/sf0.001"


def plain_runs(words, exponent, least):
    """(start, length, period) by comparing every word with those that follow."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                found.setdefault((i, length), q)  # smaller periods come first
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def strings(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        letters = r.choice(["a", "ab", "abc", "abcdefgh"])
        unit = [r.choice(letters) for _ in range(r.randrange(1, 9))]
        s = []
        while len(s) < r.randrange(60):
            s += r.choice([unit, unit * r.randrange(1, 7), [r.choice(letters)] * r.randrange(1, 6), [r.choice(letters)]])
        yield s
    a, b = ["a"], ["a", "b"]
    for _ in range(9):
        a, b = b, b + a
    yield from (b, ["a"] * 300, ["a", "a", "b"] * 70, [], ["x"])


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_plain(seed):
    many = list(strings(seed, 120))
    words = np.array([ord(c) for s in many for c in s], np.int64)
    owner = np.repeat(np.arange(len(many)), [len(s) for s in many])
    starts = np.cumsum([0, *map(len, many)])
    got = [[] for _ in many]
    for s, n, q in zip(*(x.tolist() for x in runs_of(words, owner)), strict=True):
        i = int(owner[s])
        got[i].append((s - int(starts[i]), n, q))
    for mine, s in zip(got, many, strict=True):
        assert mine == plain_runs(s, 2, 2), "".join(s)


def test_parts_by_definition():
    s = "abaabaabbaabab" * 3 + "cacacabb"
    f = Factors(np.array([ord(c) for c in s]), np.zeros(len(s), np.int64))
    assert [s[i:] for i in f.suffixes] == sorted(s[i:] for i in range(len(s)))
    for a, b in ((a, b) for a in range(len(s)) for b in range(a + 1, len(s))):
        after = next((k for k in range(len(s) - b) if s[a + k] != s[b + k]), len(s) - b)
        before = next((k for k in range(a) if s[a - k - 1] != s[b - k - 1]), a)
        assert f.agree_after(np.array([a]), np.array([b])) == after and f.agree_before(np.array([a]), np.array([b])) == before
    at, mine = 0, blocks(f).tolist()
    for block in mine[:-1]:
        assert block == at
        at += max([1, *(k for k in range(1, len(s) - at + 1) if s.find(s[at : at + k], 0, at + k - 1) >= 0)])
    assert mine[-1] == at == len(s)
    squares = {s[i : i + 2 * k] for i in range(len(s)) for k in range(1, (len(s) - i) // 2 + 1) if s[i : i + k] == s[i + k : i + 2 * k]}
    kinds = {s[i : i + 2 * k] for i, k in zip(*vocabulary(f), strict=True)}
    assert kinds == {x for x in squares if (x[: len(x) // 2] * 2).find(x[: len(x) // 2], 1) == len(x) // 2}


def contract(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0 and w:
        g, n = zlib.crc32(str(doc).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 4, 6)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(plain_collapsed(w, runs))))


def held_against_contract(got, rows):
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted((contract(d, t) for d, t in rows), key=repr)


def test_query_equals_plain(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in rows if len(r.text or "") < 6000]
    assert len(short) > 100
    got = {r.doc_id: r for r in registry.queries()["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows) and sum(r.n_runs > 0 for r in got.values()) > 10
    held_against_contract([got[d] for d, _ in short], short)


def test_odd_rows(spark):
    r = random.Random(4)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a " * 5, "a " * 6, "\x1c\x85\xa0 " * 7, "ha ha\tha\nha\x0bha ha ho", "x y " * 300 + "z", " lead " + "q " * 9]
    texts += [" ".join(r.choice(["a", "b"]) for _ in range(200)) for _ in range(60)]
    data = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "b " * 20, 2, "y"), (3, "a", 1, None), (3, "a", 1, None), (-7, "c d " * 30, 1, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, runs int, n_words string")
    from tidepool.llm.periodic_runs import collapsed_runs

    held_against_contract(collapsed_runs(df).collect(), [(d, t) for d, t, *_ in data])
    assert collapsed_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(df, min_exponent=1)
    squares = periodic_runs(df, min_exponent=2, min_length=2).collect()
    for row in squares:
        if row.doc_id is not None and row.doc_id > 3:
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[row.doc_id])
            assert [tuple(x) for x in row.runs] == plain_runs(words, 2, 2) and row.n_words == len(words)


def test_a_very_long_text(spark):
    words = [f"w{i % 977}" for i in range(200_000)] + ["end"]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = periodic_runs(df).first()
    assert [tuple(x) for x in row.runs] == [(0, 200_000, 977)] and row.collapsed == " ".join(words[:977] + ["end"])
