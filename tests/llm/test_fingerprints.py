"""Fingerprints against a plain winnowing."""

import hashlib
import random

import xxhash

from tidepool.llm.fingerprints import edited_likeness, selections


def plain(text, k, w):
    if not text:
        return []
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] or [text]
    values = [((h - (1 << 64) if h >> 63 else h) >> 17, -i) for i, g in enumerate(grams) for h in [xxhash.xxh64(g.encode(), seed=42).intdigest()]]
    kept = []
    for i in range(max(1, len(values) - w + 1)):
        h, p = min(values[i : i + w])
        if not kept or kept[-1][0] != -p:
            kept.append((-p, h))
    return kept


def text_of(kept):
    return " ".join(f"{h & (1 << 64) - 1:x}@{p}" for p, h in kept)


def near(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(seed=1):
    r = random.Random(seed)
    out = ["", "a", "ab" * 30, "x" * 300, "é😀" * 120, "one two three"]
    out += ["".join(r.choice("abc dé😀") for _ in range(r.choice([3, 20, 70, 80, 81, 150, 400, 900]))) for _ in range(40)]
    return [*out, *out[2:9], None]


def test_selections_in_blocks(spark):
    for k, w, block in [(16, 64, 1 << 15), (16, 64, 40), (4, 8, 16), (3, 5, 7), (5, 1, 64)]:
        df = spark.createDataFrame([(t,) for t in texts() if t is not None], "text string")
        for row in df.select("text", selections(df.text, k, w, block).alias("s")).collect():
            assert [(x.p, x.h) for x in row.s] == plain(row.text, k, w), (row.text, k, w, block)


def test_neighbours_and_seams(spark):
    for k, w, buckets in [(16, 64, 5), (4, 8, 1), (16, 64, 8)]:
        docs = [(i * 7 % 101, t) for i, t in enumerate(texts(k))] + [(None, "last of all")]
        df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, bucket int")
        order = sorted(((d, t or "") for d, t in docs), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        want = {}
        for (d, a), (_, b) in zip(order, [*order[1:], order[0]], strict=True):
            half = len(a) // 2
            edited = a[: len(a) - half] + b[:half]
            f, g, e = plain(a, k, w), plain(b, k, w), plain(edited, k, w)
            want[d] = (len(a), hashlib.sha256(edited.encode()).hexdigest(), text_of(f), text_of(e), near(f, e), near(f, g))
        for r in edited_likeness(df, k, w, buckets).collect():
            got = (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
            assert got == want.pop(r.doc_id), r.doc_id
        assert not want


def test_few_rows(spark):
    schema = "doc_id long, text string"
    assert edited_likeness(spark.createDataFrame([], schema)).collect() == []
    (row,) = edited_likeness(spark.createDataFrame([(3, "abc")], schema)).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    same = edited_likeness(spark.createDataFrame([(3, "abcd"), (3, "abcd"), (3, None)], schema)).collect()
    assert len(same) == 3


def test_short_texts_with_half_in_common_share_hashes(spark):
    r = random.Random(5)
    docs = ["".join(r.choice("abcdefghij klmnop") for _ in range(n)) for n in range(46, 158)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert [x.doc_id for x in edited_likeness(df).collect() if x.near_edited == 0] == []
