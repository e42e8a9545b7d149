"""Benchmark decontamination against edit distance over whole texts."""

import random

from tidepool.llm.decontaminate import contaminated, decontaminate, normalised, segments_of


def least_edits(part, text):
    """Fewest edits between part and any region of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(part, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != d), last[j] + 1, row[-1] + 1))
    return min(row)


def plain(docs, items, q, segment, stride, rate):
    found = set()
    for d, text in docs:
        for i, item in items:
            for _, part in segments_of(normalised(item or ""), segment, stride):
                e = int(rate * len(part))
                while e and len(part) - q + 1 - q * e < 1:
                    e -= 1
                if len(part) >= q and least_edits(part, normalised(text or "")) <= e:
                    found.add((d, i))
    return found


def edited(r, text, n):
    text = list(text)
    for _ in range(n):
        at = r.randrange(len(text))
        text[at : at + r.choice([0, 1, 1])] = r.choice(["", "z", "qz", " "])
    return "".join(text)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "é"]) for _ in range(r.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(r.choice([2, 8, 14, 20, 30]))) for i in range(12)] + [(50, None), (51, "ab"), (52, "same " * 20)]
    docs = []
    for d in range(50):
        text = prose(r.randrange(5, 40))
        if r.random() < 0.7:
            item = r.choice(items[:12])[1]
            a = r.randrange(0, max(1, len(item) // 3))
            cut = item[a : r.randrange(len(item) * 2 // 3, len(item) + 1)]
            text += r.choice([" ", ". ", "\n"]) + edited(r, cut, r.randrange(0, 6)).title() + "!  " + prose(r.randrange(0, 10))
        docs.append((d, text))
    return [*docs, (100, None), (101, ""), (102, "ab"), (103, "same " * 19), (104, items[4][1])], items


def test_all_regions(spark):
    for seed, q, segment, stride, rate in [(1, 6, 40, 20, 0.1), (2, 12, 96, 48, 0.05), (3, 5, 30, 10, 0.0)]:
        docs, items = corpus(seed)
        df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
        bench = spark.createDataFrame(items, "item_id long, text string")
        want = plain(docs, items, q, segment, stride, rate)
        assert want
        for block in (4 << 20, 200):
            got = contaminated(df, bench, q, segment, stride, rate, block).collect()
            assert {(r.doc_id, r.item_id) for r in got} == want
            texts = dict(docs)
            for r in got:
                assert 0 <= r.start < r.end <= len(texts[r.doc_id])


def test_exact_passage_span(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away from the old grey wolf tonight."
    df = spark.createDataFrame([(1, "Before: " + item + " After"), (None, item), (2, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: r for r in contaminated(df, bench).collect()}
    assert set(got) == {1, None} and got[1].edits == 0
    assert ("Before: " + item + " After")[got[1].start : got[1].end] == item[:-1]
    assert [r.doc_id for r in decontaminate(df, bench).collect()] == [2]
    assert contaminated(df.limit(0), bench).collect() == []
    assert contaminated(df, bench.limit(0)).collect() == []
