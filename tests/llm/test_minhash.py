"""Near duplicates against all pairs."""

import random

from tidepool.llm import minhash
from tidepool.llm.minhash import near_duplicates, without_duplicates


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    k = min(size, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def plain(docs, size, percent):
    sets = [(d, shingles(t, size)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(d, len(s), None if d is None else find(d)) for d, s in sets]


def corpus(seed=5):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    docs = []
    for base in range(30):
        text = [r.choice(words) for _ in range(r.choice([3, 6, 30, 120, 300]))]
        docs.append(" ".join(text))
        for _ in range(r.randrange(0, 5)):
            text = list(text)
            for _ in range(r.randrange(0, 1 + len(text) // 25)):
                text[r.randrange(len(text))] = r.choice(words)
            docs.append("  ".join(text).upper() if r.random() < 0.3 else " ".join(text))
    passage = [r.choice(words) for _ in range(60)]  # a shared passage alone is no near copy
    docs += [" ".join(passage + [r.choice(words) for _ in range(60)]) for _ in range(20)]
    chain = [r.choice(words) for _ in range(200)]  # each like the next, the ends not like each other
    for i in range(12):
        chain = [*chain[:15 * i], "new%d" % i, *chain[15 * i + 1 :]]
        docs.append(" ".join(chain))
    docs += [None, "", " \n\t ", "one two", "ONE  two", "one two three four", "one two three four five", "é É", "É é"]
    r.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


def check(spark, docs, size, percent):
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, node int, bucket string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, size, percent).collect()), key=repr)
    assert got == sorted(plain(docs, size, percent), key=repr)


def test_all_pairs(spark):
    check(spark, corpus(), 4, 80)


def test_odd_rows(spark):
    docs = corpus(6)[:40] + [(None, "one two"), (7, "one two"), (7, "quite another text of its own here"), (2, "quite another text of its own here")]
    check(spark, docs, 5, 80)
    kept = {(r.doc_id, r.kept) for r in near_duplicates(spark.createDataFrame([(None, "a"), (1, None), (2, "a"), (3, "A")], "doc_id long, text string")).collect()}
    assert kept == {(None, True), (1, True), (2, True), (3, False)}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_stay_one_of_each_group(spark):
    docs = corpus(7)[:60] + [(None, "one two three four five six"), (None, "one two three four five six"), (4, corpus(7)[0][1])]
    docs += [(docs[5][0], docs[5][1])] * 2 + [(900, " ".join(f"long{i % 1500}" for i in range(3000))), (901, " ".join(f"long{i % 1500}" for i in range(2900)))]
    df = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(docs)], "doc_id long, text string, _row int, bucket string")
    ranked = sorted(docs, key=lambda x: (x[0] is None, x[0] or 0))
    want = [ranked[i] for i, _, c in plain([(i, x[1]) for i, x in enumerate(ranked)], 5, 80) if c == i]
    got = without_duplicates(df.withColumnRenamed("_row", "n"))
    assert got.columns == ["doc_id", "text", "n", "bucket"]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == sorted(want, key=repr)


def test_small_places(spark, monkeypatch):
    """Hubs and buckets dealt over many places give the same."""
    monkeypatch.setattr(minhash, "PAIRS_IN_PLACE", 2)
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 1)
    check(spark, corpus(8), 4, 80)


def test_broadcasts_none(spark, monkeypatch):
    """Texts that are told by bit maps instead of broadcast ids are the same."""
    df = spark.createDataFrame(corpus(9), "doc_id long, text string").repartition(4)
    want = sorted(without_duplicates(df).collect())
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", -1)
    check(spark, corpus(9), 4, 80)
    assert sorted(without_duplicates(df).collect()) == want


def test_shuffles_little(spark):
    """A text without a partner sends its digest and the hashes of its bands, neither bands nor sketch nor text."""
    written = lambda: spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    n, before = 3000, written()
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(n)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert got.filter("kept").count() == n
    assert written() - before < 700 * n
