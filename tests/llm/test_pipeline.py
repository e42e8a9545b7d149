"""The pipeline's stages against plain versions, on a small part of the kinds of rows it meets."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_line_dedup import plain as plain_lines  # noqa: E402
from tests.llm.test_minhash import plain as plain_groups  # noqa: E402
from tidepool.llm import quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder):
    r = random.Random(11)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re"]) for _ in range(r.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(40)) for i in range(4)]
    docs, labels = [], []
    for i in range(160):
        kind = r.random()
        text = prose(r.randrange(40, 120))
        if kind < 0.15:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind < 0.25:
            text += "\n" + r.choice(items)[1] + "\n" + prose(10)
        elif kind < 0.4 and docs:
            words = r.choice(docs)[1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if r.random() < 0.3:
            text = "menu of the site\n" + text
        docs.append((i, text, "en", r.choice(["a", "b"]), len(text)))
        if r.random() < 0.8:
            labels.append((i, int(kind >= 0.15), 0))
    docs += [(500, None, None, None, None), (501, "", "en", "a", 0), (None, prose(60), "en", "b", 5), (None, prose(20) + "\n" + items[0][1], "en", "b", 5), (None, docs[9][1], "en", "b", 5), (None, "BAD!! " * 60, "en", "a", 5), (7, docs[7][1], "en", "a", 1)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def rows(df):
    return sorted(map(tuple, df.select(corpus_pipeline.COLUMNS).collect()), key=repr)


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    items = write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    at = rows(docs)
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(corpus_pipeline.materialise(stage(spark, results[-1], folder), "test"))
    # quality: each row by its own text
    texts = sorted({x[1] or "" for x in at})
    model = quality.fit(docs, labels)
    scores = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    good = {texts[r.doc_id] for r in scores if r.score >= quality.THRESHOLD}
    want = [x for x in at if (x[1] or "") in good]
    assert len(want) < len(at) and rows(results[1]) == want
    # lines
    lines = {}
    for d, text, n in plain_lines([(i, x[3], x[1]) for i, x in enumerate(want)], 0.05, 5, fold=True):
        lines[d] = text, n
    want = sorted(((x[0], lines[i][0], x[2], x[3], len(lines[i][0]) if lines[i][1] else x[4]) for i, x in enumerate(want)), key=repr)
    assert any(n for _, n in lines.values()) and rows(results[2]) == want
    # near duplicates: every row is a document, also without an id or with another's
    ranked = sorted(want, key=lambda x: (x[0] is None, x[0] or 0))
    want = sorted((ranked[i] for i, _, c in plain_groups([(i, x[1]) for i, x in enumerate(ranked)], 5, 80) if c == i), key=repr)
    assert len(want) < len(ranked) and rows(results[3]) == want
    # benchmark: whole items, or none of them
    before = len(want)
    want = [x for x in want if not (x[1] and any(i in x[1] for _, i in items))]
    assert len(want) < before and rows(results[4]) == want
    # packing: every document in pieces, and run() gives the same
    pieces = results[5].collect()
    totals = {}
    for p in pieces:
        totals.setdefault(p.doc_id, []).append((p.length, p.doc_tokens))
    assert set(totals) == {x[0] for x in want}
    key = lambda df: sorted((repr(r.doc_id), r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(results[5])
