"""Language and quality: a plain version, held-out accuracy, odd rows."""

import random
import sys
from collections import Counter
from zlib import crc32

from tidepool.llm.language_id import Ranker, _order, grams_of, identify, language_id, profiles, words_of
from tidepool.llm.quality import features, fit, quality, score, shape_of


def prose(r, parts, n):
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


LANGS = {"xx": ["the", "ing", "er", "and"], "yy": ["ung", "sch", "ein", "keit"], "zz": ["ción", "ado", "que", "ñ"]}


def corpus(seed=1, n=240):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        lang = r.choice(list(LANGS))
        docs.append((i, prose(r, LANGS[lang], r.randrange(3, 60)), None if r.random() < 0.1 else lang))
    return docs


def test_language(spark):
    docs = corpus()
    odd = [(1000, None, "xx"), (1001, "12 34 ²", "xx"), (1002, "", None), (None, "the and thing", None), (3, "the the", "xx"), (1003, "ung" * 30_000, None)]
    df = spark.createDataFrame([(*d, 0.5) for d in docs + odd], "doc_id long, text string, lang string, score double")
    got = language_id(df).collect()
    assert len(got) == len(docs) + len(odd)
    by_id = {r.doc_id: r for r in got}
    truth = {d: lang for d, _, lang in docs if lang and crc32(str(d).encode()) % 5 == 0}
    assert truth and sum(by_id[d].lang_pred == lang for d, lang in truth.items()) >= 0.97 * len(truth)
    for r in got:
        assert r.held_out == (crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) and 0 <= r.score <= 1
    assert all(by_id[d].lang_pred == "und" and by_id[d].score == 0 for d in (1000, 1001, 1002))
    assert by_id[1003].lang_pred == "yy"
    assert language_id(df.limit(0)).collect() == []
    assert {r.lang_pred for r in identify(df, {}).collect()} == {"und"}


def test_copies_teach_once(spark):
    docs = [(t, lang) for _, t, lang in corpus(3, 60)]
    schema = "text string, lang string"
    copied = docs + [docs[0]] * 400 + [("kwa kwi", "ww")] * 500 + [("kwa kwi", None)]
    want = {}
    for lang in sorted({lang for _, lang in copied if lang}):
        plain = Counter()
        for text, _ in {d for d in copied if d[1] == lang}:
            for w, n in words_of(text).items():
                for g in grams_of(w):
                    plain[g] += n
        want[lang] = sorted(plain, key=lambda g: (-plain[g], g.encode()))[:50]
    assert profiles(spark.createDataFrame(copied, schema), profile=50) == want


def test_distance_against_a_plain_one(spark):
    docs = corpus(2, 60)
    found = profiles(spark.createDataFrame(docs, "doc_id long, text string, lang string"), profile=50)
    for most in (150_000, 20):  # the memo is emptied on the way
        ranker = Ranker(found, 50, 3, most)
        for _, text, _ in docs:
            counts = Counter()
            for w, n in words_of(text).items():
                for g in grams_of(w):
                    counts[g] += n
            own = sorted(counts, key=lambda g: (-counts[g], _order(g)))[:50]
            want = []
            for grams in found.values():
                place = {g: i for i, g in enumerate(grams)}
                want.append(sum(abs(place[g] - i) if g in place else 50 for i, g in enumerate(own)) / (50 * len(own)))
            assert [round(x, 9) for x in ranker.distances(text)] == [round(x, 9) for x in want]


def test_quality(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        good = r.random() < 0.8
        text = prose(r, LANGS["xx"], r.randrange(20, 90))
        docs.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        if r.random() < 0.7:
            labels.append((i, int(good), 0))
    docs += [(900, None), (901, ""), (None, "the and"), (3, docs[3][1]), (902, "ab " * 50_000)]
    labels += [(None, 1, 0), (901, None, 0), (5, 1, 0)]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, quality int")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality(df, table).collect()
    assert len(got) == len(docs)
    by_id = {x.doc_id: x for x in got}
    truth = {d: q for d, q, _ in labels if d is not None and q is not None and d < 400 and crc32(str(d).encode()) % 5 == 0}
    assert sum(by_id[d].predicted == q for d, q in truth.items()) >= 0.95 * len(truth)
    assert by_id[900].score == by_id[901].score == 0.0
    assert quality(df.limit(0), table).collect() == []
    assert {x.score for x in quality(df, table.limit(0)).collect()} == {0.0}
    # exact cosine voting, one document at a time
    model = fit(df, table)
    texts = [t or "" for _, t in docs[:40]]
    import numpy as np

    for text, x in zip(texts, score(df.limit(40), model).orderBy("doc_id").collect(), strict=True):
        v = model.latent(features(text)[None])[0]
        near = sorted(((float(max(0, v @ w)), float(y)) for w, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[:25]
        want = sum(s**4 * y for s, y in near) / sum(s**4 for s, _ in near)
        assert abs(want - x.score) < 0.02
    assert np.isfinite(model.vectors).all()


def test_shapes():
    assert [shape_of(t) for t in ("Word", "WORD!!", "word***", "|", "a1b22", "Über,")] == ["Aa", "A!", "a*", "|", "a0a0", "Aa,"]


def test_words_and_grams_of_odd_texts():
    """Letters that are none by themselves, marks, digits and blanks; n-grams by length, then place."""
    assert grams_of("ab") == ["a", "b", " a", "ab", "b ", " ab", "ab "] and grams_of("é", 2) == ["é", " é", "é "]
    assert words_of("Ab ab, x1y _z ١٢ ² ⅠⅠ \U0001f600") == {"ab": 2, "x": 1, "y": 1, "z": 1}
    assert words_of("") == {}


def test_words_are_filtered_once_each(monkeypatch):
    looked = []

    class Word(str):
        def isalpha(self):
            looked.append(self)
            return str.isalpha(self)

    class Pattern:
        def findall(self, text):
            return [Word(w) for w in text.split()]

    monkeypatch.setattr(sys.modules[words_of.__module__], "_WORD", Pattern())
    assert words_of("so so so müch") == {"so": 3, "müch": 1} and len(looked) == 2
