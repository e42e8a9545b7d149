"""Personal data against the given patterns and plain counting."""

import hashlib
import random
import re
from collections import Counter
from math import log

from tidepool.llm.pii import find, personal_data, sanitised

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]


def texts(n=400):
    r = random.Random(9)
    bits = ["a@b.co", "@", ".", "+", "-", " ", "x.y", "1.2.3.4", "300.1.1.1", "001.0255.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111112", "+1 (555) 010-9999", "+49", "12", "é", "😀", "_", "%", "(", ")", "foo", "b.c.d", "\n", "٣", "5500005555555559", "7" * 30]
    out = ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(n)]
    return [*out, "", None, "1 " * 9000 + "a@b.cd", "a" * 50_000, "9" * 50_000, "1.2.3.4 " * 700, "+1" * 3000, "a@b.c.@d.e+x@y.z"]


def test_base_spans(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "k", []) for i, t in rows], "doc_id long, text string, base string, terms array<string>")
    for r in personal_data(df).collect():
        want = plain(rows[r.doc_id][1] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (rows[r.doc_id], r.spans[:300], line[:300])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in PATTERNS]
        assert r.spans.startswith(line)
    assert personal_data(df.limit(0)).collect() == []


def plain_terms(docs, disclosure=0.9, chance=0.05):
    """The disclosing terms of texts, by counting; true for those that always come with an entity they disclose."""
    pages = {}
    for t in docs:
        held = {(k, t[a:b].lower()) for k, a, b in plain(t)}
        bare = t.lower()
        for p in PATTERNS.values() if held else ():
            bare = re.sub(p, " 0 ", bare)
        pages[t] = held, set(re.findall(r"[^\W\d_]{3,}", bare))
    n, n_t = len(pages), Counter(w for _, words in pages.values() for w in words)
    alike, want = Counter(n_t.values()), {}
    for e in {e for held, _ in pages.values() for e in held}:
        met = Counter(w for held, words in pages.values() if e in held for w in words)
        n_e = sum(e in held for held, _ in pages.values())
        for w, n_te in met.items():
            k = n_t[w]
            if n_e == n or log(n * n_te / (k * n_e)) < disclosure * log(n / n_e):
                continue
            bound = alike[k] * (k * n_e / (n_te * n)) ** n_te
            if n_te < k:
                bound *= (k * (n - n_e) / ((k - n_te) * n)) ** (k - n_te)
            if bound <= chance:
                want[w] = want.get(w, False) or n_te == k
    return want


def test_disclosing_terms(spark):
    r = random.Random(2)
    common = ["alpha", "beta", "gamma", "delta", "common"]
    docs = []
    for i in range(600):
        docs.append(" ".join(r.choice(common) for _ in range(12)))
    for i in range(4):
        docs.append(f"Zanzibar gala {r.choice(common)} {i} mail zara@home.org common ZANZIBAR")
    docs.append("zanzibar alone, mail nothing")
    docs += ["secretword only mail bob@home.org common %d" % i for i in range(3)] + ["copied quaxword eve@x.org"] * 9
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = plain_terms(docs)
    assert {"secretword", "zanzibar", "quaxword"} <= want.keys() and not {"common", "mail"} & want.keys()
    for row in find(df).collect():
        spans = [(x.start, x.end) for x in row.terms]
        base = plain(row.text)
        hits = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", row.text) if m[0].lower() in want]
        assert spans == [s for s in hits if not any(a < s[1] and s[0] < b for _, a, b in base)]
    clean = {r.doc_id: r.text for r in sanitised(df).collect()}
    # zanzibar also comes without the entity, gala never does
    assert clean[600].startswith("[TERM]  ") and "[EMAIL]" in clean[600] and "@" not in clean[600]


def marked(df, *doc_ids):
    """The texts of the term spans of some rows of the query, a list a row."""
    texts = {r.doc_id: r.text for r in df.collect()}
    spans = {r.doc_id: r.spans for r in personal_data(df).collect()}
    found = {i: [x.split(":") for x in spans[i].split(",") if x] for i in doc_ids}
    return [[texts[i][int(a) : int(b)] for kind, a, b in found[i] if kind == "term"] for i in doc_ids]


def test_terms_of_an_entity_in_one_text(spark):
    docs = [f"common words alpha{'abc'[i % 3]} number {i}" for i in range(400)] + ["common quaxword eve@x.org"] * 5 + ["common pairword one +1 (555) 010-9999", "common pairword two +1 (555) 010-9999"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert marked(df, 400, 404, 405, 0) == [["quaxword"], ["quaxword"], ["pairword", "one"], []]
    clean = {r.doc_id: r.text for r in sanitised(df).collect()}
    assert clean[400] == "common  [EMAIL]" and clean[0] == docs[0]


def test_terms_of_a_frequent_entity(spark):
    docs = [f"common words number {i}" for i in range(60)] + [f"common hotword {i} mail desk@home.org" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert marked(df, 60, 89, 0) == [["hotword", "mail"], ["hotword", "mail"], []]
    everywhere = spark.createDataFrame([(i, f"common {i} mail desk@home.org") for i in range(20)], "doc_id long, text string")
    assert marked(everywhere, 0) == [[]]


def letters(i):
    return "".join("abcdefghij"[int(c)] for c in f"{i:05d}")


def test_rarity_and_co_occurrence_disagree(spark):
    # every text has a word of its own, so that the one beside an address tells nothing; met three times, a word tells
    docs = [f"common words own{letters(i)}" for i in range(500)]
    docs += [f"common words own{letters(900 + i)} nightjar amy@home.org" for i in range(3)]
    docs += [f"common words own{letters(950)} bob@home.org"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert marked(df, 500, 502, 503, 0) == [["nightjar"], ["nightjar"], [], []]
    assert plain_terms(docs) == {"nightjar": True}
    # where few words are rare, a single meeting is enough, and the same texts without their own words show it
    bare = [re.sub(r" own\w+", "", t) + f" {i}" for i, t in enumerate(docs)]
    bare[503] += " kestrel"
    df = spark.createDataFrame(list(enumerate(bare)), "doc_id long, text string")
    assert marked(df, 503, 0) == [["kestrel"], []]


def test_terms_by_counting(spark):
    r = random.Random(5)
    names = [f"w{letters(i)}" for i in range(300)]
    people = [f"p{i}@home.org" for i in range(25)]
    docs = []
    for _ in range(700):
        words = [names[min(int(r.expovariate(0.02)), 299)] for _ in range(r.randrange(0, 20))]
        who = r.sample(people, r.choice([0, 0, 0, 1, 2, 5]))
        docs.append(" ".join(words + who + [f"with{letters(int(p[1:p.index('@')]))}" for p in who if r.random() < 0.8]))
    docs += docs[:40] * 3 + [None, "", ""]
    df = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(docs)], "doc_id long, text string")
    want = plain_terms([t or "" for t in docs])
    rows = find(df).collect()
    assert len(rows) == len(docs) and want
    got = {row.text[x.start : x.end].lower() for row in rows for x in row.terms}
    assert got == set(want)
    assert {g for row in rows for g in row.gone} == {w for w, gone in want.items() if gone}
