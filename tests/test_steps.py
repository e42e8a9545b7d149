"""Steps that every note takes: what they cost is bounded, and they give what plain versions give."""

import random
import re

from pyspark.sql import functions as F

from tidepool.functions import redaction as R
from tidepool.functions import text as T
from tidepool.operators import decide as D
from tidepool.operators import index as I
from tidepool.operators import plan as P
from tidepool.operators import siblings as SB
from tidepool.plans import scan


def _texts(n=600):
    r = random.Random(9)
    some = ["#", "# ", "a", "word", " ", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", " ", " ", "\xa0", "　", "\t", "## h", "\U0001f600"]
    return [None, "", *("".join(r.choice(some) for _ in range(r.randrange(9))) for _ in range(n))]


def test_body_facts_against_plain_versions(spark):
    df = spark.createDataFrame([(t,) for t in _texts()], "t string")
    lines = F.transform(F.split("t", T.LINE_BREAK, -1), lambda x: F.regexp_replace(x, r"(?U)^\s+", ""))
    bare = T.strip(F.regexp_replace("t", "\r\n", "\n"))
    plain = {
        "empty": ~F.exists(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#"))),
        "headings": F.size(F.regexp_extract_all("t", F.lit(T.HEADING), F.lit(0))),
        "digest": F.left(F.sha2(T.strip(F.regexp_replace(bare, r"^# [^\n]*(?:\n|$)", "")), 256), F.lit(16)),
    }
    new = {"empty": T.body_is_empty("t"), "headings": T.heading_count("t"), "digest": T.body_digest("t")}
    rows = df.select("t", *[plain[c].alias(f"old_{c}") for c in plain], *[new[c].alias(c) for c in new]).collect()
    assert [r.t for r in rows if any(r[c] != r[f"old_{c}"] for c in new)] == []
    assert {r.empty for r in rows} == {True, False, None}


def test_blank_lines_are_passed_once(spark):
    """Many blank lines take no more than their number; whether lines differ is known without a list of them."""
    df = spark.createDataFrame([("\n \n" * 200_000,), ("\n \n" * 200_000 + "x",)], "t string").select(T.body_is_empty("t").alias("e"))
    assert [r.e for r in df.collect()] == [True, False]
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_are_tried_where_one_may_begin(monkeypatch):
    tried = []

    class Counted:
        def __init__(self, p):
            self.p = p

        def match(self, text, *at):
            tried.append(at[0])
            return self.p.match(text, *at)

    monkeypatch.setattr(R, "_NUMBERS", [(label, Counted(p), valid) for label, p, valid in R._NUMBERS])
    assert R.hide_numbers("word " * 1000 + "call +1 (555) 123-4567 or 123-45-6789 now") == ("word " * 1000 + "call [PHONE] or [SSN] now", ["PHONE", "SSN"])
    assert len(tried) < 200


def test_number_readings_against_every_place():
    """The same readings as from a trial at every place, also around odd digits and signs."""
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(["1", "55", "4111", "+", "(", ")", "-", " ", ".", "a", "١", "\n", "123-45-6789"]) for _ in range(r.randrange(14)))
        starts = {m.start() for p in (R.PHONE, R.CARD, R.SSN) for m in re.finditer(f"(?=({p}))", text)}
        assert starts <= {m.start() for m in R._NUMBER_START.finditer(text)}


def test_lists_are_put_together_once(spark):
    """The filter on lists of titles does not repeat how they are made."""
    notes = spark.createDataFrame([(f"d/{i:03}.md", "x") for i in range(200)], "rel string, body string")
    found = SB.siblings(I.index(P.plan(notes), scan.TODAY))
    filters = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "other_note_titles" in x]
    assert filters and not any("lambda" in x for x in filters)
    got = {r.rel: r.other_note_titles for r in found.collect()}
    assert got["d/100.md"] == [f"{i:03}" for i in range(80)] and got["d/003.md"] == [f"{i:03}" for i in range(81) if i != 3]


def test_votes_by_column_and_by_expression(spark):
    words = [w for _, _, some in D.KEYWORDS for w in some] + ["scan", "duplicate", "", " 　"]
    df = spark.createDataFrame([(a.upper(), f"{b}") for a in words for b in words], "t string, e string")
    both = D.keyword_voted(df, F.col("t"), F.col("e")).withColumn("one", D.keyword_vote(F.col("t"), F.col("e")))
    assert all(r.vote == r.one for r in both.collect())


def test_plain_patterns_behind_the_look_at_a_whole_list(spark):
    """A list is redacted as each of its texts is, whichever of them holds something."""
    held = ["sk-" + "a" * 20, "a@b.example", "Beaʀer", "BAſIC abcdefgh1234=", "Bearer abcdefghijklmnop", "xoxb-" + "1" * 12, "nothing", "secret_access_key=" + "A" * 24, ""]
    df = spark.createDataFrame([([a, b],) for a in held for b in held], "l array<string>")
    for r in R.redacted_together(df.withColumn("was", F.col("l")), {"l": F.col("l")}).collect():
        want = [R.redact_text(t) for t in r.was]
        assert r.l == [t for t, _ in want] and r.hits == sorted({h for _, hits in want for h in hits})


def test_bodies_are_looked_through_in_one_pass(spark):
    """No plan searches every body for one word or pattern after the other; what may hold something is told by one automaton."""
    notes = spark.createDataFrame([("d/1.md", "sk-" + "a" * 20), ("d/2.md", "plain words")], "rel string, body string")
    redacted = R.redacted_together(notes, {"body": F.col("body")})._jdf.queryExecution().optimizedPlan().toString()
    assert "_look_udf" in redacted and "explode(array(CASE WHEN __look" in redacted
    voted = D.keyword_voted(notes, F.col("rel"), F.col("body"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_some_keyword" in voted and "explode(array(CASE WHEN _any" in voted
    indexed = I.index(P.plan(notes), scan.TODAY)
    assert "_plain_words" in indexed._jdf.queryExecution().optimizedPlan().toString()


def test_words_in_bytes_against_the_pattern(spark):
    blanks = [*T.WHITE, "\x1c", "\x1f", "\u180e", "\u200b", "\x00", "\x08", "\x0e"]
    r = random.Random(3)
    texts = [None, "", *_texts(300), *("".join(r.choice([*blanks, "a", "ü", "日本", "\U0001f600"]) for _ in range(r.randrange(12))) for _ in range(1500))]
    texts += ["a b\tc", " a", "a ", "a"] * 3
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.words_counted(F.col("t")).alias("new"), T.word_count("t").alias("old"), T._plain_words("t").alias("plain")).collect()
    assert [r.t for r in rows if r.new != r.old] == []
    assert sum(r.plain is not None for r in rows) > 300 and all(r.plain in (None, r.old) for r in rows)


def test_no_text_with_something_is_passed_by(spark):
    """A look at a whole list finds all that the patterns in their own words find."""
    r = random.Random(8)
    marks = [w for words in R.HELD.values() for some in words.values() for w in some] + [w for words in R.HELD_IN_ANY_CASE.values() for w in words]
    texts = [v for w in marks for v in (w, f"x{w}y", f"\n{w.upper()}", w.swapcase())] + [*R.LIKE_ASCII, "ſecret", "baſic"]
    plain = R._looked_through(R.pa.array([[t] for t in texts])).field("plain").to_pylist()
    low = lambda t: any(w in t.lower() for words in R.HELD_IN_ANY_CASE.values() for w in words) or any(c in t for c in R.LIKE_ASCII)
    own = lambda t: any(w in t for words in R.HELD.values() for some in words.values() for w in some)
    assert plain == [low(t) or own(t) for t in texts]
    numbers = ["".join(r.choice(["1", "55", "4111", "+", "(", "-", " ", "é", "٣", "a", "\n"]) for _ in range(r.randrange(24))) for _ in range(3000)]
    d = spark.createDataFrame([(t,) for t in numbers], "t string").select("t", F.regexp_like("t", F.lit(R.MAY_BE_NUMBER)).alias("may")).collect()
    seen = R._looked_through(R.pa.array([[x.t] for x in d])).field("number").to_pylist()
    assert all(s for x, s in zip(d, seen, strict=True) if x.may) and any(x.may for x in d) and not all(seen)
    lists = R.pa.array([["a", None, "https://u:hunter2@h.example"], [], None, ["b"], ["call 555-123-4567"]])
    assert R._looked_through(lists.slice(0)).to_pylist() == [
        {"urls": ["a", None, "https://[URL_CREDENTIAL]@h.example"], "plain": True, "number": False}, {"urls": None, "plain": False, "number": False},
        {"urls": None, "plain": False, "number": False}, {"urls": None, "plain": False, "number": False}, {"urls": None, "plain": False, "number": True},
    ]
    assert R._looked_through(lists.slice(3)).field("number").to_pylist() == [False, True]


def test_digests_and_excerpts_at_their_edges(spark):
    """Texts that end in blanks or have other line ends, and those as long in bytes as an excerpt in characters."""
    ends = ["", " ", "\n", "\r\n", "　", "\x1c", "é", "# h", "# h\n", "\r"]
    df = spark.createDataFrame([(a + b + c,) for a in ends for b in ("", "x", "# t\nx", "a\r\nb") for c in ends], "t string")
    bare = T.strip(F.regexp_replace("t", "\r\n", "\n"))
    headless = F.when(F.startswith(bare, F.lit("# ")), T.strip(F.regexp_replace(bare, r"^# [^\n]*(?:\n|$)", ""))).otherwise(bare)
    assert df.filter(T.body_digest("t") != F.left(F.sha2(headless, 256), F.lit(16))).count() == 0
    long = spark.createDataFrame([(c * n,) for c in "aé日\U0001f600" for n in (399, 400, 401, 100, 101, 200, 201)], "t string").select("t", T.excerpt("t", 400).alias("e"), T.truncated("t", 400).alias("cut"))
    assert all(r.e == r.t[:400] and r.cut == (len(r.t) > 400) for r in long.collect())
