"""Literal rows for operators that the driver's tables have no cases for.

Samples of credentials are put together from pieces, so that no scanner takes this file for a leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATHS = [
    "notes/a.md", "notes/deep notes/b.md", "family/c.md", "Private/d.md", "_Inbox/e.md", "Inbox_/f.md", "inboxes/g.md", ".secrets/h.md",
    ".obsidian/i.md", "_tidepool/quarantine/j.md", "notes/.hidden.md", "top.md", "private-equity/k.md", "a b/c.md", "a/b.md", "a-b.md",
    "My Private Notes/l.md", "personalised/m.md", "notes/private.md", "work/familyroom/n.md",
]

VAULT = [
    ("hub.md", "# Hub\n" + " ".join(f"[[n{i}]]" for i in range(1, 9)) + " [[notes/n1|again]]"),
    *[(f"notes/n{i}.md", f"# Note {i}\nbody of note number {i} and [[hub]]") for i in range(1, 9)],
    ("notes/copy.md", "# Another heading\nbody of note number 1 and [[hub]]\r\n"),
    ("notes/lonely.md", "nobody links here"),
    ("notes/embeds.md", "![[picture.png]] ![x](draw.md) [y](sub/n1.md#part) [[missing]] [[n1.md]] [web](https://example.com) [[embeds]] [[n2#sec|t]]"),
    ("other/n1.md", "a second note of that name\n\n[[other/n1]] [[/notes/n2]]"),
    ("empty/e.md", "# only\n\n## headings\n"),
    ("empty/blank.md", ""),
    ("keys/k.md", "the token is " + "gh" + "p_" + "a1B2" * 9),
    ("keys/mail.md", "write to jane@example.com about it"),
    ("family/secret.md", "links to [[hub]]"),
    (".hidden/x.md", "also [[hub]]"),
]

BODIES = [
    (1, "# A\n\ntext here\n"), (2, "# B\r\n\r\ntext here"), (3, "  text here  "), (4, "# only"), (5, "\n\n"), (6, "## a\n  # b\n"), (7, "###### six\n####### seven\n#no"),
    (8, "text\n# not first"), (9, ""), (10, "#\n\n#\tx"),
]


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def paths(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(p,) for p in PATHS], "rel string")


def vault_notes(spark: SparkSession) -> DataFrame:
    return _frame(spark, VAULT, "rel string, body string")


def bodies(spark: SparkSession) -> DataFrame:
    return _frame(spark, BODIES, "id int, body string")


FILES = [
    ("ok.md", b"---\ntitle: A Title\naliases: [one, ' two ', '']\ncreated: 2025-03-04\n---\nbody\r\nmore"),
    ("bom.md", "﻿---\nalias: solo\ntidepool:\n  locked: true\n---\nbody".encode()),
    ("bad.md", b"---\nkey: [unclosed\n---\nbody stays"),
    ("scalar.md", b"---\njust words\n---\nbody"),
    ("none.md", b"# no header\n---\nnot one\n---\n"),
    ("latin.md", "caf\xe9".encode("latin-1")),
    ("end.md", b"---\ndate: 2024-01-02 10:00:00\ncreated_at: 2024-01-05\n---"),
]


def files(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(r, bytearray(c)) for r, c in FILES], "rel string, content binary")


def dates(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "2025-05-06", None, None, "2025-12-01"), (2, None, "2025-07-08T10:00", None, "2025-12-01"), (3, "2025-05-06", "2025-01-02", "2024-01-01", "2025-12-01"),
        (4, None, None, "2025-02-03", "2025-12-01"), (5, "soon", None, None, "2025-12-31"), (6, None, None, None, "2026-02-01"),
    ]
    return _frame(spark, rows, "id int, created string, date string, stamp string, modified string").withColumn("modified", F.to_timestamp("modified"))


def stamps(spark: SparkSession) -> DataFrame:
    rows = [(1, 0.5, 0.54), (2, 0.5, 0.56), (3, None, 0.1), (4, 0.1, None), (5, None, None), (6, 1.0, 1.0)]
    return _frame(spark, rows, "id int, old double, new double")


def field_names(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(n,) for n in ("ok", "_x1", "1x", "a-b", "a b", "", "x" * 64, "x" * 65, "é")], "name string")


MESSAGES = [
    "HTTP 402", "status=402, stop", "1402 items", "4021", "Payment Required", "out of credits", "timeout", "error 500", "402", "402 (payment needed)", "There are no available API credits",
    "error: it took far more than twenty-four characters, 402", "error 1402", "no available worker",
]


def messages(spark: SparkSession) -> DataFrame:
    return _frame(spark, list(enumerate(MESSAGES)), "id int, message string")


SECRETS = [
    ("key " + "sk-" + "a" * 20 + " end", ["KEY"]), ("\\n" + "gh" + "p_" + "b" * 24, ["KEY"]), ("x" + "gh" + "p_" + "b" * 24, []),
    ("id " + "AKIA" + "A1B2C3D4E5F6G7H8", ["KEY"]), ("bot" + "123456789" + ":A" + "b" * 34, []), ("/bot" + "123456789" + ":A" + "b" * 34 + "/send", ["KEY"]),
    ("https://hooks.slack" + ".com/services/T0/B0/abc", ["WEBHOOK"]), ("eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, ["JWT"]),
    ("-----BEGIN RSA PRIVATE " + "KEY-----\nabc\n-----END RSA PRIVATE " + "KEY----- after", ["PEM"]), ("-----BEGIN PRIVATE " + "KEY-----\nabc\ndef\n\nprose", ["PEM"]),
    ("Authorization: " + "Bearer abcdefghijkl123", ["BEARER"]), ("Authorization: " + "Basic dXNlcjpwYXNz", ["BEARER"]), ("Basic understanding of things", []),
    ("aws_secret_access_key = " + "A1b2" * 10, ["AWS_SECRET"]), ("'SecretAccessKey': '" + "A1b2" * 10 + "'", ["AWS_SECRET"]), ("mail jane.doe@example.com now", ["EMAIL"]),
    ("postgres://" + "user:p@ss:w0rd#1@" + "localhost/db", ["URL_CREDENTIAL"]), ("postgres://" + "user:password@" + "localhost", []),
    ("http://localhost:8080/x?email=" + "a@b.com", ["EMAIL"]), ("redis://" + ":{DB_PASSWORD}@" + "h", []), ("redis://" + ":{MyRealPassword}@" + "h", ["URL_CREDENTIAL"]),
    ("call 555-201-4477 today", ["PHONE"]), ("order 555-201-4477", []), ("+44 20 7946 0958", ["PHONE"]), ("qty 2 4111 1111 1111 1111", ["CARD"]),
    ("123-45-6789 4111 1111 1111 1111", ["CARD", "SSN"]), ("4111 1111 1111 1111-123-45-6789", ["CARD", "SSN"]), ("0000000000000000", []), ("1700000000000 ms", []), ("ssn 123-45-6789.", ["SSN"]),
]


def secrets(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(i, t) for i, (t, _) in enumerate(SECRETS)], "id int, text string")


EXCERPTS = [
    (1, "t", "has a [KEY] in it"), (2, "AKIA", "x"), (3, "t", "drank coffee"), (4, "Lorem Ipsum", "x"), (5, "t", "  \n"), (6, "Nightly", "the scan ran"), (7, "daily run", "nothing"),
    (8, "digest", "x"), (9, "t", "We decided to go, a duplicate"), (10, "t", "run pytest"), (11, "t", "see also this"), (12, "t", "plain"), (13, "t", "coffee and https://x"),
]


def excerpts(spark: SparkSession) -> DataFrame:
    return _frame(spark, EXCERPTS, "id int, title string, excerpt string")


def votes(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "reference", 0.9, 1.4, 0.1, 0.9, []), (2, "reference", 0.5, 1.4, 0.1, 0.9, []), (3, "needs_review", 0.9, 1.0, 0.1, 0.9, ["EMAIL"]), (4, "junk", 0.9, 0.1, 0.1, 0.9, []),
        (5, "junk", 0.9, 0.6, 0.1, 0.9, []), (6, "reference", 0.9, 1.4, 0.7, 0.9, []), (7, "reference", 0.9, 1.4, 0.1, 0.2, []), (8, "reference", 0.5, 1.4, 0.9, 0.1, ["JWT", "KEY"]),
        (9, "reference", 0.55, 1.4, 0.699, 0.201, ["CARD", "PHONE"]),
    ]
    return _frame(spark, rows, "id int, bucket string, bucket_confidence double, persist double, contains_secret double, safe_to_leave_in_git double, hits array<string>")


RUNS = [
    ("r1", "2025-01-01", None, True, "aaa", 1, "m1", 16000, None, False), ("r2", "2025-01-02", None, False, "aaa", 1, "m1", 16000, "d1", False),
    ("r3", "2025-01-03", "r2", False, "bbb", 1, "m2", 16000, None, False), ("r4", "2025-01-04", "r3", True, "bbb", 2, "m2", 4000, None, True),
    ("c1", "2024-01-01", "c2", True, "aaa", 1, "m1", 16000, None, False), ("c2", "2024-01-02", "c1", True, "aaa", 1, "m1", 16000, None, False),
    ("c3", "2024-01-03", "lost", True, "aaa", 1, "m1", 16000, None, False), ("r5", "2025-01-05", None, False, "bbb", 2, "m2", 4000, None, True), ("r6", "2025-01-06", None, True, "bbb", 2, "m2", 4000, None, True),
]


def runs(spark: SparkSession) -> DataFrame:
    schema = "run_id string, started string, resumed_from string, finished boolean, taxonomy string, state_version int, model_requested string, excerpt_cap int, denylist string, include_sensitive boolean"
    return _frame(spark, RUNS, schema).withColumn("sensitive_parts", F.lit("family,private"))


def chain_rows(spark: SparkSession) -> DataFrame:
    rows = []
    for pos in range(3):
        for line in range(12):
            kind = "error" if (line + pos) % 5 == 4 else "vote"
            judge = "local" if line % 6 == 5 else "judged"
            rows.append((pos, line, f"p{line}", kind, judge, f"k{(line * 7 + pos) % 9}", f"b{pos}{line % 3}"))
    return _frame(spark, rows, "chain_pos int, line int, path string, kind string, judge string, key string, bucket string")


SNAPSHOT = "path string, kind string, judge string, bucket string, confidence double, action string, exact_duplicate_of string, suggested_bucket string, truncated boolean, findings array<string>, skipped string"


def snapshot_rows() -> tuple[list, list]:
    def vote(path, bucket="reference", action="frontmatter", dup=None, suggested=None, cut=False, findings=()):
        return (path, "vote", "judged", bucket, 0.8, action, dup, suggested, cut, list(findings), None)

    before = [
        vote("same"), vote("moved"), vote("in"), vote("out", suggested="reference"), vote("held"), vote("freed", action="quarantine"), vote("dup"), vote("redup", dup="x"),
        vote("cap", cut=True), vote("fixed", findings=["f"]), vote("broke"), ("locked", "skip", None, None, None, None, None, None, None, [], None),
        ("opened", "skip", None, None, None, None, None, None, None, [], "locked"), vote("failed"), vote("gone1", findings=["g"]), vote("gone2"),
    ]
    after = [
        vote("same"), vote("moved", "junk"), vote("in", suggested="reference"), vote("out"), vote("held", action="quarantine"), vote("freed"), vote("dup", dup="same"), vote("redup", dup="y"),
        vote("cap"), vote("fixed"), vote("broke", findings=["f"]), ("locked", "skip", None, None, None, None, None, None, None, [], "locked"), vote("opened"),
        ("failed", "error", None, None, None, None, None, None, None, [], None), vote("new1", action="quarantine", suggested="needs_review"), vote("new2", dup="same", findings=["f", "h"]),
        vote("new3", suggested="junk"), ("new4", "skip", None, None, None, None, None, None, None, [], "locked"), ("new5", "error", None, None, None, None, None, None, None, [], None),
    ]
    return before, after


def snapshots(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    before, after = snapshot_rows()
    return _frame(spark, before, SNAPSHOT), _frame(spark, after, SNAPSHOT)


RECORDS = [
    '{"id": "a", "sent": {"text": "write to jane@example.com", "n": 42, "x": 0.5, "ok": true, "none": null}, "unread": 1}',
    '{"id": "b", "sent": {"card": 4242424242424242, "tel": 15551234567, "tags": ["one", "call 555-201-4477"]}}',
    "", '{"id": "c", "sent": {"quote": "say \\"hi\\"\\n\\u00e9", "empty": []}}',
]


def record_lines(spark: SparkSession) -> DataFrame:
    return _frame(spark, list(enumerate(RECORDS, 1)), "line long, value string")


#: id, what redaction hit, and the answer: pick, its confidence, the secret's probability; no answer for e.
RECORD_VOTES = [
    ("a", [], "keep", 0.9, 0.1), ("b", [], "drop", 0.54, 0.1), ("c", [], "drop", 0.2, 0.7), ("d", ["EMAIL", "KEY"], "keep", 0.9, 0.1), ("e", [], None, None, None), ("f", ["EMAIL"], "keep", 0.55, 0.69),
]


def record_votes(spark: SparkSession) -> DataFrame:
    rows = [(i, "fresh" if "KEY" not in hits else "held", hits, i, 10, *rest) for i, hits, *rest in RECORD_VOTES]
    rows += [("g", "fresh", [], "b", 10, None, None, None), ("h", "fresh", [], "e", 10, None, None, None)]
    df = _frame(spark, rows, "id string, disposition string, hits array<string>, key string, payload_chars int, pick string, sure double, secret double")
    return df.withColumn("same_as", F.when(F.col("id").isin("g", "h"), F.col("key")))


REPORT = (
    "kind string, judge string, path string, plan_ord string, bucket string, suggested_bucket string, confidence double, bucket_probabilities map<string,double>, bucket_margin double,"
    " action string, reason string, redacted array<string>, redacted_own array<string>, quarantine_triggers array<string>, truncated boolean, age_source string,"
    " graph struct<words int, age_days int, out_links int>, payload_chars int, input_tokens long, skipped string, error string,"
    " excerpt_chars int, cached boolean, question_chars int, taxonomy string, exact_duplicate_of string"
)


def report_data() -> list:
    """A run with every cause: a dominant bucket, ties, needs_review, a hot folder of cut notes, local rows, skips, errors."""
    rows = []

    def vote(path, bucket, probabilities, suggested=False, words=200, cut=False, **more):
        top = sorted(probabilities.values(), reverse=True)
        margin = round(top[0] - (top[1] if len(top) > 1 else 0), 3)
        row = dict(
            kind="vote", judge="judged", path=path, plan_ord=path, bucket=bucket, suggested_bucket=bucket if suggested else None, confidence=round(top[0] - 0.01, 3),
            bucket_probabilities=probabilities, bucket_margin=margin, action="frontmatter", reason="normal vote", redacted=[], redacted_own=[], quarantine_triggers=[],
            truncated=cut, age_source="frontmatter" if words % 2 else "mtime", graph=(words, 0 if words % 3 else 30, words % 4), payload_chars=1000 + words, input_tokens=300 + words, skipped=None, error=None,
            excerpt_chars=16_000 if cut else 900, cached=False, question_chars=2000, taxonomy="aaa", exact_duplicate_of=None,
        )
        rows.append(row | more)

    for i in range(62):
        vote(f"ref{i % 4}/n{i:03}.md", "reference", {"reference": 0.8, "code_note": 0.15, "junk": 0.05}, words=100 + i)
    for i in range(12):
        vote(f"log/2025-{i:02}.md", "log_entry", {"log_entry": 0.9, "ephemeral": 0.1}, words=60 + i)
    for i in range(10):
        vote(f"mix/t{i}.md", "code_note", {"code_note": 0.45, "reference": 0.41, "junk": 0.14}, suggested=True, words=90 + i)
    for i in range(4):
        vote(f"mix/u{i}.md", "ephemeral", {"ephemeral": 0.4, "junk": 0.35, "log_entry": 0.25}, suggested=True, words=30 + i)
    for i in range(6):
        vote(f"odd/e{i}.md", "needs_review", {"needs_review": 0.7, "junk": 0.3}, suggested=True, words=20 + i)
    for i in range(6):
        vote(f"odd/r{i}.md", "junk", {"junk": 0.5, "needs_review": 0.45, "ephemeral": 0.05}, suggested=True, words=300 + i)
    for i in range(22):
        vote(f"hot/h{i:02}.md", "reference", {"reference": 0.5, "durable_memory": 0.4, "junk": 0.1}, suggested=i < 14, words=5000 + i, cut=i < 14, redacted=["EMAIL"])
    # what tells the pile from what a policy sends to review: sure of needs_review, and unsure but held
    vote("odd/sure.md", "needs_review", {"needs_review": 0.91, "junk": 0.09}, suggested=True, words=21)
    vote("odd/held.md", "junk", {"junk": 0.31, "reference": 0.3, "ephemeral": 0.2}, words=40, action="quarantine", reason="contains_secret above threshold", quarantine_triggers=None)
    for i in range(3):
        vote(f"odd/p{i}.md", "needs_review", {"needs_review": 0.5, "junk": 0.4, "ephemeral": 0.1}, suggested=True, words=70 + i)
    for i in range(2):
        vote(f"ref1/cached{i}.md", "reference", {"reference": 0.8, "junk": 0.2}, cached=True, question_chars=None, input_tokens=900, exact_duplicate_of="ref0/n000.md" if i else None)
    vote("held/v.md", "reference", {"reference": 0.9, "junk": 0.1}, action="quarantine", reason="contains_secret above threshold", quarantine_triggers=["contains_secret"])
    for i, (reason, triggers) in enumerate([("local redaction hit: KEY", ["local:KEY"]), ("empty body or headings only: decided locally", []), ("exact duplicate of ref0/n000.md: decided locally", [])]):
        vote(f"loc/l{i}.md", "junk", {"junk": 1.0}, judge="local", reason=reason, quarantine_triggers=triggers, action="quarantine" if triggers else "frontmatter", redacted=["KEY"] if triggers else [], redacted_own=["KEY"] if triggers else [], input_tokens=0)
    blank = dict.fromkeys(rows[0], None)
    rows += [blank | {"kind": "skip", "path": p, "plan_ord": p, "skipped": s} for p, s in (("Private/x.md", "sensitive"), (".o/y.md", "hidden"), ("family/z.md", "sensitive"))]
    rows += [blank | {"kind": "error", "path": "err/a.md", "plan_ord": "err/a.md", "error": "TimeoutError"}]
    return [tuple(r.values()) for r in rows]


def report_rows(spark: SparkSession) -> DataFrame:
    return _frame(spark, report_data(), REPORT)
