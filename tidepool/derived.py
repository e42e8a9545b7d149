"""Rows that queries read: the driver's tables, with what they lack added by rules over ids.

Each is written twice, as a DataFrame here and as SQL beside it, so that the operators' SQL reads the same
rows. Which case a row is follows from its id; how many rows there are follows from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool import fixtures as X


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql_literal, v)) + "]"
    if isinstance(v, dict):
        return "MAP {" + ", ".join(f"{sql_literal(k)}: {sql_literal(x)}" for k, x in v.items()) + "}"
    text = v.replace("'", "''")
    for c in sorted({c for c in text if c < " "}):
        text = text.replace(c, f"' || chr({ord(c)}) || '")
    return f"('{text}')" if "||" in text else f"'{text}'"


def _literal(v) -> Column:
    if isinstance(v, (list, tuple)):
        return F.array(*map(_literal, v)) if v else F.array().cast("array<string>")
    if isinstance(v, dict):
        return F.create_map(*[F.lit(x) for kv in v.items() for x in kv])
    return F.lit(v)


def pick(values: list, at: Column) -> Column:
    """The value at a place that follows from an id."""
    return F.get(F.array(*map(_literal, values)), at.cast("int"))


def sql_pick(values: list, at: str) -> str:
    return f"{sql_literal(list(values))}[({at}) + 1]"


def _id() -> Column:
    return F.col("doc_id")


def div(n: int, of: Column | None = None) -> Column:
    return F.floor((_id() if of is None else of) / n)


# --- paths, bodies, dates ----------------------------------------------------------------------


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """rel: a path for every document, in folders of every kind."""
    stem = F.regexp_replace(pick(X.PATHS, _id() % len(X.PATHS)), r"\.md$", "")
    return table(spark, sf, "documents").select(F.concat(stem, _id().cast("string"), F.lit(".md")).alias("rel"))


PATHS = f"(SELECT regexp_replace({sql_pick(X.PATHS, f'doc_id % {len(X.PATHS)}')}, '\\.md$', '') || doc_id || '.md' AS rel FROM documents)"
_BODIES = [b for _, b in X.BODIES]


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """id, body: an odd beginning, and for a third of the documents their text after it."""
    rest = F.when(_id() % 3 == 0, F.coalesce("text", F.lit(""))).otherwise("")
    return table(spark, sf, "documents").select(_id().alias("id"), F.concat(pick(_BODIES, _id() % len(_BODIES)), rest).alias("body"))


BODIES = f"(SELECT doc_id AS id, {sql_pick(_BODIES, f'doc_id % {len(_BODIES)}')} || CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE '' END AS text FROM documents)"


def dates(spark: SparkSession, sf: str) -> DataFrame:
    """id, created, date, stamp (texts, some no dates) and modified of orders."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = lambda c: c.cast("string")
    return table(spark, sf, "orders").select(
        key.alias("id"), F.when(key % 3 == 0, text(day)).when(key % 7 == 0, "soon").alias("created"), F.when(key % 4 == 0, F.concat(text(F.date_add(day, -9)), F.lit("T10:00"))).alias("date"),
        F.when(key % 5 == 0, text(F.date_add(day, 40))).alias("stamp"), F.to_timestamp(F.date_add(day, 10000)).alias("modified"),
    )


DATES = """(SELECT o_orderkey AS id, least(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE END, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE - 9 END) AS made,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE + 40 END AS stamped, o_orderdate::DATE + 10000 AS modified FROM orders)"""


def stamps(spark: SparkSession, sf: str) -> DataFrame:
    """id, old, new: scores that moved by little, much, or came or went."""
    score = lambda n, gap: F.when(_id() % gap != 0, (_id() * n % 41) / 40.0)
    return table(spark, sf, "documents").select(_id().alias("id"), score(1, 9).alias("old"), score(3, 7).alias("new"))


STAMPS = "(SELECT doc_id AS id, CASE WHEN doc_id % 9 <> 0 THEN (doc_id % 41) / 40.0::DOUBLE END AS o, CASE WHEN doc_id % 7 <> 0 THEN (doc_id * 3 % 41) / 40.0::DOUBLE END AS n FROM documents)"
FIELD_NAMES = ["ok", "_x1", "1x", "a-b", "a b", "", "x" * 62, "x" * 65, "é"]


def field_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat(pick(FIELD_NAMES, _id() % 9), F.when(_id() % 2 == 0, _id().cast("string")).otherwise("")).alias("name"))


FIELDS = f"(SELECT {sql_pick(FIELD_NAMES, 'doc_id % 9')} || CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE '' END AS name FROM documents)"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """id, message: what a service says, for every order."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(key.alias("id"), F.concat(pick(X.MESSAGES, key % len(X.MESSAGES)), F.lit(" / request "), key.cast("string")).alias("message"))


MESSAGES = f"(SELECT o_orderkey AS id, {sql_pick(X.MESSAGES, f'o_orderkey % {len(X.MESSAGES)}')} || ' / request ' || o_orderkey AS message FROM orders)"
_EXCERPTS = [t for _, t, _ in X.EXCERPTS], [e for _, _, e in X.EXCERPTS]


def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """id, title, excerpt: every title with every excerpt, some with the document's text."""
    n = len(X.EXCERPTS)
    text = F.when(_id() % 5 == 0, F.concat(F.lit(" "), F.coalesce("text", F.lit("")))).otherwise("")
    return table(spark, sf, "documents").select(_id().alias("id"), pick(_EXCERPTS[0], _id() % n).alias("title"), F.concat(pick(_EXCERPTS[1], div(n) % n), text).alias("excerpt"))


EXCERPTS = f"(SELECT doc_id AS id, {sql_pick(_EXCERPTS[0], 'doc_id % 13')} AS title, {sql_pick(_EXCERPTS[1], 'doc_id // 13 % 13')} || CASE WHEN doc_id % 5 = 0 THEN ' ' || coalesce(text, '') ELSE '' END AS excerpt FROM documents)"
_HITS = [[], ["EMAIL"], ["JWT", "KEY"], ["CARD", "PHONE"], [], ["EMAIL", "KEY"], [], [], ["AWS_SECRET", "PEM"], [], [], [], []]


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """A vote for every document, over the whole range of every score."""
    score = lambda n: (_id() * n % 101) / 100.0
    return table(spark, sf, "documents").select(
        _id().alias("id"), pick(["reference", "needs_review", "junk", "junk", "code_note"], _id() % 5).alias("bucket"), score(1).alias("bucket_confidence"), ((_id() % 21) / 10.0).alias("persist"),
        score(7).alias("contains_secret"), score(13).alias("safe_to_leave_in_git"), pick(_HITS, _id() % 13).alias("hits"),
    )


VOTES = f"""(SELECT doc_id AS id, {sql_pick(["reference", "needs_review", "junk", "junk", "code_note"], "doc_id % 5")} AS bucket, (doc_id % 101) / 100.0::DOUBLE AS conf, (doc_id % 21) / 10.0::DOUBLE AS persist,
    (doc_id * 7 % 101) / 100.0::DOUBLE AS secret, (doc_id * 13 % 101) / 100.0::DOUBLE AS git, {sql_pick(_HITS, "doc_id % 13")} AS hits FROM documents)"""

# --- a linked vault ---------------------------------------------------------------------------------

_TOKEN = "gh" + "p_" + "a1B2" * 9
_HUB = "# Hub\n" + " ".join(f"[[{i}]]" for i in range(1, 9)) + " [[1|again]]"


def linked_vault(spark: SparkSession, sf: str) -> DataFrame:
    """rel, body, undecodable: documents that link to each other by name, by path, as embeds, to nothing and to themselves.

    Names repeat across folders; there are hubs, empty notes, tokens, notes that can't be decoded, and
    private and hidden folders.
    """
    text, c = F.coalesce("text", F.lit("")), lambda n: F.concat(F.lit(""), (_id() * n % 300).cast("string"))
    top = F.when(F.col("source") == "src1", "family").when(F.col("source") == "src2", ".hidden").otherwise(F.coalesce("source", F.lit("unknown")))
    name = F.concat(div(300).cast("string"), F.lit("/"), (_id() % 300).cast("string"))
    way = _id() % 8
    body = (
        F.when(way == 1, F.concat(text, F.lit(" [["), c(7), F.lit("]]")))
        .when(way == 2, F.concat(text, F.lit(" [["), top, F.lit("/0/"), c(5), F.lit("|alias]] and [x]("), c(3), F.lit(".md#part)")))
        .when(way == 3, F.concat(text, F.lit(" ![[picture.png]] ![["), c(11), F.lit("]] [[missing "), _id().cast("string"), F.lit("]] [["), c(1), F.lit("]]")))
        .when(way == 4, _HUB).when(way == 5, "# only\n\n## headings\n")
        .when(_id() % 16 == 6, F.concat(text, F.lit(" the token is " + _TOKEN))).otherwise(text)
    )
    bad = _id() % 41 == 40
    return table(spark, sf, "documents").select(
        F.concat(top, F.lit("/"), name, F.lit(".md")).alias("rel"), F.when(~bad, body).alias("body"), F.when(bad, "not UTF-8").alias("undecodable")
    )


LINKED = f"""(SELECT *, top || '/' || doc_id // 300 || '/' || doc_id % 300 || '.md' AS rel, doc_id % 41 = 40 AS bad, CASE WHEN doc_id % 41 = 40 THEN NULL ELSE CASE doc_id % 8
      WHEN 1 THEN text || ' [[' || doc_id * 7 % 300 || ']]' WHEN 2 THEN text || ' [[' || top || '/0/' || doc_id * 5 % 300 || '|alias]] and [x](' || doc_id * 3 % 300 || '.md#part)'
      WHEN 3 THEN text || ' ![[picture.png]] ![[' || doc_id * 11 % 300 || ']] [[missing ' || doc_id || ']] [[' || doc_id % 300 || ']]'
      WHEN 4 THEN {sql_literal(_HUB)} WHEN 5 THEN '# only' || chr(10) || chr(10) || '## headings' || chr(10)
      ELSE CASE WHEN doc_id % 16 = 6 THEN text || ' the token is {_TOKEN}' ELSE text END END END AS body
    FROM (SELECT doc_id, coalesce(text, '') AS text, CASE source WHEN 'src1' THEN 'family' WHEN 'src2' THEN '.hidden' ELSE coalesce(source, 'unknown') END AS top FROM documents))"""

# --- rows of a run ------------------------------------------------------------------------------------

#: doc_id % 20 -> folder, bucket, probabilities, suggested, and what else differs.
CASES: dict[tuple[int, ...], tuple[str, str, dict[str, float], bool]] = {
    tuple(range(10)): ("ref", "reference", {"reference": 0.8, "code_note": 0.15, "junk": 0.05}, False),
    (10,): ("log", "log_entry", {"log_entry": 0.9, "ephemeral": 0.1}, False),
    (11,): ("mix", "code_note", {"code_note": 0.45, "reference": 0.41, "junk": 0.14}, True),
    (12,): ("mix", "ephemeral", {"ephemeral": 0.4, "junk": 0.35, "log_entry": 0.25}, True),
    (13,): ("odd", "needs_review", {"needs_review": 0.5, "junk": 0.4, "ephemeral": 0.1}, True),
    (14,): ("odd", "junk", {"junk": 0.5, "needs_review": 0.45, "ephemeral": 0.05}, True),
    (15, 16): ("hot", "reference", {"reference": 0.5, "durable_memory": 0.4, "junk": 0.1}, True),
    (17,): ("loc", "junk", {"junk": 1.0}, False),
    (19,): ("held", "reference", {"reference": 0.9, "junk": 0.1}, False),
}
_LOCAL = ["local redaction hit: KEY", "empty body or headings only: decided locally", "exact duplicate of ref0/n0.md: decided locally"]


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a run over the documents, with every cause there is: see CASES.

    Case 17 is decided locally, 18 withheld, and of 19 a part failed, a part was held by vote.
    """
    k, turn = _id() % 20, div(20)
    by = lambda of: _by_case(k, of)
    skip, failed, local = k == 18, (k == 19) & (turn % 4 == 0), k == 17
    vote = ~skip & ~failed
    held = (k == 19) & ~failed
    v = lambda c: F.when(vote, c)
    probabilities = by(lambda case: _literal(case[2]))
    top = by(lambda case: F.lit(max(case[2].values())))
    gap = by(lambda case: F.lit(round(sorted([*case[2].values(), 0.0])[-1] - sorted([*case[2].values(), 0.0])[-2], 3)))
    chars = F.coalesce("n_chars", F.lit(0)).cast("long")
    words = F.when(k == 12, _id() % 45).otherwise(60 + chars % 700)
    cut = (k.isin(15, 16)) & (_id() % 3 != 0)
    first = F.when(turn % 3 == 0, F.array(F.lit("KEY"))).otherwise(_literal([]))
    cached = (k == 3) & (turn % 2 == 0)
    folder = F.concat(by(lambda case: F.lit(case[0])), F.when(k < 10, (_id() % 4).cast("string")).otherwise(""))
    place = F.concat(F.when(skip, "Private").when(failed, "err").otherwise(folder), F.lit("/n"), _id().cast("string"), F.lit(".md"))
    triggers = F.when(local & (turn % 3 == 0), _literal(["local:KEY"])).when(held & (turn % 2 == 1), _literal(["contains_secret"])).when(held, F.lit(None)).otherwise(_literal([]))
    reason = F.when(local, pick(_LOCAL, turn % 3)).when(held, "contains_secret above threshold").otherwise("normal vote")
    return table(spark, sf, "documents").select(
        F.when(skip, "skip").when(failed, "error").otherwise("vote").alias("kind"), v(F.when(local, "local").otherwise("judged")).alias("judge"), place.alias("path"), place.alias("plan_ord"),
        v(by(lambda case: F.lit(case[1]))).alias("bucket"), v(by(lambda case: F.lit(case[1] if case[3] else None))).alias("suggested_bucket"), v(F.round(top - 0.01 * (_id() % 3 + 1), 3)).alias("confidence"),
        v(probabilities).alias("bucket_probabilities"), v(gap).alias("bucket_margin"), v(F.when(held | (local & (turn % 3 == 0)), "quarantine").otherwise("frontmatter")).alias("action"), v(reason).alias("reason"),
        v(F.when(cut, _literal(["EMAIL"])).when(local, first).otherwise(_literal([]))).alias("redacted"), v(F.when(local, first).otherwise(_literal([]))).alias("redacted_own"), v(triggers).alias("quarantine_triggers"),
        v(cut).alias("truncated"), v(F.when(_id() % 2 == 1, "frontmatter").otherwise("mtime")).alias("age_source"),
        v(F.struct(words.cast("int").alias("words"), F.when(_id() % 3 == 0, 30).otherwise(0).alias("age_days"), (_id() % 4).cast("int").alias("out_links"))).alias("graph"),
        v(chars + 1000).cast("int").alias("payload_chars"), v(F.when(local, 0).otherwise(300 + div(3, chars))).cast("long").alias("input_tokens"), F.when(skip, pick(["sensitive", "hidden"], turn % 2)).alias("skipped"),
        F.when(failed, pick(["TimeoutError", "ValueError"], div(4, turn) % 2)).alias("error"), v(F.when(cut, 16_000).otherwise(900)).cast("int").alias("excerpt_chars"), v(cached).alias("cached"),
        v(F.when(~cached, 2000)).cast("int").alias("question_chars"), v(F.lit("aaa")).alias("taxonomy"), v(F.when(cached & (turn % 4 == 0), "ref0/n0.md")).alias("exact_duplicate_of"),
    )


def _by_case(k: Column, of) -> Column:
    out = None
    for which, case in CASES.items():
        out = F.when(k.isin(*which), of(case)) if out is None else out.when(k.isin(*which), of(case))
    return out


def _sql_by_case(of) -> str:
    return "CASE " + " ".join(f"WHEN k IN ({', '.join(map(str, which))}) THEN {of(case)}" for which, case in CASES.items()) + " END"


def _sql_report() -> str:
    top = _sql_by_case(lambda c: sql_literal(max(c[2].values())))
    gap = _sql_by_case(lambda c: sql_literal(round(sorted([*c[2].values(), 0.0])[-1] - sorted([*c[2].values(), 0.0])[-2], 3)))
    return f"""(SELECT CASE WHEN skip THEN 'skip' WHEN failed THEN 'error' ELSE 'vote' END AS kind, CASE WHEN vote THEN CASE WHEN k = 17 THEN 'local' ELSE 'judged' END END AS judge, place AS path, place AS plan_ord,
      CASE WHEN vote THEN {_sql_by_case(lambda c: sql_literal(c[1]))} END AS bucket, CASE WHEN vote THEN {_sql_by_case(lambda c: sql_literal(c[1] if c[3] else None))} END AS suggested_bucket,
      CASE WHEN vote THEN round(({top}) - 0.01::DOUBLE * (doc_id % 3 + 1), 3) END AS confidence, CASE WHEN vote THEN {_sql_by_case(lambda c: sql_literal(c[2]))} END AS p, CASE WHEN vote THEN {gap} END AS bucket_margin,
      CASE WHEN vote THEN CASE WHEN held OR (k = 17 AND turn % 3 = 0) THEN 'quarantine' ELSE 'frontmatter' END END AS action,
      CASE WHEN vote THEN CASE WHEN k = 17 THEN {sql_pick(_LOCAL, 'turn % 3')} WHEN held THEN 'contains_secret above threshold' ELSE 'normal vote' END END AS reason,
      CASE WHEN vote THEN CASE WHEN cut THEN ['EMAIL'] WHEN k = 17 AND turn % 3 = 0 THEN ['KEY'] ELSE [] END END AS redacted, CASE WHEN vote THEN CASE WHEN k = 17 AND turn % 3 = 0 THEN ['KEY'] ELSE [] END END AS redacted_own,
      CASE WHEN vote THEN CASE WHEN k = 17 AND turn % 3 = 0 THEN ['local:KEY'] WHEN held AND turn % 2 = 1 THEN ['contains_secret'] WHEN held THEN NULL ELSE [] END END AS quarantine_triggers,
      CASE WHEN vote THEN cut END AS truncated, CASE WHEN vote THEN CASE WHEN doc_id % 2 = 1 THEN 'frontmatter' ELSE 'mtime' END END AS age_source,
      CASE WHEN vote THEN CASE WHEN k = 12 THEN doc_id % 45 ELSE 60 + chars % 700 END END AS words, CASE WHEN vote THEN CASE WHEN doc_id % 3 = 0 THEN 30 ELSE 0 END END AS age_days, CASE WHEN vote THEN doc_id % 4 END AS out_links,
      CASE WHEN vote THEN chars + 1000 END AS payload_chars, CASE WHEN vote THEN CASE WHEN k = 17 THEN 0 ELSE 300 + chars // 3 END END AS input_tokens, CASE WHEN skip THEN {sql_pick(['sensitive', 'hidden'], 'turn % 2')} END AS skipped,
      CASE WHEN failed THEN {sql_pick(['TimeoutError', 'ValueError'], 'turn // 4 % 2')} END AS error, CASE WHEN vote THEN CASE WHEN cut THEN 16000 ELSE 900 END END AS excerpt_chars, CASE WHEN vote THEN served END AS cached,
      CASE WHEN vote AND NOT served THEN 2000 END AS question_chars, CASE WHEN vote THEN 'aaa' END AS taxonomy, CASE WHEN vote AND served AND turn % 4 = 0 THEN 'ref0/n0.md' END AS dup, vote AS has_graph
    FROM (SELECT *, NOT skip AND NOT failed AS vote, k = 19 AND NOT failed AS held, CASE WHEN skip THEN 'Private' WHEN failed THEN 'err' ELSE {_sql_by_case(lambda c: sql_literal(c[0]))} || CASE WHEN k < 10 THEN (doc_id % 4)::VARCHAR ELSE '' END END || '/n' || doc_id || '.md' AS place
      FROM (SELECT doc_id, doc_id % 20 AS k, doc_id // 20 AS turn, coalesce(n_chars, 0) AS chars, doc_id % 20 = 18 AS skip, doc_id % 20 = 19 AND doc_id // 20 % 4 = 0 AS failed,
        doc_id % 20 IN (15, 16) AND doc_id % 3 <> 0 AS cut, doc_id % 20 = 3 AND doc_id // 20 % 2 = 0 AS served FROM documents)))"""


REPORT = _sql_report()


# --- runs, snapshots, chains ----------------------------------------------------------------------------

def runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run for every customer: chains of up to six, some that lead to a lost run or in a circle."""
    key, text = F.col("c_custkey"), lambda n: F.concat(F.lit("r"), n.cast("string"))
    before = F.when(key % 97 == 5, "lost").when(key % 6 == 0, F.when(key % 5 == 0, text(key + 5))).otherwise(text(key - 1))
    return table(spark, sf, "customer").select(
        text(key).alias("run_id"), F.date_add(F.lit("2020-01-01").cast("date"), (key % 2000).cast("int")).cast("string").alias("started"), before.alias("resumed_from"), (key % 3 != 1).alias("finished"),
        pick(["aaa", "bbb"], div(7, key) % 2).alias("taxonomy"), (1 + key % 2).cast("int").alias("state_version"), pick(["m1", "m2", "m3"], key % 3).alias("model_requested"),
        pick([16000, 4000], div(3, key) % 2).alias("excerpt_cap"), F.when(key % 4 == 0, "d1").alias("denylist"), (key % 9 == 0).alias("include_sensitive"), F.lit("family,private").alias("sensitive_parts"),
    )


RUNS = f"""(SELECT 'r' || c_custkey AS run_id, (DATE '2020-01-01' + (c_custkey % 2000)::INT)::DATE::VARCHAR AS started,
    CASE WHEN c_custkey % 97 = 5 THEN 'lost' WHEN c_custkey % 6 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 'r' || (c_custkey + 5) END ELSE 'r' || (c_custkey - 1) END AS resumed_from, c_custkey % 3 <> 1 AS finished,
    {sql_pick(['aaa', 'bbb'], 'c_custkey // 7 % 2')} AS taxonomy, (1 + c_custkey % 2)::INT AS state_version, {sql_pick(['m1', 'm2', 'm3'], 'c_custkey % 3')} AS model_requested,
    {sql_pick([16000, 4000], 'c_custkey // 3 % 2')} AS excerpt_cap, CASE WHEN c_custkey % 4 = 0 THEN 'd1' END AS denylist, c_custkey % 9 = 0 AS include_sensitive, 'family,private' AS sensitive_parts FROM customer)"""
_KINDS = ["vote", "vote", "vote", "vote", "vote", "skip", "error"]
_FINDINGS: list = [[], [], ["f"], [], ["f", "g"]]


def _snapshot(spark: SparkSession, sf: str, after: bool) -> DataFrame:
    n, other = (_id() * 7 + 3, _id() % 11) if after else (_id(), _id() % 13)
    kind = pick(_KINDS, div(3, n) % 7)
    vote = kind == "vote"
    v = lambda c: F.when(vote, c)
    return table(spark, sf, "documents").filter(other != 0).select(
        _id().cast("string").alias("path"), kind.alias("kind"), v(F.lit("judged")).alias("judge"), v(pick(["reference", "junk", "code_note"], n % 3)).alias("bucket"), v(F.lit(0.8)).alias("confidence"),
        v(F.when(n % 5 == 0, "quarantine").otherwise("frontmatter")).alias("action"), v(F.when(div(2, n) % 4 == 0, pick(["x", "y"], n % 2))).alias("exact_duplicate_of"), v(F.when(div(5, n) % 3 == 0, "junk")).alias("suggested_bucket"),
        v(div(7, n) % 4 == 0).alias("truncated"), F.when(vote, pick(_FINDINGS, div(4, n) % 5)).otherwise(_literal([])).alias("findings"), F.when(kind == "skip", pick(["locked", "sensitive"], n % 2)).alias("skipped"),
    )


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The latest rows of two runs over the documents: every field moves by a rule of its own, rows come and go."""
    return _snapshot(spark, sf, False), _snapshot(spark, sf, True)


def _sql_snapshot(n: str, keep: str) -> str:
    v = lambda x: f"CASE WHEN kind = 'vote' THEN {x} END"
    return f"""(SELECT doc_id::VARCHAR AS path, kind, {v("'judged'")} AS judge, {v(sql_pick(['reference', 'junk', 'code_note'], 'n % 3'))} AS bucket, {v('0.8::DOUBLE')} AS confidence,
      {v("CASE WHEN n % 5 = 0 THEN 'quarantine' ELSE 'frontmatter' END")} AS action, {v(f"CASE WHEN n // 2 % 4 = 0 THEN {sql_pick(['x', 'y'], 'n % 2')} END")} AS dup, {v("CASE WHEN n // 5 % 3 = 0 THEN 'junk' END")} AS suggested,
      {v('n // 7 % 4 = 0')} AS truncated, CASE WHEN kind = 'vote' THEN {sql_pick(_FINDINGS, 'n // 4 % 5')} ELSE [] END AS findings, CASE WHEN kind = 'skip' THEN {sql_pick(['locked', 'sensitive'], 'n % 2')} END AS skipped
    FROM (SELECT doc_id, {n} AS n, {sql_pick(_KINDS, f'({n}) // 3 % 7')} AS kind FROM documents WHERE {keep}))"""


BEFORE, AFTER = _sql_snapshot("doc_id", "doc_id % 13 <> 0"), _sql_snapshot("doc_id * 7 + 3", "doc_id % 11 <> 0")


def chain_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of three runs, one event each."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        (e % 3).cast("int").alias("chain_pos"), e.alias("line"), F.concat(F.lit("p"), e.cast("string")).alias("path"), F.when(e % 5 == 4, "error").otherwise("vote").alias("kind"),
        F.when(e % 7 == 5, "local").otherwise("judged").alias("judge"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.concat(F.lit("b"), (e % 4).cast("string")).alias("bucket"),
    )


CHAIN = "(SELECT (event_id % 3)::INT AS pos, event_id AS line, 'p' || event_id AS path, 'k' || user_id AS key, 'b' || event_id % 4 AS bucket FROM events WHERE event_id % 5 <> 4 AND event_id % 7 <> 5)"


# --- records ----------------------------------------------------------------------------------------------


def record_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Records of conversations, many of a key, with the answer that a judge would give each, or none where it fails."""
    n, key = F.col("conv_id") + F.col("turn"), (F.col("conv_id") * 7 + F.col("turn")) % 211
    held, fails = key % 11 == 0, n % 4 == 0
    told = lambda c: F.when(~fails, c)
    return table(spark, sf, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.when(held, "held").otherwise("fresh").alias("disposition"),
        F.when(held, _literal(["EMAIL", "KEY"])).when(key % 3 == 0, _literal(["EMAIL"])).otherwise(_literal([])).alias("hits"), F.concat(F.lit("k"), key.cast("string")).alias("key"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("payload_chars"), told(pick(["keep", "drop"], key % 2)).alias("pick"), told((key * 13 % 101) / 100.0).alias("sure"), told((key * 7 % 101) / 100.0).alias("secret"),
    )


RECORD_VOTES = f"""(SELECT conv_id || ':' || turn AS id, 'k' || k AS key, k % 11 = 0 AS held, (conv_id + turn) % 4 = 0 AS fails, {sql_pick(["keep", "drop"], "k % 2")} AS pick, (k * 13 % 101) / 100.0::DOUBLE AS sure,
    (k * 7 % 101) / 100.0::DOUBLE AS secret FROM (SELECT *, (conv_id * 7 + turn) % 211 AS k FROM conversations))"""


# --- notes that are moved to one place --------------------------------------------------------------------------

_CLASHES = ["a/n{}", "a/N{}", "A/n{}-2", "a/n{}-2", "a/N{}-3", "a/n{}-2-2"]


def clashing_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Held notes, six of a name in one spelling or another, and what is in their folder already."""
    k = div(6).cast("string")
    d = table(spark, sf, "documents")
    path = F.concat(F.replace(pick(_CLASHES, _id() % 6), F.lit("{}"), k), F.lit(".md"))
    rows = d.select(path.alias("path"), path.alias("plan_ord"), F.lit("quarantine").alias("action"), F.concat(F.lit("case "), (_id() % 6).cast("string")).alias("reason"), F.array(F.lit("local:KEY")).alias("quarantine_triggers"))
    there = d.filter((_id() % 18).isin(0, 3)).select(F.concat(F.lit("_tidepool/quarantine/a/N"), k, F.when(_id() % 18 == 3, "-3").otherwise(""), F.lit(".md")).alias("path"))
    return rows, there


CLASHING = f"(SELECT doc_id // 6 AS k, replace({sql_pick(_CLASHES, 'doc_id % 6')}, '{{}}', (doc_id // 6)::VARCHAR) AS stem, 'case ' || doc_id % 6 AS reason FROM documents)"
THERE = "(SELECT doc_id // 6 AS k, lower('_tidepool/quarantine/a/N' || doc_id // 6 || CASE WHEN doc_id % 18 = 3 THEN '-3' ELSE '' END || '.md') AS path FROM documents WHERE doc_id % 18 IN (0, 3))"
