"""Files with headers, texts with credentials and JSON records, made from the driver's tables; SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool import fixtures as X
from tidepool.derived import pick, sql_literal, sql_pick, table

# --- files with headers -----------------------------------------------------------------------------

#: A header that can't be parsed, and what a parser says of it; its line is the file's.
BROKEN = "YAML: while parsing a flow sequence, expected '...' or '...', but got '...', line 2 column 15"


def files(spark: SparkSession, sf: str) -> DataFrame:
    """rel, content: documents as files, one in six each with a whole header, none, a broken one, a scalar, a locked one with CRLF, and not UTF-8."""
    n, way = F.col("doc_id"), F.col("doc_id") % 6
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    head = (
        F.when(way == 0, F.concat(F.lit("---\ntitle: Title "), i, F.lit("\naliases: [one, ' two ', '', n"), i, F.lit("]\ncreated: 2024-03-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("\ndate: 2025-01-01\n---\n")))
        .when(way == 1, "").when(way == 2, "---\nkey: [unclosed\n---\n").when(way == 3, "---\njust words\n---\n")
        .otherwise(F.concat(F.lit("---\r\nalias: solo "), i, F.lit("\r\ntidepool:\r\n  locked: true\r\n---\r\n")))
    )
    start = F.when(way == 5, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit("")))
    return table(spark, sf, "documents").select(F.concat(i, F.lit(".md")).alias("rel"), F.concat(start, F.encode(F.concat(head, text), "UTF-8")).alias("content"))


FILES = f"""SELECT doc_id || '.md' AS rel, CASE WHEN doc_id % 6 = 0 THEN 'Title ' || doc_id END AS header_title,
    CASE doc_id % 6 WHEN 0 THEN 'one| two ||n' || doc_id WHEN 4 THEN 'solo ' || doc_id ELSE '' END AS aliases, CASE doc_id % 6 WHEN 0 THEN 'aliases|created|date|title' WHEN 4 THEN 'alias|tidepool' ELSE '' END AS keys,
    doc_id % 6 = 4 AS locked, CASE WHEN doc_id % 6 = 0 THEN ('2024-03-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0'))::DATE END AS created,
    CASE doc_id % 6 WHEN 2 THEN {sql_literal(BROKEN)} WHEN 3 THEN 'frontmatter is a str, not a mapping' END AS header_error, CASE WHEN doc_id % 6 = 5 THEN 'not UTF-8' END AS undecodable,
    CASE WHEN doc_id % 6 <> 5 THEN md5(coalesce(text, '')) END AS body_md5 FROM documents"""

# --- credentials ----------------------------------------------------------------------------------------

_TEXTS = [t for t, _ in X.SECRETS]
#: What is left of those samples that hold something, by their place.
REDACTED = {
    0: "key [KEY] end", 1: "\\n[KEY]", 3: "id [KEY]", 5: "/bot[KEY]/send", 6: "[WEBHOOK]", 7: "[JWT]", 8: "[PEM] after", 9: "[PEM]\n\nprose", 10: "Authorization: [BEARER]", 11: "Authorization: [BEARER]",
    13: "[AWS_SECRET]", 14: "'[AWS_SECRET]", 15: "mail [EMAIL] now", 16: "postgres://[URL_CREDENTIAL]@localhost/db", 18: "http://localhost:8080/x?email=[EMAIL]", 20: "redis://[URL_CREDENTIAL]@h",
    21: "call [PHONE] today", 23: "[PHONE]", 24: "qty 2 [CARD]", 25: "[SSN] [CARD]", 26: "[CARD]-[SSN]", 29: "ssn [SSN].",
}


def secrets(spark: SparkSession, sf: str) -> DataFrame:
    """id, text: every sample of a credential or of what only looks like one, before a customer's name."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(key.alias("id"), F.concat(pick(_TEXTS, key % len(_TEXTS)), F.lit("\n\nfor "), F.translate("c_name", "0123456789#", "abcdefghij ")).alias("text"))


_LEFT = [REDACTED.get(i, t) for i, t in enumerate(_TEXTS)]
_HITS = ["|".join(h) for _, h in X.SECRETS]
SECRETS = f"""SELECT c_custkey AS id, {sql_pick(_LEFT, f'c_custkey % {len(_TEXTS)}')} || chr(10) || chr(10) || 'for ' || translate(c_name, '0123456789#', 'abcdefghij ') AS redacted,
    {sql_pick(_HITS, f'c_custkey % {len(_TEXTS)}')} AS hits FROM customer"""

# --- records -----------------------------------------------------------------------------------------------


def record_lines(spark: SparkSession, sf: str) -> DataFrame:
    """line, value: conversations as JSON lines with strings, numbers, booleans, nulls and lists, some with an address or a number to hide."""
    n, i = F.col("conv_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    mail = F.when(n % 3 == 0, F.concat(F.lit("write to u"), n.cast("string"), F.lit("@example.com now"))).otherwise(F.concat(F.lit('say "'), F.col("role"), F.lit('"\n\\ é')))
    sent = F.struct(
        F.col("role"), n.alias("n"), (F.col("turn") % 2 == 0).alias("ok"), F.array(F.lit("one"), F.col("role")).alias("tags"), mail.alias("x_text"), F.lit(None).cast("string").alias("none"),
        F.when(n % 4 == 0, F.lit(4242424242424242).cast("long")).otherwise(n + 10).alias("card"), F.lit(0.5).alias("half"),
    )
    value = F.to_json(F.struct(i.alias("id"), sent.alias("sent")), {"ignoreNullFields": "false"})
    return table(spark, sf, "conversations").select(F.monotonically_increasing_id().alias("line"), value.alias("value"))


RECORDS = """SELECT conv_id || ':' || turn AS id, '{"field_names":["card","half","n","none","ok","role","tags","x_text"],"fields":{"card":' || CASE WHEN conv_id % 4 = 0 THEN '"[CARD]"' ELSE (conv_id + 10)::VARCHAR END
    || ',"half":0.5,"n":' || conv_id || ',"none":null,"ok":' || (turn % 2 = 0) || ',"role":"' || role || '","tags":["one","' || role || '"],"x_text":"'
    || CASE WHEN conv_id % 3 = 0 THEN 'write to [EMAIL] now' ELSE 'say \\"' || role || '\\"\\n\\\\ é' END || '"}}' AS state,
    CASE WHEN conv_id % 4 = 0 AND conv_id % 3 = 0 THEN 'CARD|EMAIL' WHEN conv_id % 4 = 0 THEN 'CARD' WHEN conv_id % 3 = 0 THEN 'EMAIL' ELSE '' END AS hits FROM conversations"""
