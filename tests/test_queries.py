"""Every query that has SQL gives the same rows in DuckDB; the others give rows."""

import math
import os
from collections import Counter

import duckdb
import pytest

from tidepool.oracle import SQL
from tidepool.queries import ALL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in os.listdir(SF):
        if x.endswith(".parquet"):
            c.execute(f"create view {x[:-8]} as select * from '{SF}/{x}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def test_every_sql_has_a_query():
    assert set(SQL) <= set(ALL)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    df = ALL[name](spark, SF)
    rows = df.collect()
    assert rows
    if name not in SQL:
        return
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(range(len(names)), key=names.__getitem__)
    want = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    got = Counter(tuple(plain(r[k]) for k in sorted(df.columns)) for r in rows)
    assert got == want


def test_listed_names_within_addresses(spark, duck, tmp_path):
    """A name that is part of an address, of a key or of nothing, and a null text: as the SQL says."""
    texts = ["mail ing.45@mail0.example.com now", "key sk-ing-aaaaaaaaaaaaaaaa", "being", "The\n- and", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in ALL["r19_listed_names"](spark, str(tmp_path)).select("doc_id", "named").collect()}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(c.execute(SQL["r19_listed_names"]).fetchall()) and (0, True) in got and (4, None) in got


def test_what_is_decided_without_a_vote(spark, tmp_path):
    """A credential comes first, then headings only, then copies; a word that merely holds a keyword is judged."""
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    texts = ["plain words", f"the {key} here", f"the {key} here", "# only\n## headings", "plain words", "a lesakia word"]
    spark.createDataFrame([(i, t, "src0") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda name, *columns: Counter(tuple(r) for r in ALL[name](spark, str(tmp_path)).select(*columns).collect())
    judged, secret, junk = ("judged", "durable_memory", "frontmatter"), ("local", "needs_review", "quarantine"), ("local", "junk", "frontmatter")
    voted = ("judged", "needs_review", "quarantine")
    want = [
        ("src0/0.md", *judged, "normal vote", None), ("src0/1.md", *secret, "local redaction hit: KEY", None), ("src0/2.md", *secret, "local redaction hit: KEY", "src0/1.md"),
        ("src0/3.md", *junk, "empty body or headings only: decided locally", None), ("src0/4.md", *junk, "exact duplicate of src0/0.md: decided locally", "src0/0.md"),
        ("src0/5.md", *voted, "contains_secret above threshold", None),
    ]
    assert rows("d7_decisions", "path", "judge", "bucket", "action", "reason", "exact_duplicate_of") == Counter(want)
    assert rows("a2_bill", "n_fresh", "n_local", "over_budget") == Counter([(2, 4, False)])
