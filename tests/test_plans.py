"""Whole runs: a vault on disk, waves, records, streams, sources."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidepool import fixtures as X
from tidepool.functions import text as T
from tidepool.operators import bill as B
from tidepool.operators import exclude as EX
from tidepool.operators import index as I
from tidepool.operators import journal as J
from tidepool.operators import plan as P
from tidepool.operators import siblings as SB
from tidepool.plans import records as RP
from tidepool.plans import runner, scan
from tidepool.queries import ALL
from tidepool.sources import files, lines, notes, records, settings, sinks
from tidepool.streaming import incremental


def test_vault_on_disk(spark, tmp_path):
    for rel, body in X.VAULT:
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, newline="")
    (tmp_path / "odd.md").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "locked.md").write_text("---\ntidepool:\n  locked: true\n---\nmine")
    (tmp_path / "other.txt").write_text("not a note")
    planned = notes.read_notes(spark, str(tmp_path))
    rows = {r.path: r for r in scan.scan(planned).collect()}
    assert set(rows) == {r for r, _ in X.VAULT} | {"odd.md", "locked.md"}
    assert rows["keys/k.md"].action == "quarantine" and rows["keys/k.md"].quarantine_triggers == ["local:KEY"]
    assert rows["empty/blank.md"].reason.startswith("empty") and rows["notes/n1.md"].exact_duplicate_of == "notes/copy.md"
    assert rows["family/secret.md"].skipped == "sensitive" and rows[".hidden/x.md"].skipped == "hidden"
    assert rows["locked.md"].skipped == "locked" and rows["odd.md"].kind == "error"
    assert rows["keys/mail.md"].redacted == ["EMAIL"] and rows["keys/mail.md"].judge == "judged"


def test_headers(spark):
    got = {r.rel: r for r in notes.parsed(X.files(spark)).collect()}
    assert got["ok.md"].header_title == "A Title" and got["ok.md"].body == "body\nmore"
    assert got["bom.md"].locked and got["bom.md"].aliases == ["solo"]
    assert notes.header_fields("aliases: [2024, ' x ', true]")[1] == ["2024", " x ", "True"]
    assert got["bad.md"].header_error.startswith("YAML: ") and "unclosed" not in got["bad.md"].header_error and got["bad.md"].body == "body stays"
    assert got["scalar.md"].header_error == "frontmatter is a str, not a mapping"
    assert got["none.md"].body.startswith("# no header") and got["latin.md"].undecodable and got["end.md"].body == ""
    assert str(got["end.md"].created) == "2024-01-02"


def all_pairs(facts, keep):
    words = {r.rel: set(re.findall("[a-z0-9]+", r.title.lower())) for r in facts}
    near = lambda a, b: len(words[a.rel] & words[b.rel]) / max(1, len(words[a.rel] | words[b.rel]))
    for a in facts:
        pool = [b for b in facts if b.folder == a.folder and b.rel != a.rel and not b.title_credential]
        yield a.rel, [b.title_redacted[: T.TITLE_CUT] for b in sorted(pool, key=lambda b: (-near(a, b), b.plan_ord))[:keep]]


def test_siblings_against_all_pairs(spark):
    indexed = I.index(P.plan(X.vault_notes(spark)), scan.TODAY)
    facts = [r for r in indexed.collect() if r.status == "scan"]
    for keep in (3, 80):
        got = {r.rel: r.other_note_titles for r in SB.siblings(indexed, keep).collect()}
        for rel, want in all_pairs(facts, keep):
            assert got.get(rel, []) == want


@pytest.mark.parametrize(("rare", "most_frequent", "keep"), [(2, 8, 4), (5, 2, 60), (0, 1, 4)])
def test_siblings_where_words_are_frequent(spark, rare, most_frequent, keep):
    """A word that all titles share, others that many do, titles without words, equal titles."""
    r = random.Random(rare)
    titles = [" ".join(["Meeting", *(r.choice("ab") + str(r.randrange(4)) for _ in range(r.randrange(5)))]) for _ in range(90)]
    titles += ["only this", "***", "???", *["Meeting notes"] * 9, "Meeting Meeting a0", "a0 b1", "b3"]
    rows = [(f"d{i % 2}/{i:03}.md", "x", t) for i, t in enumerate(titles)]
    indexed = I.index(P.plan(spark.createDataFrame(rows, "rel string, body string, header_title string")), scan.TODAY).persist()
    got = {r.rel: r.other_note_titles for r in SB.siblings(indexed, keep, rare, most_frequent).collect()}
    for rel, want in all_pairs(indexed.collect(), keep):
        assert got[rel] == want, rel


def test_a_word_of_all_titles_makes_no_pairs(spark):
    """Every title has one word in common and one of its own: no step has more rows than notes times what is kept."""
    n, keep = 4000, 10
    rows = spark.range(n).select(F.format_string("f/%05d.md", "id").alias("rel"), F.lit("x").alias("body"), F.format_string("Meeting m%d", "id").alias("header_title"))
    indexed = I.index(P.plan(rows), scan.TODAY)
    found = SB.siblings(indexed, keep, 40)
    plan = found._jdf.queryExecution().executedPlan()
    assert [len(r.other_note_titles) for r in found.collect()] == [keep] * n
    seen, todo = [], [plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        for child in (node.children().apply(i) for i in range(node.children().size())):
            todo.append(child)
        if node.nodeName().startswith(("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")) and node.metrics().contains("numOutputRows"):
            seen.append(node.metrics().apply("numOutputRows").value())
    assert len(seen) > 5 and max(seen) <= n * 4 * (keep + 1)


def test_nothing_raw_is_sent(spark):
    prepared = scan.prepare(P.plan(X.vault_notes(spark)))
    sent = "\n".join(r[0] for r in prepared.select(F.to_json("state")).collect())
    assert "jane@example.com" not in sent and "p_a1B2" not in sent and "family" not in sent
    assert list(json.loads(sent.split("\n")[0])) == ["aliases", "excerpt", "frontmatter_keys", "graph", "other_note_titles", "path", "title"]


def test_cache_serves_by_key(spark):
    prepared = scan.prepare(P.plan(X.vault_notes(spark)))
    rows = scan.decided(prepared).withColumns({"chain_pos": F.lit(0), "line": F.monotonically_increasing_id()})
    again = scan.prepare(P.plan(X.vault_notes(spark)), cached=J.cache(rows))
    assert {r[0] for r in again.select("disposition").distinct().collect()} == {"cached", "local"}


def notes_to_judge(spark, n=500):
    return spark.range(n).select(F.format_string("n%05d.md", "id").alias("rel"), F.format_string("n%05d.md", "id").alias("plan_ord"), F.lit("text").alias("body"))


def answered(df, tokens=1000, **more):
    out = df.select(F.lit("vote").alias("kind"), F.lit("judged").alias("judge"), F.col("rel").alias("path"), "plan_ord", F.lit("m").alias("model"), F.lit(tokens).cast("long").alias("input_tokens"), F.lit(False).alias("cached"), F.lit(None).cast("string").alias("error"))
    return out.withColumns(more)


def test_waves_and_the_meter(spark, tmp_path):
    """A run stops at the very row that takes it above its limit, wherever its wave ends."""
    notes_df, at = notes_to_judge(spark), lambda n: f"file://{tmp_path}/{n}"
    end = runner.run(notes_df, answered, at("a"), "r1", wave_size=100)
    assert end["rows"] == 500 and end["finished"] and end["tokens"] == 500_000
    # 1000 tokens cost 0.000042: the 143rd is the first above 0.006
    end = runner.run(notes_df, answered, at("b"), "r1", wave_size=100, max_usd=0.006)
    assert end["reason"] == "meter" and end["rows"] == 143 and end["tokens"] == 143_000 and end["in_flight"] > 0
    got = sinks.read_rows(spark, at("b"), "r1")
    assert sorted(r.path for r in got.collect()) == [f"n{i:05d}.md" for i in range(143)]
    assert sinks.read_rows(spark, at("b"), "r1", in_flight=True).count() == 143 + end["in_flight"]
    # exactly at the limit is not above it
    assert runner.run(notes_df, answered, at("b2"), "r1", wave_size=500, max_usd=T.USD_PER_MILLION * 0.1)["rows"] == 101
    failing = lambda df: answered(df, kind=F.when(F.substring("path", 6, 1).isin("0", "1", "2"), "error").otherwise("vote"))
    end = runner.run(notes_df, failing, at("c"), "r1", wave_size=100)
    assert end["reason"] == "error-rate" and (end["rows"], end["errors"]) == (51, 16)
    broke = lambda df: answered(df, kind=F.when(F.col("plan_ord") == "n00217.md", "error").otherwise("vote"), error=F.when(F.col("plan_ord") == "n00217.md", "HTTP 402"))
    end = runner.run(notes_df, broke, at("d"), "r1", wave_size=100)
    assert end["reason"] == "402" and end["rows"] == 218
    drifted = lambda df: answered(df, model=F.when(F.col("plan_ord") >= "n00120.md", "new").otherwise("m"))
    end = runner.run(notes_df, drifted, at("e"), "r1", wave_size=100, known_models={"m"})
    assert end["reason"] == "model-drift" and end["rows"] == 121


def test_what_is_served_is_neither_metered_nor_counted(spark, tmp_path):
    notes_df = notes_to_judge(spark, 120)
    served = lambda df: answered(df, 10_000_000, cached=F.lit(True))
    end = runner.run(notes_df, served, f"file://{tmp_path}/a", "r1", wave_size=50, max_usd=0.001, known_models={"other"})
    assert (end["reason"], end["rows"], end["tokens"]) == ("done", 120, 0)
    local = lambda df: answered(df, 10_000_000, judge=F.lit("local"), model=F.lit("local"))
    assert runner.run(notes_df, local, f"file://{tmp_path}/b", "r1", wave_size=50, max_usd=0.001, known_models={"m"})["tokens"] == 0
    # 60 served rows don't water down the share of errors
    half = lambda df: answered(df, cached=F.col("plan_ord") < "n00060.md", kind=F.when((F.col("plan_ord") >= "n00060.md") & (F.substring("path", 6, 1) == "0"), "error").otherwise("vote"))
    assert runner.run(notes_df, half, f"file://{tmp_path}/c", "r1", wave_size=50)["finished"]


def test_a_wave_counts_once(spark, tmp_path, monkeypatch):
    """A driver that is lost between writing and committing a wave leaves nothing that is read; the run goes on from there."""
    journal, notes_df = f"file://{tmp_path}/j", notes_to_judge(spark, 300)
    asked = []

    def decide(df):
        asked.append(df.count())
        return answered(df)

    whole, calls = sinks.commit_wave, []

    def lost(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return whole(*args)

    monkeypatch.setattr(sinks, "commit_wave", lost)
    with pytest.raises(RuntimeError):
        runner.run(notes_df, decide, journal, "r1", wave_size=100)
    first = sinks.read_rows(spark, journal, "r1").count()
    assert first == asked[0]
    end = runner.run(notes_df, decide, journal, "r1", wave_size=100)
    rows = sinks.read_rows(spark, journal, "r1")
    assert end["finished"] and end["rows"] == 300 == rows.count() == rows.select("path").distinct().count()
    assert sum(asked) == 300 + asked[1]  # only the lost wave was judged again
    before = len(asked)
    assert runner.run(notes_df, decide, journal, "r1", wave_size=100)["rows"] == 300 and sum(asked[before:]) == 0
    # a wave that is committed twice stands as it was first
    held = sinks.commits(spark, journal, "r1").filter("wave = 0").first().asDict()
    assert whole(spark, journal, held | {"attempt": "other"}) == held


def test_stream_writes_each_note_once(spark, tmp_path):
    src, journal = f"file://{tmp_path}/in", f"file://{tmp_path}/journal"
    X.record_lines(spark).select("value").write.text(src)
    decide = lambda df: df.select(F.lit("vote").alias("kind"), F.sha2("value", 256).alias("path"))
    for _ in range(2):
        q = incremental.start(incremental.record_stream(spark, src), decide, journal, "s", f"file://{tmp_path}/cp")
        q.awaitTermination()
    assert sinks.read_rows(spark, journal).count() == len(X.RECORDS)


def test_a_stream_equals_one_batch(spark, tmp_path):
    """What is the same in different micro-batches is judged once; a batch that was lost before its commit is done again."""
    src, journal, asked = tmp_path / "in", f"file://{tmp_path}/journal", []
    src.mkdir()
    lines = [f"{i:03d}|text {i % 7 if i % 3 else i}" for i in range(60)] + ["060|", "061|"]

    def prepare(df):
        parts = F.split("value", r"\|")
        text = F.nullif(parts[1], F.lit(""))
        return df.select(F.concat(parts[0], F.lit(".md")).alias("path"), parts[0].alias("plan_ord"), text.alias("text"), F.sha2(text, 256).alias("key"))

    def decide(df):
        asked.append(df.count())
        return df.select(F.lit("vote").alias("kind"), "path", "plan_ord", "key", F.concat(F.lit("bucket of "), F.col("text")).alias("bucket"), F.lit(False).alias("cached"))

    whole = {r.path: (r.bucket, r.same_as, r.cached) for r in incremental.joined(prepare(spark.createDataFrame([(x,) for x in lines], "value string")), decide, None).collect()}
    assert len(whole) == 62 and sum(s is not None for _, s, _ in whole.values()) > 20
    judged = asked.pop()
    for i in range(4):
        (src / f"{i}.txt").write_text("\n".join(lines[16 * i : 16 * (i + 1)]))
        stream = spark.readStream.format("text").load(f"file://{src}")
        incremental.start(stream, decide, journal, "s", f"file://{tmp_path}/cp", "key", prepare).awaitTermination()
    rows = sinks.read_rows(spark, journal, "s").collect()
    assert {r.path: (r.bucket, r.same_as, r.cached) for r in rows} == whole and len(rows) == 62 and sum(asked) == judged
    # the same epoch again, as after a lost checkpoint, changes nothing
    incremental.start(spark.readStream.format("text").load(f"file://{src}"), decide, journal, "s", f"file://{tmp_path}/cp2", "key", prepare).awaitTermination()
    assert sinks.read_rows(spark, journal, "s").count() == 62
    assert sum(c.n_rows for c in sinks.commits(spark, journal, "s").collect()) == 62


def test_folders_are_listed_by_tasks(spark, tmp_path):
    names = ["a.md", "_b.md", ".c.md", "x/_d/e.md", "x/.f/g.md", "x/empty.md", "x/y/z/deep.md", "x/skip.txt", "é ö/h.md"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("" if "empty" in n else n)
    (tmp_path / "nothing").mkdir()
    (tmp_path / "gone.md").symlink_to(tmp_path / "nowhere.md")
    got = notes.listed(spark, f"file://{tmp_path}")
    assert sorted(r.rel for r in got.collect()) == sorted(n for n in names if n.endswith(".md")) and got.filter("modified IS NULL").isEmpty()
    read = {r.rel: r.content for r in files.with_contents(got, str(tmp_path), "rel NOT LIKE '%.c.md'").collect()}
    assert read[".c.md"] is None and bytes(read["x/empty.md"]) == b"" and bytes(read["é ö/h.md"]).decode() == "é ö/h.md"
    assert [r.rel for r in notes.read_notes(spark, f"{tmp_path}/a.md").collect()] == ["a.md"]
    assert files.tree(spark, f"{tmp_path}/nothing", ".md").collect() == []


def test_ends_of_journals(spark, tmp_path):
    """The first line and the last, whatever stands between them; a torn or foreign line is none."""
    row = '{"kind": "vote", "path": "' + "x" * 300 + '"}\n'
    (tmp_path / "long.jsonl").write_text('{"kind": "run", "id": 1}\n' + row * 2000 + '{"kind": "end", "n": 2000}\n')
    (tmp_path / "torn.jsonl").write_text('{"kind": "run", "id": "' + "y" * 9000 + '"}\n' + row + '{"kind": "end", "n": 1}')
    (tmp_path / "open.jsonl").write_text('{"kind": "run", "id": 3}\n' + row)
    (tmp_path / "odd.jsonl").write_bytes(b"\xff\xfe\n{\n")
    (tmp_path / "empty.jsonl").write_text("")
    got = {r.rel: (r.header and json.loads(r.header)["id"], r.footer and json.loads(r.footer)["n"]) for r in files.journal_ends(spark, f"file://{tmp_path}").collect()}
    assert got == {"long.jsonl": (1, 2000), "torn.jsonl": ("y" * 9000, None), "open.jsonl": (3, None), "odd.jsonl": (None, None), "empty.jsonl": (None, None)}


def test_records(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(X.RECORDS))
    df = records.read_records(spark, f"file://{path}")
    got = {r.id: json.loads(r.state) for r in records.states(df).collect()}
    assert got["a"]["fields"] == {"text": "write to [EMAIL]", "n": 42, "x": 0.5, "ok": True, "none": None}
    assert got["a"]["field_names"] == ["n", "none", "ok", "text", "x"]
    assert got["b"]["fields"] == {"card": "[CARD]", "tel": "[PHONE]", "tags": ["one", "call [PHONE]"]}
    assert got["c"]["fields"] == {"quote": 'say "hi"\né', "empty": []}
    rows = RP.judged(RP.prepare(df), {"lane": {"type": "choice", "options": {"x": "", "y": ""}}}, "lane").collect()
    assert {r.pick for r in rows} == {"x"} and len(rows) == 3


@pytest.mark.parametrize(
    "line",
    ["not json", "[1]", '{"sent": {"a": 1}}', '{"id": "x", "sent": {}}', '{"id": "x", "sent": {"a b": 1}}', '{"id": "x", "sent": {"a": {"b": 1}}}', '{"id": "x", "sent": {"a": ["s", 1]}}', '{"id": "a", "sent": {"a": 1}}'],
)
def test_bad_records_are_refused(spark, line):
    df = spark.createDataFrame([(1, '{"id": "a", "sent": {"a": 1}}'), (2, line)], "line long, value string")
    with pytest.raises(records.BadRecords, match="line 2"):
        records.checked(df)


def test_line_numbers_in_pieces(spark, tmp_path):
    path = tmp_path / "many.jsonl"
    path.write_text("".join('{"id": "%d", "sent": {"a": "%s"}}\n' % (i, "x" * (i % 90)) for i in range(1, 4001)) + "nonsense\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        with pytest.raises(records.BadRecords, match="line 4001:"):
            records.read_records(spark, f"file://{path}")
        got = lines.numbered(spark, f"file://{tmp_path}").filter("line < 4001")
        assert got.rdd.getNumPartitions() > 1 and got.filter("value NOT LIKE concat('%\"', line, '\"%')").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    same = records.in_memory(spark, [{"id": "a", "sent": {"t": "x"}}])
    assert [r.id for r in same.collect()] == ["a"]


def voted(pick, tokens=10):
    answer = {"choices": {"lane": {"pick": pick, "confidence": 0.9}}, "scores": {}, "nouls": {}, "model": "m", "input_tokens": tokens}
    return F.from_json(F.lit(json.dumps(answer)), RP.VOTE)


def test_records_of_a_judge(spark):
    """A judge sees each state once and no held record; where it fails, the next of equal states is asked."""
    seen = []

    def judge(df):
        seen.extend(r.id for r in df.collect())
        return df.withColumn("vote", F.when(F.col("id").isin("b", "f", "h"), voted("keep")))

    rows = {r.id: r for r in RP.judged(X.record_votes(spark), {}, "lane", judge).collect()}
    assert sorted(seen) == ["a", "b", "c", "e", "f", "h"] and rows["d"].action == "quarantine"
    assert {i for i, r in rows.items() if r.kind == "error"} == {"a", "c", "e"}
    assert rows["g"].same_as == "b" and rows["g"].input_tokens == 0 and rows["h"].same_as is None and rows["h"].input_tokens == 10


def group_of(spark, n, key="k"):
    return spark.range(n).select(F.format_string("r%05d", "id").alias("id"), F.lit("fresh").alias("disposition"), F.array().cast("array<string>").alias("hits"), F.lit(key).alias("key"), F.lit(5).alias("payload_chars"))


def test_leaders_hand_over(spark):
    """Of a large group of equal records one after the other is asked until one is answered."""
    tries = lambda good: lambda df: df.withColumn("vote", F.when(F.col("id") >= good, voted("x")))
    rows = RP.judged(group_of(spark, 3000), {}, "lane", tries("r00004")).collect()
    assert len(rows) == 3000 and sorted(r.id for r in rows if r.kind == "error") == [f"r{i:05d}" for i in range(4)]
    assert {r.same_as for r in rows if r.id > "r00004"} == {"r00004"} and sum(r.input_tokens or 0 for r in rows) == 10
    # none is answered: every one is tried
    rows = RP.judged(group_of(spark, 6), {}, "lane", tries("z")).collect()
    assert [r.kind for r in rows] == ["error"] * 6
    # a judge that is down stops the run; what was not sent has no row
    many = group_of(spark, 60).withColumn("key", F.concat("key", F.col("id"))).unionByName(group_of(spark, 60).withColumns({"key": F.concat("key", F.col("id")), "id": F.concat(F.lit("t"), "id")}))
    assert len(RP.judged(many, {}, "lane", tries("z")).collect()) == 60
    assert len(RP.judged(many, {}, "lane", tries("z"), error_stop=False).collect()) == 120


def test_records_are_resumed(spark):
    """What an earlier run answered is served by key, whoever asked, and never sent."""
    seen = []

    def judge(df):
        seen.extend(r.id for r in df.collect())
        return df.withColumn("vote", voted("new"))

    both = group_of(spark, 4, "old").unionByName(group_of(spark, 3, "new").withColumn("id", F.concat(F.lit("n"), "id")))
    held = spark.range(2).select(F.lit("old").alias("key"), voted("stored").alias("vote"))
    rows = RP.judged(both, {}, "lane", judge, cached=held).collect()
    assert seen == ["nr00000"] and sorted((r.pick, r.cached, r.input_tokens) for r in rows) == [("new", False, 0)] * 2 + [("new", False, 10)] + [("stored", True, 0)] * 4


def in_plan_order(paths, existing=(), folder="q"):
    """Each note in turn takes the first place that is free."""
    taken, out = {e.lower() for e in existing}, {}
    for p in sorted(paths):
        stem, end = (p[:-3], p[-3:]) if p.lower().endswith(".md") else (p, "")
        names = (f"{folder}/{stem}{end}" if k == 1 else f"{folder}/{stem}-{k}{end}" for k in range(1, 10_000))
        out[p] = next(n for n in names if n.lower() not in taken)
        taken.add(out[p].lower())
    return out


def moved(spark, paths, existing=()):
    rows = spark.createDataFrame([(p, p, "quarantine", "r", ["t"]) for p in paths] + [("kept.md", "kept.md", "frontmatter", "r", [])], "path string, plan_ord string, action string, reason string, quarantine_triggers array<string>")
    there = spark.createDataFrame([(e,) for e in existing], "path string")
    return {r["from"]: r["to"] for r in sinks.quarantine_moves(rows, "q", there).collect()}


def test_moves_that_clash(spark):
    paths = ["a.md", "A.md", "A-2.md", "a-2.md", "a-2-2.md", "b/x.md", "b/X.md", "c-3.md", "c.md", "C.md", "C.MD", "d.md"]
    assert moved(spark, paths) == in_plan_order(paths)
    existing = ["q/a.md", "q/a-2.md", "q/A-3.md", "q/d.md", "q/d-4.md", "other.md", *(f"q/c-{i}.md" for i in range(2, 40))]
    assert moved(spark, paths, existing) == in_plan_order(paths, existing)
    r = random.Random(6)
    many = list({"".join(r.choice(x) for x in ("aA", "bB")) + "".join(f"-{r.randrange(2, 5)}" for _ in range(r.randrange(3))) + ".md" for _ in range(120)})
    got = moved(spark, many)
    assert got == in_plan_order(many) and len({t.lower() for t in got.values()}) == len(many)
    assert moved(spark, []) == {}


def test_diff_in_words(spark):
    changes = J.diff(*X.snapshots(spark))
    said = sinks.diff_text(changes, 2)
    assert "bucket changed: 1\n  moved  (reference -> junk)" in said and "new notes: 5\n" in said and "... and 3 more" in said
    assert {json.loads(r.value)["category"] for r in sinks.diff_json(changes).collect()} == {r.category for r in changes.collect()}


def test_bill_in_words(spark):
    prepared = scan.prepare(P.plan(X.vault_notes(spark)))
    bill = B.bill(prepared, 1000, 0.0001)
    said = B.text_of(bill.first().asDict(), 2, [tuple(r) for r in B.largest_folders(prepared).collect()], 0.0001)
    assert "2 skipped" in said and "ceiling $0.0001: OVER" in said and "notes/" in said
    assert "Nothing was sent" in B.refusal(bill.first().asDict(), 0.0001)


def test_vault_root(spark, tmp_path):
    (tmp_path / "v" / ".obsidian").mkdir(parents=True)
    (tmp_path / "v" / "a" / "b").mkdir(parents=True)
    assert P.vault_root(spark, f"file://{tmp_path}/v/a/b") == f"{tmp_path}/v"
    assert P.vault_root(spark, f"file://{tmp_path}/v") == f"{tmp_path}/v" and P.vault_root(spark, f"file://{tmp_path}") is None


def test_exclusions_together(spark):
    folders = spark.createDataFrame([(f,) for f in ("logs", "logs/sub", "a/logs", "b/my logs", "family/logs", "c")], "folder string")
    both = spark.createDataFrame([("logs",), ("a/logs",)], "folder string")
    alone = {r.folder: r.others for r in EX.collateral(folders, both).collect()}
    assert alone == {"logs": ["a/logs", "b/my logs"], "a/logs": ["b/my logs", "logs", "logs/sub"]}
    assert {r.folder: r.others for r in EX.collateral(folders, both, together=True).collect()} == {"logs": ["b/my logs"], "a/logs": ["b/my logs"]}
    assert EX.flag(("family",), ["logs", "family"]) == "--sensitive-paths family,logs"


def test_torn_journal(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text('{"run": 1}\n{"path": "a"}\n{"path": "b"}\n{"pa')
    header, rows, torn = sinks.read_lines(spark, f"file://{path}")
    assert header == {"run": 1} and rows.count() == 2 and torn
    path.write_text('{"run": 1}\n{"pa\n{"path": "b"}\n')
    with pytest.raises(ValueError, match="damaged"):
        sinks.read_lines(spark, f"file://{path}")


def test_chains_of_more_rows_than_a_recursive_query_may_give(spark):
    runs = spark.createDataFrame([("r0", None), *[(f"r{i}", f"r{i - 1}") for i in range(1, 12)], ("a", "b"), ("b", "a"), ("c", "lost")], "run_id string, resumed_from string")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        got = {tuple(r) for r in J.chain_positions(runs).collect()}
        assert got == {(f"r{i}", at, f"r{i - at}") for i in range(12) for at in range(i + 1)} | {("a", 0, "a"), ("a", 1, "b"), ("b", 0, "b"), ("b", 1, "a"), ("c", 0, "c")}
        assert {tuple(r) for r in J.chain_positions(runs, 2).collect()} == {r for r in got if r[1] < 2}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_bodies_stay_out_of_joins_of_facts(spark, monkeypatch):
    written = {}
    keep = scan.materialised
    monkeypatch.setattr(scan, "materialised", lambda df, name: written.setdefault(name, keep(df, name)))
    scan.prepare(P.plan(X.vault_notes(spark)))
    assert "body" in written["index"].columns and "body" not in written["facts"].columns and "body" not in written["prepared"].columns


def test_link_graph_reads_its_notes_once(spark):
    for name in ("a8_graph_totals", "j2_link_degrees", "j1_resolved_links", "a10_linking_share"):
        assert not [f for f in ALL[name](spark, "/root/testdata/sf0.001").inputFiles() if "documents" in f]


def test_settings(tmp_path):
    q = tmp_path / "q.yaml"
    q.write_text("lane:\n  options: {a: x, b: y}\nworth:\n  levels: [l, m, h]\nflag:\n  instructions: is it?\n")
    got = settings.question_set(str(q))
    assert [x["type"] for x in got.values()] == ["choice", "score", "noul"] and settings.review_choice(got) == "lane"
    with pytest.raises(ValueError):
        settings.question_set(str(q), need_vault_questions=True)
    p = tmp_path / "p.toml"
    p.write_text('vault = "notes"\nmax_usd = 3\n')
    assert settings.profile(str(p)) == {"vault": str(tmp_path / "notes"), "max_usd": 3}
    p.write_text("colour = 1\n")
    with pytest.raises(ValueError):
        settings.profile(str(p))
    d = tmp_path / "d.txt"
    d.write_text("# names\nJane\nAl\n\n")
    assert settings.denylist(str(d)) == (["Jane"], ["Al"])
    with pytest.raises(KeyError):
        settings.response_vote({"answers": {}})
    with pytest.raises(ValueError):
        P.refuse_root("x", "/home/private/vault")


def test_splice():
    assert sinks.spliced("a: 1\r\n'tidepool' : x\r\n  y: z\r\nb: 2", "tidepool: n") == "a: 1\ntidepool: n\nb: 2"
    assert sinks.spliced("tidepools: 1\ntidepool:\n  a: b\n   \n", "tidepool: n") == "tidepools: 1\ntidepool: n\n   \n"
    block = "tidepool:\n  bucket: junk"
    assert sinks.spliced(None, block) == block
    assert sinks.spliced("title: a", block) == "title: a\n" + block
    assert sinks.spliced("a: 1\ntidepool:\n  old: x\n\n  more: y\n\nb: 2", block) == "a: 1\n" + block + "\n\nb: 2"
