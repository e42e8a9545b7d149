"""A query per operator over the driver's tables. SQL for the same rows is in oracle.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool import derived as Y
from tidepool import derived_text as YT
from tidepool.derived import table
from tidepool.functions import redaction as R
from tidepool.functions import text as T
from tidepool.operators import bill as B
from tidepool.operators import decide as D
from tidepool.operators import diagnose as G
from tidepool.operators import exclude as EX
from tidepool.operators import index as I
from tidepool.operators import journal as J
from tidepool.operators import plan as P
from tidepool.operators import rollup as U
from tidepool.operators import siblings as SB
from tidepool.operators import survey as V
from tidepool.plans import records as RP
from tidepool.plans import runner as W
from tidepool.plans import scan as S
from tidepool.plans import shared
from tidepool.sources import notes as N
from tidepool.sources import records as RS
from tidepool.sources import sinks as K

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    ALL[f.__name__] = f
    return f


def vault(spark: SparkSession, sf: str) -> DataFrame:
    """documents as planned notes; src1 and src2 stand for a private and a hidden folder."""
    notes = N.from_documents(table(spark, sf, "documents"))
    rel = F.regexp_replace(F.regexp_replace("rel", "^src1/", "My Private notes/"), "^src2/", ".hidden/")
    return P.plan(notes.withColumn("rel", rel).withColumn("modified", F.to_timestamp(F.lit("2025-12-01"))))


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return S.prepare(vault(spark, sf))


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return S.decided(prepared(spark, sf))


# --- flagship -----------------------------------------------------------------------------------


@query
def m0_triage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Every layer once: plan, redact, index, decide, count."""
    return rows(spark, sf).groupBy("judge", "bucket", "action").agg(F.count(F.lit(1)).alias("notes"))


# --- scans and plan ------------------------------------------------------------------------------


@query
def s1_vault_listing(spark: SparkSession, sf: str) -> DataFrame:
    return vault(spark, sf).select("rel", "folder")


@query
def s2_unix_body(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n", "\r\n").alias("raw"))
    return d.select("doc_id", F.md5(T.unix_lines("raw")).alias("body_md5"))


@query
def s3_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    parsed = N.parsed(YT.files(spark, sf))
    return parsed.select("rel", "header_title", F.array_join("aliases", "|").alias("aliases"), F.array_join("keys", "|").alias("keys"), "locked", "created", "header_error", "undecodable", F.md5("body").alias("body_md5"))


@query
def s5_records(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "conversations").select(
        F.to_json(F.struct(F.concat_ws(":", "conv_id", "turn").alias("id"), F.struct("role", "text").alias("sent"))).alias("value"), F.monotonically_increasing_id().alias("line")
    )
    out = RS.checked(lines)
    return out.select("id", F.try_variant_get(F.col("sent")["role"], "$", "string").alias("role"), F.char_length(F.try_variant_get(F.col("sent")["text"], "$", "string")).alias("chars"))


@query
def s13_runs_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return K.latest_runs(Y.runs(spark, sf)).select("run_id", "started")


@query
def s17_stamp_changes(spark: SparkSession, sf: str) -> DataFrame:
    return Y.stamps(spark, sf).select("id", T.changed("old", "new").alias("changed"))


@query
def s18_quarantine_moves(spark: SparkSession, sf: str) -> DataFrame:
    rows, there = Y.clashing_rows(spark, sf)
    return K.quarantine_moves(rows, existing=there).select("from", "to", "reason")


@query
def f1_plan_status(spark: SparkSession, sf: str) -> DataFrame:
    return vault(spark, sf).select("rel", "status", "rule", "sensitive")


@query
def f2_plan_below_a_root(spark: SparkSession, sf: str) -> DataFrame:
    return P.plan(Y.paths(spark, sf), root="Private/work").select("rel", "status", "rule")


@query
def f5_near_misses(spark: SparkSession, sf: str) -> DataFrame:
    return P.near_misses(P.plan(Y.paths(spark, sf)))


@query
def o1_component_order(spark: SparkSession, sf: str) -> DataFrame:
    p = P.with_order(Y.paths(spark, sf))
    return p.select("rel", F.row_number().over(Window.orderBy("plan_ord")).alias("place"))


# --- scalars ----------------------------------------------------------------------------------------


@query
def p2_folders(spark: SparkSession, sf: str) -> DataFrame:
    p = Y.paths(spark, sf)
    return p.select("rel", T.folder("rel").alias("folder"), T.report_folder("rel").alias("report_folder"), T.top_folder("rel").alias("top"), T.survey_folder("rel").alias("survey"), F.array_join(T.folder_chain("rel"), "|").alias("chain"))


@query
def p6_body_facts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.body_digest("text").alias("digest"), T.body_is_empty("text").alias("empty"), T.word_count("text").alias("words"), T.heading_count("text").alias("headings"))


@query
def p6_body_facts_literal(spark: SparkSession, sf: str) -> DataFrame:
    d = Y.bodies(spark, sf)
    return d.select("id", T.body_digest("body").alias("digest"), T.body_is_empty("body").alias("empty"), T.heading_count("body").alias("headings"))


@query
def p10_links(spark: SparkSession, sf: str) -> DataFrame:
    got = Y.linked_vault(spark, sf).select("rel", T.parsed_links("body").alias("l"))
    return got.select("rel", F.array_join("l.targets", "|").alias("targets"), "l.embeds")


@query
def p11_bands(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("words", T.word_count("text"))
    days = F.col("doc_id") % 1500
    return d.select("doc_id", T.banded_words("words").alias("words"), T.banded_age(days).alias("age").cast("int"), T.length_band("words").alias("band"))


@query
def p13_dates_and_age(spark: SparkSession, sf: str) -> DataFrame:
    d = Y.dates(spark, sf).withColumn("made", T.creation_date("created", "date")).withColumn("stamped", T.creation_date("stamp"))
    return d.select("id", "made", T.age_source("made", "stamped").alias("source"), T.age_days("made", "stamped", "modified", "2026-01-01").alias("days"))


@query
def p18_title_tokens(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.array_join(F.array_sort(T.title_tokens("text")), " ").alias("tokens"))


@query
def p20_sensitive_folders(spark: SparkSession, sf: str) -> DataFrame:
    return Y.paths(spark, sf).select("rel", T.path_is_sensitive("rel").alias("sensitive"), T.path_is_sensitive("rel", ("deep notes", "equity")).alias("own_list"))


@query
def p22_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.excerpt("text", 1200)).alias("cut_md5"), T.truncated("text", 1200).alias("truncated"), T.truncated("text", 0).alias("beyond_guard"))


@query
def p28_tokens_and_dollars(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("tokens", T.tokens_for("n_chars", 2.8))
    return d.select("doc_id", "tokens", F.round(T.usd_for("tokens") * 1e9, 0).cast("long").alias("nano_usd"), T.usd(T.usd_for(F.col("tokens") * 1000)).alias("shown"))


@query
def p30_persist_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", ((F.col("doc_id") % 41) / 20.0).alias("v"))
    return d.select("doc_id", T.persist_label("v").alias("label"))


@query
def p31_margins(spark: SparkSession, sf: str) -> DataFrame:
    r = Y.report_rows(spark, sf).filter("bucket_probabilities IS NOT NULL")
    top = T.ordered_probabilities("bucket_probabilities")
    return r.select("path", T.margin("bucket_probabilities").alias("margin"), F.get(top, F.lit(0))["key"].alias("first"), T.runner_up("bucket_probabilities").alias("runner_up"))


@query
def p34_field_names(spark: SparkSession, sf: str) -> DataFrame:
    return Y.field_names(spark, sf).select("name", F.regexp_like("name", F.lit(RS.NAME)).alias("fits"))


@query
def p36_states(spark: SparkSession, sf: str) -> DataFrame:
    p = S.prepare(P.plan(Y.linked_vault(spark, sf)))
    return p.select("rel", "state.title", "state.path", F.md5("state.excerpt").alias("excerpt_md5"), F.array_join("own_hits", "|").alias("own_hits"), F.array_join("state.other_note_titles", "|").alias("others"), "payload_chars")


# --- redaction ----------------------------------------------------------------------------------------


@query
def r1_redacted_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = R.redacted(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.md5("redacted").alias("redacted_md5"), F.array_join("hits", "|").alias("hits"))


@query
def r2_credential_formats(spark: SparkSession, sf: str) -> DataFrame:
    return R.redacted(YT.secrets(spark, sf), "text").select("id", "redacted", F.array_join("hits", "|").alias("hits"))


@query
def r9_emails(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(F.regexp_replace("text", F.lit("(?U)" + R.EMAIL), F.lit("[EMAIL]"))).alias("redacted_md5"))


@query
def r15_luhn(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b\d{13,19}\b"), F.lit(0))).alias("digits"))
    return d.select("doc_id", "digits", F.call_function("luhn_check", F.col("digits")).alias("ok"))


@query
def r16_ssn(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("ssn "), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit("-12-3456 end")).alias("t"))
    return R.redacted(d, "t").select("doc_id", "redacted", F.array_join("hits", "|").alias("hits"))


@query
def r19_listed_names(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a text as it stands holds a listed name, also where other labels would hide the name with what is around it."""
    d = table(spark, sf, "documents").select("doc_id", F.array("text").alias("said")).withColumn("found", R.hidden_names(["the and", "ing"])("said"))
    return d.select("doc_id", F.when(F.get("said", F.lit(0)).isNotNull(), F.array_contains("found.hits", "NAME")).alias("named"))


@query
def r19_denylist(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer, and the first two words of every benchmark item, as listed names in the documents."""
    names = table(spark, sf, "customer").select("c_name").unionByName(table(spark, sf, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("c_name")))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" seen by CUSTOMER#"), F.lpad((F.col("doc_id") % 40).cast("string"), 9, "0"), F.lit(", not xCustomer#000000001."))
    d = R.names_hidden(table(spark, sf, "documents").select("doc_id", said.alias("said")), "doc_id", "said", names)
    return d.select("doc_id", F.md5(F.get("found.texts", F.lit(0))).alias("redacted_md5"), F.array_contains("found.hits", "NAME").alias("named"))


# --- index and graph ------------------------------------------------------------------------------------


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    """The index of linked notes, with what the link graph is made of; written once, since the graph reads it many times."""
    indexed = I.index(P.plan(Y.linked_vault(spark, sf)), S.TODAY)
    return shared.materialised(indexed.select("rel", "plan_ord", "status", "undecodable", "links", "words", "age_days"), "linked")


@query
def j1_resolved_links(spark: SparkSession, sf: str) -> DataFrame:
    return I.resolved_links(_linked(spark, sf)).select("rel", "target", "place", "resolved")


@query
def j2_link_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return I.link_facts(_linked(spark, sf)).select("rel", "out_links", "in_links", "unresolved_links", "is_moc", "is_orphan")


@query
def j3_exact_duplicate_pointer(spark: SparkSession, sf: str) -> DataFrame:
    notes = vault(spark, sf).withColumn("digest", F.when(F.col("status") == "scan", T.body_digest("body")))
    return I.exact_duplicates(notes).select("rel", "exact_duplicate_of")


@query
def j4_siblings(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat_ws(" ", F.lit("Note"), (F.col("doc_id") % 11).cast("string"), F.concat(F.lit("x"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("y"), (F.col("doc_id") % 5).cast("string")))
    found = SB.siblings(I.index(vault(spark, sf).withColumn("header_title", title), S.TODAY))
    return found.select("rel", F.array_join("other_note_titles", "|").alias("titles"))


@query
def a10_linking_share(spark: SparkSession, sf: str) -> DataFrame:
    return I.linking_share(I.link_facts(_linked(spark, sf))).select(F.round("share", 9).alias("share"))


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    """The vault with facts and rows that follow from doc_id, so that every counter has something to count."""
    by = lambda n, value: F.when(F.col("doc_id") % n == 0, value)
    d = vault(spark, sf).filter("body IS NOT NULL")
    scan, n = F.col("status") == "scan", F.col("doc_id")
    voted = scan & (n % 4 != 0)
    facts = d.withColumns(
        {
            "undecodable": F.when(scan & (n % 12 == 0), "not UTF-8"), "words": T.word_count("body"), "in_links": n % 3, "out_links": n % 4, "unresolved_links": n % 2, "is_orphan": n % 7 == 0,
            "is_moc": n % 9 == 0, "age_days": F.when(n % 13 != 0, n % 400).cast("int"),
        }
    )
    locked = scan & ~voted & (n % 8 == 0)
    rows = d.select(
        F.col("rel").alias("path"), F.when(voted, "vote").when(scan & (n % 16 == 4), "error").when(~scan | locked, "skip").alias("kind"), F.when(voted, F.when(n % 4 == 1, "local").otherwise("judged")).alias("judge"),
        F.when(voted, n % 8 == 2).alias("cached"), F.when(voted, F.when(n % 3 == 0, "junk").otherwise("reference")).alias("bucket"), F.when(voted, by(5, F.lit("junk"))).alias("suggested_bucket"),
        F.when(voted, F.coalesce(by(6, F.lit("quarantine")), F.lit("frontmatter"))).alias("action"), F.when(locked, "locked").alias("skipped"), F.when(n % 10 == 0, F.array(F.lit("a"), F.lit("b"))).alias("findings"),
        F.when(voted, F.element_at(F.array(F.lit("mtime"), F.lit("frontmatter"), F.lit("stamp")), (n % 3 + 1).cast("int"))).alias("age_source"), F.lit(None).cast("string").alias("exact_duplicate_of"),
    )
    return U.noted(facts, rows)


def _flat(m: str) -> Column:
    """A map as `value:n` by value, apart by commas."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias(m)


@query
def a6_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = U.totals(_mapped(spark, sf))
    return t.select(*[c for c in t.columns if c not in U.MAPS], *map(_flat, U.MAPS))


@query
def a7_folder_map(spark: SparkSession, sf: str) -> DataFrame:
    t = U.folder_map(_mapped(spark, sf))
    return t.select(*[c for c in t.columns if c not in U.MAPS], *map(_flat, U.MAPS))


@query
def a7_folder_rollup(spark: SparkSession, sf: str) -> DataFrame:
    every = F.reduce(F.map_values("findings"), F.lit(0).cast("long"), lambda s, n: s + n)
    names = ["folder", "notes", "judged", "local", "review", "quarantined", "locked", "orphans", "mocs", "age_from_mtime", "words", "in_links", "out_links", "unresolved_links"]
    return U.folder_map(_mapped(spark, sf)).select(*names, F.col("withheld").alias("skipped"), every.alias("findings"))


@query
def a7_folder_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return U.folder_map(_mapped(spark, sf)).select("folder", F.explode("buckets").alias("bucket", "n"))


@query
def a7_folder_ages(spark: SparkSession, sf: str) -> DataFrame:
    ages = U.folder_map(_mapped(spark, sf)).select("folder", F.explode("age_bands").alias("age", "n"))
    return ages.withColumn("age", F.when(F.col("age") != "unknown", F.col("age")).cast("int"))


@query
def a8_degree_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return U.degree_histogram(I.link_facts(_linked(spark, sf)), "in_links")


@query
def a8_out_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return U.degree_histogram(I.link_facts(_linked(spark, sf)), "out_links")


@query
def a8_graph_totals(spark: SparkSession, sf: str) -> DataFrame:
    return U.graph_totals(I.link_facts(_linked(spark, sf)))


@query
def o3_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return U.hubs(I.link_facts(_linked(spark, sf)), 2)


@query
def a9_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return U.duplicate_groups(rows(spark, sf)).select("canonical", F.array_join("copies", "|").alias("copies"))


# --- decisions --------------------------------------------------------------------------------------------


@query
def d1_local_triage(spark: SparkSession, sf: str) -> DataFrame:
    return S.prepare(P.plan(Y.linked_vault(spark, sf))).select("rel", "rule", "disposition")


@query
def u2_keyword_votes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", D.keyword_vote(F.lit("Note"), F.col("text")).alias("v"))
    return d.select("doc_id", "v.bucket", "v.persist", "v.contains_secret", "v.is_actionable")


@query
def u2_keyword_votes_literal(spark: SparkSession, sf: str) -> DataFrame:
    d = Y.excerpts(spark, sf).select("id", D.keyword_vote(F.col("title"), F.col("excerpt")).alias("v"))
    return d.select("id", "v.bucket", "v.persist", "v.contains_secret", "v.looks_like_duplicate", "v.records_a_decision", "v.safe_to_leave_in_git")


@query
def d3_policy(spark: SparkSession, sf: str) -> DataFrame:
    v = Y.votes(spark, sf)
    a = D.action(F.struct("bucket", "bucket_confidence", "persist", "contains_secret", "safe_to_leave_in_git"), F.col("hits"), 0.2)
    return v.select("id", a.alias("a")).select("id", "a.action", "a.reason", "a.review", F.array_join("a.triggers", "|").alias("triggers"))


@query
def d7_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf).select("path", "judge", "bucket", "persist", "confidence", "bucket_margin", "action", "reason", "exact_duplicate_of", "excerpt_chars", "truncated")


@query
def d7_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf).select("path", "judge", "bucket", "persist", "confidence", "bucket_margin", "contains_secret", "action", "reason", "exact_duplicate_of", "cached")


@query
def d8_cached_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A second run that is served by the first: as many votes, each under its own path."""
    first = rows(spark, sf).withColumns({"chain_pos": F.lit(0), "line": F.col("path")})
    again = S.prepare(vault(spark, sf), cached=J.cache(first))
    return S.decided(again).groupBy("judge", "cached", "bucket", "action").agg(F.count(F.lit(1)).alias("notes"), F.count_distinct("path").alias("paths"))


@query
def a1_preflight(spark: SparkSession, sf: str) -> DataFrame:
    return P.counts(vault(spark, sf))


@query
def a2_bill(spark: SparkSession, sf: str) -> DataFrame:
    b = B.bill(prepared(spark, sf), 1000)
    return b.select("n_fresh", "n_local", "n_locked", "n_cached", "n_unreadable", "n_age_from_mtime", "n_dated", "n_stamp_dated", "over_budget")


@query
def a3_bill_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(
        F.lit("fresh").alias("disposition"), F.char_length("text").alias("payload_chars"), F.lit(None).cast("string").alias("header_error"), F.lit("mtime").alias("age_source")
    )
    b = B.bill(d, 1000, 0.01)
    return b.select("n_fresh", "chars", "tokens_low", "tokens_high", F.round("usd_low", 6).alias("usd_low"), F.round("usd_high", 6).alias("usd_high"), "over_budget")


@query
def o4_largest_folders(spark: SparkSession, sf: str) -> DataFrame:
    d = vault(spark, sf).select("folder", F.lit("fresh").alias("disposition"), F.char_length("body").alias("payload_chars"))
    return B.largest_folders(d)


# --- records -----------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "conversations").select(
        F.to_json(F.struct(F.concat_ws(":", "conv_id", "turn").alias("id"), F.struct("role", "text").alias("sent"))).alias("value"), F.monotonically_increasing_id().alias("line")
    )
    return RS.checked(lines)


@query
def j7_same_records(spark: SparkSession, sf: str) -> DataFrame:
    return RP.prepare(_records(spark, sf)).select("id", "disposition", "same_as")


@query
def p35_record_states(spark: SparkSession, sf: str) -> DataFrame:
    return RS.states(RS.checked(YT.record_lines(spark, sf))).select("id", "state", F.array_join("hits", "|").alias("hits"))


@query
def a4_records_bill(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.sha2(F.concat_ws("|", "role", "text"), 256).alias("key"), F.char_length("text").alias("payload_chars"), F.lit("fresh").alias("disposition"))
    return B.records_bill(p)


@query
def d4_record_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Every way a record can go: kept, unsure, a secret by vote, held, unanswered, and equals that are asked next or served."""
    answer = F.struct(
        F.create_map(F.lit("lane"), F.struct(F.col("pick"), F.col("sure").alias("confidence"))).alias("choices"), F.create_map().cast("map<string,struct<value:double,confidence:double>>").alias("scores"),
        F.create_map(F.lit("contains_secret"), F.col("secret")).alias("nouls"), F.lit("m").alias("model"), F.lit(100).cast("bigint").alias("input_tokens"),
    )
    judge = lambda df: df.withColumn("vote", F.when(F.col("pick").isNotNull(), answer))
    out = RP.judged(Y.record_votes(spark, sf), {}, "lane", judge, error_stop=False)
    return out.select("id", "kind", "judge", F.col("pick").alias("pick"), "confidence", "action", "reason", "review", "suggested", F.array_join("quarantine_triggers", "|").alias("triggers"), "input_tokens", "same_as")


@query
def d4_record_rows(spark: SparkSession, sf: str) -> DataFrame:
    q = {"lane": {"type": "choice", "options": {"keep": "", "drop": ""}}, "worth": {"type": "score", "levels": ["a", "b", "c"]}, "contains_secret": {"type": "noul"}}
    out = RP.judged(RP.prepare(_records(spark, sf)), q, "lane")
    return out.select("id", "kind", "judge", "pick", "confidence", "action", "reason", "review", F.element_at("scores", "worth")["value"].alias("worth"), "same_as")


# --- journal, diff ------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@query
def w2_latest_row_per_key(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select(F.col("user_id").alias("path"), F.col("event_id").alias("line"), "event_type")
    return J.latest(e)


@query
def w3_cache_over_a_chain(spark: SparkSession, sf: str) -> DataFrame:
    return J.cache(Y.chain_rows(spark, sf)).select("key", "path", "bucket", "chain_pos")


@query
def j6_cache_probe(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    held = table(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.md5("text").alias("key"), F.lit("junk").alias("bucket"), F.lit("m").alias("model")).distinct()
    return J.served(d, held).select("doc_id", "is_cached")


@query
def j8_errors_to_retry(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select(F.col("user_id").alias("path"), F.col("event_id").alias("line"), F.when(F.col("event_id") % 7 == 0, "error").otherwise("vote").alias("kind"))
    return J.to_retry(e)


@query
def j10_diff(spark: SparkSession, sf: str) -> DataFrame:
    a, b = Y.snapshots(spark, sf)
    return J.diff(a, b).select("category", "path", F.coalesce("detail", F.lit("")).alias("detail"))


@query
def j10_diff_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over the documents: labels' verdicts against those of an earlier run."""
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id")
    cols = lambda bucket, keep: both.filter(keep).select(
        F.col("doc_id").cast("string").alias("path"), F.lit("vote").alias("kind"), F.lit("judged").alias("judge"), bucket.alias("bucket"), F.lit(0.8).alias("confidence"),
        F.when(F.col("toxic") == 1, "quarantine").otherwise("frontmatter").alias("action"), F.lit(None).cast("string").alias("exact_duplicate_of"), F.lit(None).cast("string").alias("suggested_bucket"),
        F.lit(False).alias("truncated"), F.array().cast("array<string>").alias("findings"), F.lit(None).cast("string").alias("skipped"),
    )
    before = cols(F.lit("reference"), F.col("doc_id") % 5 != 0).withColumn("action", F.lit("frontmatter"))
    after = cols(F.when(F.col("quality") == 1, "reference").otherwise("junk"), F.col("doc_id") % 7 != 0)
    return J.diff(before, after).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query
def j13_resume_chain(spark: SparkSession, sf: str) -> DataFrame:
    return J.chain_positions(Y.runs(spark, sf))


@query
def x4_run_to_resume(spark: SparkSession, sf: str) -> DataFrame:
    return J.to_resume(Y.runs(spark, sf)).select("run_id")


@query
def g13_header_changes(spark: SparkSession, sf: str) -> DataFrame:
    return J.header_changes(Y.runs(spark, sf), "r1", "r4")


@query
def g14_findings_counters(spark: SparkSession, sf: str) -> DataFrame:
    return J.findings_counters(*Y.snapshots(spark, sf))


@query
def w4_running_spend(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select(F.col("event_id").alias("done_ord"), F.floor("value").cast("long").alias("input_tokens"))
    return B.running_spend(e, 0.005).select("done_ord", F.round("spent", 9).alias("spent"), "after_stop")


def _sent(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rows of a run: some served from the cache, some decided locally, some failed."""
    n = F.col("event_id")
    return _events(spark, sf).select(
        n.alias("done_ord"), F.when(n % 11 == 0, "error").otherwise("vote").alias("kind"), F.when(n % 7 == 0, "local").otherwise("judged").alias("judge"), (n % 5 == 0).alias("cached"), F.lit("m").alias("model"),
        (F.floor("value") * 100).cast("long").alias("input_tokens"), F.lit(None).cast("string").alias("error"),
    )


@query
def c4_exact_stop(spark: SparkSession, sf: str) -> DataFrame:
    """A run up to the very row that takes it above its limit; what is served or local is not counted."""
    return W.kept(_sent(spark, sf), "done_ord", max_usd=0.5).select("done_ord", "sent", F.round("spent", 9).alias("spent"))


@query
def t3_model_drift(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sent(spark, sf).withColumn("model", F.when(F.col("done_ord") > 1500, "new").otherwise("m"))
    return W.kept(rows, "done_ord", known_models={"m"}).agg(F.max("done_ord").alias("last"), F.count(F.lit(1)).alias("rows"))


@query
def t4_run_in_waves(spark: SparkSession, sf: str) -> DataFrame:
    """A metered run over the documents: staged, cut and committed wave by wave, and read again from its journal."""
    n = F.col("doc_id")
    notes = table(spark, sf, "documents").select(n.cast("string").alias("rel"), F.lpad(n.cast("string"), 9, "0").alias("plan_ord"), "doc_id", "n_chars")
    none = F.lit(None).cast("string")
    decide = lambda df: df.select(
        F.when(n % 11 == 0, "error").otherwise("vote").alias("kind"), F.when(n % 7 == 0, "local").otherwise("judged").alias("judge"), F.col("rel").alias("path"), "plan_ord", (n % 5 == 0).alias("cached"),
        F.lit("m").alias("model"), F.col("n_chars").cast("long").alias("input_tokens"), none.alias("error"),
    )
    journal = f"{shared.folder(spark)}/journal-{uuid.uuid4().hex}"
    W.run(notes, decide, journal, "r", 150, max_usd=0.01)
    return K.read_rows(spark, journal, "r").select("path", "kind", "judge", "input_tokens")


@query
def a33_row_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return J.kinds(Y.report_rows(spark, sf))


@query
def w5_error_stop(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select(F.col("event_id").alias("done_ord"), F.when((F.col("event_id") > 300) & (F.col("event_id") % 3 != 0), "error").otherwise("vote").alias("kind"))
    return J.error_stop(e)


@query
def j12_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    folders = Y.paths(spark, sf).select(T.report_folder("rel").alias("folder"))
    targets = folders.filter(F.col("folder").isin("a b", "a-b", "a", "notes", "notes/deep notes", "work/familyroom"))
    return EX.collateral(folders, targets).select("folder", "name", F.array_join("others", "|").alias("others"))


@query
def f12_withheld(spark: SparkSession, sf: str) -> DataFrame:
    return EX.withheld(Y.paths(spark, sf).select(T.report_folder("rel").alias("folder")).distinct())


@query
def f11_out_of_credits(spark: SparkSession, sf: str) -> DataFrame:
    return Y.messages(spark, sf).select("id", J.out_of_credits(F.col("message")).alias("out"))


# --- survey -----------------------------------------------------------------------------------------------


def _eligible(spark: SparkSession, sf: str) -> DataFrame:
    return vault(spark, sf).filter("status = 'scan'").select("rel", T.word_count("body").alias("words"), (F.col("doc_id") % 1200).cast("int").alias("age_days"))


@query
def o7_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return V.sample(_eligible(spark, sf), 75, 7).select("rel", "stratum")


@query
def a31_strata(spark: SparkSession, sf: str) -> DataFrame:
    e = _eligible(spark, sf)
    return V.coverage(e, V.sample(e, 75, 7))


@query
def o8_spot_check(spark: SparkSession, sf: str) -> DataFrame:
    return V.spot_check(rows(spark, sf), 20, 3).select("path")


# --- diagnosis ----------------------------------------------------------------------------------------------


def _report(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(Y.report_rows(spark, sf))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, 9 if "usd" in c or c in ("impact", "full") or c.startswith(("estimate", "pile_")) and c != "pile_share" else places) for c, t in df.dtypes if t == "double"})


def _placed(df: DataFrame, name: str) -> DataFrame:
    """An ordered result of a few rows with its order as a column."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


ALL |= {
    "a12_diagnosis_counts": _report(lambda r: _rounded(G.counts(r))),
    "a13_medians": _report(lambda r: G.medians(r).select(*[F.round(c, 6).alias(c) for c in ("pile_margin", "rest_margin", "confidence_gap")])),
    "a14_tie_pairs": _report(lambda r: G.tie_pairs(r).select("x", "y", "n")),
    "a14_tie_summary": _report(lambda r: _rounded(G.tie_summary(r))),
    "a15_merge_gain": _report(lambda r: G.merge_gain(r).drop("first")),
    "a16_review_pull": _report(lambda r: _rounded(G.review_pull(r))),
    "a17_hot_folders": _report(lambda r: _placed(_rounded(G.hot_folders(r)), "place")),
    "a18_hot_folder_pairs": _report(G.hot_folder_pairs),
    "a19_biggest_folder": _report(lambda r: _rounded(G.biggest_folder(r))),
    "a20_skew_causes": _report(lambda r: _rounded(G.skew_causes(r)).withColumn("pile_share", F.round("pile_share", 6))),
    "a20_doubled_cap": _report(lambda r: _rounded(G.doubled_cap(r))),
    "a21_causes": _report(lambda r: G.causes(r).select("path", F.array_join("causes", "|").alias("causes"))),
    "a22_question_chars": _report(G.question_chars),
    "a23_rerun_costs": _report(lambda r: _rounded(G.rerun_costs(r))),
    "a24_bucket_counts": _report(lambda r: G.bucket_counts(r, D.BUCKETS)),
    "a25_dominant_cover": _report(G.dominant_cover),
    "a25_dominant_cost": _report(lambda r: _rounded(G.dominant_cost(r))),
    "a26_membrane": _report(G.membrane),
    "a27_errors": _report(G.errors),
    "a28_cost": _report(lambda r: _rounded(G.cost(r))),
    "a29_age_and_graph": _report(lambda r: _rounded(G.age_and_graph(r))),
    "a30_actions": _report(lambda r: _placed(_rounded(G.actions(r)), "rank")),
    "a34_mtime_finding": _report(G.mtime_finding),
}
