"""The same rows as queries.py gives, in SQL for DuckDB, written from the operators' meaning.

What the tables lack is added by the rules in derived.py; everything else is computed here anew.
"""

from __future__ import annotations

from tidepool import derived as Y
from tidepool import derived_text as YT


PATHS, REPORT, RUNS, BEFORE, AFTER = Y.PATHS, Y.REPORT, Y.RUNS, Y.BEFORE, Y.AFTER


def sensitive(rel: str, names: tuple[str, ...] = ("family", "private", "personal", "secrets", "inbox")) -> str:
    tests = " OR ".join(
        f"len(list_filter(string_split({rel}, '/')[:-2], lambda f: contains(' ' || array_to_string(regexp_extract_all(lower(f), '[a-z0-9]+'), ' ') || ' ', ' {n} '))) > 0" for n in names
    )
    return f"({tests})"


NOTES = """
notes AS (
  SELECT doc_id, text AS body, CASE source WHEN 'src1' THEN 'My Private notes' WHEN 'src2' THEN '.hidden' ELSE source END || '/' || doc_id || '.md' AS rel
  FROM documents
), planned AS (
  SELECT *, regexp_replace(rel, '[^/]*$', '') AS folder,
    CASE WHEN rel LIKE '.hidden/%' OR rel LIKE 'My Private%' THEN 'skip' ELSE 'scan' END AS status,
    CASE WHEN rel LIKE '.hidden/%' THEN 'hidden' WHEN rel LIKE 'My Private%' THEN 'sensitive' END AS rule,
    rel LIKE 'My Private%' AS sensitive
  FROM notes
)"""

BARE = "regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\\s+', ''), '\\s+$', '')"
DIGEST = f"left(sha256(regexp_replace(regexp_replace(regexp_replace({BARE}, '^# [^\\n]*(\\n|$)', ''), '^\\s+', ''), '\\s+$', '')), 16)"
WORDS = "len(regexp_extract_all(text, '\\S+'))"

#: First in plan order per digest, among the documents that may be scanned.
DUPLICATES = (
    NOTES
    + f""", digests AS (
  SELECT rel, status, folder, replace(rel, '/', chr(1)) AS ord, CASE WHEN status = 'scan' THEN {DIGEST.replace('text', 'body')} END AS digest, body FROM planned
), firsts AS (
  SELECT digest, arg_min(rel, ord) AS first FROM digests WHERE digest IS NOT NULL GROUP BY digest
), dup AS (
  SELECT d.rel, d.status, d.folder, d.ord, d.body, CASE WHEN f.first <> d.rel THEN f.first END AS exact_duplicate_of
  FROM digests d LEFT JOIN firsts f ON d.digest = f.digest
)"""
)

#: The keyword judge for a title and an excerpt.
BLOB = "lower({title}) || ' ' || lower({excerpt})"


def keyword_bucket(blob: str, excerpt: str) -> str:
    has = lambda *words: "(" + " OR ".join(f"contains({blob}, '{w}')" for w in words) + ")"
    return f"""CASE WHEN {has('[key]', 'secret', 'sk-', 'akia')} THEN 'needs_review'
      WHEN {has('tired', 'coffee', 'scratch', 'todo later', 'asdf')} THEN 'ephemeral'
      WHEN {has('lorem ipsum')} OR regexp_full_match({excerpt}, '\\s*') THEN 'junk'
      WHEN {has('nightly', 'daily run', 'run report', 'digest')} AND {has('scan', 'report', 'digest')} THEN 'log_entry'
      WHEN {has('we decided', 'decision:')} THEN 'project_decision'
      WHEN {has('```', 'benchmark', 'pytest')} THEN 'code_note'
      WHEN {has('https://', 'see also')} THEN 'reference' ELSE 'durable_memory' END"""


PERSIST = "CASE bucket WHEN 'junk' THEN 0.1::DOUBLE WHEN 'ephemeral' THEN 0.6 WHEN 'needs_review' THEN 1.1 WHEN 'log_entry' THEN 0.9 WHEN 'code_note' THEN 1.7 WHEN 'project_decision' THEN 1.9 WHEN 'durable_memory' THEN 2.0 ELSE 1.4 END"
SECRET = "CASE bucket WHEN 'needs_review' THEN 0.97::DOUBLE WHEN 'ephemeral' THEN 0.02 WHEN 'junk' THEN 0.01 WHEN 'log_entry' THEN 0.03 WHEN 'project_decision' THEN 0.03 WHEN 'code_note' THEN 0.02 WHEN 'reference' THEN 0.02 ELSE 0.04 END"

#: Written from the rules of the report: the pile is judged rows with a confidence below 0.55.
JUDGED = f"""report AS (SELECT * FROM {REPORT}), judged AS (
  SELECT *, coalesce(confidence, 0) < 0.55 AS in_pile, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir,
    list_sort([struct_pack(v := -e.value, i := i, k := e.key) FOR e, i IN map_entries(p)]) AS top
  FROM report WHERE kind = 'vote' AND judge <> 'local'
), pile AS (
  SELECT *, bucket = 'needs_review' OR coalesce(top[2].k = 'needs_review', false) AS pulled, row_number() OVER (ORDER BY confidence, plan_ord) AS place,
    CASE WHEN len(top) > 1 AND top[1].k <> 'needs_review' AND top[2].k <> 'needs_review' THEN least(top[1].k, top[2].k) END AS x,
    CASE WHEN len(top) > 1 AND top[1].k <> 'needs_review' AND top[2].k <> 'needs_review' THEN greatest(top[1].k, top[2].k) END AS y
  FROM judged WHERE in_pile
), ties AS (
  SELECT x, y, count(*) AS n, min(place) AS first FROM pile WHERE x IS NOT NULL GROUP BY x, y ORDER BY n DESC, first LIMIT 3
), merged AS (
  SELECT path, t.x, t.y, t.n, t.first, CASE WHEN map_contains(p, t.x) AND map_contains(p, t.y)
    THEN greatest(p[t.x] + p[t.y], coalesce(list_max([e.value FOR e IN map_entries(p) IF e.key <> t.x AND e.key <> t.y]), 0)) ELSE list_max(map_values(p)) END >= 0.55 AS clears
  FROM pile, ties t
), gains AS (
  SELECT x, y, any_value(n) AS tied, count(*) FILTER (clears) AS cleared, any_value(first) AS first FROM merged GROUP BY x, y
), hot AS (
  SELECT dir, min(plan_ord) AS first, count(*) AS notes, count(*) FILTER (in_pile) AS pile, avg(in_pile::INT) AS share, sum(input_tokens)::BIGINT AS tokens FROM judged GROUP BY dir
  HAVING count(*) >= 20 AND avg(in_pile::INT) >= 1.5 * (SELECT avg(in_pile::INT) FROM judged)
), skew AS (
  SELECT 'truncated' AS cause, count(*) FILTER (truncated) AS notes, count(*) FILTER (truncated AND in_pile) AS pile, count(*) AS n, count(*) FILTER (in_pile) AS np FROM judged
  UNION ALL SELECT 'short', count(*) FILTER (words < 50), count(*) FILTER (words < 50 AND in_pile), count(*), count(*) FILTER (in_pile) FROM judged
), skews AS (
  SELECT cause, notes, pile, notes / n * 100 AS share, pile / np * 100 AS pile_share, pile >= 10 AND notes > 0 AND pile / np >= 1.5 * notes / n AS fires FROM skew
), named AS (
  SELECT j.path, j.pulled, h.dir IS NOT NULL AS hot, list_filter([CASE WHEN t.n IS NOT NULL THEN 'tie ' || j.x || '–' || j.y END, CASE WHEN j.pulled THEN 'needs_review pull' END, CASE WHEN h.dir IS NOT NULL THEN 'hot folder' END,
      CASE WHEN j.truncated AND (SELECT fires FROM skews WHERE cause = 'truncated') THEN 'truncated' END,
      CASE WHEN j.words < 50 AND (SELECT fires FROM skews WHERE cause = 'short') THEN 'short' END], lambda c: c IS NOT NULL) AS c
  FROM pile j LEFT JOIN ties t ON t.x = j.x AND t.y = j.y LEFT JOIN hot h ON h.dir = j.dir
), top_bucket AS (
  SELECT bucket, count(*) AS notes, count(*) / (SELECT count(*) FROM judged) AS share FROM judged GROUP BY bucket HAVING count(*) > 0.5 * (SELECT count(*) FROM judged)
), cover AS (
  SELECT dir, notes FROM (SELECT *, sum(notes) OVER (ORDER BY notes DESC, first) - notes AS earlier, sum(notes) OVER () AS n FROM (
    SELECT dir, count(*) AS notes, min(plan_ord) AS first FROM judged WHERE bucket IN (SELECT bucket FROM top_bucket) GROUP BY dir)) WHERE earlier < 0.8 * n
), sent AS (SELECT *, CASE WHEN question_chars > 0 THEN question_chars END AS q FROM judged WHERE NOT coalesce(cached, false)
), asked AS (SELECT count(*) AS sent, count(*) > 0 AND count(q) = count(*) AS known, CASE WHEN count(*) > 0 AND count(q) = count(*) THEN sum(q)::BIGINT END AS total FROM sent)"""
USD = "({}) / 1e6 * 0.042::DOUBLE"
LOW, HIGH = "ceil(({}) / 3.8::DOUBLE)", "ceil(({}) / 2.8::DOUBLE)"

ELIGIBLE = (
    NOTES
    + """, eligible AS (
  SELECT rel, (doc_id % 1200)::INT AS days, len(regexp_extract_all(body, '\\S+')) AS words FROM planned WHERE status = 'scan'
), strata AS (
  SELECT rel, split_part(rel, '/', 1) || '/ | ' || CASE WHEN words < 100 THEN 'stub' WHEN words < 500 THEN 'short' WHEN words < 2000 THEN 'medium' ELSE 'long' END || ' | ' ||
    CASE WHEN days >= 1000 THEN 1000 WHEN days >= 365 THEN 365 WHEN days >= 90 THEN 90 WHEN days >= 30 THEN 30 WHEN days >= 7 THEN 7 WHEN days >= 1 THEN 1 ELSE 0 END AS stratum
  FROM eligible
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7|' || rel)) AS rn FROM strata
), sampled AS (
  SELECT rel, stratum FROM ranked ORDER BY rn, sha256('7|' || stratum), sha256('7|' || rel) LIMIT 75
)"""
)

#: The linked vault: plan, links as written and where they lead, by the rules of the link graph.
GRAPH = f"""v AS (
  SELECT rel, body, replace(rel, '/', chr(1)) AS ord, CASE WHEN rel LIKE '.hidden/%' OR rel LIKE 'family/%' THEN 'skip' WHEN bad THEN 'bad' ELSE 'scan' END AS status,
    CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '[^/]*$', '') ELSE './' END AS folder,
    list_concat(regexp_extract_all(body, '!?\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]', 1), regexp_extract_all(body, '!?\\[[^\\]]*\\]\\(([^)\\s]+?\\.md)(?:#[^)]*)?\\)', 1)) AS written,
    list_concat(regexp_extract_all(body, '(!?)\\[\\[[^\\]|#]+(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]', 1), regexp_extract_all(body, '(!?)\\[[^\\]]*\\]\\([^)\\s]+?\\.md(?:#[^)]*)?\\)', 1)) AS bangs
  FROM {Y.LINKED}
), t AS (
  SELECT *, list_filter([regexp_replace(replace(trim(w), chr(92), '/'), '(?i)\\.md$', '') FOR w IN written IF lower(trim(w)) LIKE '%.md' OR NOT contains(string_split(trim(w), '/')[-1], '.')], lambda x: x <> '') AS targets,
    len(list_filter(bangs, lambda b: b = '!')) AS embeds FROM v
), links AS (
  SELECT rel, unnest(targets) AS target, unnest(range(len(targets))) AS place FROM t WHERE status = 'scan'
), wanted AS (
  SELECT *, lower(trim(target, '/')) AS want FROM links
), resolved AS (
  SELECT w.rel, w.target, w.place, (SELECT arg_min(n.rel, n.ord) FROM v n WHERE lower(string_split(regexp_replace(n.rel, '(?i)\\.md$', ''), '/')[-1]) = string_split(w.want, '/')[-1]
    AND (NOT contains(w.want, '/') OR lower(regexp_replace(n.rel, '(?i)\\.md$', '')) = w.want OR ends_with(lower(regexp_replace(n.rel, '(?i)\\.md$', '')), '/' || w.want))) AS resolved FROM wanted w
), facts AS (
  SELECT rel, ord, status, (SELECT count(*) FROM resolved r WHERE r.rel = t.rel) AS o, (SELECT count(*) FROM resolved r WHERE r.rel = t.rel AND r.resolved IS NULL) AS u,
    (SELECT count(*) FROM resolved r WHERE r.resolved = t.rel AND r.rel <> t.rel) AS i, len(regexp_extract_all(body, '\\S+')) AS words FROM t
), graph AS (
  SELECT *, CASE WHEN status = 'scan' THEN o >= 8 AND words <= 20 * o END AS is_moc, CASE WHEN status = 'scan' AND (SELECT avg((o > 0)::INT) FROM facts WHERE status = 'scan') >= 0.05 THEN i = 0 END AS is_orphan FROM facts
)"""
#: Facts and rows of the documents as the map query makes them from doc_id.
MAPPED = NOTES + f""", m AS (
  SELECT *, {WORDS.replace('text', 'body')} AS words, status = 'scan' AND doc_id % 4 <> 0 AS voted FROM planned WHERE body IS NOT NULL
), f AS (
  SELECT *, CASE WHEN voted THEN CASE WHEN doc_id % 4 = 1 THEN 'local' ELSE 'judged' END END AS judge, status = 'scan' AS scan, status = 'scan' AND doc_id % 12 <> 0 AS read, CASE WHEN doc_id % 13 <> 0 THEN (doc_id % 400)::INT END AS days, unnest(list_concat(['./'], [array_to_string(string_split(rel, '/')[:i], '/') || '/' FOR i IN range(1, len(string_split(rel, '/')))])) AS f FROM m
)"""

#: Every counter of a folder, the maps as text.
MAPS = MAPPED + """, tags AS (
  SELECT f, 'buckets' AS t, CASE WHEN doc_id % 3 = 0 THEN 'junk' ELSE 'reference' END AS value FROM f WHERE voted UNION ALL SELECT f, 'judges', judge FROM f WHERE voted UNION ALL SELECT f, 'skipped', rule FROM f WHERE NOT scan
  UNION ALL SELECT f, 'findings', unnest(['a', 'b']) FROM f WHERE doc_id % 10 = 0
  UNION ALL SELECT f, 'age_bands', coalesce((CASE WHEN days IS NULL THEN NULL WHEN days >= 365 THEN 365 WHEN days >= 90 THEN 90 WHEN days >= 30 THEN 30 WHEN days >= 7 THEN 7 WHEN days >= 1 THEN 1 ELSE 0 END)::VARCHAR, 'unknown') FROM f WHERE read
), lists AS (
  SELECT f, t, string_agg(value || ':' || n, ',' ORDER BY value) AS list FROM (SELECT f, t, value, count(*) AS n FROM tags GROUP BY ALL) GROUP BY f, t
), numbers AS (
  SELECT f AS folder, count(*) AS notes, count(*) FILTER (voted) AS judged, count(*) FILTER (judge = 'local') AS local, count(*) FILTER (voted AND doc_id % 8 = 2) AS cached, count(*) FILTER (voted AND doc_id % 5 = 0) AS review,
  count(*) FILTER (voted AND doc_id % 6 = 0) AS quarantined, count(*) FILTER (scan AND doc_id % 8 = 0) AS locked, count(*) FILTER (NOT scan) AS withheld, count(*) FILTER (scan AND doc_id % 16 = 4) AS errors,
  count(*) FILTER (voted AND doc_id % 3 = 0) AS age_from_mtime, count(*) FILTER (voted AND doc_id % 3 = 1) AS dated, count(*) FILTER (voted AND doc_id % 3 = 2) AS stamp_dated,
  count(*) FILTER (read AND doc_id % 7 = 0) AS orphans, count(*) FILTER (read AND doc_id % 9 = 0) AS mocs, coalesce(sum(words) FILTER (read), 0)::BIGINT AS words, coalesce(sum(doc_id % 3) FILTER (read), 0)::BIGINT AS in_links,
  coalesce(sum(doc_id % 4) FILTER (read), 0)::BIGINT AS out_links, coalesce(sum(doc_id % 2) FILTER (read), 0)::BIGINT AS unresolved_links FROM f GROUP BY f
), whole AS (
  SELECT n.*, coalesce(b.list, '') AS buckets, coalesce(j.list, '') AS judges, coalesce(s.list, '') AS skipped, coalesce(g.list, '') AS findings, coalesce(a.list, '') AS age_bands FROM numbers n
    LEFT JOIN lists b ON b.f = folder AND b.t = 'buckets' LEFT JOIN lists j ON j.f = folder AND j.t = 'judges' LEFT JOIN lists s ON s.f = folder AND s.t = 'skipped'
    LEFT JOIN lists g ON g.f = folder AND g.t = 'findings' LEFT JOIN lists a ON a.f = folder AND a.t = 'age_bands'
)"""
#: Rows of a run with what each cost so far; only what was sent counts.
SENT = """SELECT *, sum(CASE WHEN sent THEN t ELSE 0 END) OVER (ORDER BY o) / 1e6 * 0.042::DOUBLE AS spent"""

SQL: dict[str, str] = {
    "m0_triage_summary": f"""WITH {DUPLICATES}, v AS (
        SELECT exact_duplicate_of IS NOT NULL AS local, {keyword_bucket("lower(body)", "body")} AS b FROM dup WHERE status = 'scan')
      SELECT CASE WHEN local THEN 'local' ELSE 'judged' END AS judge, CASE WHEN local THEN 'junk' ELSE b END AS bucket, 'frontmatter' AS action, count(*) AS notes FROM v GROUP BY ALL""",
    "s1_vault_listing": f"WITH {NOTES} SELECT rel, folder FROM planned",
    "s2_unix_body": "SELECT doc_id, md5(text) AS body_md5 FROM documents",
    "s5_records": "SELECT conv_id || ':' || turn AS id, role, length(text) AS chars FROM conversations",
    "s13_runs_in_order": f"SELECT run_id, started FROM {RUNS} ORDER BY started",
    "s17_stamp_changes": f"SELECT id, coalesce(abs(o - n) > 0.05, o IS DISTINCT FROM n) AS changed FROM {Y.STAMPS}",
    "f1_plan_status": f"WITH {NOTES} SELECT rel, status, rule, sensitive FROM planned",
    "f2_plan_below_a_root": f"""SELECT rel, 'skip' AS status, CASE WHEN rel LIKE '.%' OR rel LIKE '%/.%' THEN 'hidden' WHEN rel LIKE '_tidepool/%' THEN 'tidepool' ELSE 'sensitive' END AS rule FROM {PATHS}""",
    "f5_near_misses": f"""WITH p AS (SELECT rel, replace(rel, '/', chr(1)) AS ord, unnest(string_split(rel, '/')[:-2]) AS segment FROM {PATHS}
        WHERE NOT (rel LIKE '.%' OR rel LIKE '%/.%' OR rel LIKE '_tidepool/%') AND NOT {sensitive('rel')}),
      n AS (SELECT * FROM (VALUES (1, 'family'), (2, 'private'), (3, 'personal'), (4, 'secrets'), (5, 'inbox')) AS n(i, name)),
      m AS (SELECT p.*, n.i, n.name FROM p JOIN n ON contains(lower(segment), name) AND NOT contains(' ' || array_to_string(regexp_extract_all(lower(segment), '[a-z0-9]+'), ' ') || ' ', ' ' || name || ' '))
      SELECT segment, arg_min(name, (ord, i)) AS name, arg_min(rel, (ord, i)) AS rel FROM m GROUP BY segment""",
    "o1_component_order": f"SELECT rel, row_number() OVER (ORDER BY string_split(rel, '/'))::INT AS place FROM {PATHS}",
    "p2_folders": f"""SELECT rel, CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '[^/]*$', '') ELSE './' END AS folder,
        CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '.' END AS report_folder,
        CASE WHEN contains(rel, '/') THEN split_part(rel, '/', 1) ELSE '.' END AS top, CASE WHEN contains(rel, '/') THEN split_part(rel, '/', 1) || '/' ELSE './' END AS survey,
        array_to_string(list_concat(['./'], [array_to_string(string_split(rel, '/')[:i], '/') || '/' FOR i IN range(1, len(string_split(rel, '/')))]), '|') AS chain FROM {PATHS}""",
    "p6_body_facts": f"""SELECT doc_id, {DIGEST} AS digest, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND NOT starts_with(ltrim(l), '#'))) = 0 AS empty,
        {WORDS}::INT AS words, len(regexp_extract_all(text, '(?m)^#{{1,6}}\\s+\\S'))::INT AS headings FROM documents""",
    "p6_body_facts_literal": f"""SELECT id, {DIGEST} AS digest,
        len(list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda l: trim(l) <> '' AND NOT starts_with(ltrim(l), '#'))) = 0 AS empty,
        len(regexp_extract_all(text, '(?m)^#{{1,6}}\\s+\\S'))::INT AS headings FROM {Y.BODIES}""",
    "p11_bands": f"""WITH d AS (SELECT doc_id, {WORDS} AS w, doc_id % 1500 AS days FROM documents)
      SELECT doc_id, CASE WHEN w < 100 THEN w ELSE (w // (10 ** (length(w::VARCHAR) - 2))::BIGINT) * (10 ** (length(w::VARCHAR) - 2))::BIGINT END::BIGINT AS words,
        CASE WHEN days >= 1000 THEN 1000 WHEN days >= 365 THEN 365 WHEN days >= 90 THEN 90 WHEN days >= 30 THEN 30 WHEN days >= 7 THEN 7 WHEN days >= 1 THEN 1 ELSE 0 END::INT AS age,
        CASE WHEN w < 100 THEN 'stub' WHEN w < 500 THEN 'short' WHEN w < 2000 THEN 'medium' ELSE 'long' END AS band FROM d""",
    "p18_title_tokens": "SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ') AS tokens FROM benchmark",
    "p20_sensitive_folders": f"SELECT rel, {sensitive('rel')} AS sensitive, {sensitive('rel', ('deep notes', 'equity'))} AS own_list FROM {PATHS}",
    "p22_excerpts": "SELECT doc_id, md5(left(text, 1200)) AS cut_md5, length(text) > 1200 AS truncated, length(text) > 60000 AS beyond_guard FROM documents",
    "p28_tokens_and_dollars": """WITH d AS (SELECT doc_id, ceil(n_chars / 2.8::DOUBLE)::BIGINT AS tokens FROM documents)
      SELECT doc_id, tokens, round(tokens / 1e6 * 0.042::DOUBLE * 1e9)::BIGINT AS nano_usd,
        '$' || CASE WHEN tokens * 1000 / 1e6 * 0.042::DOUBLE >= 0.10 THEN format('{:.2f}', tokens * 1000 / 1e6 * 0.042::DOUBLE) ELSE format('{:.4f}', tokens * 1000 / 1e6 * 0.042::DOUBLE) END AS shown FROM d""",
    "p30_persist_labels": """WITH d AS (SELECT doc_id, (doc_id % 41) / 20.0::DOUBLE AS v, ['drop', 'park', 'promote'] AS w FROM documents), e AS (SELECT *, floor(v)::INT AS lo, least(floor(v)::INT + 1, 2) AS hi, v - floor(v) AS f FROM d)
      SELECT doc_id, CASE WHEN f < 0.15::DOUBLE THEN w[lo + 1] WHEN f > 0.85::DOUBLE THEN w[hi + 1] ELSE w[lo + 1] || '–' || w[hi + 1] || ', leaning ' || CASE WHEN f < 0.5 THEN w[lo + 1] ELSE w[hi + 1] END END AS label FROM e""",
    "p34_field_names": f"SELECT name, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]{{0,63}}') AS fits FROM {Y.FIELDS}",
    "r9_emails": "SELECT doc_id, md5(regexp_replace(text, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b', '[EMAIL]', 'g')) AS redacted_md5 FROM documents",
    "r15_luhn": """WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b\\d{13,19}\\b')) AS digits FROM documents)
      SELECT doc_id, digits, list_sum([CASE WHEN i % 2 = 1 THEN x ELSE CASE WHEN 2 * x > 9 THEN 2 * x - 9 ELSE 2 * x END END FOR x, i IN list_transform(string_split(reverse(digits), ''), lambda c: c::INT)]) % 10 = 0 AS ok FROM d""",
    "r16_ssn": "SELECT doc_id, 'ssn [SSN] end' AS redacted, 'SSN' AS hits FROM documents",
    "s3_frontmatter": YT.FILES,
    "r2_credential_formats": YT.SECRETS,
    "p35_record_states": YT.RECORDS,
    "c4_exact_stop": f"""WITH e AS (SELECT event_id AS o, floor(value)::BIGINT * 100 AS t, event_id % 11 = 0 OR (event_id % 7 <> 0 AND event_id % 5 <> 0) AS sent FROM events), r AS ({SENT} FROM e)
      SELECT o AS done_ord, sent, round(spent, 9) AS spent FROM r WHERE o <= coalesce((SELECT min(o) FROM r WHERE sent AND t > 0 AND spent > 0.5), o)""",
    "t3_model_drift": """WITH d AS (SELECT min(event_id) AS cut FROM events WHERE event_id > 1500 AND event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0)
      SELECT max(event_id) AS last, count(*) AS rows FROM events WHERE event_id <= coalesce((SELECT cut FROM d), event_id)""",
    "t4_run_in_waves": f"""WITH e AS (SELECT doc_id, doc_id AS o, n_chars::BIGINT AS t, doc_id % 11 = 0 OR (doc_id % 7 <> 0 AND doc_id % 5 <> 0) AS sent FROM documents), r AS ({SENT} FROM e)
      SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'vote' END AS kind, CASE WHEN doc_id % 7 = 0 THEN 'local' ELSE 'judged' END AS judge, t AS input_tokens
      FROM r WHERE o <= coalesce((SELECT min(o) FROM r WHERE sent AND t > 0 AND spent > 0.01), o)""",
    "r19_denylist": """WITH names AS (SELECT DISTINCT n FROM (SELECT c_name AS n FROM customer WHERE c_custkey < 40 UNION ALL SELECT array_to_string(string_split(text, ' ')[1:2], ' ') FROM benchmark) WHERE length(trim(n)) >= 3),
      p AS (SELECT list('(^|[^A-Za-z0-9])' || array_to_string(list_transform(regexp_split_to_array(trim(n), '\\s+'), lambda w: regexp_escape(w)), '[\\s_\\-./–—]+') || '($|[^A-Za-z0-9])' ORDER BY length(trim(n)) DESC) AS ps FROM names),
      d AS (SELECT doc_id, coalesce(text, '') || ' seen by CUSTOMER#' || lpad((doc_id % 40)::VARCHAR, 9, '0') || ', not xCustomer#000000001.' AS said FROM documents),
      h AS (SELECT doc_id, said, list_reduce(list_prepend(said, ps), lambda t, x: regexp_replace(regexp_replace(t, x, '\\1[NAME]\\2', 'gi'), x, '\\1[NAME]\\2', 'gi')) AS hidden FROM d, p)
      SELECT doc_id, md5(hidden) AS redacted_md5, hidden <> said AS named FROM h""",
    "r19_listed_names": "SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(the[\\s_\\-./–—]+and|ing)($|[^A-Za-z0-9])') AS named FROM documents",
    "j3_exact_duplicate_pointer": f"WITH {DUPLICATES} SELECT rel, exact_duplicate_of FROM dup",
    "a9_duplicate_groups": f"WITH {DUPLICATES} SELECT exact_duplicate_of AS canonical, array_to_string(list_sort(list(rel)), '|') AS copies FROM dup WHERE exact_duplicate_of IS NOT NULL GROUP BY 1",
    "a7_folder_rollup": f"""WITH {MAPPED} SELECT f AS folder, count(*) AS notes, count(*) FILTER (voted) AS judged, count(*) FILTER (judge = 'local') AS local, count(*) FILTER (voted AND doc_id % 5 = 0) AS review, count(*) FILTER (voted AND doc_id % 6 = 0) AS quarantined,
        count(*) FILTER (scan AND doc_id % 8 = 0) AS locked, count(*) FILTER (NOT scan) AS skipped, count(*) FILTER (read AND doc_id % 7 = 0) AS orphans, count(*) FILTER (read AND doc_id % 9 = 0) AS mocs,
        count(*) FILTER (voted AND doc_id % 3 = 0) AS age_from_mtime, 2 * count(*) FILTER (doc_id % 10 = 0) AS findings, coalesce(sum(words) FILTER (read), 0)::BIGINT AS words, coalesce(sum(doc_id % 3) FILTER (read), 0)::BIGINT AS in_links,
        coalesce(sum(doc_id % 4) FILTER (read), 0)::BIGINT AS out_links, coalesce(sum(doc_id % 2) FILTER (read), 0)::BIGINT AS unresolved_links FROM f GROUP BY f""",
    "u2_keyword_votes": f"""WITH d AS (SELECT doc_id, {keyword_bucket("'note ' || lower(text)", "text")} AS bucket FROM documents)
      SELECT doc_id, bucket, {PERSIST} AS persist, {SECRET} AS contains_secret, CASE WHEN bucket = 'project_decision' THEN 0.7 ELSE 0.3 END::DOUBLE AS is_actionable FROM d""",
    "u2_keyword_votes_literal": f"""WITH d AS (SELECT *, {keyword_bucket("lower(title) || ' ' || lower(excerpt)", "excerpt")} AS bucket FROM {Y.EXCERPTS})
      SELECT id, bucket, {PERSIST} AS persist, {SECRET} AS contains_secret, CASE WHEN contains(lower(title || ' ' || excerpt), 'duplicate') THEN 0.12 ELSE 0.05 END::DOUBLE AS looks_like_duplicate,
        CASE WHEN bucket = 'project_decision' THEN 0.88 ELSE 0.2 END::DOUBLE AS records_a_decision, CASE WHEN bucket = 'needs_review' THEN 0.1 ELSE 0.8 END::DOUBLE AS safe_to_leave_in_git FROM d""",
    "d3_policy": f"""WITH v AS (SELECT *, list_filter(hits, lambda h: h IN ('KEY', 'WEBHOOK', 'JWT', 'PEM', 'AWS_SECRET', 'BEARER', 'URL_CREDENTIAL')) AS local FROM {Y.VOTES}),
      w AS (SELECT *, CASE WHEN len(local) > 0 THEN 1 WHEN secret >= 0.7 THEN 2 WHEN git <= 0.2 THEN 3 WHEN bucket = 'needs_review' OR conf < 0.55 THEN 4 WHEN bucket = 'junk' AND persist < 0.5 THEN 5 ELSE 6 END AS way FROM v)
      SELECT id, CASE WHEN way < 4 THEN 'quarantine' ELSE 'frontmatter' END AS action,
        CASE way WHEN 1 THEN 'local redaction hit: ' || array_to_string(local, ', ') WHEN 2 THEN 'contains_secret above threshold' WHEN 3 THEN 'safe_to_leave_in_git at or below 0.2'
          WHEN 4 THEN 'low confidence or explicit needs_review' WHEN 5 THEN 'junk, low persist: marked only, never deleted' ELSE 'normal vote' END AS reason, way = 4 AS review,
        CASE way WHEN 1 THEN array_to_string(list_transform(local, lambda h: 'local:' || h), '|') WHEN 2 THEN 'contains_secret' WHEN 3 THEN 'safe_to_leave_in_git' ELSE '' END AS triggers FROM w""",
    "a1_preflight": f"WITH {NOTES} SELECT folder, status, rule, count(*) AS notes FROM planned GROUP BY ALL",
    "a2_bill": f"""WITH {DUPLICATES} SELECT count(*) FILTER (exact_duplicate_of IS NULL) AS n_fresh, count(*) FILTER (exact_duplicate_of IS NOT NULL) AS n_local, 0::BIGINT AS n_locked, 0::BIGINT AS n_cached, 0::BIGINT AS n_unreadable,
        count(*) AS n_age_from_mtime, 0::BIGINT AS n_dated, 0::BIGINT AS n_stamp_dated, false AS over_budget FROM dup WHERE status = 'scan'""",
    "a3_bill_of_documents": """WITH d AS (SELECT count(*) AS n_fresh, (sum(length(text)) + 1000 * count(*))::BIGINT AS chars FROM documents), e AS (SELECT *, ceil(chars / 3.8::DOUBLE)::BIGINT AS tokens_low, ceil(chars / 2.8::DOUBLE)::BIGINT AS tokens_high FROM d)
      SELECT n_fresh, chars, tokens_low, tokens_high, round(tokens_low / 1e6 * 0.042::DOUBLE, 6) AS usd_low, round(tokens_high / 1e6 * 0.042::DOUBLE, 6) AS usd_high, tokens_high / 1e6 * 0.042::DOUBLE > 0.01 AS over_budget FROM e""",
    "o4_largest_folders": f"WITH {NOTES} SELECT folder, sum(length(body))::BIGINT AS chars, count(*) AS notes FROM planned GROUP BY folder ORDER BY chars DESC, folder LIMIT 5",
    "j7_same_records": """WITH c AS (SELECT conv_id || ':' || turn AS id, role, text FROM conversations), f AS (SELECT role, text, min(id) AS first FROM c GROUP BY ALL)
      SELECT id, 'fresh' AS disposition, CASE WHEN first <> id THEN first END AS same_as FROM c JOIN f USING (role, text)""",
    "a4_records_bill": """WITH c AS (SELECT conv_id || ':' || turn AS id, role, text FROM conversations), f AS (SELECT role, text, arg_min(length(text), id) AS chars, count(*) AS n FROM c GROUP BY ALL)
      SELECT count(*) AS to_send, sum(chars)::BIGINT AS chars, sum(n - 1)::BIGINT AS reused FROM f""",
    "d4_record_rows": """WITH c AS (SELECT conv_id || ':' || turn AS id, role, text FROM conversations), f AS (SELECT role, text, min(id) AS first FROM c GROUP BY ALL)
      SELECT id, 'vote' AS kind, 'judged' AS judge, 'keep' AS pick, 0.8::DOUBLE AS confidence, 'label' AS action, 'normal vote' AS reason, false AS review, 1.0::DOUBLE AS worth, CASE WHEN first <> id THEN first END AS same_as FROM c JOIN f USING (role, text)""",
    "w2_latest_row_per_key": "SELECT user_id AS path, max(event_id) AS line, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "j6_cache_probe": "SELECT doc_id, md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) AS is_cached FROM documents",
    "j8_errors_to_retry": "SELECT user_id AS path FROM events GROUP BY user_id HAVING max(event_id) % 7 = 0",
    "w4_running_spend": """WITH e AS (SELECT event_id AS done_ord, floor(value)::BIGINT AS t FROM events), s AS (SELECT *, sum(t) OVER (ORDER BY done_ord) AS upto FROM e)
      SELECT done_ord, round(upto / 1e6 * 0.042::DOUBLE, 9) AS spent, (upto - t) / 1e6 * 0.042::DOUBLE > 0.005 AS after_stop FROM s""",
    "w3_cache_over_a_chain": f"""SELECT key, arg_max(path, (-pos, line)) AS path, arg_max(bucket, (-pos, line)) AS bucket, arg_max(pos, (-pos, line))::INT AS chain_pos FROM {Y.CHAIN} GROUP BY key""",
    "j10_diff": f"""WITH a AS (SELECT * FROM {BEFORE}), b AS (SELECT * FROM {AFTER}),
      j AS (SELECT coalesce(b.path, a.path) AS path, a.path IS NULL AS new, b.path IS NULL AS gone, a.path IS NOT NULL AND b.path IS NOT NULL AS twice, coalesce(a.kind = 'vote' AND b.kind = 'vote', false) AS votes,
        a.bucket AS ab, b.bucket AS bb, coalesce(a.kind = 'vote' AND a.suggested IS NOT NULL, false) AS ar, coalesce(b.kind = 'vote' AND b.suggested IS NOT NULL, false) AS br,
        coalesce(a.action = 'quarantine', false) AS aq, coalesce(b.action = 'quarantine', false) AS bq, a.dup AS ad, b.dup AS bd, coalesce(a.truncated, false) AS acut, coalesce(b.truncated, false) AS bcut,
        coalesce(len(a.findings), 0) AS af, coalesce(len(b.findings), 0) AS bf, coalesce(a.skipped = 'locked', false) AS al, coalesce(b.skipped = 'locked', false) AS bl, coalesce(b.kind = 'error', false) AS berr
        FROM a FULL JOIN b ON a.path = b.path),
      m AS (
        SELECT 'bucket_changed' AS category, path, ab, bb, votes FROM j WHERE votes AND ab <> bb
        UNION ALL SELECT 'into_review', path, ab, bb, votes FROM j WHERE (votes AND br AND NOT ar) OR (new AND br AND NOT bq)
        UNION ALL SELECT 'out_of_review', path, ab, bb, votes FROM j WHERE votes AND ar AND NOT br
        UNION ALL SELECT 'quarantined', path, ab, bb, votes FROM j WHERE NOT gone AND bq AND NOT aq
        UNION ALL SELECT 'released', path, ab, bb, votes FROM j WHERE twice AND aq AND NOT bq
        UNION ALL SELECT 'new_duplicates', path, ab, bb, votes FROM j WHERE bd IS NOT NULL AND (new OR (votes AND bd IS DISTINCT FROM ad))
        UNION ALL SELECT 'crossed_cap', path, ab, bb, votes FROM j WHERE votes AND acut <> bcut
        UNION ALL SELECT 'findings_fixed', path, ab, bb, votes FROM j WHERE twice AND af > 0 AND bf = 0
        UNION ALL SELECT 'findings_new', path, ab, bb, votes FROM j WHERE twice AND af = 0 AND bf > 0
        UNION ALL SELECT 'locked_since', path, ab, bb, votes FROM j WHERE NOT gone AND bl AND NOT al
        UNION ALL SELECT 'unlocked_since', path, ab, bb, votes FROM j WHERE twice AND al AND NOT bl)
      SELECT category, path, CASE WHEN votes THEN ab || ' -> ' || bb ELSE '' END AS detail FROM (
        SELECT * FROM m UNION ALL SELECT 'new', path, ab, bb, votes FROM j WHERE new UNION ALL SELECT 'gone', path, ab, bb, votes FROM j WHERE gone
        UNION ALL SELECT 'errors_after', path, ab, bb, votes FROM j WHERE NOT gone AND berr
        UNION ALL SELECT 'findings_new', path, ab, bb, votes FROM j, range(bf) WHERE new
        UNION ALL SELECT 'unchanged', path, ab, bb, votes FROM j WHERE twice AND path NOT IN (SELECT path FROM m))""",
    "j10_diff_of_documents": """WITH l AS (SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)), j AS (SELECT *, doc_id % 5 <> 0 AS a, doc_id % 7 <> 0 AS b FROM l WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0)
      SELECT category, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN a AND NOT b THEN 'gone' END, CASE WHEN b AND NOT a THEN 'new' END, CASE WHEN a AND b AND quality <> 1 THEN 'bucket_changed' END,
        CASE WHEN b AND toxic = 1 THEN 'quarantined' END, CASE WHEN a AND b AND quality = 1 AND toxic <> 1 THEN 'unchanged' END], lambda c: c IS NOT NULL)) AS category FROM j) GROUP BY category""",
    "j13_resume_chain": f"""WITH RECURSIVE r AS (SELECT * FROM {RUNS}), c AS (SELECT run_id, 0 AS "at", run_id AS ancestor, resumed_from AS next, [run_id] AS seen FROM r
        UNION ALL SELECT c.run_id, c."at" + 1, r.run_id, r.resumed_from, list_append(c.seen, r.run_id) FROM c JOIN r ON r.run_id = c.next WHERE NOT list_contains(c.seen, r.run_id) AND c."at" < 99)
      SELECT run_id, "at", ancestor FROM c""",
    "x4_run_to_resume": f"WITH r AS (SELECT * FROM {RUNS}) SELECT run_id FROM r WHERE NOT finished AND run_id NOT IN (SELECT resumed_from FROM r WHERE resumed_from IS NOT NULL) ORDER BY started DESC, run_id DESC LIMIT 1",
    "g13_header_changes": f"""WITH r AS (SELECT * FROM {RUNS}), p AS (SELECT a.*, b.taxonomy AS t2, b.model_requested AS m2, b.state_version AS s2, b.excerpt_cap AS e2, b.denylist AS d2 FROM r a, r b WHERE a.run_id = 'r1' AND b.run_id = 'r4')
      SELECT * FROM (SELECT 'taxonomy' AS field, taxonomy AS before, t2 AS after FROM p UNION ALL SELECT 'model_requested', model_requested, m2 FROM p UNION ALL SELECT 'state_version', state_version::VARCHAR, s2::VARCHAR FROM p
        UNION ALL SELECT 'excerpt_cap', excerpt_cap::VARCHAR, e2::VARCHAR FROM p UNION ALL SELECT 'denylist', denylist, d2 FROM p) WHERE before IS DISTINCT FROM after""",
    "g14_findings_counters": f"""WITH f AS (SELECT unnest(findings) AS finding, 0 AS side FROM {BEFORE} UNION ALL SELECT unnest(findings), 1 FROM {AFTER})
      SELECT finding, count(*) FILTER (side = 0) AS before, count(*) FILTER (side = 1) AS after FROM f GROUP BY finding""",
    "a33_row_kinds": f"SELECT kind, count(*) AS n FROM {REPORT} GROUP BY kind",
    "f11_out_of_credits": f"""SELECT id, regexp_matches(message, '(?i)\\b(?:http|status|error)\\b([^\\n]{{0,23}}[^0-9\\n])402($|[^0-9])') OR regexp_matches(message, '(?i)(^|[^0-9])402([^0-9\\n][^\\n]{{0,23}})\\b(?:payment|credits)')
        OR (contains(lower(message), 'no available') AND contains(lower(message), 'credits')) AS out FROM {Y.MESSAGES}""",
    "o7_stratified_sample": f"WITH {ELIGIBLE} SELECT rel, stratum FROM sampled",
    "a31_strata": f"WITH {ELIGIBLE} SELECT s.stratum, s.n AS population, coalesce(t.n, 0) AS sampled FROM (SELECT stratum, count(*) AS n FROM strata GROUP BY 1) s LEFT JOIN (SELECT stratum, count(*) AS n FROM sampled GROUP BY 1) t ON s.stratum = t.stratum",
    "o8_spot_check": f"WITH {DUPLICATES} SELECT rel AS path FROM dup WHERE status = 'scan' AND exact_duplicate_of IS NULL ORDER BY sha256('3|' || rel) LIMIT 20",
    "p31_margins": f"""WITH r AS (SELECT path, list_sort([struct_pack(v := -e.value, i := i, k := e.key) FOR e, i IN map_entries(p)]) AS top FROM {REPORT} WHERE p IS NOT NULL)
      SELECT path, round((-top[1].v + coalesce(top[2].v, 0))::DOUBLE, 3) AS margin, top[1].k AS first, CASE WHEN len(top) > 1 THEN top[2].k || ' at ' || format('{{:.2f}}', (-top[2].v)::DOUBLE) ELSE 'no contender' END AS runner_up FROM r""",
    "s18_quarantine_moves": f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY stem || '.md') AS i FROM {Y.CLASHING}),
      r AS (SELECT k, 0::BIGINT AS i, coalesce(taken, []) AS taken, NULL::VARCHAR AS stem, NULL::VARCHAR AS t, NULL::VARCHAR AS reason FROM (SELECT DISTINCT k FROM d) LEFT JOIN (SELECT k, list(path) AS taken FROM {Y.THERE} GROUP BY k) USING (k)
        UNION ALL SELECT k, i, list_append(taken, lower(t)), stem, t, reason FROM (SELECT d.k, d.i, r.taken, d.stem, d.reason,
          list_filter(['_tidepool/quarantine/' || d.stem || CASE WHEN n = 1 THEN '' ELSE '-' || n END || '.md' FOR n IN range(1, 20)], lambda x: NOT list_contains(r.taken, lower(x)))[1] AS t FROM r JOIN d ON d.k = r.k AND d.i = r.i + 1))
      SELECT stem || '.md' AS from, t AS to, reason FROM r WHERE stem IS NOT NULL""",
    "a12_diagnosis_counts": f"""WITH {JUDGED} SELECT count(*) AS n_rows, count(*) FILTER (kind = 'vote') AS n_votes, (SELECT count(*) FROM judged) AS n_judged, count(*) FILTER (kind = 'vote' AND judge = 'local') AS n_local,
        count(*) FILTER (kind = 'skip') AS n_withheld, count(*) FILTER (kind = 'error') AS n_errors, (SELECT count(*) FROM pile) AS n_pile, count(*) FILTER (kind = 'vote' AND action = 'quarantine') AS n_quarantined,
        count(*) FILTER (kind = 'vote' AND len(redacted) > 0) AS n_redacted, count(*) FILTER (kind = 'vote' AND dup IS NOT NULL) AS n_duplicates,
        round((SELECT count(*) FROM pile) / (SELECT count(*) FROM judged) * 100, 6) AS pile_share FROM report""",
    "a13_medians": f"""WITH {JUDGED} SELECT round(median(coalesce(bucket_margin, 0)::DOUBLE) FILTER (in_pile), 6) AS pile_margin, round(median(coalesce(bucket_margin, 0)::DOUBLE) FILTER (NOT in_pile), 6) AS rest_margin,
        round(median(abs(confidence::DOUBLE + top[1].v::DOUBLE)), 6) AS confidence_gap FROM judged""",
    "a14_tie_pairs": f"WITH {JUDGED} SELECT x, y, n FROM ties",
    "a14_tie_summary": f"WITH {JUDGED}, t AS (SELECT (SELECT sum(n) FROM ties)::BIGINT AS tied, (SELECT count(*) FROM pile) AS n) SELECT tied, round(tied / n * 100, 6) AS share, tied / n >= 0.5 AS overlap FROM t",
    "a15_merge_gain": f"WITH {JUDGED} SELECT x, y, tied, cleared FROM gains",
    "a16_review_pull": f"""WITH {JUDGED}, e AS (SELECT count(*) FILTER (bucket = 'needs_review') AS explicit, count(*) FILTER (bucket <> 'needs_review' AND top[2].k = 'needs_review') AS runner_up, count(*) AS n FROM pile)
      SELECT explicit, runner_up, explicit + runner_up AS pull, round((explicit + runner_up) / n * 100, 6) AS pull_share FROM e""",
    "a17_hot_folders": f"WITH {JUDGED} SELECT row_number() OVER (ORDER BY share DESC, pile DESC, first)::INT AS place, dir, notes, pile, round(share, 6) AS share, tokens, round({USD.format('tokens')}, 9) AS usd FROM hot",
    "a18_hot_folder_pairs": f"""WITH {JUDGED}, h AS (SELECT dir, count(*) FILTER (pulled) AS pulled FROM pile WHERE dir IN (SELECT dir FROM hot) GROUP BY dir),
      c AS (SELECT dir, x, y, count(*) AS n, min(place) AS o FROM pile WHERE x IS NOT NULL GROUP BY dir, x, y QUALIFY row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, min(place)) = 1)
      SELECT h.dir, CASE WHEN c.n >= pulled THEN 'tie' WHEN pulled > 0 THEN 'needs_review' END AS competes, CASE WHEN c.n >= pulled THEN x END AS x, CASE WHEN c.n >= pulled THEN y END AS y,
        CASE WHEN c.n >= pulled THEN c.n WHEN pulled > 0 THEN pulled END AS n FROM h LEFT JOIN c ON c.dir = h.dir""",
    "a19_biggest_folder": f"""WITH {JUDGED}, d AS (SELECT dir, count(*) AS notes, count(*) FILTER (in_pile) AS pile, min(plan_ord) AS first FROM judged GROUP BY dir), w AS (SELECT count(*) AS n, count(*) FILTER (in_pile) AS p FROM judged)
      SELECT dir, notes, pile, round(pile / notes, 6) AS share, round((p - pile) / (n - notes), 6) AS rest_share FROM d, w ORDER BY notes DESC, first LIMIT 1""",
    "a20_skew_causes": f"WITH {JUDGED} SELECT cause, notes, pile, round(share, 6) AS share, round(pile_share, 6) AS pile_share, fires FROM skews",
    "a20_doubled_cap": f"""WITH {JUDGED}, c AS (SELECT max(excerpt_chars) AS cap, count(*) AS notes FROM judged WHERE truncated)
      SELECT cap, 2 * cap AS new_cap, notes, round({USD.format(LOW.format('notes * cap'))}, 9) AS usd_low, round({USD.format(HIGH.format('notes * cap'))}, 9) AS usd_high FROM c""",
    "a21_causes": f"WITH {JUDGED} SELECT path, CASE WHEN len(c) = 0 THEN 'unexplained' ELSE array_to_string(c, '|') END AS causes FROM named",
    "a22_question_chars": f"WITH {JUDGED} SELECT sent, known, total, round(total / sent)::BIGINT AS per_call, 'recorded on each row' AS source FROM asked",
    "a23_rerun_costs": f"""WITH {JUDGED}, c AS (SELECT sum(payload_chars) + 2000 * count(*) AS chars, sum(input_tokens) AS tokens, (SELECT sum(input_tokens) FROM judged) AS every FROM pile)
      SELECT round({USD.format(LOW.format('chars'))}, 9) AS pile_low, round({USD.format(HIGH.format('chars'))}, 9) AS pile_high, round({USD.format('tokens')}, 9) AS pile_measured, round({USD.format('every')}, 9) AS "full" FROM c""",
    "a24_bucket_counts": f"""WITH {JUDGED}, b AS (SELECT unnest(['durable_memory', 'project_decision', 'code_note', 'reference', 'log_entry', 'ephemeral', 'junk', 'needs_review']) AS bucket),
      c AS (SELECT bucket, (SELECT count(*) FROM judged j WHERE j.bucket = b.bucket) AS notes, (SELECT count(*) FROM pile j WHERE j.top[2].k = b.bucket) AS second FROM b)
      SELECT bucket, notes, CASE WHEN notes = 0 THEN second END AS as_runner_up FROM c""",
    "a25_dominant_cover": f"WITH {JUDGED} SELECT dir, notes FROM cover",
    "a25_dominant_cost": f"""WITH {JUDGED} SELECT (SELECT bucket FROM top_bucket) AS bucket, count(DISTINCT dir) AS folders, count(*) AS notes, sum(input_tokens)::BIGINT AS tokens, sum(payload_chars)::BIGINT AS chars, round({USD.format('sum(input_tokens)')}, 9) AS usd
      FROM judged WHERE dir IN (SELECT dir FROM cover)""",
    "a26_membrane": f"""WITH {JUDGED}, v AS (SELECT * FROM report WHERE kind = 'vote'), u AS (SELECT 'withheld' AS counter, skipped AS value FROM report WHERE kind = 'skip' UNION ALL SELECT 'hits', unnest(redacted) FROM v UNION ALL SELECT 'own_hits', unnest(redacted_own) FROM v
        UNION ALL SELECT 'triggers', unnest(CASE WHEN len(quarantine_triggers) > 0 THEN quarantine_triggers ELSE ['(unstated)'] END) FROM v WHERE action = 'quarantine'
        UNION ALL SELECT 'local', CASE WHEN reason LIKE 'exact duplicate of %' THEN 'exact duplicate' ELSE string_split(reason, ':')[1] END FROM v WHERE judge = 'local')
      SELECT counter, value, count(*) AS n FROM u GROUP BY ALL""",
    "a27_errors": f"SELECT error, count(*) AS n FROM {REPORT} WHERE kind = 'error' GROUP BY error",
    "a28_cost": f"""WITH {JUDGED}, s AS (SELECT sum(input_tokens)::BIGINT AS tokens, count(*) AS sent, sum(payload_chars)::BIGINT AS payload, (SELECT total FROM asked) AS total FROM sent),
      e AS (SELECT *, {USD.format('tokens')} AS usd, (payload + total) / tokens AS ratio, {USD.format(LOW.format('payload + total'))} AS lo, {USD.format(HIGH.format('payload + total'))} AS hi FROM s)
      SELECT tokens, sent, payload, round(usd, 9) AS usd, round(ratio, 6) AS ratio, CASE WHEN ratio < 2.8 THEN 'below' WHEN ratio > 3.8 THEN 'above' ELSE 'inside' END AS verdict, round(lo, 9) AS estimate_low, round(hi, 9) AS estimate_high,
        (ceil(greatest(hi, usd) / 0.5) * 0.5)::DOUBLE AS ceiling FROM e""",
    "a29_age_and_graph": f"""WITH {JUDGED}, g AS (SELECT count(*) AS n, count(*) FILTER (age_source = 'mtime') AS from_mtime, count(*) FILTER (age_source = 'frontmatter') AS from_frontmatter, count(*) FILTER (age_source = 'stamp') AS from_stamp,
        count(*) FILTER (age_source IS NULL) AS from_unknown, avg((age_days = 0)::INT) FILTER (age_days IS NOT NULL) AS zero, avg((out_links > 0)::INT) FILTER (has_graph) AS links FROM judged)
      SELECT from_mtime, from_frontmatter, from_stamp, from_unknown, round(from_mtime / n, 6) AS mtime_share, round(zero, 6) AS zero_share, round(links, 6) AS linking_share, links < 0.05 AS links_unknown, from_mtime / n >= 0.95 AND zero >= 0.95 AS just_cloned FROM g""",
    "a30_actions": f"""WITH {JUDGED}, best AS (SELECT x, y, cleared FROM gains ORDER BY cleared DESC, tied DESC, first LIMIT 1),
      covers AS (SELECT 'merge' AS action, path FROM merged m WHERE clears AND EXISTS (SELECT 1 FROM best b WHERE b.x = m.x AND b.y = m.y)
        UNION ALL SELECT 'needs_review', path FROM named WHERE pulled UNION ALL SELECT 'hot folders', path FROM named WHERE hot
        UNION ALL SELECT 'truncation', path FROM named WHERE list_contains(c, 'truncated') UNION ALL SELECT 'short', path FROM named WHERE list_contains(c, 'short') UNION ALL SELECT 'unexplained', path FROM named WHERE len(c) = 0),
      n AS (SELECT action, count(*) AS notes FROM covers GROUP BY action),
      listed AS (SELECT action, CASE action WHEN 'merge' THEN 0 WHEN 'needs_review' THEN 1 WHEN 'hot folders' THEN 3 WHEN 'truncation' THEN 4 WHEN 'short' THEN 5 ELSE 9 END AS pos, CASE WHEN action = 'unexplained' THEN 0 ELSE notes END::DOUBLE AS impact FROM n
        UNION ALL SELECT 'dominant', 2, 100 * {USD.format('sum(input_tokens)')} FROM judged WHERE dir IN (SELECT dir FROM cover) HAVING count(*) > 0
        UNION ALL SELECT 'errors', 6, count(*) FROM report WHERE kind = 'error' HAVING count(*) > 0
        UNION ALL SELECT 'links', 7, 0 FROM judged HAVING avg((out_links > 0)::INT) FILTER (has_graph) < 0.05
        UNION ALL SELECT 'dates', 8, 0 FROM judged HAVING count(*) FILTER (age_source = 'mtime') / count(*) > 0.5),
      r AS (SELECT *, row_number() OVER (ORDER BY impact DESC, pos) AS rank FROM listed), f AS (SELECT path, min(rank) AS first FROM covers JOIN r USING (action) GROUP BY path),
      s AS (SELECT r.rank, count(*) AS notes, count(*) FILTER (f.first < r.rank) AS shared FROM covers JOIN r USING (action) JOIN f USING (path) GROUP BY r.rank)
      SELECT r.rank::INT AS rank, action, round(impact, 9) AS impact, coalesce(notes, 0) AS notes, coalesce(shared, 0) AS shared, coalesce(notes > 0 AND shared >= 0.5 * notes, false) AS overlaps FROM r LEFT JOIN s ON s.rank = r.rank""",
    "a34_mtime_finding": f"SELECT count(*) FILTER (age_source = 'mtime') AS from_mtime, count(age_source) AS notes FROM {REPORT} WHERE kind = 'vote'",
    "a6_totals": f"WITH {MAPS} SELECT * EXCLUDE (folder) FROM whole WHERE folder = './'",
    "a7_folder_map": f"WITH {MAPS} SELECT * FROM whole",
    "a7_folder_buckets": f"WITH {MAPPED} SELECT f AS folder, CASE WHEN doc_id % 3 = 0 THEN 'junk' ELSE 'reference' END AS bucket, count(*) AS n FROM f WHERE voted GROUP BY ALL",
    "a7_folder_ages": f"WITH {MAPPED} SELECT f AS folder, (CASE WHEN days IS NULL THEN NULL WHEN days >= 365 THEN 365 WHEN days >= 90 THEN 90 WHEN days >= 30 THEN 30 WHEN days >= 7 THEN 7 WHEN days >= 1 THEN 1 ELSE 0 END)::INT AS age, count(*) AS n FROM f WHERE read GROUP BY ALL",
    "d4_record_policy": f"""WITH a AS (SELECT * FROM {Y.RECORD_VOTES}), l AS (SELECT key, min(id) FILTER (NOT fails) AS lead FROM a WHERE NOT held GROUP BY key),
      r AS (SELECT id, CASE WHEN id > lead AND NOT held THEN lead END AS same_as, held, held OR id < coalesce(lead, 'z') AS own, CASE WHEN NOT held AND (lead IS NULL OR id < lead) THEN NULL ELSE pick END AS pick, sure, secret FROM a LEFT JOIN l USING (key)),
      w AS (SELECT *, CASE WHEN held THEN 'held' WHEN pick IS NULL THEN 'failed' WHEN secret >= 0.7 THEN 'secret' WHEN sure < 0.55 THEN 'unsure' ELSE 'plain' END AS way FROM r)
      SELECT id, CASE WHEN way = 'failed' THEN 'error' ELSE 'vote' END AS kind, CASE WHEN way = 'held' THEN 'local' ELSE 'judged' END AS judge, CASE WHEN way NOT IN ('held', 'failed') THEN pick END AS pick, CASE WHEN way NOT IN ('held', 'failed') THEN sure END::DOUBLE AS confidence,
        CASE way WHEN 'held' THEN 'quarantine' WHEN 'secret' THEN 'quarantine' WHEN 'failed' THEN 'error' ELSE 'label' END AS action,
        CASE way WHEN 'held' THEN 'local redaction hit: KEY' WHEN 'failed' THEN 'no answer' WHEN 'secret' THEN 'contains_secret above threshold' WHEN 'unsure' THEN 'low confidence: routed to a person' ELSE 'normal vote' END AS reason,
        way = 'unsure' AS review, CASE WHEN way = 'unsure' THEN pick END AS suggested, CASE way WHEN 'held' THEN 'local:KEY' WHEN 'secret' THEN 'contains_secret' ELSE '' END AS triggers,
        CASE WHEN way = 'held' OR same_as IS NOT NULL THEN 0 WHEN way = 'failed' THEN NULL ELSE 100 END::BIGINT AS input_tokens, same_as FROM w""",
    "p10_links": f"WITH {GRAPH} SELECT rel, CASE WHEN body IS NOT NULL THEN array_to_string(targets, '|') END AS targets, CASE WHEN body IS NOT NULL THEN embeds END::INT AS embeds FROM t",
    "j1_resolved_links": f"WITH {GRAPH} SELECT rel, target, place::INT AS place, resolved FROM resolved",
    "j2_link_degrees": f"WITH {GRAPH} SELECT rel, CASE WHEN status = 'scan' THEN o END::INT AS out_links, CASE WHEN status = 'scan' THEN i END::INT AS in_links, CASE WHEN status = 'scan' THEN u END::INT AS unresolved_links, is_moc, is_orphan FROM graph",
    "a10_linking_share": f"WITH {GRAPH} SELECT round(avg((o > 0)::INT), 9) AS share FROM graph WHERE status = 'scan'",
    "a8_degree_histogram": f"WITH {GRAPH} SELECT least(i, 20)::INT AS degree, count(*) AS notes FROM graph WHERE status = 'scan' GROUP BY 1",
    "a8_out_degrees": f"WITH {GRAPH} SELECT least(o, 20)::INT AS degree, count(*) AS notes FROM graph WHERE status = 'scan' GROUP BY 1",
    "a8_graph_totals": f"WITH {GRAPH} SELECT count(*) AS nodes, sum(o - u)::BIGINT AS edges, sum(u)::BIGINT AS unresolved, count(*) FILTER (is_orphan) AS orphans, count(*) FILTER (is_moc) AS mocs FROM graph WHERE status = 'scan'",
    "o3_hubs": f"WITH {GRAPH} SELECT rel, i::INT AS in_links FROM graph WHERE status = 'scan' AND i > 0 ORDER BY i DESC, ord LIMIT 2",
    "d1_local_triage": f"""WITH {GRAPH}, d AS (SELECT rel, ord, body, {DIGEST.replace('text', 'body')} AS digest FROM v WHERE status = 'scan'), g AS (SELECT digest, arg_min(rel, ord) AS first FROM d GROUP BY digest),
      r AS (SELECT rel, CASE WHEN regexp_matches(body, 'gh[pousr]_[A-Za-z0-9]{{20,}}') THEN 'secret' WHEN len(list_filter(string_split(body, chr(10)), lambda l: trim(l) <> '' AND NOT starts_with(ltrim(l), '#'))) = 0 THEN 'empty'
        WHEN first <> rel THEN 'duplicate' END AS rule FROM d JOIN g USING (digest))
      SELECT rel, rule, CASE WHEN rule IS NULL THEN 'fresh' ELSE 'local' END AS disposition FROM r UNION ALL SELECT rel, NULL, 'undecodable' FROM v WHERE status = 'bad'""",
    "j4_siblings": f"""WITH {NOTES}, n AS (SELECT rel, folder, replace(rel, '/', chr(1)) AS ord, 'Note ' || doc_id % 11 || ' x' || doc_id % 7 || ' y' || doc_id % 5 AS title, ['note', (doc_id % 11)::VARCHAR, 'x' || doc_id % 7, 'y' || doc_id % 5] AS w FROM planned WHERE status = 'scan'),
      p AS (SELECT a.rel, b.title, row_number() OVER (PARTITION BY a.rel ORDER BY len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) DESC, b.ord) AS rn FROM n a JOIN n b ON a.folder = b.folder AND a.rel <> b.rel)
      SELECT rel, string_agg(title, '|' ORDER BY rn) AS titles FROM p WHERE rn <= 80 GROUP BY rel""",
    "d7_decisions": f"""WITH {DUPLICATES}, b AS (SELECT rel, exact_duplicate_of, {keyword_bucket("lower(body)", "body")} AS bucket FROM dup WHERE status = 'scan')
      SELECT rel AS path, CASE WHEN exact_duplicate_of IS NULL THEN 'judged' ELSE 'local' END AS judge, CASE WHEN exact_duplicate_of IS NULL THEN bucket ELSE 'junk' END AS bucket, CASE WHEN exact_duplicate_of IS NULL THEN {PERSIST} ELSE 0 END::DOUBLE AS persist,
        CASE WHEN exact_duplicate_of IS NULL THEN 0.8 ELSE 1 END::DOUBLE AS confidence, CASE WHEN exact_duplicate_of IS NULL THEN 0.86 ELSE 1 END::DOUBLE AS bucket_margin, CASE WHEN exact_duplicate_of IS NULL THEN {SECRET} ELSE 0 END::DOUBLE AS contains_secret,
        CASE WHEN exact_duplicate_of IS NULL AND {SECRET} >= 0.7 THEN 'quarantine' ELSE 'frontmatter' END AS action, exact_duplicate_of, false AS cached,
        CASE WHEN exact_duplicate_of IS NOT NULL THEN 'exact duplicate of ' || exact_duplicate_of || ': decided locally' WHEN {SECRET} >= 0.7 THEN 'contains_secret above threshold' WHEN bucket = 'needs_review' THEN 'low confidence or explicit needs_review'
          WHEN bucket = 'junk' THEN 'junk, low persist: marked only, never deleted' ELSE 'normal vote' END AS reason FROM b""",
    "d8_cached_rows": f"""WITH {DUPLICATES}, v AS (SELECT exact_duplicate_of IS NOT NULL AS local, {keyword_bucket("lower(body)", "body")} AS b FROM dup WHERE status = 'scan')
      SELECT CASE WHEN local THEN 'local' ELSE 'judged' END AS judge, NOT local AS cached, CASE WHEN local THEN 'junk' ELSE b END AS bucket, 'frontmatter' AS action, count(*) AS notes, count(*) AS paths FROM v GROUP BY ALL""",
    "w5_error_stop": """WITH e AS (SELECT event_id, (event_id > 300 AND event_id % 3 <> 0)::INT AS bad FROM events), r AS (SELECT event_id, count(*) OVER w AS n, sum(bad) OVER w AS e FROM e WINDOW w AS (ORDER BY event_id))
      SELECT min(event_id) AS "at" FROM r WHERE n >= 50 AND e > 0.2 * n""",
    "p13_dates_and_age": f"""SELECT id, made, CASE WHEN made IS NOT NULL THEN 'frontmatter' WHEN stamped IS NOT NULL THEN 'stamp' ELSE 'mtime' END AS source,
        greatest(0, DATE '2026-01-01' - coalesce(made, stamped, modified))::INT AS days FROM {Y.DATES}""",
    "f12_withheld": f"""WITH f AS (SELECT DISTINCT CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '.' END AS folder FROM {PATHS}) SELECT folder, {sensitive("(folder || '/x')")} AS withheld FROM f""",
    "j12_exclusion": f"""WITH f AS (SELECT DISTINCT CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '.' END AS folder FROM {PATHS}), w AS (SELECT folder, {sensitive("(folder || '/x')")} AS held FROM f),
      t AS (SELECT folder, string_split(folder, '/')[-1] AS name FROM f WHERE folder IN ('a b', 'a-b', 'a', 'notes', 'notes/deep notes', 'work/familyroom'))
      SELECT t.folder, t.name, coalesce(string_agg(w.folder, '|' ORDER BY w.folder), '') AS others FROM t LEFT JOIN w ON NOT w.held AND w.folder <> t.folder AND NOT starts_with(w.folder, t.folder || '/')
        AND len(list_filter(string_split(w.folder, '/'), lambda g: contains(' ' || array_to_string(regexp_extract_all(lower(g), '[a-z0-9]+'), ' ') || ' ', ' ' || array_to_string(regexp_extract_all(lower(t.name), '[a-z0-9]+'), ' ') || ' '))) > 0
      GROUP BY t.folder, t.name""",
}
