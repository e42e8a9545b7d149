"""Personal data, and terms that reveal it, in column expressions alone.

Patterns find the protected entities. For the rest of a text, corpus co-occurrence tells how strongly
a term reveals an entity: with n documents, n_t that hold the term, n_e that hold the entity and n_te
that hold both, the pointwise mutual information log(n * n_te / (n_t * n_e)) is at most the entity's
information content log(n / n_e), which it reaches if the term always comes with the entity. A term
whose share of that exceeds a threshold discloses the entity, unless chance explains it: a word of one
text lies beside whatever that text holds, and most texts have words of their own. So the share counts
only if fewer than CHANCE terms of as many texts would meet the entity as often, were the terms dealt
to texts at random: alike * exp(-n_t * KL(n_te / n_t, n_e / n)) bounds their number (Chernoff), with
`alike` the terms of the corpus that lie in exactly n_t texts. Rarity alone discloses nothing where
rare words abound, at any size of the corpus. A disclosing term is removed if it always comes with its
entity, and else replaced by a general one.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, let, materialise, once, running_sums, whole_text

KINDS = ("email", "ip", "card", "phone")
#: The given patterns, written so that no start is tried twice within a run and nothing is retried.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}+"
#: Share of the entity's information that a term may give away.
DISCLOSURE = 0.9
#: Terms that may do as well by chance, for one entity.
CHANCE = 0.05
#: Tables up to so many rows go to every executor; larger ones are shuffled.
BROADCAST_ROWS = 200_000
#: Keys of more rows than this are joined by broadcast even then.
HEAVY = 10_000


#: What a text must contain for a kind to be looked for.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = lambda x: (F.length(x) <= 3) & (F.concat(F.lit("0"), F.substring(x, 1, 3)).cast("int") <= 255)
        return F.forall(F.split(match, r"\."), lambda part: small(F.ltrim(part, F.lit("0"))))
    if kind == "card":
        return let(F.translate(match, " -", ""), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(F.translate(match, "+ ().-", "")).between(8, 15)
    return F.lit(True)


def _span(kind: str, start: Column, end: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), value.alias("value"))


def _no_spans() -> Column:
    return F.filter(F.array(_span("", F.lit(0), F.lit(0), F.lit(""))), lambda x: x["end"] > 0)


def located(text: Column, pattern: str, kind: str) -> Column:
    """All matches as array<struct<kind, start, end, value>>, in code points, end exclusive.

    The places follow from the lengths of the matches and of the text between them.
    """

    def placed(found: Column) -> Column:
        lengths = F.transform(found, lambda v: F.char_length(v))
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda g: F.char_length(g))
        both = F.zip_with(gaps, lengths, lambda g, n: F.struct(g.alias("g"), n.alias("n")))
        steps = let(both, lambda b: F.transform(b, lambda x, i: (x["g"] + F.when(i > 0, F.get(b, i - 1)["n"]).otherwise(0)).cast("long")))
        spans = F.zip_with(running_sums(steps), found, lambda s, v: _span(kind, s, s + F.char_length(v), v))
        return F.when(F.size(found) > 0, spans).otherwise(_no_spans())

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """The valid matches of all kinds, by kind as listed and then by start."""

    def of(kind: str) -> Column:
        valid = F.filter(located(text, PATTERNS[kind], kind), lambda x: _valid(kind, x["value"]))
        return F.when(F.contains(text, F.lit(NEEDED[kind])), valid).otherwise(_no_spans()) if NEEDED[kind] else valid

    return F.concat(*map(of, KINDS))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _masked(text: Column, spans: Column) -> Column:
    """The text without the matches of all patterns, if it has a span at all."""
    out = text
    for kind in KINDS:
        out = F.regexp_replace(out, F.lit(PATTERNS[kind]), F.lit(" 0 "))
    return F.when(F.size(spans) > 0, out).otherwise(text)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _with(df: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """df joined with a materialised table of one row a key; keys of great weight are not shuffled."""
    if table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), key)
    heavy = F.broadcast(table.filter(F.col(weight) > HEAVY))
    return df.join(heavy, key).unionByName(df.join(heavy.select(key), key, "left_anti").join(table, key))


def _pages(key: Column, rows: Column) -> Column:
    """Different texts among rows counted by key, which is null for texts that come once."""
    return F.sum(F.when(key.isNull(), rows).otherwise(1))


def _by_chance(n_te: Column, n_t: Column, n_e: Column, alike: Column, n: int) -> Column:
    """Logarithm of a bound on how many terms of n_t texts meet an entity of n_e texts n_te times, if dealt at random."""
    with_it = n_te * F.log(n_te * float(n) / (n_t * n_e))
    without = F.when(n_te < n_t, (n_t - n_te) * F.log((n_t - n_te) * float(n) / (n_t * (F.lit(n) - n_e)))).otherwise(0.0)
    return F.log(alike) - with_it - without


def disclosing_terms(df: DataFrame, disclosure: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """term, removed: the terms that disclose an entity, from rows of (page, text, base).

    page identifies a text, so that copies of one text count once; base holds its spans. removed is
    true if the term always comes with one of its entities. Every entity is scored, however rare or
    frequent; one of all texts has no information to give away. Entities of the same texts have the
    same terms and are scored as one.
    """
    pages = df.groupBy("page").agg(F.count(F.lit(1)).alias("rows"))
    n = pages.count()
    copied = materialise(pages.filter("rows > 1").select("page", F.lit(True).alias("copied")), "pii-copied")
    # a text that comes once is counted where it lies; only copies carry their text's digest along
    df = df.join(F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied, "page", "left").withColumn("key", F.when(F.col("copied"), F.col("page")))
    holds = F.transform("base", lambda x: F.xxhash64(F.concat_ws(":", x["kind"], F.lower(x["value"]))))
    private = df.filter(F.size("base") > 0).select("page", "key", F.array_distinct(holds).alias("entities"), "text", "base")
    private = once(private, "terms", _terms(_masked(F.col("text"), F.col("base")))).drop("text", "base")
    alone = private.filter(F.col("key").isNull()).drop("key")
    folded = private.filter(F.col("key").isNotNull()).groupBy("page").agg(*(F.first(c).alias(c) for c in ("entities", "terms")))
    private = materialise(alone.unionByName(folded), "pii-private")
    held = private.select("page", F.explode("entities").alias("entity"))
    same = [F.bit_xor(F.xxhash64("page", F.lit(seed))).alias(f"same_{seed}") for seed in (1, 2)]
    held = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), *same).filter(F.col("n_e") < n)
    held = held.groupBy("n_e", "same_1", "same_2").agg(F.min("entity").alias("entity"))
    held = materialise(held.select("entity", "n_e"), "pii-entities")
    most_held = held.agg(F.max("n_e")).first()[0]
    if most_held is None:
        return df.select(F.lit("").alias("term"), F.lit(False).alias("removed")).limit(0)

    # n_te is at most n_e, so that a term of more texts than this gives too little away
    most = lambda n_e: F.pow(n_e.cast("double"), F.lit(disclosure)) * float(n) ** (1 - disclosure) * (1 + 1e-9)
    words = df.select("key", F.explode(_terms(_masked(F.col("text"), F.col("base")))).alias("term"))
    once_each = words.groupBy("term", "key").agg(F.count(F.lit(1)).alias("c"))
    totals = once_each.groupBy("term").agg(_pages(F.col("key"), F.col("c")).alias("n_t"))
    totals = materialise(totals.filter(F.col("n_t") <= most(F.lit(most_held))), "pii-totals")
    # so many different n_t need at least half their square of (term, text) pairs: the counts stay small
    alike = F.broadcast(totals.groupBy("n_t").agg(F.count(F.lit(1)).alias("alike")))
    # a term of one text meets an entity of n_e texts by chance with probability n_e / n, 1 / n at least
    told = materialise(totals.join(alike, "n_t").filter((F.col("n_t") > 1) | (F.col("alike") <= chance * n)), "pii-told")
    terms = _with(private.select("page", F.explode("terms").alias("term")), told, "term", "n_t")
    entities = _with(private.select("page", F.explode("entities").alias("entity")), held, "entity", "n_e")
    n_te, n_t, n_e = F.col("n_te"), F.col("n_t"), F.col("n_e")
    may = (n_t <= most(n_e)) & (_by_chance(F.least(n_t, n_e), n_t, n_e, F.col("alike"), n) <= log(chance) + 1e-9)
    pairs = terms.join(entities, "page").filter(may)
    met = pairs.groupBy("term", "n_t", "alike", "entity", "n_e").agg(F.count(F.lit(1)).alias("n_te"))
    shared = F.log(F.lit(float(n)) * n_te / (n_t * n_e))
    content = F.log(F.lit(float(n)) / n_e)
    strong = met.filter((shared >= F.lit(disclosure) * content) & (_by_chance(n_te, n_t, n_e, F.col("alike"), n) <= log(chance)))
    found = materialise(strong.groupBy("term").agg(F.max(n_te == n_t).alias("removed")), "pii-disclosing")
    for table in (copied, private, held, totals, told):
        drop_table(table)
    return found


def find(df: DataFrame, disclosure: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """doc_id, text, base, terms, gone for every row of df: spans of entities, spans of disclosing terms, and those of its terms that are to be removed.

    Null and empty texts have no spans. A term's span has kind `term` and is left out where it
    overlaps a span of an entity; every occurrence of a disclosing term is marked, in any case. Only
    doc_id and text are read; repeated rows are treated alike; a table of no rows gives no rows.
    """
    rows = df.select("doc_id", whole_text().alias("text")).withColumn("page", F.xxhash64("text"))
    rows = once(rows, "base", base_spans(F.col("text")))
    terms = disclosing_terms(rows, disclosure, chance)
    count = terms.count()
    none = F.array().cast("array<string>")
    if not count:
        return rows.select("doc_id", "text", "base", _no_spans().alias("terms"), none.alias("gone"))
    words = rows.select("page", F.explode(_terms(F.col("text"))).alias("term"))
    found = words.join(F.broadcast(terms) if count <= BROADCAST_ROWS else terms, "term")
    hits = materialise(found.groupBy("page").agg(F.collect_set("term").alias("found"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone")), "pii-hits")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS // 10 else hits
    marked = rows.join(hits, "page", "left")
    spans = F.filter(
        located(F.col("text"), r"(?i)" + TERM, "term"),
        lambda x: F.array_contains(F.col("found"), F.lower(x["value"]))
        & ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    return once(marked, "terms", F.when(F.col("found").isNotNull(), spans).otherwise(_no_spans())).select("doc_id", "text", "base", "terms", F.coalesce("gone", none).alias("gone"))


def personal_data(df: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of df."""
    found = find(df, **options)
    counts = [F.size(F.filter("base", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "terms")).alias("spans"))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def sanitised(df: DataFrame, **options) -> DataFrame:
    """doc_id, text with entities as [KIND]; of disclosing terms those that always come with their entity are removed, the others stand as [TERM].

    Of overlapping spans the one that starts first stands, the longer of two with one start.
    """
    found = find(df, **options)
    order = F.array_sort(
        F.concat("base", "terms"),
        lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["end"] - a["end"]).cast("int")),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def shown(x: Column) -> Column:
        gone = (x["kind"] == "term") & F.array_contains(F.col("gone"), F.lower(x["value"]))
        return F.when(gone, "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))

    def step(state: Column, x: Column) -> Column:
        before = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        moved = F.struct(x["end"].alias("at"), F.concat(state["out"], before, shown(x)).alias("out"))
        return F.when(x["start"] >= state["at"], moved).otherwise(state)

    rest = lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.char_length("text")))
    return found.select("doc_id", F.aggregate(order, start, step, rest).alias("text"))
