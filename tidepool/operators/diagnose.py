"""Why notes ended in the review pile, and what the next run should change.

The pile is what was voted on with a confidence below the floor; local decisions are never in it.
Where counts are equal, what comes first in the pile wins: by confidence, then in plan order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions import text as T

# Fixed values.
FLOOR, TOP_TIES, TIE_SHARE, HOT_SHARE, HOT_NOTES, SKEW_SHARE, SKEW_NOTES, SHORT_WORDS = 0.55, 3, 0.5, 1.5, 20, 1.5, 10, 50
DOMINANT, COVER, CLONED, LINKLESS, USD_STEP, OVERLAP, MTIME_SHARE = 0.5, 0.8, 0.95, 0.05, 0.50, 0.5, 0.5
ABSTAIN = "needs_review"


def judged(rows: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Rows of any judge but the local one, with in_pile, the folder, its place in the pile and the top two buckets."""
    top = T.ordered_probabilities("bucket_probabilities")
    confidence = F.coalesce("confidence", F.lit(0.0))
    df = rows.filter("kind = 'vote' AND judge IS DISTINCT FROM 'local'")
    df = df.withColumns({"in_pile": confidence < floor, "dir": T.report_folder("path"), "place": F.struct(confidence.alias("c"), "plan_ord")})
    df = df.select("*", F.explode(F.array(top)).alias("_top"))
    return df.withColumns({"one": F.get("_top", F.lit(0))["key"], "two": F.get("_top", F.lit(1))["key"]}).drop("_top")


def _pulled() -> Column:
    """needs_review on top of the vote or second in it."""
    return (F.col("bucket") == ABSTAIN) | F.coalesce(F.col("two") == ABSTAIN, F.lit(False))


def _pile(rows: DataFrame) -> DataFrame:
    """The pile with x, y: the two buckets that competed, in alphabetical order, null if one is needs_review."""
    pair = F.col("two").isNotNull() & (F.col("one") != ABSTAIN) & (F.col("two") != ABSTAIN)
    return judged(rows).filter("in_pile").withColumns({"x": F.when(pair, F.least("one", "two")), "y": F.when(pair, F.greatest("one", "two"))})


def counts(rows: DataFrame) -> DataFrame:
    vote, local = F.col("kind") == "vote", F.col("judge") == "local"
    of_judge = vote & ~F.coalesce(local, F.lit(False))
    n = {
        "n_votes": vote, "n_judged": of_judge, "n_local": vote & local, "n_withheld": F.col("kind") == "skip",
        "n_errors": (F.col("kind") == "error") | F.coalesce(F.col("action") == "error", F.lit(False)),
        "n_pile": of_judge & (F.coalesce("confidence", F.lit(0.0)) < FLOOR), "n_quarantined": vote & (F.col("action") == "quarantine"),
        "n_redacted": vote & (F.size("redacted") > 0), "n_duplicates": vote & F.col("exact_duplicate_of").isNotNull(),
    }
    out = rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(k) for k, c in n.items()])
    return out.withColumn("pile_share", T.percent("n_pile", "n_judged"))


def medians(rows: DataFrame) -> DataFrame:
    """Exact medians of the margin in the pile and outside it, and of how far confidence is from the top probability."""
    df = judged(rows).withColumn("gap", F.abs(F.col("confidence") - F.array_max(F.map_values("bucket_probabilities"))))
    margin = F.coalesce("bucket_margin", F.lit(0.0))
    return df.agg(
        F.median(F.when(F.col("in_pile"), margin)).alias("pile_margin"), F.median(F.when(~F.col("in_pile"), margin)).alias("rest_margin"), F.median("gap").alias("confidence_gap")
    )


def tie_pairs(rows: DataFrame, n: int = TOP_TIES) -> DataFrame:
    """x, y, n, first: the pairs that competed most in the pile."""
    grouped = _pile(rows).filter("x IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    return grouped.orderBy(F.desc("n"), "first").limit(n)


def tie_summary(rows: DataFrame) -> DataFrame:
    """tied, share of the pile in percent, and whether the buckets overlap."""
    tied = tie_pairs(rows).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tied"))
    whole = _pile(rows).agg(F.count(F.lit(1)).alias("n_pile"))
    out = tied.crossJoin(F.broadcast(whole)).withColumn("share", T.percent("tied", "n_pile"))  # a row each
    return out.select("tied", "share", ((F.col("n_pile") > 0) & (F.col("share") >= 100 * TIE_SHARE)).alias("overlap"))


def _merged(rows: DataFrame, floor: float) -> DataFrame:
    """The pile once for each of the top pairs (at most three), with whether it would clear if the two were one."""
    top = F.broadcast(tie_pairs(rows).select(F.col("x").alias("mx"), F.col("y").alias("my"), F.col("n").alias("tied"), "first"))
    p = F.col("bucket_probabilities")
    share = lambda k: F.coalesce(F.element_at(p, F.col(k)), F.lit(0.0))
    others = F.array_max(F.map_values(F.map_filter(p, lambda k, v: (k != F.col("mx")) & (k != F.col("my")))))
    best = F.greatest(share("mx") + share("my"), F.coalesce(others, F.lit(0.0)))
    return _pile(rows).crossJoin(top).withColumn("clears", best >= floor)


def merge_gain(rows: DataFrame, floor: float = FLOOR) -> DataFrame:
    """x, y, tied, cleared, first: how many notes would leave the pile if two buckets were one, if votes split as they did."""
    out = _merged(rows, floor).groupBy("mx", "my").agg(F.max("tied").alias("tied"), F.count_if("clears").alias("cleared"), F.min("first").alias("first"))
    return out.select(F.col("mx").alias("x"), F.col("my").alias("y"), "tied", "cleared", "first").orderBy(F.desc("cleared"), F.desc("tied"), "first")


def review_pull(rows: DataFrame) -> DataFrame:
    """Pile notes voted needs_review, those where it came second, both, and their share of the pile in percent."""
    explicit = F.col("bucket") == ABSTAIN
    out = _pile(rows).agg(F.count_if(explicit).alias("explicit"), F.count_if(_pulled() & ~explicit).alias("runner_up"), F.count(F.lit(1)).alias("n"))
    pull = F.col("explicit") + F.col("runner_up")
    return out.select("explicit", "runner_up", pull.alias("pull"), T.percent(pull, "n").alias("pull_share"))


def hot_folders(rows: DataFrame) -> DataFrame:
    """dir, notes, pile, share, tokens, usd of folders with twenty notes and half again the whole share of the pile."""
    df = judged(rows)
    whole = df.agg(F.avg(F.col("in_pile").cast("double")).alias("whole"))  # one row
    per = df.groupBy("dir").agg(F.count(F.lit(1)).alias("notes"), F.count_if("in_pile").alias("pile"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens"), F.min("plan_ord").alias("first"))
    per = per.withColumn("share", F.col("pile") / F.col("notes"))
    hot = per.crossJoin(F.broadcast(whole)).filter((F.col("notes") >= HOT_NOTES) & (F.col("whole") > 0) & (F.col("share") >= HOT_SHARE * F.col("whole")))
    return hot.orderBy(F.desc("share"), F.desc("pile"), "first").select("dir", "notes", "pile", "share", "tokens", T.usd_for("tokens").alias("usd"))


def hot_folder_pairs(rows: DataFrame) -> DataFrame:
    """dir, competes, x, y, n: in each hot folder the pair that competes most, or needs_review if it pulls more."""
    here = _pile(rows).join(F.broadcast(hot_folders(rows).select("dir")), "dir", "left_semi")
    pairs = here.groupBy("dir", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.count_if(_pulled()).alias("pulled"))
    # of equal counts the pair that comes first in the pile
    most = pairs.filter("x IS NOT NULL").withColumn("rn", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "first"))).filter("rn = 1")
    pulled = pairs.groupBy("dir").agg(F.sum("pulled").alias("pulled"))
    df = pulled.join(most.select("dir", "x", "y", "n"), "dir", "left")
    tie = F.coalesce(F.col("n") >= F.col("pulled"), F.lit(False))
    competes = F.when(tie, "tie").when(F.col("pulled") > 0, ABSTAIN)
    return df.select("dir", competes.alias("competes"), *[F.when(tie, F.col(c)).alias(c) for c in ("x", "y")], F.when(tie, F.col("n")).when(F.col("pulled") > 0, F.col("pulled")).alias("n"))


def biggest_folder(rows: DataFrame) -> DataFrame:
    """The folder with most judged notes against the rest."""
    per = judged(rows).groupBy("dir").agg(F.count(F.lit(1)).alias("notes"), F.count_if("in_pile").alias("pile"), F.min("plan_ord").alias("first"))
    whole = per.agg(F.sum("notes").alias("all_notes"), F.sum("pile").alias("all_pile"))
    top = per.orderBy(F.desc("notes"), "first").limit(1).crossJoin(F.broadcast(whole))
    rest = F.col("all_notes") - F.col("notes")
    share = F.when(rest > 0, (F.col("all_pile") - F.col("pile")) / rest).otherwise(F.lit(0.0))
    return top.select("dir", "notes", "pile", (F.col("pile") / F.col("notes")).alias("share"), share.alias("rest_share"))


def _traits() -> dict[str, Column]:
    return {"truncated": F.coalesce("truncated", F.lit(False)), "short": F.coalesce(F.col("graph.words") < SHORT_WORDS, F.lit(False))}


def skew_causes(rows: DataFrame) -> DataFrame:
    """cause, notes, pile, share, pile_share, fires: whether cut or short notes fill the pile beyond their share.

    A cause needs ten notes in the pile. Shares are in percent, of all judged notes and of the pile.
    """
    n, in_pile = F.count(F.lit(1)), F.count_if("in_pile")
    parts = []
    for name, trait in _traits().items():
        every, pile = F.count_if(trait), F.count_if(trait & F.col("in_pile"))
        parts.append(F.struct(F.lit(name).alias("cause"), every.alias("notes"), pile.alias("pile"), T.percent(every, n).alias("share"), T.percent(pile, in_pile).alias("pile_share")))
    out = judged(rows).agg(F.array(*parts).alias("c")).select(F.inline("c"))
    return out.withColumn("fires", (F.col("pile") >= SKEW_NOTES) & (F.col("share") > 0) & (F.col("pile_share") >= SKEW_SHARE * F.col("share")))


def doubled_cap(rows: DataFrame) -> DataFrame:
    """cap, new_cap, notes, usd_low, usd_high: what it may cost to send twice as much of every truncated note."""
    cut = judged(rows).filter("truncated").agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.max("excerpt_chars"), F.lit(0)).alias("cap"))
    low, high = (T.usd_for(T.tokens_for(F.col("notes") * F.col("cap"), T.CHARS_PER_TOKEN[i])) for i in (1, 0))
    return cut.select("cap", (2 * F.col("cap")).alias("new_cap"), "notes", low.alias("usd_low"), high.alias("usd_high"))


def _labelled(rows: DataFrame) -> DataFrame:
    """The pile with causes: why each note is there, or `unexplained`."""
    hot = F.broadcast(hot_folders(rows).select("dir", F.lit(True).alias("hot")))
    fires = skew_causes(rows).filter("fires").agg(F.collect_set("cause").alias("fire"))
    ties = F.broadcast(tie_pairs(rows).select("x", "y", F.lit(True).alias("tied")))
    df = _pile(rows).join(hot, "dir", "left").join(ties, ["x", "y"], "left").crossJoin(F.broadcast(fires))
    skewed = [F.when(trait & F.array_contains("fire", name), name) for name, trait in _traits().items()]
    labels = F.array(
        F.when(F.col("tied"), F.concat(F.lit("tie "), F.col("x"), F.lit("–"), F.col("y"))), F.when(_pulled(), f"{ABSTAIN} pull"), F.when(F.col("hot"), "hot folder"), *skewed
    )
    found = F.filter(labels, lambda x: x.isNotNull())
    return df.withColumn("causes", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unexplained"))))


def causes(rows: DataFrame) -> DataFrame:
    """path, plan_ord, causes of every note of the pile."""
    return _labelled(rows).select("path", "plan_ord", "causes")


def question_chars(rows: DataFrame, default_taxonomy: str = "", default_chars: int = 0) -> DataFrame:
    """sent, known, total, per_call, source: characters that the questions added to the calls of a run.

    They are recorded on each row; a row without them counts as the default question set's if it was
    asked that set, and else nothing is known.
    """
    own = F.when(F.col("question_chars") > 0, F.col("question_chars"))
    size = F.coalesce(own, F.when(F.col("taxonomy") == default_taxonomy, F.lit(default_chars)))
    sent = judged(rows).filter(~F.coalesce("cached", F.lit(False)))
    out = sent.agg(F.count(F.lit(1)).alias("sent"), F.count(size).alias("sized"), F.count(own).alias("own"), F.sum(size).alias("total"))
    known = (F.col("sent") > 0) & (F.col("sized") == F.col("sent"))
    source = F.when((F.col("sent") > 0) & (F.col("own") == F.col("sent")), "recorded on each row").when(known, "the default question set")
    return out.select("sent", known.alias("known"), F.when(known, F.col("total")).alias("total"), F.when(known, F.bround(F.col("total") / F.col("sent")).cast("long")).alias("per_call"), source.alias("source"))


def rerun_costs(rows: DataFrame, default_taxonomy: str = "", default_chars: int = 0) -> DataFrame:
    """Dollars for a rerun of the pile, as a range and as measured, and of everything."""
    asked = F.broadcast(question_chars(rows, default_taxonomy, default_chars).select(F.coalesce("per_call", F.lit(0)).alias("q")))  # one row
    in_pile = lambda c: F.coalesce(F.sum(F.when(F.col("in_pile"), F.col(c))), F.lit(0))
    sums = judged(rows).agg(F.count_if("in_pile").alias("n"), in_pile("payload_chars").alias("chars"), in_pile("input_tokens").alias("tokens"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("every"))
    chars = F.col("chars") + F.col("q") * F.col("n")
    low, high = (T.usd_for(T.tokens_for(chars, T.CHARS_PER_TOKEN[i])) for i in (1, 0))
    return sums.crossJoin(asked).select(low.alias("pile_low"), high.alias("pile_high"), F.when(F.col("tokens") > 0, T.usd_for("tokens")).alias("pile_measured"), T.usd_for("every").alias("full"))


def bucket_counts(rows: DataFrame, buckets: tuple[str, ...]) -> DataFrame:
    """bucket, notes, as_runner_up for every bucket there is; the last for unused ones: how often it came second in the pile."""
    df = judged(rows)
    names = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    used = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("notes"))
    second = df.filter("in_pile").groupBy(F.col("two").alias("bucket")).agg(F.count(F.lit(1)).alias("second"))
    out = names.join(used, "bucket", "left").join(second, "bucket", "left").fillna(0, ["notes", "second"])
    return out.select("bucket", "notes", F.when(F.col("notes") == 0, F.col("second")).alias("as_runner_up"))


def dominant(rows: DataFrame) -> DataFrame:
    """bucket, notes, share of a bucket with more than half of the judged notes; none if there is no such."""
    per = judged(rows).groupBy("bucket").agg(F.count(F.lit(1)).alias("notes"))
    whole = per.agg(F.sum("notes").alias("n"))
    share = F.col("notes") / F.col("n")
    return per.crossJoin(F.broadcast(whole)).withColumn("share", share).filter(F.col("share") > DOMINANT).select("bucket", "notes", "share")


def dominant_cover(rows: DataFrame) -> DataFrame:
    """dir, notes: the fewest folders, greatest first, that hold four fifths of the dominant bucket.

    Folders of equal size are a level; how many of each level are needed follows from the levels' sums,
    which are few, and only the last level's folders have to be put in order.
    """
    top = F.broadcast(dominant(rows).select("bucket"))
    per = judged(rows).join(top, "bucket").groupBy("dir").agg(F.count(F.lit(1)).alias("notes"), F.min("plan_ord").alias("first"))
    levels = per.groupBy("notes").agg(F.count(F.lit(1)).alias("folders"))
    falling, every = Window.orderBy(F.desc("notes")), Window.partitionBy()
    held = F.col("notes") * F.col("folders")
    levels = levels.withColumns({"before": F.sum(held).over(falling) - held, "n": F.sum(held).over(every)})
    need = F.ceil((F.lit(COVER) * F.col("n") - F.col("before")) / F.col("notes"))
    levels = F.broadcast(levels.withColumn("take", F.least(need, F.col("folders"))).filter("take > 0"))
    df = per.join(levels.select("notes", "take", (F.col("take") == F.col("folders")).alias("whole")), "notes")
    last = df.filter("NOT whole").withColumn("rn", F.row_number().over(Window.partitionBy("notes").orderBy("first"))).filter("rn <= take")
    return df.filter("whole").select("dir", "notes").unionByName(last.select("dir", "notes"))


def dominant_cost(rows: DataFrame) -> DataFrame:
    """bucket, folders, notes, tokens, usd, chars: what the folders of the dominant bucket took, whatever its notes' bucket."""
    cover = dominant_cover(rows).select("dir")
    held = judged(rows).join(F.broadcast(dominant(rows).select(F.col("bucket").alias("top"))))
    held = held.join(cover, "dir", "left_semi")
    out = held.groupBy(F.col("top").alias("bucket")).agg(
        F.count_distinct("dir").alias("folders"), F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("payload_chars"), F.lit(0)).alias("chars")
    )
    return out.withColumn("usd", T.usd_for("tokens"))


def membrane(rows: DataFrame) -> DataFrame:
    """counter, value, n: what was withheld, hit, quarantined and decided locally, and why."""
    part = lambda df, name, value: df.select(F.lit(name).alias("counter"), value.alias("value"))
    votes = rows.filter("kind = 'vote'")
    reason = F.regexp_replace(F.split_part(F.coalesce("reason", F.lit("")), F.lit(":"), F.lit(1)), "^(exact duplicate) of .*$", "$1")
    out = part(rows.filter("kind = 'skip'"), "withheld", F.coalesce("skipped", "reason", "action"))
    for name, column in (("hits", "redacted"), ("own_hits", "redacted_own")):
        out = out.unionByName(part(votes.withColumn("_x", F.explode(column)), name, F.col("_x")))
    stated = F.when(F.size("quarantine_triggers") > 0, F.col("quarantine_triggers")).otherwise(F.array(F.lit("(unstated)")))
    out = out.unionByName(part(votes.filter("action = 'quarantine'").withColumn("_x", F.explode(stated)), "triggers", F.col("_x")))
    out = out.unionByName(part(votes.filter("judge = 'local'"), "local", reason))
    return out.groupBy("counter", "value").agg(F.count(F.lit(1)).alias("n"))


def errors(rows: DataFrame) -> DataFrame:
    """error, n: failed rows by class."""
    failed = rows.filter("kind = 'error' OR coalesce(action = 'error', false)")
    return failed.groupBy(F.coalesce(F.nullif("error", F.lit("")), F.lit("unknown")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def cost(rows: DataFrame, default_taxonomy: str = "", default_chars: int = 0) -> DataFrame:
    """tokens, sent, payload, usd, ratio, verdict, estimate and the ceiling to suggest, in half dollars.

    Cached rows cost nothing. The ratio of characters to tokens and the estimate need to know how long
    the questions were; the ceiling follows the greater of estimate and cost.
    """
    asked = F.broadcast(question_chars(rows, default_taxonomy, default_chars).select("known", "total"))  # one row
    sent = judged(rows).filter(~F.coalesce("cached", F.lit(False)))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("input_tokens", "tokens"), ("payload_chars", "payload"))]
    df = sent.agg(F.count(F.lit(1)).alias("sent"), *sums).crossJoin(asked).withColumn("usd", T.usd_for("tokens"))
    chars = F.col("payload") + F.col("total")
    ratio = F.when(F.col("known") & (F.col("tokens") > 0), chars / F.col("tokens"))
    few, many = T.CHARS_PER_TOKEN
    verdict = F.when(F.col("ratio") < few, "below").when(F.col("ratio") > many, "above").when(F.col("ratio").isNotNull(), "inside")
    estimate = [F.when(F.col("known"), T.usd_for(T.tokens_for(chars, c))).otherwise(F.lit(0.0)) for c in (many, few)]
    df = df.withColumns({"ratio": ratio, "estimate_low": estimate[0], "estimate_high": estimate[1]}).withColumn("verdict", verdict)
    ceiling = F.ceil(F.greatest("estimate_high", "usd") / USD_STEP) * USD_STEP
    return df.select("tokens", "sent", "payload", "usd", "ratio", "verdict", "estimate_low", "estimate_high", ceiling.cast("double").alias("ceiling"))


def age_and_graph(rows: DataFrame) -> DataFrame:
    """Where ages come from, whether the vault looks just cloned, and how many notes link."""
    source, age = F.coalesce("age_source", F.lit("unknown")), F.col("graph.age_days")
    known = F.col("graph").isNotNull()
    out = judged(rows).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(source == s).alias(f"from_{s}") for s in ("mtime", "frontmatter", "stamp", "unknown")],
        F.avg(F.when(age.isNotNull(), (age == 0).cast("double"))).alias("zero"), F.avg(F.when(known, F.coalesce(F.col("graph.out_links") > 0, F.lit(False)).cast("double"))).alias("linking_share"),
    )
    mtime = F.when(F.col("n") > 0, F.col("from_mtime") / F.col("n")).otherwise(F.lit(0.0))
    out = out.withColumns({"mtime_share": mtime, "zero_share": F.coalesce("zero", F.lit(0.0)), "links_unknown": F.coalesce(F.col("linking_share") < LINKLESS, F.lit(False))})
    cloned = F.col("zero").isNotNull() & (F.col("mtime_share") >= CLONED) & (F.col("zero_share") >= CLONED)
    return out.withColumn("just_cloned", cloned).drop("n", "zero")


def mtime_finding(rows: DataFrame) -> DataFrame:
    """from_mtime, notes: voted notes whose age would reset on a clone, of those with a known source."""
    return rows.filter("kind = 'vote'").agg(F.count_if(F.col("age_source") == "mtime").alias("from_mtime"), F.count("age_source").alias("notes"))


def actions(rows: DataFrame) -> DataFrame:
    """action, impact, notes, shared, overlaps: what to do before the next run, by falling impact.

    notes are those of the pile that an action covers, shared those that an action of more impact
    covers too; an action overlaps if that is half of them. A note counts for the first of its actions,
    a minimum per note, so no running set is needed. Dollars weigh a hundred times.
    """
    one = lambda name, at, impact, keep: F.struct(F.lit(name).alias("action"), F.lit(at).alias("at"), impact.cast("double").alias("impact"), keep.alias("keep"))
    best = F.broadcast(merge_gain(rows).orderBy(F.desc("cleared"), F.desc("tied"), "first").limit(1).select("x", "y", "cleared"))
    pile = _labelled(rows).drop("x", "y")
    clearing = _merged(rows, FLOOR).filter("clears").join(best, (F.col("mx") == best["x"]) & (F.col("my") == best["y"]), "left_semi")
    named = lambda label: F.array_contains("causes", label)
    covers = clearing.select(F.lit("merge").alias("action"), "path")
    for name, cond in ((ABSTAIN, _pulled()), ("hot folders", F.coalesce("hot", F.lit(False))), ("truncation", named("truncated")), ("short", named("short")), ("unexplained", named("unexplained"))):
        covers = covers.unionByName(pile.filter(cond).select(F.lit(name).alias("action"), "path"))
    sizes = covers.groupBy("action").agg(F.count(F.lit(1)).alias("notes"))
    # every action there may be, with its impact, from a few rows of one column each
    facts = errors(rows).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_errors"))
    facts = facts.crossJoin(age_and_graph(rows).select("links_unknown", (F.col("mtime_share") > MTIME_SHARE).alias("mtime")))
    facts = facts.crossJoin(dominant_cost(rows).agg(F.sum("usd").alias("cover_usd"))).crossJoin(hot_folders(rows).agg(F.count(F.lit(1)).alias("n_hot")))
    facts = facts.crossJoin(sizes.groupBy().pivot("action", ["merge", ABSTAIN, "hot folders", "truncation", "short", "unexplained"]).agg(F.sum("notes")))
    n = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(0))
    zero = F.lit(0.0)
    possible = [
        one("merge", 0, n("merge"), n("merge") > 0), one(ABSTAIN, 1, n(ABSTAIN), n(ABSTAIN) > 0), one("dominant", 2, 100 * F.col("cover_usd"), F.col("cover_usd").isNotNull()),
        one("hot folders", 3, n("hot folders"), F.col("n_hot") > 0), one("truncation", 4, n("truncation"), n("truncation") > 0), one("short", 5, n("short"), n("short") > 0),
        one("errors", 6, F.col("n_errors"), F.col("n_errors") > 0), one("links", 7, zero, F.col("links_unknown")), one("dates", 8, zero, F.col("mtime")), one("unexplained", 9, zero, n("unexplained") > 0),
    ]
    listed = facts.select(F.inline(F.array(*possible))).filter("keep")
    listed = listed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("impact"), "at")))  # ten rows at most
    each = covers.join(F.broadcast(listed.select("action", "rank")), "action")
    first = each.groupBy("path").agg(F.collect_set("rank").alias("ranks"), F.min("rank").alias("first"))
    shared = first.select(F.explode("ranks").alias("rank"), "first").groupBy("rank").agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("first") < F.col("rank")).alias("shared"))
    out = listed.join(shared, "rank", "left").fillna(0, ["notes", "shared"])
    overlaps = (F.col("notes") > 0) & (F.col("shared") >= OVERLAP * F.col("notes"))
    return out.orderBy("rank").select("action", "impact", "notes", "shared", overlaps.alias("overlaps"))
