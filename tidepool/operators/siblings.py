"""The most alike titles of each note's folder, without pairs of all notes that share a word.

Notes of one folder with the same title words are one set. Two sets are alike by the share of their
words in common, so for a given number of common words the smaller set is nearer. A word that few sets
of a folder have is rare. What shares a rare word with a set meets it through that word. What shares only
frequent words is found by classes, sets with the same frequent words: a class is as near as its
smallest set, and of all classes that hold the same frequent words only the first few can matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions import text as T
from tidepool.plans.shared import materialised

SIBLINGS = 80
#: A word is rare if no more sets of a folder have it; pairs through rare words are at most this many a word and set.
RARE = 4 * SIBLINGS
#: Classes of more frequent words meet all classes they share one with; the others meet by subsets of their words.
MOST_FREQUENT = 8


def _first(df: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group; every task keeps n a group before rows are shuffled."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def _subsets(words: Column) -> Column:
    """All subsets of an array but the empty one, as texts; an array in order gives subsets in order."""
    none = F.array(F.array().cast("array<string>"))
    every = F.aggregate(words, none, lambda acc, w: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, w))))
    return F.transform(F.filter(every, lambda s: F.size(s) > 0), lambda s: F.array_join(s, " "))


def _alike(common: Column, one: str, other: str) -> Column:
    return common / (F.col(one) + F.col(other) - common)


def _sets(notes: DataFrame) -> DataFrame:
    """folder, tokens, m (how many words) of every set that has any."""
    return notes.filter(F.size("tokens") > 0).select("folder", "tokens").distinct().withColumn("m", F.size("tokens"))


def _split(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """sets with their rare and frequent words, each in order."""
    words = sets.withColumn("token", F.explode("tokens")).join(frequent, ["folder", "token"], "left")
    often = F.col("often").isNotNull()
    parts = words.groupBy("folder", "tokens", "m").agg(F.array_sort(F.collect_list(F.when(~often, F.col("token")))).alias("rare"), F.array_sort(F.collect_list(F.when(often, F.col("token")))).alias("freq"))
    return parts


def nearest_sets(mine: DataFrame, pool: DataFrame, keep: int, rare: int = RARE, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """folder, tokens, other (tokens), alike: for every set of words in mine the `keep` nearest of pool, by plan order where equal.

    mine: folder, tokens (sorted). pool: folder, tokens, first_ord (plan order of its first note). Only
    sets with a word in common are listed.
    """
    asked, held = _sets(mine), pool.filter(F.size("tokens") > 0)
    counts = held.select("folder", F.explode("tokens").alias("token")).groupBy("folder", "token").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.filter(F.col("n") > rare).select("folder", "token", F.lit(True).alias("often"))
    # read by several of the joins below, so they are written once: a row a set
    asked = materialised(_split(asked, frequent), "sets")
    held = materialised(_split(_sets(pool), frequent).join(held.select("folder", "tokens", "first_ord"), ["folder", "tokens"]), "sets")
    # a rare word in common: a pair meets at the first of them
    left = asked.filter(F.size("rare") > 0).select("folder", "tokens", "m", "rare", F.explode("rare").alias("token"))
    right = held.filter(F.size("rare") > 0).select("folder", F.col("tokens").alias("other"), F.col("m").alias("l"), F.col("rare").alias("their"), "first_ord", F.explode("rare").alias("token"))
    met = left.join(right, ["folder", "token"]).filter(F.col("token") == F.array_min(F.array_intersect("rare", "their")))
    by_rare = met.select("folder", "tokens", "other", "first_ord", _alike(F.size(F.array_intersect("tokens", "other")), "m", "l").alias("alike"))
    by_rare = _first(by_rare, ["folder", "tokens"], [F.desc("alike"), "first_ord"], keep)
    if held.filter(F.size("freq") > 0).isEmpty():
        return by_rare.select("folder", "tokens", "other", "alike")
    # only frequent words in common: classes, each as near as its smallest set, of equals the first in plan order
    sets = held.filter(F.size("freq") > 0).select("folder", F.col("freq").alias("theirs"), F.col("tokens").alias("other"), F.col("m").alias("l"), "first_ord")
    classes = sets.groupBy("folder", "theirs").agg(F.min(F.struct("l", "first_ord")).alias("best"))
    wanted = asked.filter(F.size("freq") > 0).select("folder", "freq", "m").distinct()
    few = lambda c: F.size(c) <= most_frequent
    listed = _first(classes.filter(few("theirs")).withColumn("part", F.explode(_subsets(F.col("theirs")))), ["folder", "part"], ["best"], keep)
    groups = wanted.select("folder", "freq").distinct()
    found = groups.filter(few("freq")).withColumn("part", F.explode(_subsets(F.col("freq")))).join(listed, ["folder", "part"]).select("folder", "freq", "theirs", "best")
    # classes of many frequent words: all that share one, met at the first in common
    one, two = groups.withColumn("token", F.explode("freq")), classes.withColumn("token", F.explode("theirs"))
    many = one.join(two, ["folder", "token"]).filter((~few("freq") | ~few("theirs")) & (F.col("token") == F.array_min(F.array_intersect("freq", "theirs"))))
    found = found.distinct().unionByName(many.select("folder", "freq", "theirs", "best"))
    found = wanted.join(found, ["folder", "freq"]).withColumns({"common": F.size(F.array_intersect("freq", "theirs")), "l": F.col("best.l")})
    found = _first(found.withColumn("alike", _alike(F.col("common"), "m", "l")), ["folder", "freq", "m"], [F.desc("alike"), F.col("best.first_ord")], keep)
    members = _first(sets, ["folder", "theirs"], ["l", "first_ord"], keep)
    found = found.select("folder", "freq", "m", "theirs", "common").join(members, ["folder", "theirs"]).withColumn("alike", _alike(F.col("common"), "m", "l"))
    found = _first(found, ["folder", "freq", "m"], [F.desc("alike"), "first_ord"], keep)
    of_class = found.groupBy("folder", "freq", "m").agg(F.collect_list(F.struct("other", "first_ord", "alike")).alias("near"))  # a bounded list a class
    by_class = asked.select("folder", "tokens", "freq", "m").join(of_class, ["folder", "freq", "m"]).select("folder", "tokens", F.inline("near"))
    every = by_rare.unionByName(by_class.select(by_rare.columns)).groupBy("folder", "tokens", "other").agg(F.max("alike").alias("alike"), F.first("first_ord").alias("first_ord"))
    return _first(every, ["folder", "tokens"], [F.desc("alike"), "first_ord"], keep).select("folder", "tokens", "other", "alike")


def siblings(indexed: DataFrame, keep: int = SIBLINGS, rare: int = RARE, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """rel, other_note_titles: titles of the most alike notes in a note's folder, at most `keep`.

    Alike is the share of title words in common; equal ones go by plan order. Sensitive notes, those that
    could not be read and titles with credentials are never listed. Where fewer than `keep` share a word,
    the folder's first notes in plan order fill up, from one list a folder.
    """
    from .index import was_read

    words, shown = F.array_sort(T.title_tokens("title")), F.left("title_redacted", F.lit(T.TITLE_CUT))
    listed = ~F.col("sensitive") & ~F.col("title_credential")
    # titles alone, written once for all the joins
    read = indexed.filter(was_read()).select("folder", "rel", "plan_ord", shown.alias("t"), words.alias("tokens"), F.coalesce(listed, F.lit(False)).alias("listed"))
    read = materialised(read, "titles")
    mine = read.select("folder", "rel", "tokens")
    base = read.filter("listed").select("folder", "rel", "plan_ord", "t", "tokens")
    pool = base.groupBy("folder", "tokens").agg(F.min("plan_ord").alias("first_ord"))
    # one more than asked for, since a note is in its own list
    near = nearest_sets(mine, pool, keep + 1, rare, most_frequent)
    heads = _first(base.filter(F.size("tokens") > 0), ["folder", "tokens"], ["plan_ord"], keep + 1).withColumnRenamed("tokens", "other")
    near = near.join(heads, ["folder", "other"]).withColumn("rn", F.row_number().over(Window.partitionBy("folder", "tokens").orderBy(F.desc("alike"), "plan_ord"))).filter(F.col("rn") <= keep + 1)
    near = near.groupBy("folder", "tokens").agg(F.sort_array(F.collect_list(F.struct("rn", "rel", "t"))).alias("near"), F.collect_list("rel").alias("near_rels"))
    first = _first(base, ["folder"], ["plan_ord"], 2 * keep + 1)
    first = first.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("plan_ord", "rel", "t"))).alias("first"))  # a bounded list a folder
    every = mine.join(near, ["folder", "tokens"], "left").join(first, "folder", "left")
    none = F.array().cast("array<string>")
    own = F.filter("near", lambda x: x["rel"] != F.col("rel"))
    # a list that is not full holds all that share a word: so many more of the folder's first notes are enough, and names tell the others
    known = F.coalesce(F.size("near_rels"), F.lit(0))
    strange = F.filter(F.slice("first", F.lit(1), F.greatest(known, F.lit(0)) + keep + 1), lambda x: (x["rel"] != F.col("rel")) & ~F.coalesce(F.array_contains("near_rels", x["rel"]), F.lit(False)))
    titles = lambda c: F.coalesce(F.transform(c, lambda x: x["t"]), none)
    full = F.coalesce(F.size(own) >= keep, F.lit(False))
    out = F.when(full, F.slice(titles(own), 1, keep)).otherwise(F.slice(F.concat(titles(own), titles(strange)), 1, keep))
    # a column that the filter can't repeat: a list is put together once
    return every.select("rel", F.explode(F.array(out)).alias("other_note_titles")).filter(F.size("other_note_titles") > 0)
