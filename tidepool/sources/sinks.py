"""What a run leaves behind: journal, maps, and, only if asked for, stamps and moves of files."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.plans.shared import drop, materialised

from .lines import numbered

#: Rows of a wave are cut in the order of this column.
ORDER = "plan_ord"


#: What a commit says of a wave: which attempt counts, and up to which place of the order its rows do.
COMMIT = "run_id string, wave int, attempt string, cut string, reason string, n_rows long, n_sent long, n_errors long, n_tokens long, n_in_flight long"


def stage_wave(rows: DataFrame, journal: str, run_id: str, wave: int) -> str:
    """Write the rows of a wave where nobody reads them yet; gives the name of the attempt.

    An attempt that was never committed, because the driver or the executors were lost, stays unread.
    """
    attempt = uuid.uuid4().hex
    rows.write.parquet(f"{journal}/rows/run_id={run_id}/wave={wave}/attempt={attempt}")
    return attempt


def read_wave(spark: SparkSession, journal: str, run_id: str, wave: int, attempt: str) -> DataFrame:
    """The rows of one attempt; no other wave's files are looked at."""
    return spark.read.parquet(f"{journal}/rows/run_id={run_id}/wave={wave}/attempt={attempt}")


def commit_wave(spark: SparkSession, journal: str, commit: dict) -> dict:
    """Make a staged wave count, once: the first commit of a wave stands, and it is given back."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{journal}/commits/run_id={commit['run_id']}/{commit['wave']:09d}.json")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = where.suffix(f".{uuid.uuid4().hex}.part")
    out = files.create(whole, False)
    out.write(bytearray((json.dumps(commit) + "\n").encode()))
    out.close()
    # a name is given once: a half-written commit never has it
    if files.exists(where) or not files.rename(whole, where):
        files.delete(whole, False)
    return spark.read.schema(COMMIT).json(where.toString()).first().asDict()


def commits(spark: SparkSession, journal: str, run_id: str | None = None) -> DataFrame:
    """What was committed, a row for each wave; none if there is no journal yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{journal}/commits" + (f"/run_id={run_id}" if run_id else ""))
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(where.toString())


def read_rows(spark: SparkSession, journal: str, run_id: str | None = None, in_flight: bool = False) -> DataFrame:
    """Committed rows of a journal or of one run, with run_id and wave.

    in_flight: also those that had been judged when their run stopped before them; they are no rows of
    the run, and what was paid for them can be served to the next one.
    """
    done = commits(spark, journal, run_id).select("run_id", "wave", "attempt", "cut")
    if done.isEmpty():
        return done.select("run_id", "wave", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("path"))
    rows = spark.read.option("mergeSchema", "true").parquet(f"{journal}/rows")
    rows = rows.withColumns({"run_id": F.col("run_id").cast("string"), "attempt": F.col("attempt").cast("string")})
    kept = rows.join(done, ["run_id", "wave", "attempt"])
    if not in_flight and ORDER in rows.columns:
        kept = kept.filter(F.col("cut").isNull() | (F.col(ORDER).cast("string") <= F.col("cut")))
    return kept.drop("attempt", "cut")


def append_rows(rows: DataFrame, journal: str, run_id: str, wave: int = -1) -> None:
    """Rows that no stop can cut, staged and committed; a second time they change nothing."""
    attempt = stage_wave(rows, journal, run_id, wave)
    n = read_wave(rows.sparkSession, journal, run_id, wave, attempt).count()
    commit_wave(rows.sparkSession, journal, {"run_id": run_id, "wave": wave, "attempt": attempt, "cut": None, "reason": None, "n_rows": n, "n_sent": 0, "n_errors": 0, "n_tokens": 0, "n_in_flight": 0})


def append_run(spark: SparkSession, journal: str, header: dict) -> None:
    spark.createDataFrame([header]).coalesce(1).write.mode("append").json(f"{journal}/runs")


def read_lines(spark: SparkSession, path: str) -> tuple[dict, DataFrame, bool]:
    """Header, rows (line, row as variant) and whether the last line is torn, of a JSON-lines journal.

    A last line that is no JSON is dropped; one elsewhere is an error.
    """
    lines = numbered(spark, path).select("line", "value").filter("value != ''")
    rows = lines.select("line", "value", F.try_parse_json("value").alias("row"))
    last = rows.agg(F.max("line")).first()[0]
    bad = rows.filter("row IS NULL").agg(F.min("line"), F.max("line")).first()
    if bad[0] is not None and bad[0] != last:
        raise ValueError(f"{path}: line {bad[0]} is damaged")
    first = rows.filter("row IS NOT NULL").orderBy("line").limit(1).first()
    header = json.loads(first["value"]) if first else {}
    return header, rows.filter("row IS NOT NULL").filter(F.col("line") > (first["line"] if first else 0)).select("line", "row"), bad[0] is not None


def latest_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy("started", "run_id")


def quarantine_moves(rows: DataFrame, folder: str = "_tidepool/quarantine", existing: DataFrame | None = None) -> DataFrame:
    """from, to, reason, triggers: where held notes go; no two go to one place, nor to one that is taken.

    rows: path, plan_ord, action, reason, quarantine_triggers. existing: path of what is there already.
    A note keeps its path below the folder; if that is taken it gets -2, -3, ..., the first that is free
    when the notes are moved in plan order. Places that differ in case only are one, since file systems
    take them so. Every note claims a place, the first in plan order holds it and the others claim their
    next one: a round of claims is a partial sum by place, so that no place is a hot key. Chains of
    claims settle in as many rounds as they are long.
    """
    spark = rows.sparkSession
    held = rows.filter("action = 'quarantine'").select("path", "plan_ord", "reason", "quarantine_triggers")
    stem = F.lower(F.concat(F.lit(folder + "/"), F.regexp_replace("path", r"(?i)\.md$", "")))
    held = held.withColumn("_stem", stem)
    if existing is None:
        existing = spark.createDataFrame([], "path string")
    there = existing.select(F.regexp_replace(F.lower("path"), r"\.md$", "").alias("name")).distinct()
    # which numbers of a stem are taken by what is there; 1 is the stem itself
    number = F.regexp_extract("name", r"-([1-9][0-9]{0,8})$", 1)
    taken = there.select(F.col("name").alias("_stem"), F.lit(1).alias("k")).unionByName(there.filter(number != "").select(F.regexp_replace("name", r"-[0-9]+$", "").alias("_stem"), number.cast("int").alias("k")))
    taken = taken.join(held.select("_stem").distinct(), "_stem", "left_semi").groupBy("_stem").agg(F.array_sort(F.collect_set("k")).alias("_taken"))
    nth = lambda after: F.reduce(F.coalesce("_taken", F.array().cast("array<int>")), after + 1, lambda at, k: F.when(k == at, at + 1).otherwise(at))
    claims = held.join(taken, "_stem", "left").withColumn("_k", nth(F.lit(0)))
    place = F.when(F.col("_k") == 1, F.col("_stem")).otherwise(F.concat_ws("-", "_stem", "_k"))
    claims = materialised(claims, "moves")
    while True:
        first = claims.withColumn("_place", place).groupBy("_place").agg(F.min(F.struct("plan_ord", "path")).alias("_f"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        lost = claims.withColumn("_place", place).join(first, "_place").filter(F.col("_f.path") != F.col("path")).select("path", F.lit(True).alias("_lost"))
        if lost.isEmpty():
            break
        after = claims.join(lost, "path", "left").withColumn("_k", F.when(F.col("_lost"), nth(F.col("_k"))).otherwise(F.col("_k"))).drop("_lost")
        before, claims = claims, materialised(after, "moves")
        drop(before)
    shown = F.concat(F.lit(folder + "/"), F.regexp_replace("path", r"(?i)\.md$", ""))
    ending = F.regexp_extract("path", r"((?i)\.md)$", 1)
    to = F.concat(shown, F.when(F.col("_k") > 1, F.concat(F.lit("-"), F.col("_k").cast("string"))).otherwise(F.lit("")), ending)
    return claims.select(F.col("path").alias("from"), to.alias("to"), "reason", F.col("quarantine_triggers").alias("triggers"))


#: The tool's key and the lines below it that are indented, or blank with an indented one to follow.
OWN_BLOCK = re.compile(r"""^(?P<q>['"]?)tidepool(?P=q)[ \t]*:[^\n]*(?:\n(?:[ \t\r]*\n)*[ \t]+[^\s][^\n]*)*""", re.M)


def spliced(header: str | None, block: str) -> str:
    """A header with the tool's own block put in place of the old one, or at the end; all else keeps its bytes."""
    if header is None:
        return block
    unix = header.replace("\r\n", "\n")
    new, found = OWN_BLOCK.subn(lambda _: block, unix, count=1)
    return new if found else f"{unix}\n{block}"


def stamp_changes(old: str, new: str) -> Column:
    """Whether a stamp must be written anew: bucket or action differ, or a score moved beyond noise."""
    from tidepool.functions.text import changed

    a, b = (lambda c, s=s: F.col(f"{s}.{c}") for s in (old, new))
    scores = ("persist", "confidence", "bucket_margin", "contains_secret", "safe_to_leave_in_git")
    out = ~a("bucket").eqNullSafe(b("bucket")) | ~a("action").eqNullSafe(b("action"))
    for s in scores:
        out = out | changed(a(s), b(s))
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pile_markdown(rows: DataFrame) -> DataFrame:
    """value: a line for each note to review, least confident first, for a text sink."""
    line = F.concat(F.lit("- [ ] "), "path", F.lit(" — "), "suggested_bucket", F.lit(" at "), F.format_number("confidence", 2))
    return rows.filter("suggested_bucket IS NOT NULL OR action = 'quarantine'").orderBy("confidence", "plan_ord").select(F.coalesce(line, F.concat(F.lit("- [ ] "), "path", F.lit(" — held"))).alias("value"))


#: Categories of a diff in the order in which they are shown, with their headings.
SHOWN = {
    "bucket_changed": "bucket changed", "into_review": "into the review pile", "out_of_review": "out of the review pile", "quarantined": "newly quarantined", "released": "released from quarantine",
    "new_duplicates": "new exact duplicates", "crossed_cap": "crossed the excerpt cap", "findings_fixed": "findings fixed", "findings_new": "new findings", "locked_since": "locked since",
    "unlocked_since": "unlocked since", "new": "new notes", "gone": "gone", "errors_after": "errors in the later run",
}


def diff_json(changes: DataFrame) -> DataFrame:
    """value: one JSON object for each category, with its count and its entries in order, for a text sink."""
    entry = F.struct("path", "detail")
    each = changes.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(entry)).alias("entries"))
    return each.select(F.to_json(F.struct("category", "n", "entries")).alias("value"))


def diff_text(changes: DataFrame, most: int = 20) -> str:
    """The changes in words: every category with its count and its first entries."""
    counts = {r["category"]: r["n"] for r in changes.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.row_number().over(Window.partitionBy("category").orderBy("path", "detail"))
    first: dict[str, list[str]] = {}
    for r in changes.withColumn("rn", place).filter(F.col("rn") <= most).orderBy("category", "rn").collect():
        first.setdefault(r["category"], []).append(r["path"] + (f"  ({r['detail']})" if r["detail"] else ""))
    lines = [f"{counts.get('unchanged', 0):,} unchanged"]
    for category, heading in SHOWN.items():
        if n := counts.get(category):
            lines.append(f"{heading}: {n:,}")
            lines += [f"  {x}" for x in first[category]]
            if n > most:
                lines.append(f"  ... and {n - most:,} more")
    return "\n".join(lines)
