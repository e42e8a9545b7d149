"""Command line: `python -m tidepool.cli notes PATH` and `python -m tidepool.cli records FILE`.

Ends with 0 if all went well, 1 if it was refused, 2 if notes failed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tidepool.api import OverBudget, judge_records, scan_vault
from tidepool.functions import text as T
from tidepool.operators import bill as B
from tidepool.operators import index as I
from tidepool.operators import journal as J
from tidepool.operators import plan as P
from tidepool.operators import rollup as U
from tidepool.operators import survey as V
from tidepool.plans import scan
from tidepool.session import local_session
from tidepool.sources import notes, settings, sinks
from tidepool.sources.records import BadRecords


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidepool", description=__doc__)
    sub = top.add_subparsers(dest="kind", required=True)
    n = sub.add_parser("notes")
    n.add_argument("path")
    n.add_argument("--config", help="a TOML profile; flags come before it")
    n.add_argument("--plan", action="store_true", help="show what would be read and sent, and stop")
    n.add_argument("--include-sensitive", action="store_true")
    n.add_argument("--sensitive-paths", help="names, parted by commas, in place of the default list")
    n.add_argument("--taxonomy")
    n.add_argument("--git-unsafe-below", type=float)
    n.add_argument("--journal")
    n.add_argument("--resume", help="a run's id")
    n.add_argument("--diff", nargs=2, metavar=("BEFORE", "AFTER"), help="two run ids of the journal")
    n.add_argument("--no-local-triage", action="store_true")
    n.add_argument("--survey", type=int, help="a sample of so many notes")
    n.add_argument("--map", help="folder for the rollup of folders, as JSON")
    n.add_argument("--review-pile", help="folder for the list of notes to review")
    r = sub.add_parser("records")
    r.add_argument("path")
    r.add_argument("--questions", required=True)
    r.add_argument("--review-choice")
    for p in (n, r):
        p.add_argument("--denylist")
        p.add_argument("--excerpt-chars", default=None)
        p.add_argument("--out", help="folder for the rows, as JSON")
        p.add_argument("--json", action="store_true", help="print rows as JSON lines")
    return top


def _show(df, as_json: bool, out: str | None, order: str) -> None:
    if out:
        sinks.write_json(df, out)
    if as_json:
        for line in df.orderBy(order).toJSON().toLocalIterator():
            print(line)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = local_session("tidepool")
    try:
        names = settings.denylist(a.denylist)[0] if a.denylist else None
        if a.kind == "records":
            cap = T.parse_excerpt_chars(a.excerpt_chars) if a.excerpt_chars else T.EXCERPT_CAP
            rows = judge_records(spark, a.path, a.questions, names, T.effective_cap(cap), a.review_choice)
            _show(rows, a.json, a.out, "id")
            rows.groupBy("action", "pick").count().show(truncate=False)
            return 0
        profile = settings.profile(a.config) if a.config else {}
        parts = tuple(a.sensitive_paths.split(",")) if a.sensitive_paths else tuple(profile.get("sensitive_paths", T.SENSITIVE_NAMES))
        chars = a.excerpt_chars or profile.get("excerpt_chars")
        cap = T.parse_excerpt_chars(str(chars)) if chars is not None else T.EXCERPT_CAP
        sensitive = a.include_sensitive or profile.get("include_sensitive", False)
        journal = a.journal or profile.get("journal")
        if a.diff:
            before, after = (J.latest(_for_diff(sinks.read_rows(spark, journal, x)), order="line") for x in a.diff)
            changes = J.diff(before, after)
            if a.out:
                sinks.diff_json(changes).write.mode("overwrite").text(a.out)
            print(sinks.diff_text(changes))
            return 0
        P.refuse_root(a.path, a.path, parts, sensitive)
        planned = notes.read_notes(spark, a.path, parts, sensitive)
        if a.plan or a.survey:
            P.counts(planned).orderBy("folder", "status").show(1000, truncate=False)
            P.near_misses(planned, parts).show(truncate=False)
            prepared = scan.prepare(planned, names=names, cap=cap)
            withheld = B.skipped(planned).groupBy().sum("notes").first()[0] or 0
            print(B.text_of(B.bill(prepared, 1000).first().asDict(), withheld, [tuple(r) for r in B.largest_folders(prepared).collect()], 2.0))
            if a.survey:
                V.sample(prepared.filter("disposition = 'fresh'").select("rel", "words", "age_days"), a.survey).show(a.survey, truncate=False)
            return 0
        rows, end = scan_vault(
            spark, a.path, None, a.taxonomy, sensitive, parts, names, excerpt_chars=cap, local_triage=not a.no_local_triage, journal=journal, resume=a.resume, git_unsafe_below=a.git_unsafe_below
        )
        rows = rows.persist()
        _show(rows, a.json, a.out, "path")
        if a.map:
            facts = I.link_facts(I.index(planned, scan.TODAY, names), a.path.endswith(".md"))
            sinks.write_json(U.folder_map(U.noted(facts, rows)), a.map)
        if a.review_pile:
            sinks.pile_markdown(rows).coalesce(1).write.mode("overwrite").text(a.review_pile)
        rows.groupBy("kind", "judge", "bucket", "action").count().orderBy("kind", "judge", "bucket").show(100, truncate=False)
        return 2 if end["reason"] != "done" or rows.filter("kind = 'error'").limit(1).count() else 0
    except (OverBudget, BadRecords, ValueError) as refused:
        print(f"refused: {refused}", file=sys.stderr)
        return 1


def _for_diff(rows):
    wanted = {"path": "string", "kind": "string", "judge": "string", "bucket": "string", "confidence": "double", "action": "string", "exact_duplicate_of": "string", "suggested_bucket": "string", "truncated": "boolean", "findings": "array<string>", "skipped": "string"}
    have = set(rows.columns)
    return rows.select(*[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in wanted.items()], (F.coalesce("kind", F.lit("")) != "error").cast("int").alias("line"))


if __name__ == "__main__":
    sys.exit(main())
