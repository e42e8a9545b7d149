"""Files of a store that tasks open themselves: folders listed level by level, contents, ends of journals.

Spark's own file sources leave out empty files and names that begin with a dot or an underscore, list on
the driver, and read whole files. Here every folder is listed by a task, and a file is opened only by
the task that has its row. The store is whatever the path's scheme names (local files, HDFS, S3, ...).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.plans.shared import materialised

#: Entries of a folder that are given on at once, and bytes of content.
ENTRIES, CONTENT_BYTES = 10_000, 4 << 20
#: A journal's last line is looked for in so many bytes at its end.
TAIL = 64 << 10
LISTED = "rel string, folder boolean, size long, modified timestamp"


def opened(path: str):
    """The store that a path names, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        import os

        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def _below(store, root: str, rel: str) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    entries: list[tuple] = []
    base = f"{root}/{rel}".rstrip("/")
    for e in store.get_file_info(fs.FileSelector(base, recursive=False)):
        # a link that leads nowhere is neither a file nor a folder
        if e.type in (fs.FileType.File, fs.FileType.Directory):
            entries.append((f"{rel}/{e.base_name}".lstrip("/"), e.type == fs.FileType.Directory, e.size, e.mtime))
        if len(entries) >= ENTRIES:
            yield _frame(entries)
            entries = []
    if entries:
        yield _frame(entries)


def _frame(entries: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(entries, columns=["rel", "folder", "size", "modified"])
    out["size"] = pd.to_numeric(out["size"]).fillna(0).astype("int64")
    out["modified"] = pd.to_datetime(out["modified"], utc=True)
    return out


def tree(spark: SparkSession, root: str, ending: str) -> DataFrame:
    """rel, size, modified of every file below root whose name has the ending; hidden and empty ones too.

    One round a level: its folders are dealt to the tasks, and what they hold is written before the next
    level is looked at. The driver holds no names.
    """

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = opened(root)
        for batch in batches:
            for rel in batch["rel"]:
                yield from _below(store, base, rel)

    level = spark.range(1).select(F.lit("").alias("rel"))
    found = None
    while True:
        here = materialised(level.mapInPandas(below, LISTED), "listing")
        files = here.filter(~F.col("folder") & F.endswith("rel", F.lit(ending))).drop("folder")
        found = files if found is None else found.unionByName(files)
        folders = here.filter("folder").select("rel")
        if folders.isEmpty():
            return found
        level = folders.repartition(4 * spark.sparkContext.defaultParallelism)


def with_contents(df: DataFrame, root: str, wanted: str) -> DataFrame:
    """df (rel, ...) with content, the bytes of the file, where the condition `wanted` holds and null elsewhere.

    Files whose rows don't want them are never opened. What a task holds is one file and 4 MB more.
    """
    names = df.columns
    flagged = df.withColumn("_wanted", F.coalesce(F.expr(wanted), F.lit(False)))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = opened(root)
        for batch in batches:
            start = held = 0
            contents: list[bytes | None] = []
            for i, (rel, wants) in enumerate(zip(batch["rel"], batch["_wanted"], strict=True)):
                if wants:
                    with store.open_input_stream(f"{base}/{rel}") as f:
                        contents.append(f.read())
                    held += len(contents[-1])
                else:
                    contents.append(None)
                if held >= CONTENT_BYTES:
                    yield batch.iloc[start : i + 1].drop(columns="_wanted").assign(content=contents)
                    start, held, contents = i + 1, 0, []
            if contents:
                yield batch.iloc[start:].drop(columns="_wanted").assign(content=contents)

    return flagged.mapInPandas(read, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", content binary")


def _ends(store, path: str, size: int) -> tuple[str | None, str | None]:
    with store.open_input_file(path) as f:
        first = b""
        while b"\n" not in first and (more := f.read(4096)):
            first += more
        f.seek(max(0, size - TAIL))
        tail = f.read()
    header = _object(first.split(b"\n", 1)[0], "run")
    # without its line end the last line was torn
    footer = _object(tail.rstrip(b"\n").rsplit(b"\n", 1)[-1], "end") if tail.endswith(b"\n") else None
    return header, footer


def _object(line: bytes, kind: str) -> str | None:
    """A line as it is, if it is a JSON object of the kind."""
    try:
        found = json.loads(line)
    except ValueError:
        return None
    return line.decode() if isinstance(found, dict) and found.get("kind") == kind else None


def journal_ends(spark: SparkSession, root: str, ending: str = ".jsonl") -> DataFrame:
    """rel, size, header, footer of every journal below root: its first line and its last, if they are what they should be.

    A journal is a JSON object of kind `run`, rows, and one of kind `end`. Its rows are not read: a
    journal costs as much as its first line and 64 KiB, however long it is. header and footer are JSON
    texts, null where the line is missing, torn or something else.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = opened(root)
        for batch in batches:
            ends = [_ends(store, f"{base}/{rel}", size) for rel, size in zip(batch["rel"], batch["size"], strict=True)]
            yield batch.assign(header=[h for h, _ in ends], footer=[f for _, f in ends])

    files = tree(spark, root, ending).select("rel", "size")
    return files.mapInPandas(read, "rel string, size long, header string, footer string")
