"""What the operators of this subpackage share: tables in the shared folder, Arrow batches, column helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only a session in one process (local master) may go without; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tidepool-"))
    return _own[0]


def new_table(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by materialise(), once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key is hot if more than one in so many of all rows have it; there are fewer hot keys than this.
MOST_HOT = 1000


def join_spread(df: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """df joined with a table of one row a key, whose column weight says how many of df's `total` rows have the key.

    Rows of hot keys stay where they are: the table's rows for them, fewer than MOST_HOT, go to every
    executor. The rest is shuffled. how: inner or left_semi. Both sides are read twice.
    """
    hot = F.broadcast(table.filter(F.col(weight) * MOST_HOT > total))
    rest = df.join(hot.select(*keys), keys, "left_anti").join(table, keys, how)
    return df.join(hot, keys, how).unionByName(rest)


#: Places of the map that maybe_in() sends to the executors: 16 MB, however many keys there are.
MAP_PLACES, MAP_BUCKET = 1 << 27, 1 << 15


def maybe_in(df: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
    """df with a boolean column: false for rows whose key is certainly not in the table, true for all that are and a few more.

    Every key of the table sets one of MAP_PLACES bits by its hash. The map has a bounded size; with as
    many keys as a tenth of its places, one row in ten is marked in vain, and none is ever missed.
    """
    place = F.pmod(F.xxhash64(key), F.lit(MAP_PLACES))
    at = table.select(place.alias("p")).select(F.floor(F.col("p") / MAP_BUCKET).alias("_bucket"), (F.col("p") % MAP_BUCKET).alias("at"))
    bits = at.groupBy("_bucket").agg(F.bitmap_construct_agg("at").alias("_bits"))
    out = df.withColumn("_place", place).withColumn("_bucket", F.floor(F.col("_place") / MAP_BUCKET)).join(F.broadcast(bits), "_bucket", "left")
    within = F.col("_place") % MAP_BUCKET
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(within / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("getbit", byte, (within % 8).cast("int")) == 1
    return out.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_place", "_bucket", "_bits")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times in body, inside one expression."""
    return F.transform(F.array(value), body)[0]


def whole_text(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder by five; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: What one Arrow batch may hold: texts of any length then need little memory outside the heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
_memos: dict[str, Callable[[], None]] = {}


def memo(name: str, clear: Callable[[], None]) -> None:
    """Register what an operator keeps in a Python worker, and clear what the others do: a worker serves one at a time."""
    others = [n for n in _memos if n != name]
    for other in others:
        _memos.pop(other)()
    if others:
        _give_back()
    _memos[name] = clear


def _libc(name: str):
    return getattr(ctypes.CDLL(None), name, None) if sys.platform == "linux" else None


@functools.cache
def _steady_allocator() -> None:
    """Large blocks go back to the system when they are freed: left alone, the allocator learns to keep them."""
    if option := _libc("mallopt"):
        for parameter, value in ((-3, 1 << 20), (-1, 2 << 20), (-8, 2)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
            option(parameter, value)


def _give_back() -> None:
    """Return freed memory to the system, where its allocator can be asked to."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _libc("malloc_trim"):
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to BATCH; lower ones stay."""
    for key, most in BATCH.items():
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def arrow_map(df: DataFrame, over: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function from one batch to one batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _steady_allocator()
        try:
            for batch in batches:
                if batch.num_rows and (out := over(batch)) is not None and out.num_rows:
                    yield out
        finally:  # the worker idles beside the next stages, with what this one freed
            _give_back()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes of text each, one row at least."""
    start = total = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if total and total + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    yield batch.slice(start)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is evaluated once a row: projections above are not merged into this one."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def running_sums(numbers: Column, block: int = 128) -> Column:
    """Inclusive running sums of an array of numbers, in blocks, so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    places = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)

    def of(a: Column) -> Column:
        blocks = F.transform(places(F.ceil(F.size(a) / block).cast("int")), lambda b: F.slice(a, b * block + 1, block))

        def joined(parts: Column) -> Column:
            def with_sums(sums: Column) -> Column:
                before = lambda i: total(F.slice(sums, F.lit(1), i))
                inside = lambda p, o: F.transform(p, lambda _, i: o + total(F.slice(p, F.lit(1), i + 1)))
                return F.flatten(F.transform(parts, lambda p, i: let(before(i), lambda o: inside(p, o))))

            return let(F.transform(parts, total), with_sums)

        return let(blocks, joined)

    return let(numbers, of)
