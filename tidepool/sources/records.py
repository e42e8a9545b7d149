"""JSON-lines records: id and what is sent of each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.redaction import redacted

from .lines import numbered

NAME = r"^[A-Za-z_][A-Za-z0-9_]{0,63}$"


class BadRecords(ValueError):
    """The file is refused as a whole, with its first bad line."""


def _problem(v: Column) -> Column:
    """What is wrong with a line's variant, or null."""
    kind = F.schema_of_variant(v)
    ident = F.try_variant_get(v, "$.id", "string")
    sent = F.try_variant_get(v, "$.sent", "map<string,variant>")
    entries = F.map_entries(sent)
    kinds = F.transform(entries, lambda e: F.schema_of_variant(e["value"]))
    plain = lambda k: k.isin("STRING", "BOOLEAN", "VOID", "ARRAY<STRING>", "ARRAY<VOID>") | F.regexp_like(k, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
    return (
        F.when(v.isNull(), "not JSON").when(~F.startswith(kind, F.lit("OBJECT")), "not an object").when(ident.isNull() | (ident == ""), "no id")
        .when(sent.isNull(), "sent is not an object").when(F.size(sent) == 0, "sent is empty")
        .when(F.exists(F.map_keys(sent), lambda k: ~F.regexp_like(k, F.lit(NAME))), "a field's name is no identifier")
        .when(F.exists(kinds, lambda k: ~plain(k)), "a value is nested or a mixed list")
    )


def checked(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """id, sent (map of variants), line of (value, line); raises BadRecords at the first bad line.

    Ids must be unique. Field names that redaction would change are refused too. Only id and sent are
    read; the driver sees one line of messages at most.
    """
    v = F.try_parse_json("value")
    df = df.filter(F.trim("value") != "").select("line", v.alias("v")).select("line", "v", _problem(F.col("v")).alias("problem"))
    first = df.filter("problem IS NOT NULL").orderBy("line").limit(1).first()
    if first:
        raise BadRecords(f"line {first['line']}: {first['problem']}")
    out = df.select(F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.sent", "map<string,variant>").alias("sent"), "line")
    again = out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("line")).filter("n > 1").orderBy("line").limit(1).first()
    if again:
        raise BadRecords(f"line {again['line']}: this id came before")
    fields = redacted(out.select(F.explode(F.map_keys("sent")).alias("field")).distinct(), "field", names).filter(F.size("hits") > 0)
    if not fields.isEmpty():
        raise BadRecords("a field's name holds something to redact")
    return out


def read_records(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    return checked(numbered(spark, path).select("value", "line"), names)


def in_memory(spark: SparkSession, rows: list[dict], names: list[str] | None = None) -> DataFrame:
    """The same for rows that the caller holds (dicts with id and sent); a row's line is its place in the list."""
    return checked(spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows, 1)], "line long, value string"), names)


def states(records: DataFrame, names: list[str] | None = None, cap: int = 16_000) -> DataFrame:
    """id, state (JSON of fields and field_names), hits, key, payload_chars.

    Strings are redacted and then cut. Numbers are redacted as text and stay numbers if nothing was
    found; booleans and nulls pass; lists are redacted element by element. Fields meet again by id.
    """
    each = records.select("id", F.explode(F.map_entries("sent")).alias("e")).select("id", "e.key", F.col("e.value").alias("v"))
    kind = F.schema_of_variant(F.col("v"))
    listed = F.startswith(kind, F.lit("ARRAY"))
    values = F.when(listed, F.try_variant_get("v", "$", "array<string>")).otherwise(F.array(F.try_variant_get("v", "$", "string")))
    flat = each.select("id", "key", kind.alias("kind"), F.posexplode_outer(values).alias("i", "text"))
    flat = redacted(flat, "text", names)
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', 1)
    cut = F.left("redacted", F.lit(cap))
    bare = F.col("kind").isin("BOOLEAN", "BIGINT", "DOUBLE", "FLOAT") | F.startswith("kind", F.lit("DECIMAL"))
    wire = F.when(F.col("text").isNull(), "null").when(bare & (F.col("text") == F.col("redacted")), F.col("text")).otherwise(quoted(cut))
    one = flat.withColumn("wire", wire).groupBy("id", "key", "kind").agg(
        F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "wire")))).alias("w"), F.flatten(F.collect_list("hits")).alias("h")
    )
    joined = F.array_join(F.transform("w", lambda x: x["wire"]), ",")
    value = F.when(F.startswith("kind", F.lit("ARRAY")), F.concat(F.lit("["), joined, F.lit("]"))).otherwise(joined)
    by_id = one.select("id", "key", value.alias("value"), "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("f"), F.flatten(F.collect_list("h")).alias("h"))
    fields = F.array_join(F.transform("f", lambda x: F.concat(quoted(x["key"]), F.lit(":"), x["value"])), ",")
    names_json = F.array_join(F.transform("f", lambda x: quoted(x["key"])), ",")
    state = F.concat(F.lit('{"field_names":['), names_json, F.lit('],"fields":{'), fields, F.lit("}}"))
    out = by_id.select("id", state.alias("state"), F.array_sort(F.array_distinct("h")).alias("hits"))
    return out.withColumns({"key": F.left(F.sha2("state", 256), F.lit(24)), "payload_chars": F.char_length("state")})


def reused(prepared: DataFrame) -> DataFrame:
    """prepared with same_as: of equal keys all but the first by id take that one's answer."""
    first = prepared.groupBy("key").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key", "_first")
    out = prepared.join(first, "key", "left")
    return out.withColumn("same_as", F.when(F.col("_first") != F.col("id"), F.col("_first"))).drop("_first").select(*prepared.columns, "same_as")
