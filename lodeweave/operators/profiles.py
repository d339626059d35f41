"""Profiles of nested data: every path through structs, arrays, maps and JSON, with how often it is there and what it holds.

Leaves are listed by column expressions, so rows never leave the engine. Presence and counts are
exact; distinct values and quantiles come from sketches, which profiles keep, so that those of
several tables can be merged without reading them again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.session import written

#: Levels of JSON that are told apart; what lies deeper is one value.
DEPTH = 4
LEAF = "array<struct<path:string,type:string,text:string,number:double>>"
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _leaf(path: Column, kind: Column | str, text: Column, number: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    number = F.lit(None).cast("double") if number is None else number.cast("double")
    return F.array(F.struct(path.alias("path"), kind.alias("type"), text.cast("string").alias("text"), number.alias("number")))


def _none() -> Column:
    return F.array().cast(LEAF)


def _variant(value: Column, path: Column, depth: int) -> Column:
    kind = F.schema_of_variant(value)
    # Text, numbers and whatever lies too deep.
    scalar = _leaf(path, F.lower(kind), F.coalesce(F.try_variant_get(value, "$", "string"), value.cast("string")), F.when(~kind.isin("STRING", "BOOLEAN"), F.try_variant_get(value, "$", "double")))
    out = F.when(value.isNull() | F.is_variant_null(value), _none())
    if depth:
        entries, items = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), F.try_variant_get(value, "$", "array<variant>")
        inner = F.flatten(F.transform(entries, lambda e: _variant(e["value"], F.concat(path, F.lit("."), e["key"]), depth - 1)))
        each = F.flatten(F.transform(items, lambda x: _variant(x, F.concat(path, F.lit("[]")), depth - 1)))
        out = out.when(kind.startswith("OBJECT"), inner).when(kind.startswith("ARRAY"), each)
    return out.otherwise(scalar)


def _leaves(value: Column, kind: T.DataType, path: Column, depth: int) -> Column:
    if isinstance(kind, T.StructType):
        parts = [_leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), depth) for f in kind.fields]
        return F.when(value.isNull(), _none()).otherwise(F.concat(_none(), *parts))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: _leaves(x, kind.elementType, F.concat(path, F.lit("[]")), depth))), _none())
    if isinstance(kind, T.MapType):
        each = F.transform(F.map_entries(value), lambda e: _leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")), depth))
        return F.coalesce(F.flatten(each), _none())
    if isinstance(kind, T.VariantType):
        return _variant(value, path, depth)
    number = value if isinstance(kind, NUMBERS) else None
    there = value.isNotNull() & (value != "") if isinstance(kind, T.StringType) else value.isNotNull()
    return F.when(there, _leaf(path, kind.simpleString(), value, number)).otherwise(_none())


def leaves(df: DataFrame, json: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """One row for each row of `df`: `leaves`, its values with their paths. json: text columns that are read as JSON; broken JSON has no leaves."""
    parts = []
    for f in df.schema.fields:
        value, kind = F.col(f"`{f.name}`"), f.dataType
        if f.name in (json or []):
            value, kind = F.try_parse_json(value), T.VariantType()
        parts.append(_leaves(value, kind, F.lit(f.name), depth))
    return df.select(F.concat(_none(), *parts).alias("leaves"))


def nested_profile(df: DataFrame, json: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """(path, rows, present, values, types, length_sum, distinct_sketch, quantile_sketch, minimum, maximum): the mergeable form of a profile.

    rows: of the table; present: rows in which the path has a value; values: all values, several in a row of an array.
    """
    every = leaves(df, json, depth)

    def row(path: Column, kind: Column, text: Column, number: Column, values: int, present: int, rows: int) -> Column:
        return F.struct(path.alias("path"), kind.alias("type"), text.alias("text"), number.alias("number"), *(F.lit(n).alias(name) for n, name in ((values, "values"), (present, "present"), (rows, "rows"))))

    nothing, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    # Values, the row's different paths, and the row itself, so that one pass and one aggregate give all counts.
    found = F.transform("leaves", lambda x: row(x["path"], x["type"], x["text"], x["number"], 1, 0, 0))
    paths = F.transform(F.array_distinct(F.transform("leaves", lambda x: x["path"])), lambda p: row(p, nothing, nothing, none, 0, 1, 0))
    listed = every.select(F.inline(F.concat(found, paths, F.array(row(nothing, nothing, nothing, none, 0, 0, 1)))))
    counts = written(listed.groupBy("path").agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.sum("values").alias("values"), F.array_sort(F.collect_set("type")).alias("types"), F.sum(F.length("text")).alias("length_sum"),
        F.hll_sketch_agg(F.when(F.col("text").isNotNull(), F.xxhash64("text")), F.lit(14)).alias("distinct_sketch"), F.kll_sketch_agg_double("number").alias("quantile_sketch"), F.min("number").alias("minimum"), F.max("number").alias("maximum"),
    ), "profile")
    total = counts.where("path IS NULL").select("rows")
    return counts.where("path IS NOT NULL").drop("rows").join(F.broadcast(total)).select("path", "rows", "present", "values", "types", "length_sum", "distinct_sketch", "quantile_sketch", "minimum", "maximum")  # one row


def merged(*profiles: DataFrame) -> DataFrame:
    """One profile from those of several tables; a table in which a path never occurs counts with its rows."""
    tagged = [p.withColumn("_k", F.lit(k)) for k, p in enumerate(profiles)]
    every = reduce(DataFrame.unionByName, tagged)
    rows = every.groupBy("_k").agg(F.max("rows").alias("n")).agg(F.sum("n").alias("rows"))
    out = every.groupBy("path").agg(
        F.sum("present").alias("present"), F.sum("values").alias("values"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"), F.sum("length_sum").alias("length_sum"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
    )
    return out.join(F.broadcast(rows)).select("path", "rows", "present", "values", "types", "length_sum", "distinct_sketch", "quantile_sketch", "minimum", "maximum")  # one row


def described(profile: DataFrame) -> DataFrame:
    """(field_name, presence_rate, data_type, n_values, avg_length, approx_distinct, minimum, median, maximum) of a profile."""
    number = F.col("minimum").isNotNull()
    return profile.select(
        F.col("path").alias("field_name"), (F.col("present") / F.col("rows")).alias("presence_rate"), F.array_join("types", "|").alias("data_type"), F.col("values").alias("n_values"),
        (F.col("length_sum") / F.col("values")).alias("avg_length"), F.hll_sketch_estimate("distinct_sketch").alias("approx_distinct"), "minimum",
        F.when(number, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(0.5))).alias("median"), "maximum",
    )
