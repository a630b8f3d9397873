"""The shapes of JSON texts over whole tables, and how two tables differ in them.

Texts are parsed to VARIANT once; level by level what is nested is exploded to values with a path, of
which only path and type are counted. Entries of a list share a path, so a table of any size has as
many rows as it has different paths and types. No text and no list passes the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.storage import stored

#: A path element: names that are not plain are quoted, so that a dot within one is no level.
_PLAIN = "^[A-Za-z_][A-Za-z0-9_]*$"


def _type(v: Column) -> Column:
    told = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "unreadable").when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "STRING", "string")
        .when(told == "BOOLEAN", "boolean").when(told == "VOID", "null").otherwise("number")
    )


def _level(values: DataFrame) -> DataFrame:
    """path, type, and the value where it is nested, stored: each value is exploded once."""
    typed = values.withColumn("type", _type(F.col("v")))
    return stored(typed.select("path", "type", F.when(F.col("type").isin("object", "array"), F.col("v")).alias("v")), "level")


def shapes(df: DataFrame, json: str) -> DataFrame:
    """path, type, n: how many values of each type stand at each path; null and malformed texts are "unreadable" at "$"."""
    spark = df.sparkSession
    cur = _level(df.select(F.lit("$").alias("path"), F.try_parse_json(F.col(json)).alias("v")))
    counts = [cur.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))]
    while not (nested := cur.where("v IS NOT NULL").select("path", "v")).isEmpty():
        inside = spark.sql("SELECT f.path, e.key, e.value AS v FROM {nested} f, LATERAL variant_explode(f.v) e", nested=nested)
        quoted = F.concat(F.lit("['"), F.replace("key", F.lit("'"), F.lit("\\'")), F.lit("']"))
        at = F.when(F.col("key").isNull(), "[]").when(F.col("key").rlike(_PLAIN), F.concat(F.lit("."), "key")).otherwise(quoted)
        cur = _level(inside.select(F.concat("path", at).alias("path"), "v"))
        counts.append(cur.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, counts)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, change, types_a, types_b of two tables' shapes: paths that only a has are missing, those that only b has extra, those whose types differ changed."""
    types = lambda s, name: s.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias(name))
    both = types(a, "types_a").join(types(b, "types_b"), "path", "full")
    change = F.when(F.col("types_b").isNull(), "missing").when(F.col("types_a").isNull(), "extra").when(F.col("types_a") != F.col("types_b"), "changed")
    return both.select("path", change.alias("change"), "types_a", "types_b").where("change IS NOT NULL")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, type, side: what only one of two shapes has, both ways."""
    x, y = a.select("path", "type"), b.select("path", "type")
    return x.exceptAll(y).withColumn("side", F.lit("only_a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("only_b")))
