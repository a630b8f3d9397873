"""Line-delimited JSON logs and manifests, runs told by file names, and what is written back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.storage import scratch  # noqa: F401

#: Sidecar files of a run, told by how their names end.
SIDECARS = r"(judged|equiv|gtaudit|todo|missing|summary)\.jsonl?$"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_log(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a log with source_file; a missing path is empty, lines that aren't JSON objects are left out."""
    return _scan(spark, path, schema).where("row IS NOT NULL").select("row.*", "source_file")


def count_bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_file, n_rows, n_bad: lines that parse as objects and lines, not blank, that don't."""
    bad = F.col("row").isNull() & (F.trim("value") != "")
    return _scan(spark, path, "a string").groupBy("source_file").agg(
        F.count_if(F.col("row").isNotNull()).alias("n_rows"), F.count_if(bad).alias("n_bad")
    )


def _scan(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        empty = T.StructType([T.StructField("value", T.StringType()), T.StructField("row", kind), T.StructField("source_file", T.StringType())])
        return spark.createDataFrame([], empty)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source_file"))
    # A line is good if it is one whole JSON object; torn tails fail to parse.
    whole = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    return lines.withColumn("row", F.when(whole, F.from_json("value", kind)))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a line that doesn't parse fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def discover_runs(spark: SparkSession, glob: str) -> DataFrame:
    """source_file, dataset, model, budget, condition, run of the log files under a glob, sidecars left out."""
    names = spark.read.format("binaryFile").load(glob).select(F.element_at(F.split("path", "/"), -1).alias("source_file"))
    return names.where(~F.col("source_file").rlike(SIDECARS)).select("source_file", *run_parts(F.col("source_file")))


def run_parts(name: Column) -> list[Column]:
    pattern = r"^(.+?)__(.+?)_think(\d+)_(.+?)_r(\d+)\.jsonl$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return [
        part(1).alias("dataset"), part(2).alias("model"), part(3).try_cast("int").alias("budget"), part(4).alias("condition"),
        part(5).try_cast("int").alias("run"),
    ]


def tag_parts(tag: Column, models: list[str]) -> list[Column]:
    """model and protocol of a run's tag: the longest of the known models that it begins with, and the rest without
    the number of a repeat; nulls for a tag of no known model."""
    model = F.lit(None).cast("string")
    for name in sorted(models, key=len):
        model = F.when(tag.startswith(f"{name}_"), F.lit(name)).otherwise(model)
    rest = F.regexp_replace(F.substring(tag, F.length(model) + 2, F.length(tag)), r"_r\d+$", "")
    return [model.alias("model"), rest.alias("protocol")]


def blind_control(examples: DataFrame, prefix: str = "blind") -> DataFrame:
    """The examples under a uid of their own, with the source's uid beside it, to be asked without their images."""
    keep = [c for c in examples.columns if c not in ("uid", "images")]
    return examples.select(F.concat(F.lit(f"{prefix}:"), "uid").alias("uid"), F.col("uid").alias("src_uid"), *keep)


def resolve_arm(runs: DataFrame, wanted: str | None = None, canonical: str | None = None, across: bool = False) -> list[str]:
    """File names of the arm to read: the one asked for, the canonical one, or the only one; never several models.

    Several protocols (budget, condition) together need across. Raises ValueError where that leaves no answer.
    """
    rows = runs.distinct().collect()  # one row a file
    pick = [r for r in rows if wanted is None or r.source_file == wanted]
    if wanted is None and canonical is not None and any(r.condition == canonical for r in pick):
        pick = [r for r in pick if r.condition == canonical]
    if not pick:
        raise ValueError(f"no run matches {wanted or 'the folder'}")
    if len({r.model for r in pick}) > 1:
        raise ValueError("runs of several models can't be pooled: " + ", ".join(sorted({str(r.model) for r in pick})))
    if len({(r.budget, r.condition) for r in pick}) > 1 and not across:
        raise ValueError("runs under several protocols need across=True")
    return sorted(r.source_file for r in pick)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """source_file, n_lines, n_bytes: what a summary was made from."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_size").alias("size"))
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_lines"), F.max("size").alias("n_bytes"))


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fingerprint rows of one side only, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("now")))


def require_unchanged(stored: DataFrame, now: DataFrame) -> None:
    """Raise if what a summary was made from is not what is there now."""
    names = sorted({r.source_file for r in changed(stored, now).select("source_file").distinct().limit(1000).collect()})
    if names:
        raise ValueError(f"made from other files than there are now: {len(names)} differ, {', '.join(names[:3])}")


def write_unless_empty(df: DataFrame, path: str, fmt: str = "json") -> int:
    """Write and return the number of rows; nothing is written, and what is there stays, if there are none."""
    n = df.count()
    if not n:
        raise ValueError(f"nothing to write to {path}")
    df.write.mode("overwrite").format(fmt).save(path)
    return n


def require_rows(df: DataFrame, by: str, least: int) -> None:
    """Raise unless each group has at least so many rows."""
    few = df.groupBy(by).count().where(F.col("count") < least).limit(5).collect()
    if few:
        raise ValueError(f"fewer than {least} rows: " + ", ".join(f"{r[0]} ({r[1]})" for r in few))


def write_summary(df: DataFrame, path: str) -> None:
    """Nested rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a markdown table; raises if it has more rows than a report should."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *([show(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def json_shape(value: object, at: str = "$") -> dict[str, str]:
    """Paths of a JSON value and their types; list entries share a path."""
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
    out = {at: kinds[type(value)]}
    if isinstance(value, dict):
        for k, v in value.items():
            out |= json_shape(v, f"{at}.{k}")
    elif isinstance(value, list):
        for v in value:
            out |= json_shape(v, f"{at}[]")
    return out


def compare_shapes(a: str, b: str) -> dict[str, list[str]]:
    """Paths that only one of two JSON texts has, and those whose type differs."""
    x, y = json_shape(json.loads(a)), json_shape(json.loads(b))
    return {
        "missing": sorted(x.keys() - y.keys()), "extra": sorted(y.keys() - x.keys()),
        "changed": sorted(k for k in x.keys() & y.keys() if x[k] != y[k]),
    }
