"""From documents to a training mixture: quality, lines, near duplicates, benchmarks, mixing.

Each stage takes what its predecessor kept and returns the columns of documents (the last adds
where in the mixture a row stands). Every stage reads only COLUMNS, so further columns, whatever
their names, are not carried; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import decontaminate, line_dedup, mixing, ngram_jaccard, quality_model
from evalframe.llm.common import BROADCAST_KEYS, has_repeated_keys, materialize

#: The columns of documents; other columns are not carried.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage has changed it."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all labels of the given documents may be learnt from.

    Null and empty texts are scored like any other; rows that repeat a doc_id are judged each by its text;
    a score at the threshold is accepted; without labels of both classes all documents get one score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_model.score_quality(docs.select(*COLUMNS), labels, usable=F.lit(True), keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents of which no word is left go, those that had none stay.

    Null texts stay null. Of equal or similar lines the one of the smallest (doc_id, line number) stays; rows
    that repeat a doc_id are told apart by their texts.
    """
    docs = docs.select(*COLUMNS)
    cleaned = line_dedup.dedup_lines(docs, n_removed="_removed")
    left = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x00-\x20]")
    return _resized(cleaned.where((F.col("_removed") == 0) | left))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates (five words, similarity 0.8).

    Null and wordless texts are alone and stay. Equal rows of a doc_id stay or go together; rows of a doc_id with
    different texts are documents of their own.
    """
    docs = docs.select(*COLUMNS)
    if has_repeated_keys(docs, "doc_id", "text"):
        row = F.struct("doc_id", F.xxhash64("text").alias("mark"))
        docs = docs.withColumn("_row", row)
        found = ngram_jaccard.near_duplicates(docs, key="_row").where(~F.col("_row").eqNullSafe(F.col("component_id")))
        gone = found.select(F.col("_row.doc_id").alias("_id"), F.col("_row.mark").alias("_mark")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark"))
        return docs.join(gone.hint("merge"), same, "left_anti").select(*COLUMNS)
    found = ngram_jaccard.near_duplicates(docs)
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; documents that are mostly such passages go.

    Null and empty texts have no passage and stay; repeated rows are treated alike; without items nothing changes.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # The text as it was is not sent back beside the one that takes its place.
    keep = [c for c in COLUMNS if c != "text"]
    found = decontaminate.find_contamination(docs.select(*COLUMNS), items, keep=keep, with_text=True)
    return _resized(found.where(~F.col("over_limit")).withColumnRenamed("clean_text", "text"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixed corpus, as often as it takes them, with their place in it.

    Null sources form one source; documents without words cost nothing and ride along with their block; rows
    that repeat a doc_id are taken together.
    """
    return mixing.mix_sources(docs.select(*COLUMNS), keep=COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmarks", benchmarks),
    ("mixture", mixture),
]

#: The trained classifier, MinHash and the random order of the mixture have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
