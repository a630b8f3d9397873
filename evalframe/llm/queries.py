"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import decontaminate as dc
from evalframe.llm import language_id as li
from evalframe.llm import lexical_search as ls
from evalframe.llm import license_scan as lc
from evalframe.llm import line_dedup as ld
from evalframe.llm import mixing as mx
from evalframe.llm import ngram_jaccard as nj
from evalframe.llm import oracles
from evalframe.llm import quality_model as qm
from evalframe.llm import quality_rules as qr
from evalframe.llm import substring_dedup as sd
from evalframe.llm import toxicity as tx
from evalframe.llm import warc
from evalframe.llm import whitening as wh
from evalframe.llm.common import discard


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qr.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nj.near_duplicates(_table(spark, sf_dir, "documents"), nj.Settings(n=4, threshold_pct=85))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = [("n_words", "bigint", pa.int64()), ("n_removed", "bigint", pa.int64()), ("kept_sha256", "string", pa.string())]

    def digest(words, left):
        return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()

    return sd.remove_spans(sd.join_spans(docs, sd.find_repeats(docs)), fields, digest, keep=["doc_id"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = dc.find_contamination(docs, items, keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mx.mix_sources(docs, keep=["doc_id", "source"]).select("doc_id", "source", "n_tokens", "epoch", "block", "place")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = qm.score_quality(docs, labels, usable=_fold(5) != 0, keep=["doc_id"])
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by page_id, and documents by doc_id: plain texts without markup, whose source stands for the host.

    The model does not see the documents that held_out marks.
    """
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = li.fit(docs, usable=_fold(5) != 0)
    found = li.identify(pages, model).withColumn("doc_id", F.lit(None).cast("long")).withColumn("held_out", F.lit(None).cast("boolean"))
    plain = docs.select("doc_id", F.concat(F.lit("source://"), "source").alias("url"), "text")
    told = li.identify(plain, model, key="doc_id", html="text", markup=False)
    told = told.withColumn("page_id", F.lit(None).cast("long")).withColumn("held_out", _fold(5) == 0)
    columns = ["doc_id", "page_id", "held_out", "lang", "confidence", "text_lang", "declared", "suffix", "host"]
    return found.unionByName(told).select(*columns)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(_table(spark, sf_dir, "pages"))
    records = warc.read_records(spark, path, with_payload=False)
    captures = warc.with_referred(warc.assemble(records))
    discard(records)
    size, digest = warc.payload_facts(captures)
    records = F.lit(1) + F.col("request").isNotNull().cast("int") + F.col("metadata").isNotNull().cast("int")
    return captures.select(
        "page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("response.kind").alias("record_type"),
        "refers_to", records.alias("n_records"), F.col("request.fields")["method"].alias("request_method"), F.col("request.fields")["path"].alias("request_path"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = ld.dedup_lines(_table(spark, sf_dir, "documents"), n_removed="n_removed")
    return cleaned.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = tx.score_toxicity(docs, labels, train=_fold(3) != 1, keep=["doc_id"])
    return scored.select(
        "doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted",
        F.size("sentences").alias("n_sentences"), F.get(F.col("sentences"), F.lit(0))["n"].alias("first_sentence"),
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lc.scan_licenses(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    best = F.array_max(F.transform("places", lambda p: p["coverage"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ls.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fit = wh.fit_whitening(_table(spark, sf_dir, "embeddings"))
    if fit is None:
        none = "cast(null as int) component", "0L n", "0L deviation", "0D whitened", "0D explained", "0D identity_error"
        return rows.where("false").selectExpr("vec_id", *none)
    told = wh.whiten(rows, fit, keep=["vec_id"])
    error, shares = wh.identity_error(told, fit.n), F.array(*map(F.lit, fit.explained()))
    flat = told.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return flat.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_quality_model": op3_quality_model,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_license_scan": op11_license_scan,
    "op12_lexical_search": op12_lexical_search,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.quality_rules(),
    "op2_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op5_decontaminate": oracles.DECONTAMINATE,
    "op7_warc": oracles.WARC,
    "op11_license_scan": oracles.license_scan(),
    "op12_lexical_search": oracles.LEXICAL_SEARCH,
}
