"""Language identification of web pages and of plain texts by Bayesian evidence fusion.

Evidence: the visible text's likelihood under byte-trigram models, the language that the markup
declares, and a prior for the host that is smoothed hierarchically: all pages, then the
address suffix, then the host. How far declarations can be trusted, and the priors, come from
grouped sums of the text posteriors over all pages; a page's own share is taken out of its host.

Trigram models are learnt from at most `sample_per_language` labelled documents per language,
whole texts, chosen by a hash of the key, of those that `usable` admits, so that accuracy can be
told on the others. With `markup` tags, entities, scripts and comments are taken off first; only
whole tags are, so a bare `<` costs no text. Without it the text is taken as it is and declares
nothing.

Edge cases: null and empty pages have no text evidence
and follow declaration and host; pages without a host share one; unknown declarations count as
none; without labelled documents the result has null languages; ties go to the first language
by name; repeated rows are judged alike; keys that repeat among the documents are one of the
sample; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.batches import map_texts
from evalframe.llm.common import join_small, materialize

_HIDDEN = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(rb"</?[a-zA-Z][^<>]*>|<[!?][^<>]*>|&#?[a-zA-Z0-9]+;")
_DECLARED = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
#: Bytes of text models: letters in lower case and non-ASCII bytes; the rest a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SIZE = 1 << 16


@dataclass(frozen=True)
class Settings:
    sample_per_language: int = 1500
    weight: float = 0.2  # of a trigram's log likelihood: trigrams overlap and depend on each other
    most_nats: float = 25.0  # that text alone may bring
    declared_prior: float = 20.0  # pages' worth of belief that declarations are mostly right
    suffix_prior: float = 50.0
    host_prior: float = 5.0


def trigrams(text: bytes) -> np.ndarray:
    a = np.frombuffer(b" " + b" ".join(text.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    return ((a[:-2] * 961 + a[1:-1] * 31 + a[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64) if len(a) > 2 else np.zeros(0, np.int64)


def visible(page: bytes) -> bytes:
    return _TAG.sub(b" ", _HIDDEN.sub(b" ", page))


def fit(
    docs: DataFrame, cfg: Settings = Settings(), key: str = "doc_id", text: str = "text", lang: str = "lang", usable: Column | None = None
) -> tuple[list[str], np.ndarray]:
    """Language names, sorted, and each one's log probabilities of hashed trigrams."""
    if usable is not None:
        docs = docs.where(usable)
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("_l"))
    names = sorted(r[0] for r in docs.where("_l is not null").select("_l").distinct().collect())
    if not names:
        return [], np.zeros((0, _SIZE))
    keys = docs.where("t is not null and _l is not null").select("k", F.xxhash64("k").alias("u"), F.xxhash64("t").alias("v"), "_l").distinct()
    parts = [keys.where(F.col("_l") == n).orderBy("u", "k", "v").limit(cfg.sample_per_language) for n in names]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    # At most sample_per_language rows a language: bounded by the parameter.
    texts = docs.select("k", F.col("t").cast("binary").alias("_t"), F.xxhash64("t").alias("v"))
    # A row repeated is one of the sample: hashed texts tell.
    rows = texts.join(F.broadcast(chosen.drop("u")), ["k", "v"]).dropDuplicates(["k", "v", "_l"])

    def count(batches):
        sums = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[name] = sums.get(name, 0) + np.bincount(trigrams(t), minlength=_SIZE)
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(c[at].astype(np.int64))], names=["l", "g", "c"])

    table = np.full((len(names), _SIZE), 0.5)
    counted = rows.select("_l", "_t").mapInArrow(count, "l string, g bigint, c bigint").groupBy("l", "g").agg(F.sum("c").alias("c"))
    for r in counted.collect():  # at most 65,536 a language
        table[names.index(r.l), r.g] += r.c
    return names, np.log(table / table.sum(1, keepdims=True))


def identify(
    pages: DataFrame, model: tuple[list[str], np.ndarray], cfg: Settings = Settings(), key: str = "page_id", url: str = "url",
    html: str = "html", markup: bool = True,
) -> DataFrame:
    """key, lang, confidence, text_lang, declared, suffix, host, ll, posterior (by language, in name order); model is that of fit."""
    names, table = model
    k = len(names)
    held = pages.sparkSession.sparkContext.broadcast(table)

    def factory():
        table = held.value

        def fn(texts):
            logs, declared = [], []
            for t in texts:
                grams = trigrams(visible(t) if markup else t) if t else np.zeros(0, np.int64)
                ll = cfg.weight * table[:, grams].sum(1) if k else np.zeros(0)
                logs.append((np.maximum(ll - ll.max(), -cfg.most_nats) if k else ll).tolist())
                m = _DECLARED.search(t) if t and markup else None
                d = m.group(1).lower().decode() if m else None
                declared.append(d if d in names else None)
            return [pa.array(logs, pa.list_(pa.float64())), pa.array(declared, pa.string())]

        return fn

    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(F.col(key).alias("_key"), host.alias("host"), F.col(html).alias("_html"))
    rows = map_texts(rows, factory, "ll array<double>, declared string", ["_key", "host"], "_html")
    rows = rows.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1)).withColumn("declared", F.coalesce("declared", F.lit("")))
    rows = materialize(rows.withColumn("p", _normal(F.transform("ll", F.exp))), "pages")
    if not names:
        empty = F.lit(None).cast("string")
        return rows.select(F.col("_key").alias(key), empty.alias("lang"), F.lit(None).cast("double").alias("confidence"), empty.alias("text_lang"),
                           F.nullif("declared", F.lit("")).alias("declared"), "suffix", "host", "ll", F.array().cast("array<double>").alias("posterior"))

    sums = F.array(*(F.sum(F.get("p", F.lit(i))) for i in range(k)))
    hosts = materialize(rows.groupBy("host", "suffix").agg(sums.alias("hs"), F.count(F.lit(1)).alias("hn")), "hosts")
    up = F.array(*(F.sum(F.get("hs", F.lit(i))) for i in range(k)))
    suffixes = hosts.groupBy("suffix").agg(up.alias("ss"), F.sum("hn").alias("sn"))
    total = hosts.agg(up.alias("gs"), F.sum("hn").alias("gn")).first()
    prior = [((total.gs[i] or 0) + 1) / ((total.gn or 0) + k) for i in range(k)] if total.gn else [1 / k] * k
    base = F.array(*map(F.lit, prior))
    smooth = lambda s, n, q, w: F.zip_with(s, q, lambda a, b: (a + w * b) / (n + w))
    known = hosts.join(suffixes, "suffix").select("host", "hs", "hn", smooth(F.col("ss"), F.col("sn"), base, cfg.suffix_prior).alias("sp"))

    trust = rows.groupBy("declared").agg(sums.alias("ds")).collect()  # one row per language and one for none
    seen = {r.declared: r.ds for r in trust}
    at = ["", *names]
    size = [sum(seen.get(d, [0] * k)[i] for d in at) for i in range(k)]
    like = {}
    for d in at:
        guess = [0.1 if d == "" else 0.8 if d == n else 0.1 / max(1, k - 1) for n in names]
        like[d] = [(seen.get(d, [0] * k)[i] + cfg.declared_prior * guess[i]) / (size[i] + cfg.declared_prior) for i in range(k)]
    said = F.create_map(*(x for d in at for x in (F.lit(d), F.array(*map(F.lit, like[d])))))

    joined = join_small(rows, known, ["host"], known.count())
    own = F.zip_with("hs", "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))
    joined = joined.withColumn("hp", smooth(own, F.col("hn") - 1, F.col("sp"), cfg.host_prior))
    joined = joined.withColumn("dl", F.element_at(said, F.col("declared")))
    log = F.zip_with(F.zip_with("ll", "hp", lambda a, b: a + F.log(b)), "dl", lambda a, b: a + F.log(b))
    joined = joined.withColumn("log", log)
    joined = joined.withColumn("posterior", _normal(F.transform("log", lambda x: F.exp(x - F.array_max("log")))))
    label = F.array(*map(F.lit, names))
    best = lambda a: F.get(label, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return joined.select(
        F.col("_key").alias(key), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"),
        F.when(F.array_max("p") > F.array_min("p"), best(F.col("p"))).alias("text_lang"),
        F.nullif("declared", F.lit("")).alias("declared"), "suffix", "host", "ll", "posterior",
    )


def _normal(a):
    total = F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return F.transform(a, lambda x: x / total)
