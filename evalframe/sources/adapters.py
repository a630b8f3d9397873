"""Manifests of several benchmarks to one table of examples: uid, dataset, question, answer_type, gold_text, gold_box, meta.

Each adapter is a projection (one row may give several examples); `load` picks one by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions import geometry as geo
from evalframe.operators import graph
from evalframe.storage import stored

_ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def adapter(name: str):
    def register(f: Callable[[DataFrame], DataFrame]):
        _ADAPTERS[name] = f
        return f

    return register


def load(name: str, manifest: DataFrame) -> DataFrame:
    if name not in _ADAPTERS:
        raise KeyError(f"no adapter {name}; there are {', '.join(sorted(_ADAPTERS))}")
    return _ADAPTERS[name](manifest)


def names() -> list[str]:
    return sorted(_ADAPTERS)


def _example(df: DataFrame, dataset: str, uid: Column, question: Column, kind: Column, text: Column | None = None, box: Column | None = None, **meta: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{dataset}:"), uid).alias("uid"), F.lit(dataset).alias("dataset"), question.alias("question"), kind.alias("answer_type"),
        (F.lit(None).cast("array<string>") if text is None else text).alias("gold_text"),
        (F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>") if box is None else box).alias("gold_box"),
        F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v.cast("string")))).alias("meta") if meta else F.create_map().cast("map<string,string>").alias("meta"),
    )


def _box(a: Column) -> Column:
    return geo.box(*(F.get(a, F.lit(i)).cast("double") for i in range(4)))


@adapter("infographic")
def infographic(m: DataFrame) -> DataFrame:
    """questionId, question, answers: one example a row."""
    return _example(m, "infographic", F.col("questionId").cast("string"), F.col("question"), F.lit("span"), F.col("answers"))


@adapter("charts")
def charts(m: DataFrame) -> DataFrame:
    """original_id, descriptive (array of qid and answer), reasoning_q, reasoning_a: all descriptive ones and the reasoning one."""
    one = lambda tag, qid, q, a: F.struct(tag.alias("tag"), qid.alias("qid"), q.alias("q"), a.alias("a"))
    described = F.transform(
        "descriptive", lambda d, i: one(F.concat(F.lit("d"), i.cast("string")), d["qid"].cast("int"), F.concat(F.lit("template "), d["qid"].cast("string")), d["a"])
    )
    reason = F.array(one(F.lit("r"), F.lit(0), F.col("reasoning_q"), F.col("reasoning_a")))
    rows = m.select("original_id", F.inline(F.concat(described, reason)))
    uid = F.concat(F.lpad(F.col("original_id").cast("string"), 5, "0"), F.lit(":"), "tag")
    return _example(rows, "charts", uid, F.col("q"), F.lit("span"), F.array("a"), qid=F.col("qid"))


@adapter("screens")
def screens(m: DataFrame) -> DataFrame:
    """file_name, instruction, bbox in unit coordinates."""
    return _example(m, "screens", F.col("file_name"), F.col("instruction"), F.lit("point"), box=_box(F.col("bbox")))


@adapter("screens_pixels")
def screens_pixels(m: DataFrame) -> DataFrame:
    """id, instruction, bbox in pixels, img_size: normalised and clamped."""
    n = geo.normalized_box(_box(F.col("bbox")), F.get("img_size", F.lit(0)), F.get("img_size", F.lit(1)))
    return _example(m, "screens_pixels", F.col("id").cast("string"), F.col("instruction"), F.lit("point"), box=n["box"], clamped=n["clamped"])


@adapter("diagrams")
def diagrams(m: DataFrame) -> DataFrame:
    """question, options, answer (index): rows with four options; the answer as its letter; short options are structural."""
    rows = m.where(F.size("options") == 4)
    letter = F.substring(F.lit("ABCD"), F.col("answer").cast("int") + 1, F.lit(1))
    short = F.forall("options", lambda o: F.length(F.trim(o)) <= 2)
    return _example(rows, "diagrams", F.col("id").cast("string"), F.col("question"), F.lit("choice"), F.array(letter), structural=short)


@adapter("slides")
def slides(m: DataFrame) -> DataFrame:
    """qa_id, question, answer, pages (with gaps), evidence_pages: the evidence pages in page order."""
    pages = F.filter("pages", lambda p: p.isNotNull())
    shown = F.transform(F.sort_array("evidence_pages"), lambda e: F.get(pages, e.cast("int") - 1))
    return _example(m, "slides", F.col("qa_id").cast("string"), F.col("question"), F.lit("span"), F.array("answer"), images=F.array_join(shown, "|"), n_pages=F.size(pages))


@adapter("localization")
def localization(m: DataFrame) -> DataFrame:
    """uid, qtype, question, answer, gold_bbox_norm: points have boxes, other questions texts."""
    point = F.col("qtype") == "point"
    kind = F.when(point, "point").otherwise("span")
    return _example(m, "localization", F.col("uid"), F.col("question"), kind, F.when(~point, F.array("answer")), F.when(point, _box(F.col("gold_bbox_norm"))), qtype=F.col("qtype"))


@adapter("counting")
def counting(m: DataFrame) -> DataFrame:
    """uid, question, true_count."""
    q = F.lower("question")
    family = F.when(q.contains("arrows"), "connections").when(q.contains("bars"), "bars").otherwise("other")
    return _example(m, "counting", F.col("uid"), F.col("question"), F.lit("count"), F.array(F.col("true_count").cast("string")), family=family)


@adapter("svg_word_mc")
def word_choices(m: DataFrame) -> DataFrame:
    """uid, question, options, answer (letter), answer_text, distractors."""
    return _example(
        m, "svg_word_mc", F.col("uid"), F.col("question"), F.lit("choice"), F.array(F.col("answer").cast("string")),
        options=F.array_join("options", "|"), answer_text=F.col("answer_text"), distractors=F.array_join(F.coalesce("distractors", F.array()), "|"),
        answer_len=F.length(F.coalesce("answer_text", F.lit(""))),
    )


@adapter("flowlearn_sim")
def flowcharts(m: DataFrame, seed: int = 0) -> DataFrame:
    """image, variant, mermaid, and atob and between, each with a pair (a, b) of labels under yes and no: up to six rows a chart.

    Two families of edge questions, with and without direction, each with either polarity, and the
    counts of nodes and arrows. Golds are read off the parsed chart, not the polarity. A pair that is
    meant to be unconnected but isn't is replaced by one that is (graph.unconnected_pair); a chart
    without such a pair has no such row, and one without nodes has none at all.
    """
    nodes, edges = graph.parse_flowcharts(m, "image", "mermaid")
    nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    counts = nodes.groupBy("gid").agg(F.count(F.lit(1)).alias("n_nodes")).join(edges.groupBy("gid").agg(F.count(F.lit(1)).alias("n_arrows")), "gid", "left")
    charts_ = m.select(F.col("image").alias("gid"), "variant", "atob", "between").join(counts.fillna(0), "gid")

    one = lambda family, polarity: F.struct(F.lit(family).alias("family"), F.lit(polarity).alias("polarity"), F.col(f"{family}.{polarity}").alias("p"))
    asked = F.inline(F.array(*(one(f, p) for f in ("atob", "between") for p in ("yes", "no"))))
    pairs = charts_.select("gid", "variant", asked).select("gid", "variant", "family", "polarity", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    pairs = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    linked = graph.has_edge(pairs, nodes, edges, directed=False).withColumnRenamed("has_edge", "joined")
    free = graph.unconnected_pair(nodes, edges, seed).select("gid", F.col("a").alias("_fa"), F.col("b").alias("_fb"))
    wrong = (F.col("family") == "between") & (F.col("polarity") == "no") & F.coalesce(F.col("joined"), F.lit(True))
    rows = linked.withColumn("_wrong", wrong).join(free, "gid", "left")
    rows = rows.select("gid", "variant", "family", "polarity", *(F.when(F.col("_wrong"), F.col(f"_f{c}")).otherwise(F.col(c)).alias(c) for c in "ab"))
    rows = rows.where("a IS NOT NULL AND b IS NOT NULL")

    there = graph.has_edge(rows, nodes, edges).withColumnRenamed("has_edge", "_forth")
    there = graph.has_edge(there, nodes, edges, directed=False).withColumnRenamed("has_edge", "_any")
    turned = lambda df: df.select(*({"a": F.col("b").alias("a"), "b": F.col("a").alias("b")}.get(c, F.col(c)) for c in df.columns))
    back = turned(graph.has_edge(turned(there), nodes, edges).withColumnRenamed("has_edge", "_back"))
    back = graph.edge_style(back, nodes, edges)
    derived = F.when(F.col("family") == "atob", F.col("_forth")).otherwise(F.col("_any"))
    gold = F.when(F.coalesce(derived, F.lit(False)), "yes").otherwise("no")
    why = F.when(derived.isNull(), "phantom_node").when(F.col("_back"), "reversed_edge").otherwise("unconnected")
    ask = F.when(
        F.col("family") == "atob", F.concat(F.lit('Is there an arrow from "'), "a", F.lit('" to "'), "b", F.lit('"? An arrow the other way round does not count.'))
    ).otherwise(F.concat(F.lit('Does an arrow join "'), "a", F.lit('" and "'), "b", F.lit('", in whichever direction?')))
    uid = F.concat_ws(":", "variant", "gid", "family", "polarity")
    edge_rows = _example(
        back, "flowlearn_sim", uid, ask, F.lit("boolean"), F.array(gold), family=F.col("family"), polarity=F.col("polarity"),
        false_mode=F.when(F.col("polarity") == "no", why), edge_style=F.col("style"), disagrees=(gold != F.col("polarity")),
    )
    kinds = F.array(
        F.struct(F.lit("nodes").alias("family"), F.lit("How many boxes does the chart have?").alias("q"), F.col("n_nodes").alias("n")),
        F.struct(F.lit("arrows").alias("family"), F.lit("How many arrows does the chart have?").alias("q"), F.col("n_arrows").alias("n")),
    )
    count_rows = charts_.select("gid", "variant", F.inline(kinds))
    uid = F.concat_ws(":", "variant", "gid", "family")
    return edge_rows.unionByName(_example(
        count_rows, "flowlearn_sim", uid, F.col("q"), F.lit("count"), F.array(F.col("n").cast("string")), family=F.col("family"), true_count=F.col("n")
    ))
