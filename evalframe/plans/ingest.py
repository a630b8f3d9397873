"""Queries over logs and manifests that are first written as JSON lines, and over a streamed log."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import graph
from evalframe.plans.base import query
from evalframe.sources import adapters, logs
from evalframe.streaming import runlog

_ROW = "seq long, uid string, pred string"


def _torn(t):
    """The log as JSON lines, every 50th cut off, in a folder of its own."""
    path = logs.scratch(t.spark, "log")
    line = F.to_json(F.struct("seq", "uid", "pred"))
    t.log.select(F.when(F.col("seq") % 50 == 7, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return path


@query("s01_tolerant_scan", "SELECT seq, uid, pred FROM log WHERE seq % 50 <> 7")
def _(t):
    return logs.read_log(t.spark, _torn(t), _ROW).select("seq", "uid", "pred")


@query("s02_malformed_count", "SELECT count(*) FILTER (WHERE seq % 50 <> 7) AS n_rows, count(*) FILTER (WHERE seq % 50 = 7) AS n_bad FROM log")
def _(t):
    return logs.count_bad_lines(t.spark, _torn(t)).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"))


@query("s03_strict_manifest", "SELECT uid, size FROM examples")
def _(t):
    path = logs.scratch(t.spark, "manifest")
    t.examples.select("uid", "size").write.json(path)
    return logs.read_manifest(t.spark, path, "uid string, size long")


@query("s01_missing_file", "SELECT seq, uid, pred FROM log WHERE seq % 50 <> 7")
def _(t):
    """A log that is there and one that is not: the second adds nothing."""
    absent = logs.read_log(t.spark, logs.scratch(t.spark, "absent"), _ROW)
    return logs.read_log(t.spark, _torn(t), _ROW).unionByName(absent).select("seq", "uid", "pred")


@query("s06_infographic", "SELECT 'infographic:' || p_partkey::VARCHAR AS uid, p_name AS question, p_type || '|' || p_brand AS golds FROM part")
def _(t):
    m = t.part.select(F.col("p_partkey").alias("questionId"), F.col("p_name").alias("question"), F.array("p_type", "p_brand").alias("answers"))
    return adapters.load("infographic", m).select("uid", "question", F.array_join("gold_text", "|").alias("golds"))


@query("s07_charts_unpivot", """SELECT 'charts:' || lpad(p_partkey::VARCHAR, 5, '0') || ':' || tag AS uid, gold FROM (
  SELECT p_partkey, unnest(['d0', 'd1', 'd2', 'd3', 'r']) AS tag, unnest([p_brand, p_type, p_name, CAST(p_size AS VARCHAR), p_name || '?']) AS gold FROM part)""")
def _(t):
    d = lambda q, a: F.struct(F.lit(q).alias("qid"), F.col(a).cast("string").alias("a"))
    m = t.part.select(
        F.col("p_partkey").alias("original_id"), F.array(d(1, "p_brand"), d(5, "p_type"), d(9, "p_name"), d(12, "p_size")).alias("descriptive"),
        F.lit("why").alias("reasoning_q"), F.concat("p_name", F.lit("?")).alias("reasoning_a"),
    )
    return adapters.load("charts", m).select("uid", F.get("gold_text", F.lit(0)).alias("gold"))


@query("s09_screens_pixels", """SELECT 'screens_pixels:' || uid::VARCHAR AS uid, round(least(x0 * 2000 / 1500, 1), 9) AS x0, x0 * 2000 / 1500 > 1 OR x1 * 2000 / 1500 > 1 OR y0 * 2000 / 1500 > 1 OR y1 * 2000 / 1500 > 1 AS clamped FROM boxes""")
def _(t):
    m = t.boxes.select(F.col("uid").alias("id"), F.lit("click").alias("instruction"), F.transform(F.array("x0", "y0", "x1", "y1"), lambda v: v * 2000).alias("bbox"), F.array(F.lit(1500), F.lit(1500)).alias("img_size"))
    e = adapters.load("screens_pixels", m)
    return e.select("uid", F.round("gold_box.x0", 9).alias("x0"), (F.col("meta")["clamped"] == "true").alias("clamped"))


@query("s11_diagrams", "SELECT 'diagrams:' || p_partkey::VARCHAR AS uid, substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1) AS gold, p_partkey % 3 = 0 AS structural FROM part WHERE p_partkey % 5 <> 0")
def _(t):
    short = F.array(*(F.lit(c) for c in "abcd"))
    opts = F.when(F.col("p_partkey") % 5 == 0, F.array("p_name")).when(F.col("p_partkey") % 3 == 0, short).otherwise(F.array("p_name", "p_type", "p_brand", "p_name"))
    m = t.part.select(F.col("p_partkey").alias("id"), F.lit("which").alias("question"), opts.alias("options"), (F.col("p_partkey") % 4).alias("answer"))
    e = adapters.load("diagrams", m)
    return e.select("uid", F.get("gold_text", F.lit(0)).alias("gold"), (F.col("meta")["structural"] == "true").alias("structural"))


@query("s12_slides", "SELECT 'slides:' || p_partkey::VARCHAR AS uid, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END::VARCHAR AS n_pages, p_name || '|' || (CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END) AS images FROM part")
def _(t):
    pages = F.array(F.col("p_name"), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")), F.col("p_type"))
    m = t.part.select(F.col("p_partkey").alias("qa_id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), pages.alias("pages"), F.array(F.lit(2), F.lit(1)).alias("evidence_pages"))
    return adapters.load("slides", m).select("uid", F.col("meta")["n_pages"].alias("n_pages"), F.col("meta")["images"].alias("images"))


@query("s13_localization", "SELECT 'localization:' || uid::VARCHAR AS uid, CASE WHEN scene % 3 = 0 THEN 'span' ELSE 'point' END AS answer_type, CASE WHEN scene % 3 <> 0 THEN round(x0, 9) END AS x0 FROM boxes")
def _(t):
    m = t.boxes.select(F.col("uid").cast("string").alias("uid"), F.when(F.col("scene") % 3 == 0, "relation").otherwise("point").alias("qtype"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.array("x0", "y0", "x1", "y1").alias("gold_bbox_norm"))
    return adapters.load("localization", m).select("uid", "answer_type", F.round("gold_box.x0", 9).alias("x0"))


@query("s14_counting", "SELECT 'counting:' || o_orderkey::VARCHAR AS uid, (o_orderkey % 13)::VARCHAR AS gold, CASE WHEN o_orderkey % 2 = 0 THEN 'connections' ELSE 'other' END AS family FROM orders")
def _(t):
    q = F.when(F.col("o_orderkey") % 2 == 0, "How many Arrows?").otherwise("How many?")
    m = t.orders.select(F.col("o_orderkey").cast("string").alias("uid"), q.alias("question"), (F.col("o_orderkey") % 13).alias("true_count"))
    return adapters.load("counting", m).select("uid", F.get("gold_text", F.lit(0)).alias("gold"), F.col("meta")["family"].alias("family"))


@query("s14_word_choices", "SELECT 'svg_word_mc:' || p_partkey::VARCHAR AS uid, substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1) AS gold, length(p_name) AS answer_len FROM part")
def _(t):
    m = t.part.select(
        F.col("p_partkey").cast("string").alias("uid"), F.lit("Which word is on it?").alias("question"), F.array("p_name", "p_type").alias("options"),
        F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("answer"), F.col("p_name").alias("answer_text"), F.array("p_type").alias("distractors"),
    )
    return adapters.load("svg_word_mc", m).select("uid", F.get("gold_text", F.lit(0)).alias("gold"), F.col("meta")["answer_len"].cast("long").alias("answer_len"))


@query("s15_run_names", """SELECT 'set' || (r_regionkey)::VARCHAR AS dataset, 'model-' || r_regionkey::VARCHAR AS model, CAST(r_regionkey * 1000 AS INT) AS budget, 'plain' AS condition, CAST(1 AS INT) AS run FROM region""")
def _(t):
    k = F.col("r_regionkey").cast("string")
    name = F.concat(F.lit("set"), k, F.lit("__model-"), k, F.lit("_think"), (F.col("r_regionkey") * 1000).cast("string"), F.lit("_plain_r1.jsonl"))
    return t.region.select(name.alias("f")).select(*logs.run_parts(F.col("f")))



@query("x01_streamed_log", "SELECT uid, seq, pred FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY (pred IS NOT NULL) DESC, seq DESC) AS r FROM log) WHERE r = 1")
def _(t):
    source, table, mark = (logs.scratch(t.spark, k) for k in ("waves", "table", "mark"))
    rows = t.log.select("seq", "uid", "model", "pred", F.when(F.col("failed"), "error").alias("error"), "cost")
    rows.repartitionByRange("seq").write.json(source)
    runlog.append_log(runlog.read_waves(t.spark, source, per_trigger=2), table, mark).awaitTermination()
    return runlog.latest_table(t.spark, table, F.col("pred").isNotNull()).select("uid", "seq", "pred")


_FLOW = "'flowchart LR' || chr(10) || 'a[\"' || p_name || '\"] --> b(\"' || p_brand || '\")' || chr(10) || 'b ==> c{\"' || p_type || '\"}' || chr(10) || 'c -.-> a'"


@query("f23_flowchart_edges", "SELECT p_partkey AS gid, unnest(['a', 'b', 'c']) AS src, unnest(['b', 'c', 'a']) AS dst, unnest(['solid', 'thick', 'dotted']) AS style FROM part")
def _(t):
    _, edges = graph.parse_flowcharts(t.part.select("p_partkey", F.expr(_FLOW.replace("chr(10)", "char(10)")).alias("s")), "p_partkey", "s")
    return edges.select("gid", "src", "dst", "style")


@query("f23_flowchart_nodes", "SELECT p_partkey AS gid, unnest(['a', 'b', 'c']) AS id, unnest([p_name, p_brand, p_type]) AS label FROM part")
def _(t):
    nodes, _ = graph.parse_flowcharts(t.part.select("p_partkey", F.expr(_FLOW.replace("chr(10)", "char(10)")).alias("s")), "p_partkey", "s")
    return nodes


@query("r05_graph_f1", "SELECT p_partkey AS gid, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS f1, p_size % 2 = 0 AS exact FROM part")
def _(t):
    a = t.part.select(F.col("p_partkey").alias("gid"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("items"))
    b = t.part.select(F.col("p_partkey").alias("gid"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("z"), F.lit("y"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("items"))
    return graph.graph_f1(a, b, "items").select("gid", F.round("f1", 9).alias("f1"), "exact")


_LONE = f"CASE WHEN p_size % 2 = 0 THEN {_FLOW.replace('chr(10)', 'char(10)')} || char(10) || 'd[\"apart\"]' ELSE {_FLOW.replace('chr(10)', 'char(10)')} END"


@query("s10_edge_questions", """WITH r AS (SELECT p_partkey AS k, p_size % 2 = 0 AS lone, p_size % 3 = 0 AS ghost FROM part)
SELECT 'flowlearn_sim:word:' || k || ':' || q.f AS uid, q.g AS gold, q.m AS false_mode FROM (SELECT k, unnest(list_filter([{'f': 'atob:yes', 'g': 'yes', 'm': NULL}, {'f': 'atob:no', 'g': 'no', 'm': CASE WHEN ghost THEN 'phantom_node' ELSE 'reversed_edge' END},
  {'f': 'between:yes', 'g': 'yes', 'm': NULL}, CASE WHEN lone THEN {'f': 'between:no', 'g': 'no', 'm': 'unconnected'} END, {'f': 'nodes', 'g': CASE WHEN lone THEN '4' ELSE '3' END, 'm': NULL}, {'f': 'arrows', 'g': '3', 'm': NULL}], lambda x: x IS NOT NULL)) AS q FROM r)""")
def _(t):
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    ghost = F.struct(F.when(F.col("p_size") % 3 == 0, "nowhere").otherwise(F.col("p_brand")).alias("a"), F.col("p_name").alias("b"))
    m = t.part.select(
        F.col("p_partkey").cast("string").alias("image"), F.lit("word").alias("variant"), F.expr(_LONE).alias("mermaid"),
        F.struct(pair("p_name", "p_brand").alias("yes"), ghost.alias("no")).alias("atob"),
        F.struct(pair("p_name", "p_type").alias("yes"), pair("p_type", "p_brand").alias("no")).alias("between"),
    )
    return adapters.load("flowlearn_sim", m).select("uid", F.get("gold_text", F.lit(0)).alias("gold"), F.col("meta")["false_mode"].alias("false_mode"))
