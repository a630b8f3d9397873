"""Generated questions and records, display helpers and what is left of the small projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import answers as an
from evalframe.functions import stats
from evalframe.functions import text as tx
from evalframe.operators import generation as gen
from evalframe.operators import graph, joins, windows
from evalframe.plans.base import query
from evalframe.sources import logs


@query("g14_largest_canvas", """SELECT p_partkey, CASE WHEN e <= p AND w >= 950 THEN 1568 ELSE CAST(floor(w * least(e, p)) AS INT) END AS cw, CASE WHEN e <= p AND w < 950 THEN 1568 ELSE CAST(floor(950 * least(e, p)) AS INT) END AS ch
FROM (SELECT p_partkey, w, 1568.0::DOUBLE / greatest(w, 950) AS e, sqrt(1150000.0::DOUBLE / (w * 950)) AS p FROM (SELECT p_partkey, round_even(950 * (0.3::DOUBLE + p_size / 10), 0) AS w FROM part))""")
def _(t):
    c = gen.largest_canvas(F.lit(0.3) + F.col("p_size") / 10)
    return t.part.select("p_partkey", c["w"].alias("cw"), c["h"].alias("ch"))


@query("q04_ladder", """SELECT CAST(s AS BIGINT) AS scene, aspect, rung, CAST(floor(w * scale) AS INT) AS w, CAST(floor(h * scale) AS INT) AS h
FROM range(30) AS g(s), (VALUES ('wide', 1568, 671), ('page', 1347, 853)) AS a(aspect, w, h), (VALUES ('small', 0.5), ('large', 1.0)) AS r(rung, scale)""")
def _(t):
    return gen.ladder(t.spark, {"wide": 7 / 3, "page": 1500 / 950}, {"small": 0.5, "large": 1.0}, 30)


@query("f25_label_words", r"SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(p_name || ' ' || p_type, '\b([A-Za-z][A-Za-z-]{3,})\b'))), ' ') AS words FROM part")
def _(t):
    w = gen.words_of(F.concat_ws(" ", "p_name", "p_type"))
    return t.part.select("p_partkey", F.array_join(F.array_sort(w), " ").alias("words"))


@query("q03_word_choices")
def _(t):
    scenes = t.part.select(F.col("p_partkey").alias("scene"), F.array("p_name", "p_type").alias("labels"))
    return gen.word_choice(scenes, ["harbor", "velocity", "granite", "ring", "lantern", "orchard"], 17)


@query("q01_relation_questions", """SELECT uid, 'Which label is right of ' || uid::VARCHAR || '?' AS question, neighbour::VARCHAR AS gold FROM (
  SELECT a.uid, b.uid AS neighbour, row_number() OVER (PARTITION BY a.uid ORDER BY (b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2, b.uid) AS r
  FROM boxes a JOIN boxes b ON a.scene = b.scene AND a.uid <> b.uid
  WHERE (b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2 > 0 AND abs((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2) <= 0.03) WHERE r = 1""")
def _(t):
    n = joins.nearest_right(t.boxes, "scene", "uid", 0.03)
    u = F.col("uid").cast("string")
    return n.select("uid", F.concat(F.lit("Which label is right of "), u, F.lit("?")).alias("question"), F.col("neighbour").cast("string").alias("gold"))


@query("w13_spread_selection")
def _(t):
    s = t.scored.where("size IS NOT NULL").select("uid", "size", "dataset", "primitive", "family")
    return gen.pick_spread(gen.banded_quota(s, "size", 5, 40, "uid"), ["dataset", "primitive", "family"], "uid", 0)


@query("w14_band_quotas", """WITH b AS (SELECT CAST(floor((row_number() OVER (ORDER BY size, uid) * 5 - 1) / count(*) OVER ()) AS INT) AS bin FROM scored WHERE size IS NOT NULL),
n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin), e AS (SELECT *, n * 43.0 / sum(n) OVER () AS e FROM n), f AS (SELECT *, floor(e) AS f, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, bin) AS r FROM e)
SELECT bin, CAST(f + CASE WHEN r <= 43 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota, n FROM f""")
def _(t):
    s = t.scored.where("size IS NOT NULL")
    return gen.banded_quota(s, "size", 5, 43, "uid").groupBy("bin", "quota").agg(F.count(F.lit(1)).alias("n"))


@query("q05_training_records", """SELECT uid, '{"prompt":"' || primitive || '","completion":"' || gold_option || '","meta":{"family":' || family::VARCHAR || '}}' AS record FROM scored""")
def _(t):
    return gen.training_records(t.scored, F.col("primitive"), F.col("gold_option"), meta=F.struct("family"))




@query("f24_rubric_batches", "SELECT qid, (rn - 1) // 5 AS batch, string_agg('T' || pos::VARCHAR || ': ' || uid, chr(10) ORDER BY pos) AS prompt FROM (SELECT qid, uid, rn, (rn - 1) % 5 + 1 AS pos FROM (SELECT qid, uid, row_number() OVER (PARTITION BY qid ORDER BY uid) AS rn FROM examples)) GROUP BY 1, 2")
def _(t):
    from pyspark.sql import Window as W

    b = joins.batches(t.examples, "qid", "uid", 5)
    pos = F.row_number().over(W.partitionBy("qid", "batch").orderBy("uid"))
    b = b.withColumn("p", pos)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("p", "uid"))), lambda s: F.concat(F.lit("T"), s["p"].cast("string"), F.lit(": "), s["uid"]))
    return b.groupBy("qid", "batch").agg(F.array_join(lines, "\n").alias("prompt"))


@query("f26_length_bins", "SELECT doc_id, CASE WHEN n_chars < 300 THEN 'brief' WHEN n_chars < 1500 THEN 'middle' ELSE 'lengthy' END AS bin, CASE WHEN lang IN ('de', 'fr') THEN 'long' ELSE 'short' END AS kind FROM documents")
def _(t):
    kind = F.when(F.col("lang").isin("de", "fr"), "long").otherwise("short")
    return t.documents.select("doc_id", an.bucket(F.col("n_chars"), [300, 1500], ["brief", "middle", "lengthy"]).alias("bin"), kind.alias("kind"))


@query("f27_percent_labels", "SELECT family, printf('%.1f%%', 100.0 * sum(CASE WHEN picked = gold_option THEN 1 ELSE 0 END) / count(*)) AS label FROM scored GROUP BY family")
def _(t):
    rate = 100.0 * F.count_if(F.col("picked") == F.col("gold_option")) / F.count(F.lit(1))
    return t.scored.groupBy("family").agg(F.format_string("%.1f%%", rate).alias("label"))


@query("f43_panel_bins", "SELECT uid, CASE WHEN n_true <= 1 THEN '1' WHEN n_true < 5 THEN '2-4' WHEN n_true < 9 THEN '5-8' ELSE '9+' END AS panels FROM scored")
def _(t):
    return t.scored.select("uid", an.bucket(F.col("n_true"), [2, 5, 9], ["1", "2-4", "5-8", "9+"]).alias("panels"))


@query("f44_family_map", "SELECT family, CASE WHEN family IN (0, 1) THEN 'title' WHEN family IN (2, 5) THEN 'axis' ELSE 'other' END AS fam, count(*) AS n FROM scored GROUP BY 1, 2")
def _(t):
    name = an.by_group(F.col("family"), {"title": (0, 1), "axis": (2, 5)}, "other")
    return t.scored.groupBy("family", name.alias("fam")).agg(F.count(F.lit(1)).alias("n"))


@query("f45_cell_names", "SELECT CASE WHEN n_true > 6 THEN 'multi' ELSE 'single' END || '_' || CASE WHEN family < 3 THEN 'arith' ELSE 'plain' END AS cell, count(*) AS n FROM scored GROUP BY 1")
def _(t):
    name = an.cell_name(F.col("n_true") > 6, F.col("family") < 3)
    return t.scored.groupBy(name.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("s04_paths", "SELECT uid, 'data/images/' || dataset || '/' || uid || '.png' AS path FROM examples")
def _(t):
    return t.examples.select("uid", F.concat_ws("/", F.lit("data/images"), "dataset", F.concat("uid", F.lit(".png"))).alias("path"))


@query("k03_summary_roundtrip", "SELECT dataset, count(*) AS n FROM scored GROUP BY dataset")
def _(t):
    path = logs.scratch(t.spark, "summary")
    logs.write_summary(t.scored.groupBy("dataset").agg(F.struct(F.count(F.lit(1)).alias("n")).alias("cell")), path)
    return t.spark.read.schema("dataset string, cell struct<n: long>").json(path).select("dataset", "cell.n")


@query("k08_minimum_rows", "SELECT dataset, count(*) AS n FROM scored GROUP BY dataset HAVING count(*) < 200")
def _(t):
    return t.scored.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).where("n < 200")


@query("u04_item_sets", "SELECT l_orderkey, list_has_all(list_distinct(list(l_linestatus)), ['F']) AS has_f, len(list_distinct(list(l_returnflag)))::INT AS n FROM lineitem GROUP BY l_orderkey")
def _(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linestatus").alias("s"), F.collect_set("l_returnflag").alias("r"))
    return g.select("l_orderkey", (F.size(F.array_except(F.array(F.lit("F")), "s")) == 0).alias("has_f"), F.size("r").alias("n"))


@query("a26_one_page_collapse", "SELECT family, count(*) AS n, round(avg(s.score) - avg(c.score), 9) AS collapse FROM scored s JOIN control c ON c.src_uid = s.uid WHERE s.score >= 0.5 GROUP BY family")
def _(t):
    j = joins.control_pairs(t.scored.where("score >= 0.5"), t.control).join(t.scored.select("uid", "family"), "uid")
    return j.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sighted") - F.avg("blind"), 9).alias("collapse"))


@query("w17_band_prompts", """WITH b AS (SELECT uid, CAST(floor((row_number() OVER (ORDER BY size, uid) * 4 - 1) / count(*) OVER ()) AS INT) AS bin FROM scored WHERE size IS NOT NULL)
SELECT bin, uid FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY sha1('11:' || uid::VARCHAR), uid) AS r FROM b) WHERE r <= 6""")
def _(t):
    b = windows.equal_count_bins(t.scored, "size", 4, "uid")
    return windows.stratified_sample(b, ["bin"], 6, "uid", 11).select("bin", "uid")


_W = "(({p} + 1.9208 / {n}) / (1 + 3.8416 / {n}) {s} 1.96 / (1 + 3.8416 / {n}) * sqrt({p} * (1 - {p}) / {n} + 0.9604 / {n} / {n}))"


@query("t02_wilson_of_scores", f"SELECT primitive, round(greatest({_W.format(p='a', n='n', s='-')}, 0), 9) AS lo, round(least({_W.format(p='a', n='n', s='+')}, 1), 9) AS hi FROM (SELECT primitive, avg(score) AS a, count(score) AS n FROM scored GROUP BY primitive)")
def _(t):
    g = t.scored.groupBy("primitive").agg(F.avg("score").alias("a"), F.count("score").alias("n"))
    ci = stats.wilson_of_mean(F.col("a"), F.col("n"))
    return g.select("primitive", F.round(ci["lo"], 9).alias("lo"), F.round(ci["hi"], 9).alias("hi"))


@query("t03_wilson_percent", f"SELECT verdict, round(100 * greatest({_W.format(p='(k / n)', n='n', s='-')}, 0), 9) AS lo, round(100 * least({_W.format(p='(k / n)', n='n', s='+')}, 1), 9) AS hi FROM (SELECT verdict, count(*) AS n, count(*) FILTER (WHERE equivalent) AS k FROM judged GROUP BY verdict)")
def _(t):
    g = t.judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if("equivalent").alias("k"))
    ci = stats.wilson_percent(F.col("k"), F.col("n"))
    return g.select("verdict", F.round(ci["lo"], 9).alias("lo"), F.round(ci["hi"], 9).alias("hi"))


@query("v03_readability", "SELECT doc_id FROM documents WHERE CASE WHEN n_chars % 40 >= 24 THEN 3.0 ELSE 4.5 END > (doc_id % 60) / 10")
def _(t):
    from evalframe.functions import geometry as geo

    need = geo.required_contrast(F.col("n_chars") % 40)
    return t.documents.where(need > (F.col("doc_id") % 60) / 10).select("doc_id")


@query("v05_box_checks", """SELECT uid, x0 >= 0 AND x0 < x1 AND x1 <= w AND y0 >= 0 AND y0 < y1 AND y1 <= h AND uid % 17 <> 0 AS in_bounds, x1 - x0 >= 2 AND y1 - y0 >= 2 AS non_degenerate,
  CASE WHEN uid % 17 = 0 THEN 2000 ELSE w END <= 1568 AND uid % 6 <> 0 AS undownscaled, uid % 10 <> 0 AS has_ink, uid % 10 <> 0 AND spill = 0 AS tight FROM manifest""")
def _(t):
    from evalframe.functions import geometry as geo
    from evalframe.operators import validation

    size = lambda w, h: F.struct(w.alias("w"), h.alias("h"))
    ink = F.when(F.col("uid") % 10 != 0, geo.box(F.col("x0") + F.col("spill"), *(F.col(c) for c in ("y0", "x1", "y1"))))
    m = t.manifest.withColumn("image", size(F.col("w"), F.col("h"))).withColumn("ink", ink).withColumn("shrunk", F.col("uid") % 6 == 0)
    return validation.box_checks(m.withColumn("file", size(F.when(F.col("uid") % 17 == 0, 2000).otherwise(F.col("w")), F.col("h"))))


@query("q02_scene_seeds", "SELECT CAST(s AS BIGINT) AS scene, CAST(17 * 100003 + s * 7919 AS BIGINT) AS seed FROM range(200) AS g(s)")
def _(t):
    return gen.scene_seeds(t.spark, 200, 17)


@query("r01_labels_to_ids", "SELECT n_name AS label, n_nationkey AS id FROM nation")
def _(t):
    nodes = t.nation.select(F.lit(0).alias("gid"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("id"))
    return graph.ids_of_labels(nodes).select("label", "id")
