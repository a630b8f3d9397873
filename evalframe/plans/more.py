"""Further projections, contrasts and audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalframe.functions import answers as an
from evalframe.functions import geometry as geo
from evalframe.functions import stats
from evalframe.operators import aggregates as ag
from evalframe.operators import dedup, joins, windows
from evalframe.plans.base import query
from evalframe.plans.selection import usable
from evalframe.sources import logs


def _r(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 9))
    return df


@query("p01_prompts", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || chr(10) || 'Answer yes or no.' WHEN 1 THEN lang || chr(10) || 'Answer with a whole number.' ELSE 'own' END AS prompt FROM documents")
def _(t):
    k = F.col("doc_id") % 3
    kind = F.when(k == 0, "boolean").when(k == 1, "count").otherwise("span")
    return t.documents.select("doc_id", an.prompt(F.col("lang"), kind, own=F.when(k == 2, "own")).alias("prompt"))


@query("p01_choice_prompts", "SELECT p_partkey, p_name || chr(10) || 'A) ' || p_brand || chr(10) || 'B) ' || p_type AS prompt FROM part")
def _(t):
    return t.part.select("p_partkey", an.prompt(F.col("p_name"), F.lit("choice"), F.array("p_brand", "p_type")).alias("prompt"))


@query("p02_parse_response", "SELECT event_id, round((user_id % 1000) / 1000, 9) AS x, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS n FROM events WHERE event_type <> 'view'")
def _(t):
    raw = F.when(F.col("event_type") == "error", '{"count": "x"').otherwise(F.concat(F.lit('{"count": '), F.col("user_id").cast("string"), F.lit("}")))
    point = F.concat(F.lit('{"x": '), (F.col("user_id") % 1000).cast("string"), F.lit(', "y": 5}'))
    e = t.events.where("event_type <> 'view'")
    return e.select("event_id", F.round(an.parse_response(point, F.lit("point"))["point"]["x"], 9).alias("x"), an.parse_response(raw, F.lit("count"))["count"].alias("n"))


@query("p03_taxonomy", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'cheap' WHEN p_brand = 'Brand#2' THEN 'second' END AS primitive FROM part")
def _(t):
    return t.part.select("p_partkey", an.first_known(F.array("p_type", "p_brand"), {"ECONOMY": "cheap", "Brand#2": "second"}).alias("primitive"))


@query("p05_confidence", "SELECT uid, CASE WHEN qid IN (1, 3) THEN 'fuzzy' ELSE 'strict' END AS confidence FROM examples")
def _(t):
    return t.examples.select("uid", an.by_group(F.col("qid"), {"fuzzy": (1, 3)}, "strict").alias("confidence"))



@query("p08_usable", "SELECT tag, count(*) FILTER (WHERE pred IS NOT NULL AND NOT failed) AS n_usable, count(*) AS n FROM log GROUP BY tag")
def _(t):
    return t.log.groupBy("tag").agg(F.count_if(usable()).alias("n_usable"), F.count(F.lit(1)).alias("n"))


@query("p09_restricted_pool", "SELECT primitive, count(*) FILTER (WHERE n_true BETWEEN 2 AND 9) AS kept, count(*) FILTER (WHERE n_true NOT BETWEEN 2 AND 9) AS excluded FROM scored GROUP BY primitive")
def _(t):
    ok = F.col("n_true").between(2, 9)
    return t.scored.groupBy("primitive").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("excluded"))


@query("p11_axis_containment", "SELECT uid, x BETWEEN x0 AND x1 AS x_inside, y BETWEEN y0 AND y1 AS y_inside FROM boxes")
def _(t):
    return t.boxes.select("uid", F.col("x").between(F.col("x0"), F.col("x1")).alias("x_inside"), F.col("y").between(F.col("y0"), F.col("y1")).alias("y_inside"))


@query("p12_hits", "SELECT uid, score >= 0.5 AS hit FROM scored WHERE score IS NOT NULL")
def _(t):
    return t.scored.where("score IS NOT NULL").select("uid", (F.col("score") >= 0.5).alias("hit"))


@query("s08_decimals_asked", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'Answer with a whole number.' WHEN user_id % 3 = 0 THEN 'Answer with one decimal place.' ELSE 'Answer with 2 decimal places.' END AS asked FROM events")
def _(t):
    a = F.when(F.col("user_id") % 2 == 0, "12").when(F.col("user_id") % 3 == 0, "1.5").otherwise("1.25")
    return t.events.select("event_id", an.decimals_asked(a).alias("asked"))


@query("s20_dataset_stats", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"))


@query("k02_todo_manifest", "SELECT dataset, uid FROM examples WHERE uid NOT IN (SELECT uid FROM log WHERE pred IS NOT NULL AND NOT failed)")
def _(t):
    left = joins.todo(t.examples, t.log, usable())
    path = logs.scratch(t.spark, "todo")
    left.select("dataset", "uid").write.json(path)
    return logs.read_manifest(t.spark, path, "dataset string, uid string")


@query("j08_suffix_pairing", r"SELECT a.src_uid AS id, a.score, s.score AS sighted FROM control a JOIN scored s ON s.uid = CAST(regexp_extract(a.uid, ':(\d+)$', 1) AS BIGINT)")
def _(t):
    c = t.control.withColumn("k", F.regexp_extract("uid", r":(\d+)$", 1).cast("long")).select("k", F.col("src_uid").alias("id"), "score")
    return c.join(t.scored.select(F.col("uid").alias("k"), F.col("score").alias("sighted")), "k").select("id", "score", "sighted")


@query("j15_same_figure", "SELECT a.l_orderkey AS figure, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 2 AND b.l_linenumber = 3 GROUP BY 1")
def _(t):
    one = lambda n: t.lineitem.where(F.col("l_linenumber") == n).groupBy(F.col("l_orderkey").alias("figure")).agg(F.count(F.lit(1)).alias(f"n{n}"))
    return one(2).join(one(3), "figure").select("figure", (F.col("n2") * F.col("n3")).alias("pairs"))


@query("j18_scene_targets", "SELECT o_orderkey, o_orderstatus, array_to_string(list_sort(list_distinct(list(l_returnflag))), '') AS targets FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def _(t):
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), "").alias("targets"))
    return t.orders.join(flags, "o_orderkey").select("o_orderkey", "o_orderstatus", "targets")


@query("j20_value_in_pool", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND abs(l_quantity - o_custkey % 50) <= 1e-9 * greatest(1, abs(l_quantity))) AS found FROM orders")
def _(t):
    pool = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_quantity").alias("pool"))
    p = F.col("o_custkey") % 50
    near = F.exists("pool", lambda x: F.abs(p - x) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(x)))
    return t.orders.join(pool, "o_orderkey", "left").select("o_orderkey", F.coalesce(near, F.lit(False)).alias("found"))


@query("a06_dataset_summary", """SELECT dataset, count(*) AS n, round(avg(score), 9) AS acc, round(avg(CASE WHEN equivalent THEN 1.0 ELSE score END), 9) AS acc_meaning,
 count(*) FILTER (WHERE score < 0.5) AS failures, count(*) FILTER (WHERE score < 0.5 AND failure_mode = 'unclassified') AS unclassified FROM scored LEFT JOIN judged USING (uid) WHERE score IS NOT NULL GROUP BY dataset""")
def _(t):
    j = t.scored.where("score IS NOT NULL").join(t.judged.select("uid", "equivalent"), "uid", "left")
    bad = F.col("score") < 0.5
    return _r(j.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("acc"), F.avg(F.when(F.col("equivalent"), 1.0).otherwise(F.col("score"))).alias("acc_meaning"),
        F.count_if(bad).alias("failures"), F.count_if(bad & (F.col("failure_mode") == "unclassified")).alias("unclassified"),
    ), "acc", "acc_meaning")


@query("a11_median_split", """WITH m AS (SELECT dataset, median(n_true) AS m, count(*) AS n, max(n_true) - min(n_true) AS span FROM scored WHERE score IS NOT NULL GROUP BY dataset)
SELECT dataset, count(*) FILTER (WHERE n_true <= m) AS n_low, count(*) FILTER (WHERE n_true > m) AS n_high, round(avg(score) FILTER (WHERE n_true <= m), 9) AS low, round(avg(score) FILTER (WHERE n_true > m), 9) AS high
FROM scored JOIN m USING (dataset) WHERE score IS NOT NULL AND n >= 20 AND span >= 4 GROUP BY dataset""")
def _(t):
    s = t.scored.where("score IS NOT NULL")
    m = s.groupBy("dataset").agg(F.median("n_true").alias("m"), F.count(F.lit(1)).alias("n"), (F.max("n_true") - F.min("n_true")).alias("span")).where("n >= 20 and span >= 4")
    low = F.col("n_true") <= F.col("m")
    out = s.join(m.select("dataset", "m"), "dataset").groupBy("dataset").agg(F.count_if(low).alias("n_low"), F.count_if(~low).alias("n_high"), F.avg(F.when(low, F.col("score"))).alias("low"), F.avg(F.when(~low, F.col("score"))).alias("high"))
    return _r(out.where("n_low >= 6 and n_high >= 6"), "low", "high")


@query("a13_error_histogram", "SELECT n_pred - n_true AS d, count(*) AS n FROM scored GROUP BY 1")
def _(t):
    return t.scored.groupBy((F.col("n_pred") - F.col("n_true")).alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("a15_polarity", "SELECT label % 2 = 0 AS dark, count(*) AS n, count(*) FILTER (WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS k, round(avg((x1 - x0) * (y1 - y0)), 9) AS area FROM boxes GROUP BY 1")
def _(t):
    hit = F.expr("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return _r(t.boxes.groupBy((F.col("label") % 2 == 0).alias("dark")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("k"), F.avg(geo.area(F.col("box"))).alias("area")), "area")


@query("a19_cross_cuts", "SELECT coalesce(dataset, '') AS dataset, coalesce(primitive, '') AS primitive, coalesce(CAST(family AS STRING), '') AS family, count(score) AS n, round(avg(score), 9) AS acc FROM scored GROUP BY GROUPING SETS ((dataset), (primitive), (family))")
def _(t):
    cuts = [("dataset", [1, 0, 0]), ("primitive", [0, 1, 0]), ("family", [0, 0, 1])]
    name = lambda c, on: F.coalesce(F.col(c).cast("string"), F.lit("")) if on else F.lit("")
    # One pass over the rows: each counts once for each cut.
    rows = F.array(*(F.struct(name("dataset", a).alias("dataset"), name("primitive", b).alias("primitive"), name("family", c).alias("family")) for _, (a, b, c) in cuts))
    return _r(t.scored.select("score", F.inline(rows)).groupBy("dataset", "primitive", "family").agg(F.count("score").alias("n"), F.avg("score").alias("acc")), "acc")



@query("a28_format_artifacts", "SELECT dataset, count(*) FILTER (WHERE score = 0) AS hard_zeros, count(*) FILTER (WHERE score < 1) AS non_exact, count(*) FILTER (WHERE score < 1 AND equivalent) AS equivalent FROM scored JOIN judged USING (uid) GROUP BY dataset")
def _(t):
    j = t.scored.join(t.judged, "uid")
    s = F.col("score")
    return j.groupBy("dataset").agg(F.count_if(s == 0).alias("hard_zeros"), F.count_if(s < 1).alias("non_exact"), F.count_if((s < 1) & F.col("equivalent")).alias("equivalent"))


@query("a30_three_costs", """WITH e AS (SELECT s.uid, s.score AS s, CASE WHEN j.equivalent THEN 1.0 ELSE s.score END AS f, s.n_true > 6 AS several, s.family < 3 AS computed FROM scored s LEFT JOIN judged j USING (uid)),
w AS (SELECT c.src_uid AS uid, c.score AS s, CASE WHEN j.equivalent THEN 1.0 ELSE c.score END AS f FROM control c LEFT JOIN judged j ON j.uid = c.src_uid),
r AS (SELECT 'retrieval' AS cost, avg(w.s) - avg(e.s) AS s, avg(w.f) - avg(e.f) AS f FROM e JOIN w USING (uid) UNION ALL SELECT 'integration', avg(s) FILTER (WHERE several) - avg(s) FILTER (WHERE NOT several), avg(f) FILTER (WHERE several) - avg(f) FILTER (WHERE NOT several) FROM e
 UNION ALL SELECT 'derivation', avg(s) FILTER (WHERE computed) - avg(s) FILTER (WHERE NOT computed), avg(f) FILTER (WHERE computed) - avg(f) FILTER (WHERE NOT computed) FROM e)
SELECT cost, round(100 * s, 9) AS as_scored, round(100 * f, 9) AS corrected FROM r""")
def _(t):
    told = t.judged.select("uid", "equivalent")
    whole = t.control.select(F.col("src_uid").alias("uid"), "score").join(told, "uid", "left")
    costs = ag.three_costs(t.scored.join(told, "uid", "left"), whole, "uid", "score", "equivalent", F.col("n_true") > 6, F.col("family") < 3)
    return _r(costs, "as_scored", "corrected")


@query("a31_two_by_two", "SELECT s.family < 3 AS near, s.primitive = 'F' AS easy, count(*) AS n, round(avg(s.score - c.score), 9) AS gap FROM scored s JOIN control c ON c.src_uid = s.uid WHERE s.score IS NOT NULL GROUP BY 1, 2")
def _(t):
    c = t.control.select(F.col("src_uid").alias("uid"), F.col("score").alias("b"))
    j = t.scored.where("score IS NOT NULL").join(c, "uid")
    return _r(j.groupBy((F.col("family") < 3).alias("near"), (F.col("primitive") == "F").alias("easy")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("score") - F.col("b")).alias("gap")), "gap")


@query("a32_divergence", "SELECT CASE WHEN s.score >= 0.5 THEN 'ok' ELSE 'no' END || '/' || CASE WHEN c.score >= 0.5 THEN 'ok' ELSE 'no' END AS bucket, count(*) AS n FROM scored s JOIN control c ON c.src_uid = s.uid WHERE s.score IS NOT NULL GROUP BY 1")
def _(t):
    c = t.control.select(F.col("src_uid").alias("uid"), F.col("score").alias("b"))
    ok = lambda c: F.when(F.col(c) >= 0.5, "ok").otherwise("no")
    j = t.scored.where("score IS NOT NULL").join(c, "uid")
    return j.groupBy(F.concat(ok("score"), F.lit("/"), ok("b")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("a35_gold_floor", "SELECT dataset, count(*) AS failures, count(gt_quality) AS audited, count(*) FILTER (WHERE gt_quality = 'wrong') AS contested, round(count(*) FILTER (WHERE gt_quality = 'wrong') * 1.0 / count(gt_quality), 9) AS contested_rate FROM scored LEFT JOIN judged USING (uid) WHERE score < 0.5 GROUP BY dataset")
def _(t):
    j = t.scored.where("score < 0.5").join(t.judged.select("uid", "gt_quality"), "uid", "left")
    out = j.groupBy("dataset").agg(F.count(F.lit(1)).alias("failures"), F.count("gt_quality").alias("audited"), F.count_if(F.col("gt_quality") == "wrong").alias("contested"))
    return _r(out.withColumn("contested_rate", F.try_divide("contested", "audited")), "contested_rate")


@query("a36_contrast", "SELECT round(avg(score) FILTER (WHERE n_true = 1), 9) AS one, round(avg(score) FILTER (WHERE n_true >= 10), 9) AS many, least(count(score) FILTER (WHERE n_true = 1), count(score) FILTER (WHERE n_true >= 10)) AS min_cell FROM scored")
def _(t):
    a, b = F.when(F.col("n_true") == 1, F.col("score")), F.when(F.col("n_true") >= 10, F.col("score"))
    return _r(t.scored.agg(F.avg(a).alias("one"), F.avg(b).alias("many"), F.least(F.count(a), F.count(b)).alias("min_cell")), "one", "many")


@query("a39_out_of_range", "SELECT dataset, count(*) FILTER (WHERE n_pred < 0) AS n, round(avg(CASE WHEN n_pred < 0 THEN 1.0 ELSE 0.0 END), 9) AS frac FROM scored GROUP BY dataset")
def _(t):
    bad = F.col("n_pred") < 0
    return _r(t.scored.groupBy("dataset").agg(F.count_if(bad).alias("n"), F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("frac")), "frac")



@query("a41_list_integrity", "SELECT failure_mode, count(*) AS n, count(*) FILTER (WHERE score < 0.5) AS failed FROM scored WHERE failure_mode LIKE 'mode%' GROUP BY failure_mode")
def _(t):
    s = t.scored.where(F.col("failure_mode").startswith("mode"))
    return s.groupBy("failure_mode").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") < 0.5).alias("failed"))



@query("a43_thin_bins_null", "SELECT failure_mode, n_true, count(score) AS n, CASE WHEN count(score) >= 150 THEN round(avg(score), 9) END AS acc FROM scored WHERE failure_mode IS NOT NULL GROUP BY 1, 2")
def _(t):
    g = t.scored.where("failure_mode IS NOT NULL").groupBy("failure_mode", "n_true").agg(F.count("score").alias("n"), F.avg("score").alias("a"))
    return g.select("failure_mode", "n_true", "n", F.when(F.col("n") >= 150, F.round("a", 9)).alias("acc"))


@query("a44_grader_agreement", "SELECT count(*) AS n, count(*) FILTER (WHERE score >= 0.5 AND judge_score < 0.5) AS string_only, count(*) FILTER (WHERE score < 0.5 AND judge_score >= 0.5) AS judge_only FROM scored JOIN judged USING (uid) WHERE score IS NOT NULL")
def _(t):
    j = t.scored.where("score IS NOT NULL").join(t.judged, "uid")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("score >= 0.5 AND judge_score < 0.5")).alias("string_only"), F.count_if(F.expr("score < 0.5 AND judge_score >= 0.5")).alias("judge_only"))


@query("a45_localization_parts", """WITH d AS (SELECT greatest(abs(x - (x0 + x1) / 2), abs(y - (y0 + y1) / 2)) AS m, x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AS hit FROM boxes),
r AS (SELECT *, row_number() OVER (ORDER BY m) - 1 AS k, count(*) OVER () AS n FROM d)
SELECT count(*) FILTER (WHERE m <= 0.1) AS found, count(*) FILTER (WHERE m > 0.25) AS lost, count(*) FILTER (WHERE m <= 0.1 AND hit) AS hit_given_found, round(max(m) FILTER (WHERE k = n // 2), 9) AS upper_median FROM r""")
def _(t):
    b = t.boxes.withColumn("m", F.expr("greatest(abs(x - (x0 + x1) / 2), abs(y - (y0 + y1) / 2))")).withColumn("hit", geo.in_box(F.col("x"), F.col("y"), F.col("box")))
    mid = windows.order_statistics(b, "m", 2).select(F.round("cut", 9).alias("upper_median"))
    found = F.col("m") <= 0.1
    return b.agg(F.count_if(found).alias("found"), F.count_if(F.col("m") > 0.25).alias("lost"), F.count_if(found & F.col("hit")).alias("hit_given_found")).crossJoin(mid)


@query("a47_divergent_primitives", "SELECT primitive, round(max(a) - min(a), 9) AS spread, max(a) - min(a) > 0.01 AS flagged FROM (SELECT primitive, dataset, avg(score) AS a FROM scored GROUP BY 1, 2) GROUP BY primitive")
def _(t):
    g = t.scored.groupBy("primitive", "dataset").agg(F.avg("score").alias("a")).groupBy("primitive").agg((F.max("a") - F.min("a")).alias("s"))
    return g.select("primitive", F.round("s", 9).alias("spread"), (F.col("s") > 0.01).alias("flagged"))


@query("a50_arms_against_baseline", """WITH a AS (SELECT graph_id, target, rung, bool_or(hit) AS h FROM rungs GROUP BY 1, 2, 3)
SELECT x.rung, count(*) AS n, count(*) FILTER (WHERE x.h AND NOT b.h) AS only_arm, count(*) FILTER (WHERE b.h AND NOT x.h) AS only_base FROM a x JOIN a b ON b.rung = 'N' AND x.rung <> 'N' AND x.graph_id = b.graph_id AND x.target = b.target GROUP BY x.rung""")
def _(t):
    a = t.rungs.groupBy("graph_id", "target", "rung").agg(F.bool_or("hit").alias("h"))
    base = a.where("rung = 'N'").select("graph_id", "target", F.col("h").alias("b"))
    j = a.where("rung <> 'N'").join(base, ["graph_id", "target"])
    return j.groupBy("rung").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h") & ~F.col("b")).alias("only_arm"), F.count_if(F.col("b") & ~F.col("h")).alias("only_base"))


@query("w09_hits_and_misses", "(SELECT uid, true AS hit FROM scored WHERE score >= 0.5 AND size IS NOT NULL ORDER BY size, uid LIMIT 10) UNION ALL (SELECT uid, false FROM scored WHERE score < 0.5 AND size IS NOT NULL ORDER BY size, uid LIMIT 10)")
def _(t):
    pick = lambda e, h: t.scored.where(e).where("size IS NOT NULL").orderBy("size", "uid").limit(10).select("uid", F.lit(h).alias("hit"))
    return pick("score >= 0.5", True).unionByName(pick("score < 0.5", False))


@query("w15_smallest_third_quota", """WITH b AS (SELECT uid, rung, CAST(floor((row_number() OVER (PARTITION BY rung ORDER BY (x1 - x0) * (y1 - y0), uid) * 3 - 1) / count(*) OVER (PARTITION BY rung)) AS INT) AS bin FROM boxes)
SELECT rung, uid FROM (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY sha1('2:' || uid::VARCHAR), uid) AS r FROM b WHERE bin = 0) WHERE r <= 4""")
def _(t):
    b = windows.equal_count_bins(t.boxes.withColumn("a", geo.area(F.expr("struct(x0, y0, x1, y1)"))), "a", 3, "uid", ["rung"]).where("bin = 0")
    return windows.stratified_sample(b, ["rung"], 4, "uid", 2).select("rung", "uid")


@query("w19_shuffle", "SELECT uid, row_number() OVER (ORDER BY sha1('8:' || uid), uid) AS place FROM examples")
def _(t):
    hashed = t.examples.select("uid", windows.stable_hash(8, F.col("uid")).alias("h"))
    return windows.positions(hashed, ["h", "uid"]).select("uid", F.col("_row").cast("long").alias("place"))



@query("t13_permutation_mean", "SELECT CAST(20 AS BIGINT) AS shuffles, round(avg(rate), 9) AS mean_rate FROM (SELECT rep, sum(CASE WHEN a.gold_option = b.picked THEN 1 ELSE 0 END) / count(*) AS rate FROM (SELECT rep, gold_option, row_number() OVER (PARTITION BY rep ORDER BY uid) AS r FROM scored, range(1, 21) AS g(rep)) a JOIN (SELECT rep, picked, row_number() OVER (PARTITION BY rep ORDER BY sha1(rep::VARCHAR || ':' || uid::VARCHAR), uid) AS r FROM scored, range(1, 21) AS g(rep)) b USING (rep, r) GROUP BY rep)")
def _(t):
    rates = windows.hash_order_null(t.scored, "uid", "gold_option", "picked", 20)
    return rates.agg(F.lit(20).cast("long").alias("shuffles"), F.round(F.avg("rate"), 9).alias("mean_rate"))


@query("f16_lenient_point", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'box' ELSE 'point' END AS kind, round(CASE WHEN user_id % 2 = 0 THEN (user_id + 10) / 2 ELSE user_id END, 9)::DOUBLE AS x FROM events")
def _(t):
    u = F.col("user_id").cast("string")
    text = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("at ["), u, F.lit(", 2, 10, 4]"))).otherwise(F.concat(F.lit("at ("), u, F.lit(", 7)")))
    p = an.lenient_point(text)
    return t.events.select("event_id", p["kind"].alias("kind"), F.round(p["x"], 9).alias("x"))



@query("f18_verdicts", "SELECT tag, CASE WHEN failed THEN 'call_error' WHEN pred IS NULL THEN 'wrong_format' WHEN pred = 'v1' THEN 'correct' ELSE 'wrong' END AS verdict, count(*) AS n FROM log GROUP BY 1, 2")
def _(t):
    v = an.verdict(F.when(F.col("failed"), "e"), F.col("pred"), F.col("pred") == "v1")
    return t.log.groupBy("tag", v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("f19_checked_box", "SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN vec_id::DOUBLE END AS left_edge FROM embeddings")
def _(t):
    v = F.col("vec_id").cast("string")
    text = F.concat(F.lit("["), v, F.lit(", 0, "), F.when(F.col("vec_id") % 3 == 0, v).otherwise((F.col("vec_id") + 5).cast("string")), F.lit(", 9]"))
    return t.embeddings.select("vec_id", an.checked_box(text)[0].alias("left_edge"))



@query("f37_expression_value", "SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN o_orderkey + 3 WHEN 1 THEN o_orderkey * 3 ELSE o_orderkey / 4 END, 9)::DOUBLE AS v FROM orders")
def _(t):
    k = F.col("o_orderkey") % 3
    e = F.concat(F.col("o_orderkey").cast("string"), F.when(k == 0, " + 3").when(k == 1, " * 3").otherwise(" / 4"))
    return t.orders.select("o_orderkey", F.round(an.expression_value(e), 9).alias("v"))



@query("f34_corrected_score", "SELECT uid, CASE WHEN equivalent THEN 1.0 ELSE score END AS score FROM scored JOIN judged USING (uid)")
def _(t):
    return t.scored.join(t.judged, "uid").select("uid", an.corrected_score(F.col("score"), F.col("equivalent")).alias("score"))


@query("f41_bucket", "SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS size FROM documents")
def _(t):
    return t.documents.select("doc_id", an.bucket(F.col("n_chars"), [500, 2000], ["short", "medium", "long"]).alias("size"))


@query("g12_growth", "SELECT uid, round_even((x0 - 0) * 1000, 1) AS left_growth FROM boxes")
def _(t):
    outer = geo.box(F.lit(0.0), F.lit(0.0), F.lit(1000.0), F.lit(1000.0))
    inner = geo.box(*(F.col(c) * 1000 for c in ("x0", "y0", "x1", "y1")))
    return t.boxes.select("uid", geo.growth(inner, outer)[0].alias("left_growth"))


@query("g16_megapixels", "SELECT o_orderkey, round((500 + o_orderkey % 3000) * (400 + o_custkey % 2500) / 1e6, 9) AS mp FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round((500 + F.col("o_orderkey") % 3000) * (400 + F.col("o_custkey") % 2500) / 1e6, 9).alias("mp"))




@query("t05_chi2_picks", "WITH g AS (SELECT gold_option AS o, count(*) AS g FROM scored GROUP BY 1), p AS (SELECT picked AS o, count(*) AS p FROM scored GROUP BY 1) SELECT round(sum(pow(p - g, 2) / g), 9) AS chi2 FROM g JOIN p USING (o)")
def _(t):
    g = t.scored.groupBy(F.col("gold_option").alias("o")).agg(F.count(F.lit(1)).alias("g"))
    p = t.scored.groupBy(F.col("picked").alias("o")).agg(F.count(F.lit(1)).alias("p"))
    return g.join(p, "o").agg(F.round(F.sum(F.pow(F.col("p") - F.col("g"), F.lit(2.0)) / F.col("g")), 9).alias("chi2"))


@query("t10_exclusive_p90", "SELECT dataset, round((l[j] * (100 - d) + l[j + 1] * d) / 100, 6) AS p90 FROM (SELECT *, 90 * (n + 1) - j * 100 AS d FROM (SELECT *, least(greatest(90 * (n + 1) // 100, 1), n - 1) AS j FROM (SELECT dataset, count(size) AS n, list(size ORDER BY size) AS l FROM scored WHERE size IS NOT NULL GROUP BY dataset)))")
def _(t):
    return windows.percentiles(t.scored, ["dataset"], "size", p90=("exclusive", 90)).select("dataset", F.round("p90", 6).alias("p90"))


@query("t14_chance", "SELECT rung, round(avg((x1 - x0) * (y1 - y0)), 9) AS chance FROM boxes GROUP BY rung")
def _(t):
    return _r(t.boxes.groupBy("rung").agg(F.avg(geo.area(F.col("box"))).alias("chance")), "chance")


_CI = "(({p} + 1.9208 / n) / (1 + 3.8416 / n) {s} 1.96 / (1 + 3.8416 / n) * sqrt({p} * (1 - {p}) / n + 0.9604 / n / n))"


@query("t16_disjoint_intervals", f"WITH c AS (SELECT dataset, avg(score) AS a, count(score) AS n FROM scored GROUP BY dataset), i AS (SELECT dataset, greatest({_CI.format(p='a', s='-')}, 0) AS lo, least({_CI.format(p='a', s='+')}, 1) AS hi FROM c) SELECT x.dataset, y.dataset AS other, x.hi < y.lo OR y.hi < x.lo AS disjoint FROM i x JOIN i y ON x.dataset < y.dataset")
def _(t):
    c = ag.accuracy_cell(t.scored, ["dataset"])
    o = c.select(F.col("dataset").alias("other"), F.col("ci_lo").alias("lo2"), F.col("ci_hi").alias("hi2"))
    # Cells, not rows: a handful of datasets.
    j = c.join(F.broadcast(o), F.col("dataset") < F.col("other"))
    return j.select("dataset", "other", ((F.col("ci_hi") < F.col("lo2")) | (F.col("hi2") < F.col("ci_lo"))).alias("disjoint"))


@query("v08_legibility_floor", "SELECT p_partkey, greatest(p_size, 9) AS size, p_size < 9 AS raised FROM part")
def _(t):
    return t.part.select("p_partkey", an.legible(F.col("p_size")).alias("l")).select("p_partkey", "l.*")


@query("q04_ladder_grid", "SELECT a.r_name AS aspect, n_name AS rung, o AS scene FROM region a, nation, range(3) AS s(o)")
def _(t):
    scenes = t.spark.range(3).select(F.col("id").alias("scene"))
    return t.region.select(F.col("r_name").alias("aspect")).crossJoin(t.nation.select(F.col("n_name").alias("rung"))).crossJoin(F.broadcast(scenes))


@query("x07_shortfall", "SELECT count(*) AS selected, count(*) FILTER (WHERE uid IN (SELECT uid FROM log WHERE pred IS NOT NULL AND NOT failed)) AS done FROM examples")
def _(t):
    done = t.log.where(usable()).select("uid").distinct().withColumn("d", F.lit(True))
    return t.examples.join(done, "uid", "left").agg(F.count(F.lit(1)).alias("selected"), F.count("d").alias("done"))
