"""Cells, contrasts, tests, audits and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import stats
from evalframe.operators import aggregates as ag
from evalframe.operators import graph, windows
from evalframe.plans.base import query


def _r(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 9))
    return df


_W = "(({p} + 1.9208 / {n}) / (1 + 3.8416 / {n}) {s} 1.96 / (1 + 3.8416 / {n}) * sqrt({p} * (1 - {p}) / {n} + 0.9604 / {n} / {n}))"


@query("a02_accuracy_cell", f"""SELECT dataset, round(acc, 9) AS acc, n, round(greatest({_W.format(p='acc', n='n', s='-')}, 0), 9) AS ci_lo, round(least({_W.format(p='acc', n='n', s='+')}, 1), 9) AS ci_hi
FROM (SELECT dataset, avg(score) AS acc, count(score) AS n FROM scored GROUP BY dataset)""")
def _(t):
    return _r(ag.accuracy_cell(t.scored, ["dataset"]), "acc", "ci_lo", "ci_hi")


@query("a03_slices", "SELECT primitive, family, round(avg(score), 9) AS acc, count(score) AS n FROM scored GROUP BY primitive, family HAVING count(score) >= 100")
def _(t):
    return _r(ag.slice_by(t.scored, ["primitive", "family"], 100), "acc").select("primitive", "family", "acc", "n")


@query("a04_rate_cell", f"""SELECT rung, n, k, round(k / n, 9) AS acc, round({_W.format(p='(k / n)', n='n', s='-')}, 9) AS lo, round({_W.format(p='(k / n)', n='n', s='+')}, 9) AS hi, n < 30 AS suppressed, round(c, 9) AS chance, round(k / n / c, 9) AS ratio
FROM (SELECT rung, count(*) AS n, count(*) FILTER (WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS k, avg((x1 - x0) * (y1 - y0)) AS c FROM boxes GROUP BY rung)""")
def _(t):
    hit = F.expr("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return _r(ag.rate_cell(t.boxes, ["rung"], hit, F.expr("(x1 - x0) * (y1 - y0)")), "acc", "lo", "hi", "chance", "ratio")


@query("a05_rate_cell_plain", "SELECT family, count(score) AS n, count(*) FILTER (WHERE score >= 0.5) AS k FROM scored GROUP BY family")
def _(t):
    return ag.rate_cell(t.scored, ["family"], F.col("score") >= 0.5).select("family", "n", "k")


@query("a07_matrix", "SELECT primitive, dataset, round(avg(score), 9) AS acc, count(score) AS n, CAST(grouping_id(primitive, dataset) AS BIGINT) AS level FROM scored GROUP BY CUBE (primitive, dataset)")
def _(t):
    return _r(ag.pivot_matrix(t.scored, "primitive", "dataset"), "acc")


@query("a08_mode_histogram", "SELECT coalesce(failure_mode, 'unclassified') AS mode, count(*) AS n FROM scored GROUP BY 1")
def _(t):
    return t.scored.groupBy(F.coalesce("failure_mode", F.lit("unclassified")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query("a09_signed_errors", """SELECT dataset, round(avg(n_pred - n_true), 9) AS mean_signed, round(avg(n_pred - n_true) FILTER (WHERE n_pred <> n_true), 9) AS mean_signed_when_wrong,
  median(abs(n_pred - n_true))::DOUBLE AS median_abs, count(*) FILTER (WHERE n_pred < n_true) AS under, count(*) FILTER (WHERE n_pred > n_true) AS over FROM scored GROUP BY dataset""")
def _(t):
    return _r(ag.signed_errors(t.scored, ["dataset"], "n_pred", "n_true"), "mean_signed", "mean_signed_when_wrong")


_BIN = "CASE WHEN n_true BETWEEN 1 AND 4 THEN '1-4' WHEN n_true BETWEEN 5 AND 6 THEN '5-6' WHEN n_true BETWEEN 7 AND 9 THEN '7-9' WHEN n_true BETWEEN 10 AND 15 THEN '10-15' WHEN n_true >= 16 THEN '16+' END"


@query("a10_dose_response", f"""SELECT CAST(o AS INT) AS bin_order, v.bin, coalesce(n, 0) AS n, round(acc, 9) AS acc FROM (VALUES (0, '1-4'), (1, '5-6'), (2, '7-9'), (3, '10-15'), (4, '16+')) AS v(o, bin)
LEFT JOIN (SELECT {_BIN} AS bin, count(score) AS n, avg(score) AS acc FROM scored GROUP BY 1) c ON c.bin = v.bin""")
def _(t):
    cells = t.scored.groupBy(F.expr(_BIN).alias("bin")).agg(F.count("score").alias("n"), F.avg("score").alias("acc"))
    return _r(ag.with_empty_bins(cells, ["1-4", "5-6", "7-9", "10-15", "16+"], "bin"), "acc").select("bin_order", "bin", "n", "acc")


@query("a12_top_forms", "SELECT dataset, failure_mode, n FROM (SELECT dataset, failure_mode, count(*) AS n, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, failure_mode) AS r FROM scored WHERE failure_mode IS NOT NULL GROUP BY 1, 2) WHERE r <= 3")
def _(t):
    from pyspark.sql import Window as W

    c = t.scored.where("failure_mode IS NOT NULL").groupBy("dataset", "failure_mode").agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("n"), "failure_mode"))
    return c.withColumn("r", r).where("r <= 3").drop("r")


@query("a14_family_by_rung", "SELECT dataset, family, count(score) AS n, round(avg(score), 9) AS acc FROM scored GROUP BY ROLLUP (dataset, family)")
def _(t):
    return _r(t.scored.rollup("dataset", "family").agg(F.count("score").alias("n"), F.avg("score").alias("acc")), "acc")


@query("a18_official_metrics", """SELECT dataset, count(*) AS n, count(*) FILTER (WHERE verdict = 'neither_correct') AS wrong_format, round(avg(CASE WHEN verdict IN ('gold_correct', 'both_acceptable') THEN 1.0 ELSE 0.0 END), 9) AS action_acc
FROM scored JOIN judged USING (uid) WHERE score IS NOT NULL GROUP BY dataset""")
def _(t):
    j = t.scored.where("score IS NOT NULL").join(t.judged, "uid")
    ok = F.col("verdict").isin("gold_correct", "both_acceptable")
    return _r(j.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "neither_correct").alias("wrong_format"), F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("action_acc")), "action_acc")


@query("a20_audit_rates", f"""SELECT primitive, n, bad, round(100 * greatest({_W.format(p='(bad / n)', n='n', s='-')}, 0), 9) AS lo, round(100 * least({_W.format(p='(bad / n)', n='n', s='+')}, 1), 9) AS hi
FROM (SELECT primitive, count(*) AS n, count(*) FILTER (WHERE gt_quality <> 'unambiguous') AS bad FROM scored JOIN judged USING (uid) GROUP BY primitive)""")
def _(t):
    j = t.scored.join(t.judged, "uid").groupBy("primitive").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gt_quality") != "unambiguous").alias("bad"))
    ci = stats.wilson_percent(F.col("bad"), F.col("n"))
    return _r(j.withColumn("lo", ci["lo"]).withColumn("hi", ci["hi"]), "lo", "hi")


@query("a21_prevalence_weighted", """WITH r AS (SELECT dataset, avg(CASE WHEN gt_quality = 'wrong' THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS audited FROM scored JOIN judged USING (uid) GROUP BY dataset),
p AS (SELECT dataset, count(*) AS size FROM scored GROUP BY dataset) SELECT round(sum(rate * size) / sum(size), 9) AS rate, CAST(sum(audited) AS BIGINT) AS audited FROM r JOIN p USING (dataset)""")
def _(t):
    pop = t.scored.groupBy("dataset").agg(F.count(F.lit(1)).alias("size"))
    return _r(ag.reweighted_rate(t.scored.join(t.judged, "uid"), "dataset", F.col("gt_quality") == "wrong", pop), "rate")


@query("a22_crosstab", "SELECT verdict, gt_quality, count(*) AS n FROM judged GROUP BY 1, 2")
def _(t):
    return t.judged.groupBy("verdict", "gt_quality").agg(F.count(F.lit(1)).alias("n"))



@query("a25_vision_adds", "SELECT dataset, count(*) AS n, round(avg(c.score), 9) AS blind, round(avg(s.score), 9) AS sighted, round(100 * (avg(s.score) - avg(c.score)), 9) AS vision_adds_pp FROM scored s JOIN control c ON c.src_uid = s.uid WHERE s.score IS NOT NULL GROUP BY dataset")
def _(t):
    c = t.control.select(F.col("src_uid").alias("uid"), F.col("score").alias("b"))
    j = t.scored.where("score IS NOT NULL").join(c, "uid").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("blind"), F.avg("score").alias("sighted"))
    return _r(j.withColumn("vision_adds_pp", 100 * (F.col("sighted") - F.col("blind"))), "blind", "sighted", "vision_adds_pp")


@query("a27_abstention", "SELECT d.lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS tn FROM labels JOIN documents d USING (doc_id) GROUP BY d.lang")
def _(t):
    j = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return ag.confusion(j, ["lang"], F.col("quality") == 1, F.col("toxic") == 1)


@query("a29_relative_error", "SELECT dataset, round(median(e), 9) AS median_rel, count(*) FILTER (WHERE e = 0) AS exact, count(*) FILTER (WHERE e <= 0.1) AS within_10, count(*) FILTER (WHERE e > 1) AS over_100 FROM (SELECT dataset, abs(n_pred - n_true) / n_true AS e FROM scored WHERE n_true > 0) GROUP BY dataset")
def _(t):
    e = t.scored.where("n_true > 0").withColumn("e", F.expr("abs(n_pred - n_true) / n_true"))
    return _r(e.groupBy("dataset").agg(F.median("e").alias("median_rel"), F.count_if(F.col("e") == 0).alias("exact"), F.count_if(F.col("e") <= 0.1).alias("within_10"), F.count_if(F.col("e") > 1).alias("over_100")), "median_rel")


@query("a33_fixed_histogram", "SELECT CAST(CASE WHEN score < 0.25 THEN 0 WHEN score < 0.5 THEN 1 WHEN score < 0.75 THEN 2 ELSE 3 END AS INT) AS bin, count(*) AS n FROM scored WHERE score IS NOT NULL GROUP BY 1")
def _(t):
    s = F.col("score")
    return t.scored.where("score IS NOT NULL").groupBy(F.when(s < 0.25, 0).when(s < 0.5, 1).when(s < 0.75, 2).otherwise(3).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("a34_latency", "SELECT tag, round(avg(latency_s), 9) AS mean_s, round(avg(cost), 9) AS mean_cost, count(*) AS n FROM log GROUP BY tag")
def _(t):
    return _r(t.log.groupBy("tag").agg(F.avg("latency_s").alias("mean_s"), F.avg("cost").alias("mean_cost"), F.count(F.lit(1)).alias("n")), "mean_s", "mean_cost")


@query("a37_position_bias", """SELECT o AS option, (SELECT count(*) FROM scored WHERE gold_option = o) AS gold, (SELECT count(*) FROM scored WHERE picked = o) AS picked,
  (SELECT count(*) FROM scored WHERE picked = o AND picked <> gold_option) AS wrong_picks, (SELECT count(*) FROM scored WHERE gold_option = o AND picked = o) AS right_picks FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(o)""")
def _(t):
    opts = t.spark.createDataFrame([(c,) for c in "ABCDE"], "option string")
    g = t.scored.groupBy(F.col("gold_option").alias("option")).agg(F.count(F.lit(1)).alias("gold"), F.count_if(F.col("picked") == F.col("gold_option")).alias("right_picks"))
    p = t.scored.groupBy(F.col("picked").alias("option")).agg(F.count(F.lit(1)).alias("picked"), F.count_if(F.col("picked") != F.col("gold_option")).alias("wrong_picks"))
    return F.broadcast(opts).join(g, "option", "left").join(p, "option", "left").fillna(0)


@query("a38_top_distractors", "SELECT picked, gold_option, count(*) AS n FROM scored WHERE picked <> gold_option GROUP BY 1, 2 ORDER BY n DESC, picked, gold_option LIMIT 5")
def _(t):
    c = t.scored.where("picked <> gold_option").groupBy("picked", "gold_option").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "picked", "gold_option").limit(5)


@query("w11_top_with_rest", "WITH c AS (SELECT dataset, count(*) AS n FROM scored GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, dataset) AS r FROM c) SELECT CASE WHEN r <= 3 THEN dataset ELSE 'other' END AS dataset, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def _(t):
    return ag.top_with_rest(t.scored, "dataset", 3)


_TREE = """WITH g AS (SELECT CASE WHEN grouping(primitive) = 0 AND grouping(dataset) = 0 THEN primitive || '/' || dataset WHEN grouping(primitive) = 0 THEN primitive ELSE '' END AS path,
  CASE WHEN grouping(primitive) = 0 AND grouping(dataset) = 0 THEN primitive WHEN grouping(primitive) = 0 THEN '' END AS parent,
  CAST(2 - grouping(primitive) - grouping(dataset) AS INT) AS depth, count(score) AS n, avg(score) AS value FROM scored GROUP BY ROLLUP (primitive, dataset))
SELECT g.path, g.depth, g.n, round(g.value, 9) AS value, round(g.value - p.value, 9) AS delta, round(k.spread, 9) AS spread FROM g
LEFT JOIN g p ON p.path = g.parent AND p.depth = g.depth - 1
LEFT JOIN (SELECT parent, max(value) - min(value) AS spread FROM g WHERE n >= 30 AND parent IS NOT NULL GROUP BY parent HAVING count(*) >= 2) k ON k.parent = g.path"""


@query("a46_drill_down", _TREE)
def _(t):
    return _r(ag.drill_down(t.scored, ["primitive", "dataset"]), "value", "delta", "spread")


@query("v07_conservation", """WITH g AS (SELECT primitive, dataset, count(score) AS n FROM scored GROUP BY 1, 2), p AS (SELECT primitive, sum(n) AS n FROM g GROUP BY 1), m AS (SELECT max(primitive) AS m FROM p)
SELECT '' AS path, CAST(0 AS INT) AS depth, CAST((SELECT sum(n) FROM g) AS BIGINT) AS n, CAST((SELECT sum(n) - 1 FROM g) AS BIGINT) AS of_children
UNION ALL SELECT primitive, CAST(1 AS INT), CAST(n - 1 AS BIGINT), CAST(n AS BIGINT) FROM p, m WHERE primitive = m""")
def _(t):
    tree = ag.drill_down(t.scored, ["primitive", "dataset"])
    # One row is lost at the second level of the last primitive: its parent and its children no longer agree with it.
    last = t.scored.agg(F.max("primitive")).first()[0]
    lost = F.when((F.col("depth") == 1) & (F.col("path") == last), 1).otherwise(0)
    return ag.conservation_violations(tree.withColumn("n", F.col("n") - lost))


@query("a48_advantages", "SELECT uid, round(mu, 9) AS mu, round(sd, 9) AS sigma, sd <= 1e-9 AS dead, round(CASE WHEN sd > 1e-9 THEN (score - mu) / sd END, 6) AS advantage FROM (SELECT *, avg(score) OVER w AS mu, stddev_pop(score) OVER w AS sd FROM scored WHERE score IS NOT NULL WINDOW w AS (PARTITION BY dataset, family))")
def _(t):
    s = t.scored.where("score IS NOT NULL").withColumn("g", F.struct("dataset", "family"))
    a = _r(windows.advantages(s, "g", "score"), "mu", "sigma")
    return a.select("uid", "mu", "sigma", "dead", F.round("advantage", 6).alias("advantage"))


@query("a49_repeat_consistency", "SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS identical, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 9) AS agreement FROM (SELECT uid, min_by(pred, seq) AS a, max_by(pred, seq) AS b FROM log WHERE pred IS NOT NULL GROUP BY uid HAVING count(*) > 1)")
def _(t):
    p = t.log.where("pred IS NOT NULL").groupBy("uid").agg(F.count(F.lit(1)).alias("c"), F.min_by("pred", "seq").alias("a"), F.max_by("pred", "seq").alias("b")).where("c > 1")
    same = F.col("a") == F.col("b")
    return _r(p.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("identical"), F.avg(F.when(same, 1.0).otherwise(0.0)).alias("agreement")), "agreement")


_RUNG = "SELECT graph_id, target, anchor, bool_or(hit) AS hit FROM rungs WHERE rung = '{}' GROUP BY 1, 2, 3"


@query("t06_mcnemar", f"""WITH a AS ({_RUNG.format('A')}), b AS ({_RUNG.format('N')}), j AS (SELECT a.hit AS x, b.hit AS y FROM a JOIN b ON a.graph_id = b.graph_id AND a.target = b.target AND a.anchor IS NOT DISTINCT FROM b.anchor),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE x AND y) AS both, count(*) FILTER (WHERE x AND NOT y) AS only_a, count(*) FILTER (WHERE NOT x AND y) AS only_b, count(*) FILTER (WHERE NOT x AND NOT y) AS neither FROM j)
SELECT *, round(pow(abs(only_a - only_b) - 1, 2) / (only_a + only_b), 9) AS chi2, coalesce(pow(abs(only_a - only_b) - 1, 2) / (only_a + only_b) > 3.841, false) AS significant FROM s""")
def _(t):
    one = lambda r: t.rungs.where(F.col("rung") == r).groupBy("graph_id", "target", "anchor").agg(F.bool_or("hit").alias("hit"))
    return _r(ag.paired(one("A"), one("N"), ["graph_id", "target", "anchor"]), "chi2")


@query("t01_wilson", f"SELECT family, round({_W.format(p='(k / n)', n='n', s='-')}, 9) AS lo, round({_W.format(p='(k / n)', n='n', s='+')}, 9) AS hi FROM (SELECT family, count(*) AS n, count(*) FILTER (WHERE picked = gold_option) AS k FROM scored GROUP BY family)")
def _(t):
    c = t.scored.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("picked") == F.col("gold_option")).alias("k"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return _r(c.select("family", w["lo"].alias("lo"), w["hi"].alias("hi")), "lo", "hi")


@query("t04_chi2_positions", "WITH e AS (SELECT * FROM (VALUES ('A', 0.25), ('B', 0.25), ('C', 0.25), ('D', 0.25)) AS v(picked, share)), o AS (SELECT e.picked, share, count(s.uid) AS o FROM e LEFT JOIN scored s ON s.picked = e.picked GROUP BY 1, 2), n AS (SELECT CAST(sum(o) AS BIGINT) AS n FROM o) SELECT n.n, round(sum(pow(o - share::DOUBLE * n.n, 2) / (share::DOUBLE * n.n)), 6) AS chi2, sum(pow(o - share::DOUBLE * n.n, 2) / (share::DOUBLE * n.n)) > 7.815 AS biased FROM o, n GROUP BY n.n")
def _(t):
    e = t.spark.createDataFrame([(c, 0.25) for c in "ABCD"], "picked string, share double")
    return ag.chi2_against(t.scored, "picked", e).withColumn("chi2", F.round("chi2", 6))



@query("t07_mcnemar_exact_whole", """WITH b AS (SELECT dataset, count(*) FILTER (WHERE s.score >= 0.5 AND c.score < 0.5) AS b, count(*) FILTER (WHERE s.score < 0.5 AND c.score >= 0.5) AS c FROM scored s JOIN control c ON c.src_uid = s.uid GROUP BY dataset)
SELECT dataset, b, c, CASE WHEN b + c > 0 THEN round(least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 6) END AS p FROM b""")
def _(t):
    c = t.control.select(F.col("src_uid").alias("uid"), F.col("score").alias("bs"))
    j = t.scored.join(c, "uid").groupBy("dataset").agg(F.count_if(F.expr("score >= 0.5 AND bs < 0.5")).alias("b"), F.count_if(F.expr("score < 0.5 AND bs >= 0.5")).alias("c"))
    return j.select("dataset", "b", "c", F.round(stats.mcnemar_exact(F.col("b"), F.col("c")), 6).alias("p"))


_MH = """WITH t AS (SELECT family, count(*) FILTER (WHERE e AND h)::DOUBLE AS a, count(*) FILTER (WHERE e AND NOT h)::DOUBLE AS b, count(*) FILTER (WHERE NOT e AND h)::DOUBLE AS c, count(*) FILTER (WHERE NOT e AND NOT h)::DOUBLE AS d
 FROM (SELECT family, primitive = 'F' AS e, score >= 0.5 AS h FROM scored WHERE score IS NOT NULL) GROUP BY family),
u AS (SELECT *, a + b + c + d AS n FROM t WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0),
s AS (SELECT count(*) AS n_strata, sum(a * d / n) AS r, sum(b * c / n) AS s, sum((a + d) / n * a * d / n) AS pr, sum((a + d) / n * b * c / n + (b + c) / n * a * d / n) AS ps, sum((b + c) / n * b * c / n) AS qs FROM u)
SELECT n_strata, round(r / s, 9) AS odds_ratio, round(exp(ln(r / s) - 1.96 * sqrt(pr / (2 * r * r) + ps / (2 * r * s) + qs / (2 * s * s))), 6) AS lo, round(exp(ln(r / s) + 1.96 * sqrt(pr / (2 * r * r) + ps / (2 * r * s) + qs / (2 * s * s))), 6) AS hi FROM s"""


@query("t08_mantel_haenszel", _MH)
def _(t):
    s = t.scored.where("score IS NOT NULL")
    m = ag.mantel_haenszel(s, ["family"], F.col("primitive") == "F", F.col("score") >= 0.5)
    return m.select("n_strata", F.round("odds_ratio", 9).alias("odds_ratio"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("t09_crude_odds", "SELECT dataset, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 9) AS odds FROM (SELECT dataset, count(*) FILTER (WHERE primitive = 'F' AND score >= 0.5) AS a, count(*) FILTER (WHERE primitive = 'F' AND score < 0.5) AS b, count(*) FILTER (WHERE primitive <> 'F' AND score >= 0.5) AS c, count(*) FILTER (WHERE primitive <> 'F' AND score < 0.5) AS d FROM scored GROUP BY dataset)")
def _(t):
    n = lambda e: F.count_if(F.expr(e)).cast("double")
    s = t.scored.groupBy("dataset").agg(n("primitive = 'F' AND score >= 0.5").alias("a"), n("primitive = 'F' AND score < 0.5").alias("b"), n("primitive <> 'F' AND score >= 0.5").alias("c"), n("primitive <> 'F' AND score < 0.5").alias("d"))
    return s.select("dataset", F.round(stats.crude_odds_ratio(*map(F.col, "abcd")), 9).alias("odds"))


@query("t11_median", "SELECT dataset, round(median(size), 9) AS med FROM scored GROUP BY dataset")
def _(t):
    return _r(t.scored.groupBy("dataset").agg(F.median("size").alias("med")), "med")


@query("t12_regression", "SELECT rung, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS n FROM boxes GROUP BY rung")
def _(t):
    r = t.boxes.groupBy("rung").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count(F.lit(1)).alias("n"))
    return r.select("rung", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")




@query("v04_count_crosscheck", "SELECT o_orderkey, declared, drawn FROM (SELECT o_orderkey, o_orderkey % 9 AS declared FROM orders) JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS drawn FROM lineitem GROUP BY 1) USING (o_orderkey) WHERE declared <> drawn")
def _(t):
    d = t.orders.select("o_orderkey", (F.col("o_orderkey") % 9).alias("declared"))
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("drawn"))
    return d.join(n, "o_orderkey").where("declared <> drawn")




def _edges(t):
    """Nation edges of all customers and suppliers; each side's distinct values first, so that the join stays small."""
    c = t.customer.select(F.col("c_nationkey").alias("src"), F.expr("c_custkey % 50").alias("m")).distinct()
    s = t.supplier.select(F.col("s_nationkey").alias("dst"), F.expr("s_suppkey % 50").alias("m")).distinct()
    return c.join(s, "m").select(F.lit(0).alias("gid"), "src", "dst").distinct()


@query("r04_hops_whole")
def _(t):
    e = _edges(t)
    return graph.hops(e, graph.undirected(e).select("gid", "src").distinct()).select("src", "node", "hops")


@query("r02_has_edge_whole", """WITH c AS (SELECT DISTINCT c_nationkey, c_custkey % 50 AS m FROM customer), s AS (SELECT DISTINCT s_nationkey, s_suppkey % 50 AS m FROM supplier), e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM c JOIN s USING (m))
SELECT a.n_nationkey AS a, b.n_nationkey AS b, EXISTS (SELECT 1 FROM e WHERE e.src = a.n_nationkey AND e.dst = b.n_nationkey) AS has_edge FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey""")
def _(t):
    z = F.lit(0).alias("gid")
    nodes = t.nation.select(z, F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("label"))
    n1, n2 = t.nation.select("n_regionkey", F.col("n_nationkey").alias("a")), t.nation.select("n_regionkey", F.col("n_nationkey").alias("b"))
    return graph.has_edge(n1.join(n2, "n_regionkey").select(z, "a", "b"), nodes, _edges(t)).select("a", "b", "has_edge")
