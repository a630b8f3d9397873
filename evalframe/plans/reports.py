"""Published tables as single queries, and preconditions that some groups fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import answers as an
from evalframe.functions import geometry as geo
from evalframe.functions import permute
from evalframe.operators import graph, reports
from evalframe.plans.base import BASE, query
from evalframe.plans.measures import _D
from evalframe.plans.selection import _HIT


@query("report_benchmark_suite", """WITH u AS (SELECT uid, max_by(pred, seq) AS pred FROM log WHERE pred IS NOT NULL AND NOT failed GROUP BY uid),
s AS (SELECT e.dataset, CASE WHEN u.pred = e.gold THEN 1.0 ELSE 0.0 END AS string_score, j.judge_score FROM u JOIN examples e USING (uid) LEFT JOIN (SELECT 'q' || uid::VARCHAR AS uid, judge_score FROM judged) j USING (uid)),
g AS (SELECT dataset, grouping(dataset) = 1 AS whole, count(*) AS n, avg(coalesce(judge_score, string_score)) AS acc, avg(string_score) AS string_acc, count(judge_score) AS judged FROM s GROUP BY ROLLUP (dataset))
SELECT dataset, whole, n, round(acc, 9) AS acc, round(string_acc, 9) AS string_acc, judged FROM g""")
def _(t):
    verdicts = t.judged.select(F.concat(F.lit("q"), F.col("uid").cast("string")).alias("uid"), "judge_score")
    usable = F.col("pred").isNotNull() & ~F.col("failed")
    suite = reports.benchmark_suite(t.log, t.examples, verdicts, usable, (F.col("pred") == F.col("gold")).cast("double"))
    return suite.select("dataset", "whole", "n", F.round("acc", 9).alias("acc"), F.round("string_acc", 9).alias("string_acc"), "judged")


@query("report_precision_ladder", """WITH g AS (SELECT unnest([2, 3, 4, 8, 16]) AS grid), c AS (SELECT grid,
  least(CAST(trunc(x * grid) AS INT), grid - 1) AS cx, least(CAST(trunc(y * grid) AS INT), grid - 1) AS cy,
  least(CAST(trunc((x0 + x1) / 2 * grid) AS INT), grid - 1) AS bx, least(CAST(trunc((y0 + y1) / 2 * grid) AS INT), grid - 1) AS by_ FROM boxes, g),
r AS (SELECT grid, count(*) AS n, 1.0::DOUBLE / grid / grid AS chance, count(*) FILTER (WHERE cx = bx AND cy = by_) / count(*) AS acc FROM c GROUP BY grid
UNION ALL SELECT 0, count(*), avg((x1 - x0) * (y1 - y0)), count(*) FILTER (WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) / count(*) FROM boxes)
SELECT grid, n, round(chance, 9) AS chance, round(acc, 9) AS acc, round(acc / chance, 6) AS ratio FROM r""")
def _(t):
    r = reports.precision_ladder(t.boxes, "x", "y", "box")
    return r.select("grid", "n", F.round("chance", 9).alias("chance"), F.round("acc", 9).alias("acc"), F.round("ratio", 6).alias("ratio"))


@query("report_where_misses_land", f"""WITH m AS (SELECT *, {_D} AS d FROM boxes WHERE NOT ({_HIT})),
o AS (SELECT rung, count(*) AS k FROM m p WHERE EXISTS (SELECT 1 FROM boxes o WHERE o.scene = p.scene AND o.uid <> p.uid AND p.x BETWEEN o.x0 AND o.x1 AND p.y BETWEEN o.y0 AND o.y1) GROUP BY rung)
SELECT rung, n AS n_miss, round(near / n, 9) AS near, round(moderate / n, 9) AS moderate, round(far / n, 9) AS wrong_region, round(md, 9) AS median_d, round(coalesce(k, 0) / n, 9) AS on_other
FROM (SELECT rung, count(*) AS n, count(*) FILTER (WHERE d < 0.1) AS near, count(*) FILTER (WHERE d >= 0.1 AND d <= 0.25) AS moderate, count(*) FILTER (WHERE d > 0.25) AS far, median(d) AS md FROM m GROUP BY rung) LEFT JOIN o USING (rung)""")
def _(t):
    r = reports.where_misses_land(t.boxes.withColumn("hit", F.expr(_HIT)), "rung", "scene", "uid", "x", "y", "box")
    return r.select("rung", "n_miss", *(F.round(c, 9).alias(c) for c in ("near", "moderate", "wrong_region", "median_d", "on_other")))


_SIZE = "(x1 - x0) * (y1 - y0)"


@query("report_polarity", f"""WITH b AS (SELECT *, {_SIZE} AS area, x + y AS ink, label % 2 = 0 AS e, {_HIT} AS h FROM boxes),
a3 AS (SELECT max(area) FILTER (WHERE r = n // 3) AS lo, max(area) FILTER (WHERE r = 2 * n // 3) AS hi FROM (SELECT area, row_number() OVER (ORDER BY area) - 1 AS r, count(*) OVER () AS n FROM b)),
i3 AS (SELECT max(ink) FILTER (WHERE r = n // 3) AS lo, max(ink) FILTER (WHERE r = 2 * n // 3) AS hi FROM (SELECT ink, row_number() OVER (ORDER BY ink) - 1 AS r, count(*) OVER () AS n FROM b)),
k AS (SELECT rung, CASE WHEN area < a3.lo THEN 0 WHEN area < a3.hi THEN 1 ELSE 2 END AS ta, CASE WHEN ink < i3.lo THEN 0 WHEN ink < i3.hi THEN 1 ELSE 2 END AS ti, e, h FROM b, a3, i3),
t AS (SELECT count(*) FILTER (WHERE e AND h)::DOUBLE AS a, count(*) FILTER (WHERE e AND NOT h)::DOUBLE AS b, count(*) FILTER (WHERE NOT e AND h)::DOUBLE AS c, count(*) FILTER (WHERE NOT e AND NOT h)::DOUBLE AS d FROM k GROUP BY rung, ta, ti),
u AS (SELECT *, a + b + c + d AS n FROM t WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0),
s AS (SELECT count(*) AS n_strata, sum(a * d / n) AS r, sum(b * c / n) AS s, sum((a + d) / n * a * d / n) AS pr, sum((a + d) / n * b * c / n + (b + c) / n * a * d / n) AS ps, sum((b + c) / n * b * c / n) AS qs FROM u),
w AS (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM t),
z AS (SELECT e AS exposed, count(*) AS n, count(*) FILTER (WHERE h) AS k FROM b GROUP BY e)
SELECT exposed, z.n, z.k, round(z.k / z.n, 9) AS acc, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 9) AS crude, round(r / s, 9) AS odds_ratio,
  round(exp(ln(r / s) - 1.96 * sqrt(pr / (2 * r * r) + ps / (2 * r * s) + qs / (2 * s * s))), 6) AS lo, round(exp(ln(r / s) + 1.96 * sqrt(pr / (2 * r * r) + ps / (2 * r * s) + qs / (2 * s * s))), 6) AS hi, n_strata
FROM z, s, w""")
def _(t):
    b = t.boxes.withColumn("area", geo.area(F.col("box"))).withColumn("ink", F.col("x") + F.col("y"))
    r = reports.polarity(b, F.col("label") % 2 == 0, F.expr(_HIT), "rung", ["area", "ink"])
    return r.select("exposed", "n", "k", F.round("acc", 9).alias("acc"), F.round("crude", 9).alias("crude"), F.round("odds_ratio", 9).alias("odds_ratio"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n_strata")


@query("k08_thin_months", "SELECT year(l_shipdate) * 100 + month(l_shipdate) AS month, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) < 600")
def _(t):
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long").alias("month")
    return t.lineitem.groupBy(month).agg(F.count(F.lit(1)).alias("n")).where("n < 600")


_CENTS = "CAST(floor(o_totalprice * 100) AS BIGINT)"
_PRICE = f"""CASE WHEN {_CENTS} % 100 = 0 THEN CAST({_CENTS} // 100 AS VARCHAR) WHEN {_CENTS} % 10 = 0 THEN CAST({_CENTS} // 100 AS VARCHAR) || '.' || CAST({_CENTS} % 100 // 10 AS VARCHAR)
  ELSE CAST({_CENTS} // 100 AS VARCHAR) || '.' || lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0') END"""


@query("s08_decimals_of_prices", f"""SELECT o_orderkey AS uid, CASE len(split_part(p, '.', 2)) WHEN 0 THEN 'Answer with a whole number.' WHEN 1 THEN 'Answer with one decimal place.' ELSE 'Answer with 2 decimal places.' END AS asked
FROM (SELECT o_orderkey, {_PRICE} AS p FROM orders)""")
def _(t):
    text = F.expr(_PRICE.replace("//", "div").replace("VARCHAR", "STRING"))
    return t.orders.select(F.col("o_orderkey").alias("uid"), an.decimals_asked(text).alias("asked"))


@query("r05_sets_of_orders", """WITH s AS (SELECT l_orderkey AS gid, coalesce(list(DISTINCT l_suppkey % 7) FILTER (WHERE l_linenumber % 2 = 1), []) AS a, coalesce(list(DISTINCT l_partkey % 7) FILTER (WHERE l_linenumber % 2 = 0), []) AS b FROM lineitem GROUP BY l_orderkey),
n AS (SELECT gid, len(list_filter(a, lambda x: list_contains(b, x))) AS k, len(a) + len(b) AS total FROM s)
SELECT gid, round(CASE WHEN total = 0 THEN 1.0 ELSE 2.0 * k / total END, 9)::DOUBLE AS f1, 2 * k = total AS exact FROM n""")
def _(t):
    side = lambda c, odd: F.collect_set(F.when(F.col("l_linenumber") % 2 == odd, F.col(c) % 7)).alias("items")
    sets = lambda c, odd: t.lineitem.groupBy(F.col("l_orderkey").alias("gid")).agg(side(c, odd))
    return graph.graph_f1(sets("l_suppkey", 1), sets("l_partkey", 0), "items").select("gid", F.round("f1", 9).alias("f1"), "exact")


#: Numbers of a page, the right one and the one that was answered.
BASE["readings"] = """
SELECT o_orderkey AS uid, o_orderpriority AS dataset, CAST(o_custkey % 97 AS DOUBLE) AS gold, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST((o_orderkey * 7 + o_custkey) % 97 AS DOUBLE) END AS pred,
       CAST(o_custkey * 3 % 97 AS DOUBLE) AS p1, CAST((o_custkey + o_orderkey * 7) % 97 * (o_orderkey % 2) AS DOUBLE) AS p2, CAST(o_orderkey % 89 AS DOUBLE) AS p3
FROM {orders}"""
_KEYED = permute.permuted_sql("keyed", "pos", "n", "key")


@query("report_wrong_numbers", f"""WITH RECURSIVE wrong AS (SELECT *, CASE WHEN gold <> 0 THEN abs(pred - gold) / abs(gold) END AS e FROM readings WHERE abs(pred - gold) > 1e-6 * greatest(1, abs(gold))),
numbered AS (SELECT *, row_number() OVER (ORDER BY uid) - 1 AS pos, count(*) OVER () AS n FROM wrong), keyed AS (SELECT pos, n, key FROM numbered, range(1, 21) AS g(key)), walk AS ({_KEYED[0]} UNION ALL {_KEYED[1]}),
rates AS (SELECT key, avg(CASE WHEN b.pred = a.p1 OR b.pred = a.p2 OR b.pred = a.p3 THEN 1.0 ELSE 0.0 END) AS rate FROM walk JOIN numbered a ON a.pos = walk.pos JOIN numbered b ON b.pos = walk.place WHERE walk.turns > 0 AND walk.place < walk.n GROUP BY key)
SELECT dataset, count(*) AS n, round(median(e), 9) AS median_error, round(avg(CASE WHEN e <= 0.1 THEN 1.0 WHEN e > 0.1 THEN 0.0 END), 9) AS within_tenth,
  round((SELECT avg(CASE WHEN pred = p1 OR pred = p2 OR pred = p3 THEN 1.0 ELSE 0.0 END) FROM wrong), 9) AS seen, round((SELECT avg(rate) FROM rates), 9) AS by_chance FROM wrong GROUP BY dataset""")
def _(t):
    out = reports.wrong_numbers(t.readings, "dataset", "uid", "gold", "pred", ["p1", "p2", "p3"])
    return out.select("dataset", "n", *(F.round(c, 9).alias(c) for c in ("median_error", "within_tenth", "seen", "by_chance")))
