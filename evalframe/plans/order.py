"""Permutations without sorting, and order statistics of values that many rows share."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import permute
from evalframe.operators import windows
from evalframe.plans.base import BASE, query

#: Half of all rows have one value; a part has none.
BASE["ties"] = """
SELECT l_orderkey AS uid, l_linenumber AS line, l_returnflag AS rung,
       CASE WHEN l_orderkey % 2 = 0 THEN 7.5 WHEN l_orderkey % 17 = 0 THEN NULL ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS DOUBLE) / 8 END AS v
FROM {lineitem}"""

_PLACED = "placed AS (SELECT uid, gold_option, picked, row_number() OVER (ORDER BY uid) - 1 AS pos, count(*) OVER () AS n FROM scored)"
_KEYED = permute.permuted_sql("keyed", "pos", "n", "key")


@query("t13_permutation_keyed", f"""WITH RECURSIVE {_PLACED}, keyed AS (SELECT pos, n, key FROM placed, range(1, 21) AS g(key)), walk AS ({_KEYED[0]} UNION ALL {_KEYED[1]}),
rates AS (SELECT key, avg(CASE WHEN a.gold_option = b.picked THEN 1.0 ELSE 0.0 END) AS rate FROM walk JOIN placed a ON a.pos = walk.pos JOIN placed b ON b.pos = walk.place WHERE walk.turns > 0 AND walk.place < walk.n GROUP BY key)
SELECT count(*) AS shuffles, round(avg(rate), 9) AS mean_rate, round(min(rate), 9) AS lowest, round(max(rate), 9) AS highest FROM rates""")
def _(t):
    rates = windows.permutation_null(t.scored, ["uid"], ["gold_option"], ["picked"], F.col("gold_option") == F.col("picked"), 20)
    told = F.avg("rate").alias("mean_rate"), F.min("rate").alias("lowest"), F.max("rate").alias("highest")
    out = rates.agg(F.count(F.lit(1)).alias("shuffles"), *told)
    return out.select("shuffles", *(F.round(c, 9).alias(c) for c in ("mean_rate", "lowest", "highest")))


@query("w19_keyed_shuffle", f"""WITH RECURSIVE placed AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS pos, count(*) OVER () AS n FROM scored), keyed AS (SELECT pos, n, 8::BIGINT AS key FROM placed), walk AS ({_KEYED[0]} UNION ALL {_KEYED[1]})
SELECT uid, place FROM walk JOIN placed USING (pos) WHERE turns > 0 AND place < walk.n""")
def _(t):
    return windows.shuffled(t.scored.select("uid"), ["uid"], 8)


@query("t10_counted_percentiles", """WITH v AS (SELECT rung, v, row_number() OVER (PARTITION BY rung ORDER BY v) AS r, count(*) OVER (PARTITION BY rung) AS n FROM ties WHERE v IS NOT NULL),
j AS (SELECT *, least(greatest(90 * (n + 1) // 100, 1), n - 1) AS j FROM v)
SELECT rung, any_value(n) AS n, (max(v) FILTER (WHERE r = (n + 1) // 2) + max(v) FILTER (WHERE r = n // 2 + 1)) / 2 AS median,
  CASE WHEN any_value(n) > 2 THEN (max(v) FILTER (WHERE r = j) * (100 - any_value(90 * (n + 1) - j * 100)) + max(v) FILTER (WHERE r = j + 1) * any_value(90 * (n + 1) - j * 100)) / 100 ELSE max(v) FILTER (WHERE r = 1) END AS p90
FROM j GROUP BY rung""")
def _(t):
    return windows.percentiles(t.ties, ["rung"], "v", median=("median", 0), p90=("exclusive", 90))


@query("w20_shares_of_ties", "SELECT uid, line, round(cume_dist() OVER (PARTITION BY rung ORDER BY v), 9) AS share FROM ties WHERE v IS NOT NULL")
def _(t):
    return windows.cumulative_share(t.ties, ["rung"], "v").select("uid", "line", F.round("share", 9).alias("share"))


@query("a48_group_statistics", """SELECT dataset, family, count(score) AS n, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS pstdev, max(score) AS best, min(score) AS worst,
  stddev_pop(score) <= 1e-9 AS dead, count(score) < 390 AS truncated FROM scored GROUP BY dataset, family""")
def _(t):
    out = windows.group_statistics(t.scored, ["dataset", "family"], "score", 390)
    return out.select("dataset", "family", "n", F.round("mean", 9).alias("mean"), F.round("pstdev", 9).alias("pstdev"), "best", "worst", "dead", "truncated")
