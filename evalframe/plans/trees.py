"""Drill-downs as trees: keys with nulls and separators, remainders, several dimensions a node, conservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.operators import drill
from evalframe.plans.base import BASE, query

BASE["tree_rows"] = """
SELECT o_orderkey AS uid, CASE CAST(o_custkey % 6 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '(null)' WHEN 2 THEN 'a/b' WHEN 3 THEN 'a' WHEN 4 THEN '' ELSE o_orderstatus END AS kind,
       CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'b' WHEN 1 THEN NULL ELSE chr(92) || 'N' END AS part,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'others' ELSE 'deck' || CAST((o_custkey * o_custkey) % 41 AS STRING) END AS deck,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 END AS score
FROM {orders}"""
_ESC = "replace(replace({0}, chr(92), chr(92) || chr(92)), '/', chr(92) || '/')"
_NODE = "count(score) AS n, count(*) - count(score) AS n_null, avg(score) AS value, avg(CASE WHEN score IS NOT NULL THEN CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END END) AS em"


def _tree(t) -> DataFrame:
    """Kinds, split by part and, but for the kind "a", by the three largest decks and the rest."""
    decks = drill.Dim("deck", F.col("deck"), top_k=3, under=lambda v: v.isNull() | (v != "a"))
    return drill.drill_tree(t.tree_rows, (drill.Dim("kind", F.col("kind"), (drill.Dim("part", F.col("part")), decks)),), F.col("score"), {"em": (F.col("score") >= 0.5).cast("double")})


def _spread(dim: str) -> Column:
    return F.get(F.filter("splits", lambda s: s["dim"] == dim), F.lit(0))["spread"]


#: tree(path, depth, level, n, n_null, value, em, up): the nodes; up is the parent's path.
_TREE = f"""
r AS (SELECT *, coalesce({_ESC.format("kind")}, chr(92) || 'N') AS k, coalesce({_ESC.format("part")}, chr(92) || 'N') AS p, coalesce({_ESC.format("deck")}, chr(92) || 'N') AS d FROM tree_rows),
sized AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, any_value(deck) NULLS LAST) AS place, count(*) OVER (PARTITION BY k) AS groups FROM r WHERE kind IS DISTINCT FROM 'a' GROUP BY k, d),
tree AS (
  SELECT '' AS path, 0 AS depth, NULL AS level, NULL AS up, {_NODE} FROM r
  UNION ALL SELECT k, 1, 'kind', '', {_NODE} FROM r GROUP BY k
  UNION ALL SELECT k || '/' || p, 2, 'part', k, {_NODE} FROM r GROUP BY k, p
  UNION ALL SELECT k || '/' || CASE WHEN place <= 3 THEN d ELSE chr(92) || '+others x' || (groups - 3)::VARCHAR END, 2, 'deck', k, {_NODE}
  FROM r JOIN sized USING (k, d) GROUP BY k, CASE WHEN place <= 3 THEN d ELSE chr(92) || '+others x' || (groups - 3)::VARCHAR END
),
spreads AS (SELECT up, depth - 1 AS depth, level, max(value) - min(value) AS spread FROM tree WHERE n >= 30 AND depth > 0 GROUP BY up, depth, level HAVING count(*) >= 2)"""


@query("a46_drill_tree", f"""WITH {_TREE}
SELECT t.path, t.depth::INT AS depth, t.level, t.n, t.n_null, round(t.value, 9) AS value, round(t.em, 9) AS em, round(t.value - u.value, 9) AS delta,
  round(sk.spread, 9) AS spread_kind, round(sp.spread, 9) AS spread_part, round(sd.spread, 9) AS spread_deck
FROM tree t LEFT JOIN tree u ON u.path = t.up AND u.depth = t.depth - 1 LEFT JOIN spreads sk ON sk.up = t.path AND sk.depth = t.depth AND sk.level = 'kind'
LEFT JOIN spreads sp ON sp.up = t.path AND sp.depth = t.depth AND sp.level = 'part' LEFT JOIN spreads sd ON sd.up = t.path AND sd.depth = t.depth AND sd.level = 'deck'""")
def _(t):
    spreads = (F.round(_spread(d), 9).alias(f"spread_{d}") for d in ("kind", "part", "deck"))
    level = F.try_element_at("path", F.lit(-1))["dim"].alias("level")
    rounded = (F.round(c, 9).alias(c) for c in ("value", "em", "delta"))
    return _tree(t).select(drill.path_text(F.col("path")).alias("path"), "depth", level, "n", "n_null", *rounded, *spreads)


@query("v07_lost_leaves", f"""WITH {_TREE}
SELECT k.up AS path, k.level AS dimension, t.n AS parent_n, (sum(k.n) FILTER (WHERE kept))::BIGINT AS children_n, t.n_null AS parent_null, (sum(k.n_null) FILTER (WHERE kept))::BIGINT AS children_null,
  count(*) AS children_made, count(*) FILTER (WHERE kept) AS children_left
FROM (SELECT *, path NOT IN (chr(92) || 'N/' || chr(92) || 'N', '(null)/b') OR level <> 'part' AS kept FROM tree) k JOIN tree t ON t.path = k.up AND t.depth = k.depth - 1
GROUP BY k.up, k.level, t.n, t.n_null HAVING count(*) > count(*) FILTER (WHERE kept)""")
def _(t):
    # Two leaves are lost: null beneath null, and "b" beneath the text "(null)".
    last = F.try_element_at("path", F.lit(-1))
    first = F.get("path", F.lit(0))["value"]
    lost = (F.col("depth") == 2) & (last["dim"] == "part") & ((first.isNull() & last["value"].isNull()) | (first.eqNullSafe("(null)") & last["value"].eqNullSafe("b")))
    bad = drill.violations(_tree(t).where(~F.coalesce(lost, F.lit(False))))
    return bad.withColumn("path", drill.path_text(F.col("path")))


@query("k04_drill_rows", f"""WITH {_TREE}
SELECT t.path, t.depth::INT AS depth, CASE WHEN t.depth = 0 THEN 'root' ELSE 'node' END AS kind, t.level, t.n AS n_scored, t.n_null, round(t.value, 9) AS value, round(100 * (t.value - u.value), 9) AS delta_pp,
  round(100 * s.spread, 9) AS children_spread_pp, t.n < 30 AND t.depth > 0 AS small_n
FROM tree t LEFT JOIN tree u ON u.path = t.up AND u.depth = t.depth - 1
LEFT JOIN (SELECT up, depth, count(*) AS dims, any_value(spread) AS spread FROM (SELECT k.up, k.depth - 1 AS depth, k.level, any_value(s.spread) AS spread FROM tree k LEFT JOIN spreads s ON s.up = k.up AND s.depth = k.depth - 1 AND s.level = k.level WHERE k.depth > 0 GROUP BY k.up, k.depth, k.level) GROUP BY up, depth) s
  ON s.up = t.path AND s.depth = t.depth AND s.dims = 1
UNION ALL
SELECT t.path, (t.depth + 1)::INT, 'dim', g.level, t.n, t.n_null, round(t.value, 9), NULL, round(100 * s.spread, 9), false
FROM (SELECT DISTINCT up, depth - 1 AS depth, level FROM tree WHERE depth = 2 AND up <> 'a') g JOIN tree t ON t.path = g.up AND t.depth = g.depth LEFT JOIN spreads s ON s.up = g.up AND s.depth = g.depth AND s.level = g.level""")
def _(t):
    rows = drill.flat_rows(_tree(t))
    return rows.select("path", "depth", "kind", "level", "n_scored", "n_null", *(F.round(c, 9).alias(c) for c in ("value", "delta_pp", "children_spread_pp")), "small_n")
