"""Shortest ways between asked pairs of a graph of orders and what they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import graph
from evalframe.plans.base import query

#: An order and the parts it holds, by how they came back: a graph of many thousand nodes; of each nation its first and its last order are asked.
_E = """e0 AS (SELECT DISTINCT 'o' || l_orderkey::VARCHAR AS a, 'p' || l_partkey::VARCHAR || l_returnflag AS b FROM lineitem),
e AS (SELECT a AS src, b AS dst FROM e0 UNION ALL SELECT b, a FROM e0),
asked AS (SELECT c_nationkey AS nation, 'o' || min(o_orderkey)::VARCHAR AS a, 'o' || max(o_orderkey)::VARCHAR AS b FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey)"""


@query("r04_hops_between", f"""WITH RECURSIVE {_E},
walk(src, node, d) AS (SELECT DISTINCT a, a, 0 FROM asked UNION SELECT walk.src, e.dst, d + 1 FROM walk JOIN e ON e.src = walk.node WHERE d < 12),
near AS (SELECT src, node, min(d) AS hops FROM walk GROUP BY src, node)
SELECT nation, a, b, hops::INT AS hops FROM asked LEFT JOIN near ON near.src = a AND near.node = b""")
def _(t):
    order = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    edges = t.lineitem.select(F.lit(0).alias("gid"), order.alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"), "l_returnflag").alias("dst"))
    name = lambda c: F.concat(F.lit("o"), c.cast("string"))
    sold = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("nation"))
    asked = sold.agg(name(F.min("o_orderkey")).alias("a"), name(F.max("o_orderkey")).alias("b")).withColumn("gid", F.lit(0))
    ids = t.orders.select(F.lit(0).alias("gid"), name(F.col("o_orderkey")).alias("id"))
    return graph.hops_between(asked, ids.withColumn("label", F.col("id")), edges).select("nation", "a", "b", "hops")
