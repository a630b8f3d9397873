from evalframe import plans
from evalframe.operators import graph
from evalframe.plans.base import Tables

SF_DIR = "/root/testdata/sf0.001"


def table_edges(spark):
    t = Tables(spark, SF_DIR)
    suppliers = [(r.s_suppkey % 50, r.s_nationkey) for r in t.supplier.collect()]
    return {(r.c_nationkey, n) for r in t.customer.collect() for m, n in suppliers if r.c_custkey % 50 == m}


def bfs(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in near:
        front, depth = {start}, 0
        while front:
            out.update({(start, n): depth for n in front})
            front, depth = {b for n in front for b in near[n] if (start, b) not in out}, depth + 1
    return out


def test_queries_take_whole_tables(spark):
    edges = table_edges(spark)
    got = {(r.src, r.node): r.hops for r in plans.QUERIES["r04_hops_whole"](spark, SF_DIR).collect()}
    assert got == bfs(edges)
    rows = plans.QUERIES["r02_has_edge_whole"](spark, SF_DIR).collect()
    assert rows and all(r.has_edge == ((r.a, r.b) in edges) for r in rows)


def test_hops_end_with_the_frontier(spark):
    edges = [(1, i, i + 1) for i in range(67)] + [(2, 0, 1)]
    e, s = spark.createDataFrame(edges, "gid int, src int, dst int"), spark.createDataFrame([(1, 0), (2, 1)], "gid int, src int")
    got = {(r.gid, r.node): r.hops for r in graph.hops(e, s).collect()}
    assert got == {**{(1, i): i for i in range(68)}, (2, 1): 0, (2, 0): 1}
    assert graph.hops(e, s, 3).count() == 6
