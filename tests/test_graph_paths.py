import random
from collections import deque

from pyspark.sql import functions as F

from evalframe.operators import graph

NODES, EDGES = "gid int, id string, label string", "gid int, src string, dst string, style string, seq int"


def charts(n=14, seed=2):
    rnd = random.Random(seed)
    nodes, edges = [], []
    for g in range(n):
        size = rnd.randrange(1, 12)
        nodes += [(g, f"i{k}", f"L{k * 7 % 12:02d}") for k in range(size)]
        if size > 3:
            nodes.append((g, "z", "L00"))  # a label on two nodes
        edges += [(g, f"i{rnd.randrange(size)}", f"i{rnd.randrange(size)}", "solid", k) for k in range(rnd.randrange(0, 2 * size))]
    nodes += [(99, f"i{k}", f"x{k}") for k in range(3)]
    edges += [(99, f"i{a}", f"i{b}", "solid", a) for a in range(3) for b in range(3)]  # all connected
    return nodes, edges


def test_the_pair_is_the_picked_one_of_all(spark):
    nodes, edges = charts()
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    place = {r.gid: r.h for r in n.select("gid", F.xxhash64(F.lit(7), "gid").alias("h")).distinct().collect()}
    want = set()
    for g in place:
        ids = {}
        for gid, i, label in nodes:
            if gid == g:
                ids[label] = max(i, ids.get(label, ""))
        near = {frozenset((s, d)) for gid, s, d, *_ in edges if gid == g}
        free = [(a, b) for a in sorted(ids) for b in sorted(ids) if a < b and frozenset((ids[a], ids[b])) not in near]
        if free:
            want.add((g, *free[place[g] % len(free)]))
    assert {tuple(r) for r in graph.unconnected_pair(n, e, 7).collect()} == want and len(want) > 8


def bfs(edges, g, a, b, directed):
    steps = {}
    for gid, s, d, *_ in edges:
        if gid == g:
            steps.setdefault(s, set()).add(d)
            if not directed:
                steps.setdefault(d, set()).add(s)
    far, todo = {a: 0}, deque([a])
    while todo:
        x = todo.popleft()
        for y in steps.get(x, ()):
            if y not in far:
                far[y] = far[x] + 1
                todo.append(y)
    return far.get(b)


def test_hops_between_asked_pairs(spark):
    rnd = random.Random(9)
    edges = [(0, f"v{i}", f"v{i + 1}", "solid", i) for i in range(11)]  # a long way
    edges += [(1, f"v{rnd.randrange(60)}", f"v{rnd.randrange(60)}", "solid", i) for i in range(80)]
    ids = {(g, x) for g, s, d, *_ in edges for x in (s, d)} | {(1, "alone")}
    nodes = [(g, x, x.upper()) for g, x in sorted(ids)]
    asked = [(0, "V0", "V11"), (0, "V11", "V0"), (0, "V3", "V3"), (0, "V0", "nowhere"), (1, "ALONE", "V1"), (0, None, "V1"), (0, "V0", "V11")]
    asked += [(1, f"V{rnd.randrange(60)}", f"V{rnd.randrange(60)}") for _ in range(30)]
    n, e, p = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, "gid int, a string, b string")
    for directed in (False, True):
        got = graph.hops_between(p, n, e, directed).collect()
        known = {(g, label): x for g, x, label in nodes}
        want = []
        for g, a, b in asked:
            x, y = known.get((g, a)), known.get((g, b))
            want.append((g, a, b, None if x is None or y is None else bfs(edges, g, x, y, directed)))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        assert max(r.hops or 0 for r in got) >= 11


def test_small_charts_are_moved_once_and_larger_ones_give_the_same_pairs(spark, monkeypatch):
    nodes, edges = charts()
    nodes += [(98, None, "no id"), (98, "a", None), (98, "a", "la"), (98, "b", "lb"), (None, "a", "x"), (None, "b", "y")]
    edges += [(98, "a", "a", "solid", 0), (98, None, "b", "solid", 1)]
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    pairs = lambda: sorted(map(str, graph.unconnected_pair(n, e, 7).collect()))
    split = []
    for most in ((0, 0), (5, 6)):
        monkeypatch.setattr(graph, "SMALL_CHART", most)
        split.append(pairs())
    monkeypatch.setattr(graph, "SMALL_CHART", (32, 128))
    monkeypatch.setattr(graph.windows, "positions", None)  # nothing is dealt into ranges
    assert split == [pairs()] * 2 and len(split[0]) > 8
