"""Labelled graphs as tables: nodes (gid, id, label) and edges (gid, src, dst, style, seq)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.operators import windows
from evalframe.operators.dedup import first
from evalframe.storage import small_side, stored

_NODE = r"([A-Za-z0-9_]+)\s*(?:\[+|\(+|\{+)\s*\"?([^\]\)\}\"]*)\"?\s*(?:\]+|\)+|\}+)"
_EDGE = r"^\s*([A-Za-z0-9_]+)[^-=.]*?\s*(-->|==>|-\.->|---)\s*(?:\|[^|]*\|\s*)?([A-Za-z0-9_]+)"
#: How arrows are written and called.
STYLES = {"-->": "solid", "==>": "thick", "-.->": "dotted", "---": "open"}


def parse_flowcharts(df: DataFrame, gid: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of flowchart texts, one statement a line."""
    lines = df.select(F.col(gid).alias("gid"), F.posexplode(F.split(source, "\n")).alias("seq", "line"))
    style = F.create_map(*(x for k, v in STYLES.items() for x in (F.lit(k), F.lit(v))))
    edges = lines.where(F.col("line").rlike(_EDGE)).select(
        "gid", F.regexp_extract("line", _EDGE, 1).alias("src"), F.regexp_extract("line", _EDGE, 3).alias("dst"),
        style[F.regexp_extract("line", _EDGE, 2)].alias("style"), "seq",
    )
    ids, labels = (F.regexp_extract_all("line", F.lit(_NODE), F.lit(k)) for k in (1, 2))
    named = lines.select("gid", "seq", F.inline(F.arrays_zip(ids.alias("id"), labels.alias("label"))))
    nodes = first(named.withColumn("label", F.trim("label")), ["gid", "id"]).select("gid", "id", "label")
    return nodes, edges


def undirected(edges: DataFrame) -> DataFrame:
    swapped = {"src": "dst", "dst": "src"}
    return edges.unionByName(edges.select(*(F.col(swapped.get(c, c)).alias(c) for c in edges.columns)))


def has_edge(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """pairs (gid, a, b as labels) plus has_edge; null if a label is not in the graph."""
    n = nodes.select("gid", "id", "label")
    j = pairs.join(n.select("gid", F.col("label").alias("a"), F.col("id").alias("_a")), ["gid", "a"], "left")
    j = j.join(n.select("gid", F.col("label").alias("b"), F.col("id").alias("_b")), ["gid", "b"], "left")
    e = (edges if directed else undirected(edges)).select("gid", F.col("src").alias("_a"), F.col("dst").alias("_b"), F.lit(True).alias("_e")).distinct()
    j = j.join(e, ["gid", "_a", "_b"], "left")
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.select(*pairs.columns, F.when(known, F.coalesce("_e", F.lit(False))).alias("has_edge"))


def edge_style(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (gid, a, b as labels) plus style: of the first edge between the two, in either direction; null without one."""
    n = nodes.select("gid", "id", "label")
    j = pairs.join(n.select("gid", F.col("label").alias("a"), F.col("id").alias("_a")), ["gid", "a"], "left")
    j = j.join(n.select("gid", F.col("label").alias("b"), F.col("id").alias("_b")), ["gid", "b"], "left")
    e = undirected(edges).groupBy("gid", F.col("src").alias("_a"), F.col("dst").alias("_b")).agg(F.min_by("style", "seq").alias("style"))
    return j.join(e, ["gid", "_a", "_b"], "left").select(*pairs.columns, "style")


def ids_of_labels(nodes: DataFrame) -> DataFrame:
    """gid, label, id: the largest id of those that share a label."""
    return nodes.groupBy("gid", "label").agg(F.max("id").alias("id"))


#: Rows of nodes and of edges up to which a chart is one row of arrays.
SMALL_CHART = (32, 128)


def unconnected_pair(nodes: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """gid, a, b: one pair of labels (a before b) without an edge in either direction, picked by a hash of seed and gid
    among all such pairs of the chart in the order of their labels.

    Charts are counted first: those up to SMALL_CHART are moved once, as a row each; larger ones are never held whole.
    Charts in which all labels are connected give no row, nor do rows without a gid.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sizes = nodes.select("gid", one.alias("n"), none.alias("e")).unionByName(edges.select("gid", none.alias("n"), one.alias("e")))
    sizes = sizes.where("gid IS NOT NULL").groupBy("gid").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    large = stored(sizes.where((F.col("n") > SMALL_CHART[0]) | (F.col("e") > SMALL_CHART[1])).select("gid"), "large")
    if large.isEmpty():
        return _pair_of_small(nodes, edges, seed)
    told = small_side(large)
    kind = lambda how: (df.join(told, "gid", how) for df in (nodes, edges))
    return _pair_of_small(*kind("left_anti"), seed).unionByName(_pair_of_large(*kind("left_semi"), seed))


def _pair_of_small(nodes: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """unconnected_pair of charts that a row holds: both tables are dealt by gid once, and what follows stays there."""
    dealt = nodes.where("gid IS NOT NULL").select("gid", "id", "label").repartition("gid")
    charts = ids_of_labels(dealt).groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("label", "id"))).alias("labels"))
    linked = edges.where("gid IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").select("gid", "src", "dst").repartition("gid")
    # Least and greatest end: an edge counts in either direction.
    ends = lambda x, y: F.struct(F.least(x, y), F.greatest(x, y))
    linked = linked.groupBy("gid").agg(F.collect_set(ends(F.col("src"), F.col("dst"))).alias("edges"))
    both = charts.join(linked.hint("merge"), "gid", "left")
    joined = lambda x, y: F.coalesce(F.array_contains("edges", ends(x["id"], y["id"])), F.lit(False))
    apart = lambda x, y: x["id"].isNull() | y["id"].isNull() | ~joined(x, y)
    behind = lambda x, i: F.filter(F.slice("labels", i + 2, F.size("labels")), lambda y: apart(x, y))
    pairs = F.flatten(F.transform("labels", lambda x, i: F.transform(behind(x, i), lambda y: F.struct(x["label"].alias("a"), y["label"].alias("b")))))
    place = lambda p: F.pmod(F.xxhash64(F.lit(seed), F.col("gid")), F.nullif(F.size(p), F.lit(0)).cast("long")).cast("int")
    # Bound once, for their number and the one that is picked.
    picked = F.filter(F.transform(F.array(pairs), lambda p: F.get(p, place(p))), lambda p: p.isNotNull())
    return both.select("gid", F.inline(picked))


def _pair_of_large(nodes: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """unconnected_pair of charts of any size.

    Pairs are counted, not made: a label has as many as there are labels behind it less its neighbours among these.
    The label in which the picked place falls, and the label behind it that leaves as many free ones before it, are
    found by numbers of rows.
    """
    placed = windows.positions(ids_of_labels(nodes), ["label"], ["gid"])
    placed = stored(placed.select("gid", "label", "id", F.col("_row").alias("r"), F.col("_n").alias("labels")), "labels")
    x, y = (placed.select("gid", F.col("id").alias(c), F.col("r").alias(f"r{c}")) for c in ("src", "dst"))
    near = edges.select("gid", "src", "dst").join(x, ["gid", "src"]).join(y, ["gid", "dst"])
    near = near.select("gid", F.least("rsrc", "rdst").alias("r"), F.greatest("rsrc", "rdst").alias("rb")).where("r < rb").distinct()
    near = stored(near, "near")
    degree = near.groupBy("gid", "r").agg(F.count(F.lit(1)).alias("_d"))
    free = placed.join(degree, ["gid", "r"], "left").select("gid", "r", "label", (F.col("labels") - F.col("r") - F.coalesce("_d", F.lit(0))).alias("free"))
    summed = windows.prefix_sums(free, ["gid"], "r", "free").where("_n > 0")
    pick = F.pmod(F.xxhash64(F.lit(seed), F.col("gid")), F.col("_n")) - F.col("_before")
    first = summed.withColumn("k", pick).where("k >= 0 AND k < free").select("gid", "r", F.col("label").alias("a"), "k")
    first = stored(first, "first")
    # Of the neighbours behind it, those that have no more than k free labels before them lie before the picked one.
    behind = windows.positions(near.join(first, ["gid", "r"]).select("gid", "r", "rb", "k"), ["rb"], ["gid"])
    passed = behind.groupBy("gid").agg(F.count_if(F.col("rb") - F.col("r") - F.col("_row") <= F.col("k")).alias("_m"))
    told = first.join(passed, "gid", "left").select("gid", "a", (F.col("r") + 1 + F.col("k") + F.coalesce("_m", F.lit(0))).alias("r"))
    return told.join(placed.select("gid", "r", F.col("label").alias("b")), ["gid", "r"]).select("gid", "a", "b")


def hops_between(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """Asked pairs (gid, a, b as labels) plus hops: fewest edges from a to b; 0 to itself, null if a label is unknown or nothing leads there.

    Both ends are searched breadth first, a level at a time in turn, and a pair is done when its two searches meet or
    one of them arrives nowhere new; so only nodes within about half of the way are held, and only for pairs that are open.
    """
    ids = ids_of_labels(nodes)
    end = lambda c: ids.select("gid", F.col("label").alias(c), F.col("id").alias(f"_{c}"))
    known = stored(pairs.select("gid", "a", "b").distinct().join(end("a"), ["gid", "a"]).join(end("b"), ["gid", "b"]), "pairs")
    pair = ["gid", "_a", "_b"]
    out = [known.where("_a = _b").select(*pair, F.lit(0).alias("hops"))]
    open_ = known.where("_a <> _b").select(*pair).distinct()
    e = stored((edges if directed else undirected(edges)).select("gid", "src", "dst").where("src <> dst").distinct(), "edges")
    steps = {"_a": e.select("gid", F.col("src").alias("n"), F.col("dst").alias("m")), "_b": e.select("gid", F.col("dst").alias("n"), F.col("src").alias("m"))}
    front = {s: open_.select(*pair, F.col(s).alias("n")) for s in steps}
    seen, depth, side = dict(front), 0, "_a"
    while True:
        depth += 1
        other = "_b" if side == "_a" else "_a"
        new = front[side].join(steps[side], ["gid", "n"]).select(*pair, F.col("m").alias("n")).distinct()
        # Stored each round, else the plan grows by a level a round.
        new = stored(new.join(seen[side], [*pair, "n"], "left_anti"), "front")
        met = stored(new.join(seen[other], [*pair, "n"], "left_semi").select(*pair).distinct(), "met")
        out.append(met.withColumn("hops", F.lit(depth)))
        # Open pairs arrived somewhere new and have not met.
        still = stored(new.select(*pair).distinct().join(met, pair, "left_anti"), "open")
        if still.isEmpty():
            break
        left = lambda rows: rows.join(still, pair, "left_semi")  # noqa: E731, B023
        front, seen = {side: left(new), other: left(front[other])}, {side: left(seen[side].unionByName(new)), other: left(seen[other])}
        if depth % 4 == 0:
            front, seen = ({s: stored(d, "reached") for s, d in x.items()} for x in (front, seen))
        side = other
    found = reduce(DataFrame.unionByName, out)
    told = known.join(found, pair).select("gid", "a", "b", "hops")
    return pairs.join(told, ["gid", "a", "b"], "left").select(*pairs.columns, "hops")


def hops(edges: DataFrame, sources: DataFrame, limit: int | None = None, directed: bool = False) -> DataFrame:
    """Fewest edges from each (gid, src) to every node it reaches: gid, src, node, hops; 0 to itself.

    Breadth first until a round arrives nowhere new; only where a `limit` is asked for, no deeper than that.
    """
    e = (edges if directed else undirected(edges)).select("gid", "src", "dst").distinct()
    found = sources.select("gid", "src", F.col("src").alias("node"), F.lit(0).alias("hops")).distinct()
    front, reached = found, found
    depth = 0
    while limit is None or depth < limit:
        depth += 1
        step = front.select("gid", "src", F.col("node").alias("_n")).join(e.select("gid", F.col("src").alias("_n"), "dst"), ["gid", "_n"])
        step = step.select("gid", "src", F.col("dst").alias("node")).distinct()
        # Stored each round, else the plan grows by a level a round.
        front = stored(step.join(reached.select("gid", "src", "node"), ["gid", "src", "node"], "left_anti").withColumn("hops", F.lit(depth)))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
        reached = stored(reached) if depth % 16 == 0 else reached
    return reached


def graph_f1(a: DataFrame, b: DataFrame, items: str, by: str = "gid") -> DataFrame:
    """F1 of two item sets per graph; two empty sets agree."""
    x, y = a.select(by, F.col(items).alias("_x")), b.select(by, F.col(items).alias("_y"))
    j = x.join(y, by)
    both = F.size(F.array_intersect("_x", "_y"))
    total = F.size(F.array_distinct("_x")) + F.size(F.array_distinct("_y"))
    return j.select(by, F.when(total == 0, 1.0).otherwise(F.try_divide(2.0 * both, total)).alias("f1"), (both * 2 == total).alias("exact"))
