"""Drill-downs as trees of structural keys.

A node's key is its path: an array of (dim, value, merged). A null value is a key of its own beside any
text, a value with a separator in it is one value, and the remainder of a split that keeps its largest
groups says how many values it merges, so that no value can be taken for it. Paths become text only
for people (path_text), in a form that can be read back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalframe.storage import stored

SUPPRESS_BELOW = 30


@dataclass(frozen=True)
class Dim:
    """One way to split a node. Every dimension of `then` splits its groups again."""

    name: str
    value: Column
    then: tuple[Dim, ...] = ()
    #: Keep so many groups of a parent, the largest by rows (ties by value, null last), and merge the rest.
    top_k: int | None = None
    other: str = "others"
    #: Split only groups of the dimension above whose value it holds for.
    under: Callable[[Column], Column] | None = None


def chains(dims: tuple[Dim, ...], above: tuple[Dim, ...] = ()) -> list[tuple[Dim, ...]]:
    """Every way from the root to a last dimension."""
    return [c for d in dims for c in (chains(d.then, (*above, d)) if d.then else [(*above, d)])]


def drill_tree(df: DataFrame, dims: tuple[Dim, ...], score: Column, means: dict[str, Column] | None = None, min_n: int = SUPPRESS_BELOW) -> DataFrame:
    """A row a node: path, depth, n, n_null, value (mean score), each of means, delta to the parent, splits.

    means are over scored rows. splits has, for each dimension that splits the node: dim, children, and spread, the
    largest less the smallest value of its children of min_n scored rows at least; null with fewer than two of those.

    The rows are read and reduced once a way from the root to a last dimension; all levels are sums of that.
    """
    means = means or {}
    names = list(means)
    done: set[tuple[str, ...]] = set()
    levels: list[DataFrame] = []
    for chain in chains(dims) or [()]:
        levels += _levels(df, chain, score, means, done)
    nodes = reduce(DataFrame.unionByName, levels)
    mean = lambda s, n: F.try_divide(F.col(s), F.col(n))
    nodes = nodes.select("path", F.size("path").alias("depth"), "n", "n_null", mean("_s", "n").alias("value"), *(mean(f"_s_{m}", f"_n_{m}").alias(m) for m in names))
    parent = F.slice("path", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))
    kids = nodes.where("depth > 0").select(parent.alias("_at"), F.try_element_at("path", F.lit(-1))["dim"].alias("_dim"), "n", "value")
    large = F.when((F.col("n") >= min_n) & F.col("value").isNotNull(), F.col("value"))
    each = kids.groupBy("_at", "_dim").agg(F.count(F.lit(1)).alias("children"), F.when(F.count(large) >= 2, F.max(large) - F.min(large)).alias("spread"))
    splits = each.groupBy("_at").agg(F.sort_array(F.collect_list(F.struct(F.col("_dim").alias("dim"), "children", "spread"))).alias("splits"))
    up = nodes.select(F.col("path").alias("_up"), F.col("value").alias("_above"))
    out = nodes.withColumn("_parent", F.when(F.col("depth") > 0, parent)).join(up, F.col("_parent") == F.col("_up"), "left")
    out = out.join(splits, F.col("path") == F.col("_at"), "left")
    none = F.array().cast("array<struct<dim:string,children:bigint,spread:double>>")
    return out.select(
        "path", "depth", "n", "n_null", "value", *names, (F.col("value") - F.col("_above")).alias("delta"), F.coalesce("splits", none).alias("splits")
    )


def _levels(df: DataFrame, chain: tuple[Dim, ...], score: Column, means: dict[str, Column], done: set) -> list[DataFrame]:
    """The nodes of each level of a chain that is not done yet: path, n, n_null and sums."""
    scored = score.isNotNull()
    sums = [F.count(score).alias("n"), F.count_if(~scored).alias("n_null"), F.sum(score).alias("_s")]
    for m, c in means.items():
        sums += [F.sum(F.when(scored, c)).alias(f"_s_{m}"), F.count(F.when(scored, c)).alias(f"_n_{m}")]
    added = ["n", "n_null", "_s", *(f"_{k}_{m}" for m in means for k in "sn")]
    values = [d.value.cast("string").alias(f"_v{i}") for i, d in enumerate(chain)]
    cur = df.groupBy(*values).agg(*sums)
    if any(d.top_k is not None for d in chain):
        cur = stored(cur, "leaves")
    again = [F.sum(c).alias(c) for c in added]
    kind = "array<struct<dim:string,value:string,merged:int>>"
    out = []
    if () not in done:
        done.add(())
        # Without rows there is still a root.
        whole = cur.agg(*again).withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in added if c[:2] != "_s"})
        out.append(whole.withColumn("path", F.array().cast(kind)))
    keys: list[str] = []
    for i, d in enumerate(chain):
        if d.under is not None and i:
            cur = cur.where(d.under(F.col(f"_v{i - 1}")))
        cur = cur.withColumn(f"_m{i}", F.lit(0)) if d.top_k is None else _merged(cur, keys, f"_v{i}", d)
        keys += [f"_v{i}", f"_m{i}"]
        name = tuple(x.name for x in chain[: i + 1])
        if name in done:
            continue
        done.add(name)
        path = F.array(*(F.struct(F.lit(x.name).alias("dim"), F.col(f"_v{j}").alias("value"), F.col(f"_m{j}").alias("merged")) for j, x in enumerate(chain[: i + 1])))
        out.append(cur.groupBy(*keys).agg(*again).select(path.cast(kind).alias("path"), *added))
    return [x.select("path", *added) for x in out]


def _merged(cur: DataFrame, keys: list[str], value: str, dim: Dim) -> DataFrame:
    """cur with the values of a dimension that are not among the largest of their parent replaced by the remainder, which counts them."""
    mark = f"_m{value[2:]}"
    groups = cur.groupBy(*keys, value).agg((F.sum("n") + F.sum("n_null")).alias("_c"))
    parents = keys or [F.lit(0)]
    # A rank with a limit: each task keeps no more than top_k groups of a parent before the shuffle.
    rank = F.row_number().over(W.partitionBy(*parents).orderBy(F.desc("_c"), F.col(value).asc_nulls_last()))
    kept = groups.withColumn("_r", rank).where(F.col("_r") <= dim.top_k)
    totals = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("_groups"))
    same = lambda a, names: reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"{a}{k}")) for k in names), F.lit(True))
    k = kept.select(*(F.col(c).alias(f"_k{c}") for c in [*keys, value]), F.lit(True).alias("_kept"))
    n = totals.select(*(F.col(c).alias(f"_t{c}") for c in keys), "_groups")
    both = cur.join(k, same("_k", [*keys, value]), "left")
    both = both.join(n, same("_t", keys)) if keys else both.crossJoin(n)  # one row
    new = {value: F.when(F.col("_kept"), F.col(value)).otherwise(F.lit(dim.other)), mark: F.when(F.col("_kept"), 0).otherwise(F.col("_groups") - dim.top_k).cast("int")}
    return both.select(*(c for c in cur.columns if c != value), *(v.alias(c) for c, v in new.items()))


def violations(tree: DataFrame) -> DataFrame:
    """Splits whose children are not as many as when the tree was made, or whose numbers don't add up to the parent's."""
    parent = F.slice("path", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))
    kids = tree.where("depth > 0").groupBy(parent.alias("_at"), F.try_element_at("path", F.lit(-1))["dim"].alias("_dim")).agg(
        F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"), F.sum("n_null").alias("_u")
    )
    want = tree.select("path", "depth", "n", "n_null", F.inline("splits"))
    both = want.join(kids, (F.col("path") == F.col("_at")) & (F.col("dim") == F.col("_dim")), "left")
    both = both.select(
        "path", F.col("dim").alias("dimension"), F.col("n").alias("parent_n"), F.coalesce("_n", F.lit(0)).alias("children_n"), F.col("n_null").alias("parent_null"),
        F.coalesce("_u", F.lit(0)).alias("children_null"), F.col("children").alias("children_made"), F.coalesce("_k", F.lit(0)).alias("children_left"),
    )
    return both.where("parent_n <> children_n OR parent_null <> children_null OR children_made <> children_left")


def path_text(path: Column) -> Column:
    """The values joined by "/": a backslash or slash within one has a backslash before it, null is \\N, a remainder begins with \\+ and ends with its number."""
    plain = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/"))
    told = lambda p: F.when(p["merged"] > 0, F.concat(F.lit("\\+"), plain(p["value"]), F.lit(" x"), p["merged"].cast("string"))).otherwise(
        F.coalesce(plain(p["value"]), F.lit("\\N"))
    )
    return F.array_join(F.transform(path, told), "/")


def flat_rows(tree: DataFrame, small: int = SUPPRESS_BELOW) -> DataFrame:
    """A tree as rows of plain columns, for files that people open: a row a node, and one a split where several dimensions split a node."""
    node = tree.select(
        path_text(F.col("path")).alias("path"), "depth", F.when(F.col("depth") == 0, "root").otherwise("node").alias("kind"),
        F.try_element_at("path", F.lit(-1))["dim"].alias("level"), F.col("n").alias("n_scored"), "n_null", "value", (100 * F.col("delta")).alias("delta_pp"),
        F.when(F.size("splits") == 1, 100 * F.get("splits", F.lit(0))["spread"]).alias("children_spread_pp"), ((F.col("n") < small) & (F.col("depth") > 0)).alias("small_n"),
    )
    dims = tree.where(F.size("splits") > 1).select("path", "depth", "n", "n_null", "value", F.inline("splits")).select(
        path_text(F.col("path")).alias("path"), (F.col("depth") + 1).alias("depth"), F.lit("dim").alias("kind"), F.col("dim").alias("level"), F.col("n").alias("n_scored"), "n_null", "value",
        F.lit(None).cast("double").alias("delta_pp"), (100 * F.col("spread")).alias("children_spread_pp"), F.lit(False).alias("small_n"),
    )
    return node.unionByName(dims)
