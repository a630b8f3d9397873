"""Components of exactly verified links inside buckets, without making a bucket's pairs at once.

Ids in a bucket are candidates of each other; of buckets of the same ids one is kept. A bucket of
two is one check. In larger ones each id is first held against the one leader that it shares most
buckets with, a bucket's leader being the id that stands in most buckets (of edited copies, the
least edited one shares most), and then, while many are found to link, against one id of its
bucket's largest component. What then still holds ids of
several components is settled in rounds: a few ids of each open bucket, drawn by hash, lead;
every other id of another component is held against them, and a leader is done with its bucket.
Each round quadruples the leaders, so even a bucket whose ids never link ends after a number of
rounds that grows with the logarithm of its size, and its pairs are only made as far as no link
found on the way has put both ids into one component. So a group of n near copies costs about n
checks, and no link between components is lost.

Tables that grow with the input are joined by sorting (merge hints): stored tables compress so
well that their file size would pass for a small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.common import components, discard, join_small, materialize, parts, semi_join

Side = Callable[[str], Column]
Verify = Callable[[DataFrame, bool], DataFrame]
#: Leaders of a bucket in the first of the rounds.
FIRST = 4


def link_groups(
    keyed: DataFrame,
    prepare: Callable[[DataFrame], tuple[DataFrame | None, Verify]],
    may_link: Callable[[Side, Side], Column] | None = None,
) -> DataFrame:
    """(node, component) of the linked ids; keyed has t (bucket) and id (a long), each pair once.

    prepare gets the ids that share a bucket with another and returns facts (a table by id that
    may_link, a necessary condition of a link, reads of either side; or None) and verify, which takes
    distinct pairs (a, b), a < b, and whether they met may_link already, and returns those that link.
    Ids without a link are missing from the result; an empty table gives an empty one.
    """
    ends = keyed.groupBy("t").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("id")).alias("_ids"))
    # Buckets of the same ids have the same pairs.
    ends = materialize(ends.where("lo <> hi").groupBy("lo", "hi", "_n", "_ids").agg(F.min("t").alias("t")), "buckets")
    larger = ends.where("_n > 2").select("t", "_n")
    rows = join_small(keyed, larger, ["t"], larger.count(), "inner")
    rows = materialize(rows.withColumn("_w", F.count(F.lit(1)).over(Window.partitionBy("id"))), "rows")
    twos = ends.where("_n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
    ids = rows.select("id").unionByName(twos.select(F.col("a").alias("id"))).unionByName(twos.select(F.col("b").alias("id")))
    facts, verify = prepare(ids.distinct())

    heads = rows.groupBy("t").agg(F.max_by("id", F.struct("_w", "id")).alias("lead"))
    heads = materialize(heads, "heads")
    shared = rows.join(heads.hint("merge"), "t").where("id <> lead").groupBy("id", "lead").agg(F.count(F.lit(1)).alias("c"))
    led = shared.groupBy("id").agg(F.max_by("lead", F.struct("c", "lead")).alias("lead"))
    pairs = twos.unionByName(led.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")))
    links = materialize(verify(pairs.distinct(), False), "links")
    comp = materialize(components(links), "components")
    discard(links, ends, heads)

    def merged(comp: DataFrame, pairs: DataFrame) -> tuple[DataFrame, int]:
        """comp with the links among the pairs, and how many these are."""
        more = materialize(verify(pairs.coalesce(n).distinct(), may_link is not None), "links")
        found = more.count()
        if found:
            both = more.select("a", "b").unionByName(comp.select(F.col("component").alias("a"), F.col("node").alias("b")))
            new = materialize(components(both), "components")
            discard(comp)
            comp = new
        discard(more)
        return comp, found

    def candidates(fresh: DataFrame, leads: DataFrame, once: Column | None = None) -> DataFrame:
        """Pairs of a bucket's ids and its leaders of another component that may link."""
        x, y = fresh.alias("x"), leads.hint("merge").alias("y")
        on = (F.col("x.t") == F.col("y.t")) & (F.col("x._comp") != F.col("y._comp"))
        if once is not None:
            on &= once
        if may_link is not None:
            on &= may_link(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
        return x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    # A place in [0, 1) by hash; the rounds go through a bucket's ids in this order.
    place = F.xxhash64("t", "id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    left = rows.select("t", "id", "_n", "_w").withColumn("_u", place)
    n_rows = rows.count()
    n = parts(n_rows)
    done, step, turn = 0, FIRST, 0
    while True:
        stored = _open(left, comp, n_rows)
        discard(rows)
        rows, n_rows = stored, stored.count()
        n = parts(n_rows)
        if not n_rows:
            discard(rows)
            return comp
        fresh = rows
        if facts is not None:
            # Only what the ids that are left need is moved.
            near = semi_join(facts, rows.select("id").distinct(), ["id"], n_rows)
            fresh = materialize(rows.join(near.hint("merge"), "id"), "rows", 4 * n_rows)
        if turn >= 0:
            # While it pays, all others are held against one id of the bucket's largest component, another one each time.
            best = F.struct("_w", "id") if turn == 0 else F.xxhash64("id", F.lit(turn))
            sizes = fresh.groupBy("t", "_comp").agg(F.count(F.lit(1)).alias("c"), F.max_by("id", best).alias("id"))
            leads = sizes.groupBy("t").agg(F.max_by(F.struct("id", "_comp"), F.struct("c", "id")).alias("m")).select("t", "m.id")
            leads = materialize(fresh.join(leads.hint("merge"), ["t", "id"]), "leads", n_rows)
            pairs = materialize(candidates(fresh, leads), "pairs", n_rows)
            tried = pairs.count()
            comp, found = merged(comp, pairs)
            discard(leads, pairs)
            turn = turn + 1 if found > tried // 4 and turn < 3 else -1
            left = rows.select("t", "id", "_n", "_w", "_u")
        else:
            first = F.col("_u") * F.col("_n") < F.lit(float(done + step))
            # Two leaders meet once, by the order of their ids.
            once = (F.col("x._u") * F.col("x._n") >= F.lit(float(done + step))) | (F.col("x.id") > F.col("y.id"))
            comp, _ = merged(comp, candidates(fresh, fresh.where(first), once))
            done, step = done + step, step * 4
            left = rows.where(F.col("_u") * F.col("_n") >= F.lit(float(done))).select("t", "id", "_n", "_w", "_u")
        if facts is not None:
            discard(fresh)


def _open(rows: DataFrame, comp: DataFrame, n_rows: int) -> DataFrame:
    """Rows of the buckets that still hold ids of several components, with each id's component; stored."""
    named = comp.select(F.col("node").alias("id"), "component").hint("merge")
    rows = rows.join(named, "id", "left").withColumn("_comp", F.coalesce("component", "id")).drop("component")
    rows = materialize(rows, "rows", n_rows)
    open_ = rows.groupBy("t").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).where("_lo <> _hi").select("t")
    open_ = materialize(open_, "open", n_rows)
    out = materialize(rows.join(open_.hint("merge"), "t", "left_semi"), "rows", n_rows)
    discard(rows, open_)
    return out
