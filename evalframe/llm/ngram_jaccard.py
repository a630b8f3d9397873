"""Near-duplicate documents by the Jaccard similarity of word n-grams, with vertical partitioning.

The global n-gram order is the order of 64-bit n-gram hashes. It is cut into fragments, ranges of
hashes, and each is used on its own:

1. The first fragment (30 % of the range; all of it for small sets) counts, per n-gram, whether
   more than one set holds it. A set that links to another shares at least the threshold's part
   of its n-grams, so one with more unshared n-grams in the fragment than that allows links with
   nothing and is done. That is exact, and most sets of a corpus end here.
2. Among the rest, n-grams are ranked rare first and each set's prefix, of which linked sets must
   share one, gives its buckets (unshared n-grams take up places of the prefix but no bucket).
3. Candidate pairs are checked fragment by fragment: partial overlaps are counted separately and
   summed per pair; the threshold is compared in integers.

Equal sets are one class from the start. Within buckets only as many pairs are made as are needed
to settle the components (see linking). Edge cases: null or empty text has an empty set, which
links with nothing; a text of fewer words than n is one n-gram; rows that repeat a key belong
together, also with different texts; ties go to the smallest key; an empty table gives an empty
result. Other columns are ignored, whatever their names. Equal sets are told by 128 bits, linked
by 64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.batches import map_texts
from evalframe.llm.common import components, discard, materialize, only_ids, semi_join
from evalframe.llm.linking import link_groups
from evalframe.llm.token_hash import WordHashes, signed, windows


@dataclass(frozen=True)
class Settings:
    n: int = 5
    threshold_pct: int = 80
    first_fragment: float = 0.3
    small_set: int = 80  # sets below this size are counted over the whole range
    fragments: int = 8  # of the pair check


#: Of each of 2,048 ranges of the hash order, whether a set holds an odd number there; 64 ranges a column.
PARITY = tuple(f"p{k}" for k in range(32))


def shingle_set(words: list[bytes], n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; of a shorter text, of its whole sequence."""
    return np.unique(windows(hashes.of(words), min(n, len(words)))) if words else np.zeros(0, np.uint64)


def _first_pass(docs: DataFrame, cfg: Settings, key: str, text: str) -> DataFrame:
    n, low = cfg.n, np.uint64(int(cfg.first_fragment * 2**64))
    # A partner of a small set is at most this large; it emits its whole range too.
    whole = -(-cfg.small_set * 100 // cfg.threshold_pct)

    def factory():
        hashes = WordHashes()

        def fn(texts):
            size, s1, s2, grams = [], [], [], []
            for t in texts:
                s = shingle_set((t or b"").lower().split(), n, hashes)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                size.append(len(s))
                s1.append((d >> 64) - (1 << 63))
                s2.append((d & ((1 << 64) - 1)) - (1 << 63))
                grams.append(signed(s if len(s) <= whole else s[: np.searchsorted(s, low)]))
            return [pa.array(size, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                    pa.array(grams, pa.list_(pa.int64()))]

        return fn

    return map_texts(docs, factory, "n bigint, s1 bigint, s2 bigint, grams array<bigint>", [key], text, rows=1000)


def _parities(sets: list[np.ndarray]) -> list[pa.Array]:
    """The columns of PARITY."""
    n = 64 * len(PARITY)
    shift = np.uint64(65 - n.bit_length())
    odd = np.zeros((len(sets), len(PARITY)), np.int64)
    for row, s in zip(odd, sets):
        row[:] = np.packbits(np.bincount((s >> shift).astype(np.int64), minlength=n) & 1).view(np.int64)
    return [pa.array(odd[:, k]) for k in range(len(PARITY))]


def _full_sets(docs: DataFrame, cfg: Settings, key: str, text: str) -> DataFrame:
    """id (half of the set's digest), n, the bits of PARITY, grams."""
    n = cfg.n

    def factory():
        hashes = WordHashes()

        def fn(texts):
            sets = [shingle_set((t or b"").lower().split(), n, hashes) for t in texts]
            ids = [(xxhash.xxh3_128_intdigest(s.tobytes()) >> 64) - (1 << 63) for s in sets]
            return [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    *_parities(sets),
                    pa.array([signed(s) for s in sets], pa.list_(pa.int64()))]

        return fn

    fields = f"id bigint, n bigint, {', '.join(f'{p} bigint' for p in PARITY)}, grams array<bigint>"
    return map_texts(docs, factory, fields, [], text, rows=1000)


def _candidates(docs: DataFrame, cfg: Settings, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All sets, the classes of equal ones with their representative, full sets of classes that may link."""
    pct = cfg.threshold_pct
    # Differences that a link allows: on one side of n, and in both sets of together m.
    first = materialize(_first_pass(docs, cfg, key, text), "first")
    sets = materialize(first.select(F.col(key).alias("key"), "n", "s1", "s2"), "sets")
    classes = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("key").alias("rep"), F.max("n").alias("n"))
    classes = materialize(classes, "classes")
    low = int(cfg.first_fragment * 2**64)
    low = low if low < 2**63 else low - 2**64
    in_first = F.col("g").between(0, low - 1) if low >= 0 else (F.col("g") >= 0) | (F.col("g") < low)
    grams = first.select("s1", F.explode("grams").alias("g"))
    alone = grams.groupBy("g").agg(F.min("s1").alias("s1"), F.max("s1").alias("hi")).where("s1 = hi")
    alone = alone.groupBy("s1").agg(F.count(F.lit(1)).alias("all"), F.count_if(in_first).alias("low"))
    lone = F.coalesce(F.when(F.col("n") < cfg.small_set, F.col("all")).otherwise(F.col("low")), F.lit(0))
    left = classes.join(alone.hint("merge"), "s1", "left").where(lone * 100 <= F.col("n") * (100 - pct))
    left = materialize(left.select(F.col("rep").alias(key)).distinct(), "left")
    discard(first)

    part = semi_join(docs.select(key, text), left, [key], left.count())
    # A representative's key may stand on several texts; each is a set of its own.
    full = materialize(_full_sets(part, cfg, key, text).dropDuplicates(["id"]), "full")
    discard(left)
    return sets, classes, full


def near_duplicate_links(
    docs: DataFrame, cfg: Settings = Settings(), key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """links (a, b, a < b: every pair of representatives at the threshold) and members (key, rep), without loss.

    Documents of equal sets share a representative, the smallest key, and link with each other too;
    one without words is alone. A group of n representatives gives up to n * (n - 1) / 2 links, which
    is what is asked for here; near_duplicates makes only those that settle the components.
    """
    sets, classes, full = _candidates(docs, cfg, key, text)
    buckets = materialize(_buckets(full, cfg.threshold_pct).join(full.drop("grams").hint("merge"), "id"), "buckets")
    side = lambda s: lambda c: F.col(f"{s}.{c}")
    on = (F.col("x.t") == F.col("y.t")) & (F.col("x.id") < F.col("y.id")) & _may_link(cfg.threshold_pct)(side("x"), side("y"))
    pairs = buckets.alias("x").join(buckets.hint("merge").alias("y"), on)
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    found = materialize(_verified(pairs, full, cfg), "links")
    rep = lambda c: classes.select(F.col("s1").alias(c), F.col("rep").alias(f"{c}_rep")).hint("merge")
    links = found.join(rep("a"), "a").join(rep("b"), "b").where("a_rep <> b_rep")
    links = links.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")).distinct()
    links = materialize(links, "links")
    discard(buckets, full, found)
    named = sets.join(classes.select("s1", "s2", "rep").hint("merge"), ["s1", "s2"], "left")
    return links, named.select(F.col("key").alias(key), F.coalesce(F.when(F.col("n") > 0, F.col("rep")), F.col("key")).alias("rep")).distinct()


def near_duplicates(
    docs: DataFrame, cfg: Settings = Settings(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links)."""
    pct = cfg.threshold_pct
    sets, classes, full = _candidates(docs, cfg, key, text)
    keyed = materialize(_buckets(full, pct), "keyed")
    facts = full.drop("grams")
    comp = link_groups(keyed, lambda _: (facts, lambda pairs, met: _verified(pairs, full, cfg, met)), _may_link(pct))
    discard(keyed, full)
    # A key on several texts holds their classes together.
    several = sets.where("n > 0").groupBy("key").agg(F.min("s1").alias("a"), F.max("s1").alias("b"), F.count(F.lit(1)).alias("c"))
    several = materialize(several.where("a <> b").select("key", "a"), "several")
    if not several.isEmpty():
        held = sets.where("n > 0").join(several.hint("merge"), "key").where("s1 <> a").select("a", F.col("s1").alias("b"))
        comp = materialize(components(held.unionByName(comp.select(F.col("component").alias("a"), F.col("node").alias("b")))), "components")
    linked = classes.join(comp.withColumnRenamed("node", "s1").hint("merge"), "s1")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = linked.select("s1", "s2", "component").join(materialize(least, "least").hint("merge"), "component").drop("component")
    named = classes.select("s1", "s2", "rep").join(linked.hint("merge"), ["s1", "s2"], "left")
    named = named.select("s1", "s2", F.coalesce("component_id", "rep").alias("component_id"))
    out = sets.join(materialize(named, "named").hint("merge"), ["s1", "s2"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def _buckets(full: DataFrame, pct: int) -> DataFrame:
    """t, id: a set's places in the rare-first order that a partner must share one of."""
    grams = full.select("id", "n", F.explode("grams").alias("t"))
    known = grams.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Stored, so that the join with it can split a hot n-gram.
    known = materialize(known, "shared")
    ranked = grams.join(known.hint("merge"), "t").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("r"))
    # Places of the prefix, less those that unshared n-grams fill.
    places = F.floor(F.col("n") * (100 - pct) / 100) + 1 - (F.col("n") - F.size("r"))
    rows = ranked.where(places > 0).select("id", F.explode(F.slice("r", F.lit(1), places.cast("int"))).alias("x"))
    return rows.select(F.col("x.t").alias("t"), "id")


def _may_link(pct: int):
    """Sizes near enough, and no more ranges of differing parity than differences are allowed."""

    def test(x, y):
        low, high = F.least(x("n"), y("n")), F.greatest(x("n"), y("n"))
        odd = sum((F.bit_count(x(p).bitwiseXOR(y(p))) for p in PARITY), F.lit(0))
        return (low * 100 >= high * pct) & (odd * (100 + pct) <= (low + high) * (100 - pct))

    return test


def _verified(pairs: DataFrame, full: DataFrame, cfg: Settings, met: bool = False) -> DataFrame:
    """Pairs whose overlaps, counted per fragment and summed, reach the threshold; met: all may link."""
    pct, k = cfg.threshold_pct, cfg.fragments
    sides = full.select("id", "n") if met else full.drop("grams")
    x = sides.select([F.col(c).alias(f"x_{c}") for c in sides.columns])
    y = sides.select([F.col(c).alias(f"y_{c}") for c in sides.columns])
    near = pairs.join(x.hint("merge"), F.col("a") == F.col("x_id")).join(y.hint("merge"), F.col("b") == F.col("y_id"))
    near = near if met else near.where(_may_link(pct)(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}")))
    near = materialize(near.select("a", "b", (F.col("x_n") + F.col("y_n")).alias("m")), "pairs")
    # Only the sets of these pairs are cut and moved.
    full = only_ids(full, near)
    # Fragment of a hash: its top bits, as k equal ranges of the unsigned order.
    frag = lambda g: F.shiftrightunsigned(g, 32) * k / F.lit(2**32)
    cut = full.select(
        "id",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(k - 1)),
                lambda f: F.struct(f.alias("f"), F.filter("grams", lambda g: F.floor(frag(g)) == f).alias("part")),
            )
        ).alias("s"),
    ).select("id", "s.f", "s.part")
    asked = near.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("f"))
    one = asked.join(cut.select(F.col("id").alias("a"), "f", F.col("part").alias("pa")).hint("merge"), ["a", "f"])
    two = one.join(cut.select(F.col("id").alias("b"), "f", F.col("part").alias("pb")).hint("merge"), ["b", "f"])
    partial = two.select("a", "b", F.size(F.array_intersect("pa", "pb")).alias("c"))
    both = partial.groupBy("a", "b").agg(F.sum("c").alias("c"))
    # c / (m - c) >= pct / 100
    return both.join(near.hint("merge"), ["a", "b"]).where(F.col("c") * (100 + pct) >= F.col("m") * pct).select("a", "b")
