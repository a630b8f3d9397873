"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent between 1 (as they are) and 0 (all equal) and
normalised. The exponent is bisected (`cuts` parts at a time, all of them in one aggregation over
the sources' totals) to the flattest mixture that neither passes a target entropy (a share of the
largest possible) nor repeats a source's tokens more than `max_repeat` times.

Each source is then realised as permutations of budgeted blocks. Its documents stand in the order
of a hash, which is cut into blocks of `block_tokens` (more where a source would have more than
`most_blocks`). The cuts lie between buckets, ranges of a 2**20th of the hashes, so a block passes
its budget by a bucket at most. Every pass over a source is a permutation of its blocks by a hash
of seed, pass and block. The quota takes whole passes and of a further one the first blocks, the
last of them up to the document that would pass the quota. `place`, the share of the source's
quota that stands before a block, puts the blocks of all sources into one order, in which any
stretch has about the target weights: sort by place, source and turn.

Only figures per source, bucket and block are aggregated and joined to the documents, which do not
move as long as those are few (a counted broadcast). No window sees more than 2**20 buckets, or
the documents of one bucket.

Edge cases: null sources form one source; documents without words cost nothing and ride along with
their block; a source without any words has no share and gives nothing; rows that repeat a key are
taken together; documents that tie in their hash are ordered by key; a source whose quota ends
before its first document gives none; an empty table gives an empty result; columns named as the
added ones raise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalframe.llm.common import discard, join_small, materialize, words


@dataclass(frozen=True)
class Settings:
    budget: int | None = None  # tokens; None: as many as there are
    entropy: float | None = 0.97  # share of the logarithm of the number of sources
    max_repeat: float | None = 4.0
    seed: int = 17
    cuts: int = 64
    rounds: int = 7
    block_tokens: int = 1_000_000
    most_blocks: int = 65_536


ADDED = ("n_tokens", "epoch", "block", "place", "turn")


def flattest_exponent(totals: DataFrame, budget: int, cfg: Settings) -> float:
    """The least exponent that both limits allow; each round is one aggregation over the sources' totals."""
    whole, count, fewest = totals.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens")).first()
    if not whole or count < 2:
        return 1.0
    logp, least = F.log(F.col("tokens") / F.lit(float(whole))), math.log(fewest / whole)

    def allowed(x: float, z: float, s: float) -> bool:
        if cfg.entropy is not None and math.log(z) - x * s / z > cfg.entropy * math.log(count) + 1e-12:
            return False
        repeat = math.exp(x * least) / z * budget / fewest
        return cfg.max_repeat is None or repeat <= max(cfg.max_repeat, budget / whole) + 1e-12

    low, high = 0.0, 1.0
    for step in range(cfg.rounds):
        tried = [low + (high - low) * i / cfg.cuts for i in range(cfg.cuts + 1)]
        at = totals.select(logp.alias("l"), F.posexplode(F.array(*map(F.lit, tried))).alias("i", "x"))
        sums = at.groupBy("i").agg(F.sum(F.exp(F.col("x") * F.col("l"))).alias("z"), F.sum(F.exp(F.col("x") * F.col("l")) * F.col("l")).alias("s"))
        by = {r.i: (r.z, r.s) for r in sums.collect()}
        first = next((i for i in range(cfg.cuts) if allowed(tried[i], *by[i])), cfg.cuts)
        if step == 0 and first == 0:
            return low
        low, high = tried[max(first - 1, 0)], tried[first]
    return high


def source_weights(sizes: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """src, tokens, share, weight, quota (tokens), passes (whole), rest (tokens of the last, part pass)."""
    totals = materialize(sizes.groupBy("src").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "totals")
    whole = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = whole if cfg.budget is None else cfg.budget
    x = flattest_exponent(totals, budget, cfg)
    share = F.col("tokens") / F.lit(float(max(whole, 1)))
    z = totals.agg(F.sum(F.pow(share, F.lit(x)))).first()[0] or 1.0
    out = totals.withColumn("share", share).withColumn("weight", F.pow("share", F.lit(x)) / F.lit(z))
    # A hair above the product, so that a quota meant to be whole isn't floored below itself.
    out = out.withColumn("quota", F.floor(F.col("weight") * budget * (1 + 1e-12) + 1e-6))
    out = out.withColumn("passes", F.floor(F.col("quota") / F.col("tokens")))
    out = out.withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
    out = materialize(out, "weights")
    discard(totals)
    return out


def _turn(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


#: Ranges of the hash: 2**10 cells, and 2**20 buckets.
_cell = lambda u: F.shiftright(u, 54).cast("int")
_bucket = lambda u: F.shiftright(u, 44).cast("int")


def _blocks(buckets: DataFrame, weights: DataFrame, n: int, cfg: Settings) -> DataFrame:
    """src, cell, bucket, t, block: buckets in the order of the hash, cut into blocks by their tokens."""
    cells = buckets.groupBy("src", "cell").agg(F.sum("t").alias("t"))
    before = F.sum("t").over(W.partitionBy("src").orderBy("cell")) - F.col("t")
    cells = cells.select("src", "cell", before.alias("cell_at"))
    inner = F.sum("t").over(W.partitionBy("src", "cell").orderBy("bucket")) - F.col("t")
    placed = buckets.withColumn("inner", inner).join(cells.hint("merge"), ["src", "cell"])
    placed = join_small(placed, weights.select("src", "tokens"), ["src"], n, "inner")
    budget = F.greatest(F.lit(cfg.block_tokens), F.ceil(F.col("tokens") / cfg.most_blocks))
    at = F.col("cell_at") + F.col("inner")
    # A last bucket without words starts at the total; it stays in the last block.
    block = F.floor(F.least(at, F.col("tokens") - 1) / budget).cast("int")
    return placed.select("src", "cell", "bucket", "t", block.alias("block"))


def _passes(blocks: DataFrame, weights: DataFrame, n: int, cfg: Settings) -> DataFrame:
    """src, block, epoch, at (tokens before it in the pass), rest: the blocks that a pass takes, wholly or in part."""
    sums = blocks.groupBy("src", "block").agg(F.sum("t").alias("t"))
    sums = join_small(sums, weights.select("src", "tokens", "quota", "passes", "rest"), ["src"], n, "inner")
    last = F.when(F.col("rest") > 0, F.col("passes")).otherwise(F.col("passes") - 1)
    sums = sums.where(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    order = W.partitionBy("src", "epoch").orderBy(F.xxhash64("src", "epoch", "block", F.lit(cfg.seed)), "block")
    sums = sums.withColumn("at", F.sum("t").over(order) - F.col("t"))
    part = F.col("epoch") == F.col("passes")
    sums = sums.withColumn("left", F.when(part, F.col("rest") - F.col("at"))).where(~part | (F.col("left") > 0))
    place = (F.col("epoch") * F.col("tokens") + F.col("at")) / F.col("quota")
    # left: tokens of a block that is not taken whole.
    return sums.select("src", "block", "epoch", place.alias("place"), F.when(F.col("left") < F.col("t"), F.col("left")).alias("left"))


def mix_sources(
    docs: DataFrame, cfg: Settings = Settings(), key: str = "doc_id", source: str = "source", text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """keep columns plus n_tokens, epoch (pass, from 0), block, place and turn: the order within a block."""
    keep = docs.columns if keep is None else keep
    clash = sorted(set(ADDED) & set(keep))
    if clash:
        raise ValueError(f"there are columns {clash} already")
    src = F.coalesce(F.col(source).cast("string"), F.lit(""))
    tokens = F.size(words(F.col(text))).cast("long")
    sizes = docs.select(F.col(key).alias("k"), src.alias("src"), tokens.alias("n_tokens"), _turn(F.col(key), cfg.seed).alias("u"))
    sizes = materialize(sizes, "sizes")
    weights = source_weights(sizes, cfg)
    n = weights.count()
    buckets = sizes.groupBy("src", _cell(F.col("u")).alias("cell"), _bucket(F.col("u")).alias("bucket")).agg(F.sum("n_tokens").alias("t"))
    blocks = materialize(_blocks(buckets, weights, n, cfg), "blocks")
    passes = materialize(_passes(blocks, weights, n, cfg), "passes")

    # The document at which a part block ends: first its bucket, then in the bucket.
    cut = passes.where("left is not null").select("src", "block", "left")
    run = join_small(blocks, cut, ["src", "block"], n, "inner")
    run = run.withColumn("end", F.sum("t").over(W.partitionBy("src").orderBy("bucket")))
    cut = run.where("end > left").groupBy("src").agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("end") + F.col("t")).alias("left")), "bucket").alias("c"))
    cut = cut.select("src", F.col("c.bucket").alias("bucket"), F.col("c.left").alias("left"))
    inner = join_small(sizes.withColumn("bucket", _bucket(F.col("u"))), cut, ["src", "bucket"], n, "inner")
    # Rows that repeat a key go together, so they are one step of the sum.
    inner = inner.groupBy("src", "u", "k").agg(F.sum("n_tokens").alias("t"), F.first("left").alias("left"))
    inner = inner.withColumn("end", F.sum("t").over(W.partitionBy("src").orderBy("u", "k")))
    stop = inner.where("end > left").groupBy("src").agg(F.min(F.struct("u", "k")).alias("stop"))
    stop = materialize(stop, "stop")

    # The blocks that start in a cell or reach into it, each with its first bucket there.
    starts = blocks.groupBy("src", "cell", "block").agg(F.min("bucket").alias("bucket"))
    cells = starts.groupBy("src", "cell").agg(F.sort_array(F.collect_list(F.struct("bucket", "block"))).alias("starts"))
    cells = materialize(cells, "cells")
    taken = passes.groupBy("src", "block").agg(F.collect_list(F.struct("epoch", "place", F.col("left").isNotNull().alias("part"))).alias("passes"))
    taken = materialize(taken, "taken")

    name = "_src"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    own = {c: f"{name}{c}" for c in ("cell", "starts", "block", "passes", "pass", "stop", "u")}
    turn = _turn(F.col(key), cfg.seed)
    rows = docs.select(*keep, F.col(key).alias(f"{name}k"), src.alias(name), tokens.alias("n_tokens"), turn.alias(own["u"]))
    rows = rows.withColumn(own["cell"], _cell(F.col(own["u"])))
    rows = join_small(rows, cells.withColumnsRenamed({"src": name, **own}), [name, own["cell"]], cells.count(), "inner")
    begun = F.filter(own["starts"], lambda b: b["bucket"] <= _bucket(F.col(own["u"])))
    rows = rows.withColumn(own["block"], F.element_at(begun, -1)["block"])
    rows = join_small(rows, taken.withColumnsRenamed({"src": name, **own}), [name, own["block"]], taken.count(), "inner")
    rows = join_small(rows, stop.withColumnsRenamed({"src": name, **own}), [name], n)
    rows = rows.withColumn(own["pass"], F.explode(own["passes"]))
    at, p = F.struct(F.col(own["u"]).alias("u"), F.col(f"{name}k").alias("k")), F.col(own["pass"])
    rows = rows.where(~p["part"] | F.col(own["stop"]).isNull() | (at < F.col(own["stop"])))
    discard(sizes, weights, blocks, passes)
    return rows.select(*keep, "n_tokens", p["epoch"].alias("epoch"), F.col(own["block"]).alias("block"), p["place"].alias("place"), F.col(own["u"]).alias("turn"))
