"""Bins, stratified and seeded samples, apportionment and running totals.

Samples are picked by a hash of seed and key: the same for any partitioning, different by seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalframe.functions import permute, stats
from evalframe.storage import small_side, stored


def stable_hash(seed: int, key: Column) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def positions(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """df plus _row (place from 1 in the order, within by's groups) and _n (the group's size), in no single task.

    Rows are dealt into ranges of the order and stored, so that the ranges are the same for counting
    and for numbering; a row's place is its place in its range after the rows of the ranges before,
    of which there is one count a range and group.
    """
    by = by or []
    names = [f"_by{i}" for i in range(len(by))]
    part = W.partitionBy("_part", *by)
    dealt = stored(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part", *(F.col(c).alias(n) for c, n in zip(by, names))).agg(F.count(F.lit(1)).alias("_c"))
    group = W.partitionBy(*names) if by else W.partitionBy(F.lit(0))
    before = F.sum("_c").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.col("_part").alias("_p"), *names, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(group).alias("_n"))
    on = F.col("_part") == F.col("_p")
    for c, n in zip(by, names):
        on &= F.col(c).eqNullSafe(F.col(n))
    local = dealt.withColumn("_local", F.row_number().over(part.orderBy(*order)))
    out = local.join(counts, on)
    return out.select(*df.columns, (F.col("_before") + F.col("_local")).alias("_row"), "_n")


def counted_positions(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by's columns, the different values of each group, and of each how many rows have it (_c), how many are before it (_before) and in the group (_n).

    Rows are reduced to counts before they are dealt into ranges, so a value that half of all rows have is one row.
    """
    return prefix_sums(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")), by, value, "_c")


def prefix_sums(df: DataFrame, by: list[str], order: str, weight: str) -> DataFrame:
    """df plus _before (the weights before a row in its group's order) and _n (all of the group's), in no single task. The order is without ties."""
    dealt = stored(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "counts")
    names = [f"_by{i}" for i in range(len(by))]
    sums = dealt.groupBy("_part", *(F.col(c).alias(n) for c, n in zip(by, names))).agg(F.sum(weight).alias("_c"))
    # One row a range and group.
    group = W.partitionBy(*names) if by else W.partitionBy(F.lit(0))
    before = F.sum("_c").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(F.col("_part").alias("_p"), *names, F.coalesce(before, F.lit(0)).alias("_at"), F.sum("_c").over(group).alias("_n"))
    on = F.col("_part") == F.col("_p")
    for c, n in zip(by, names):
        on &= F.col(c).eqNullSafe(F.col(n))
    own = F.sum(weight).over(W.partitionBy("_part", *by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    out = dealt.withColumn("_own", F.coalesce(own, F.lit(0))).join(sums, on)
    return out.select(*df.columns, (F.col("_at") + F.col("_own")).alias("_before"), "_n")


def equal_count_bins(df: DataFrame, value: str, k: int, tie: str, by: list[str] | None = None) -> DataFrame:
    """Rows with a value, and their bin (from 0) of about equal counts within each of by's groups."""
    placed = positions(df.where(F.col(value).isNotNull()), [value, tie], by)
    return placed.withColumn("bin", stats.equal_count_bin(F.col("_row"), F.col("_n"), k)).drop("_row", "_n")


def bin_summary(binned: DataFrame, value: str, score: str) -> DataFrame:
    return binned.groupBy("bin").agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(score).alias("n"), F.avg(score).alias("acc")
    )


def bin_trend(summary: DataFrame, min_n: int) -> DataFrame:
    """Whether accuracy falls or rises from bin to bin, first less last and the spread; nulls if a bin is thin."""
    prev = F.lag("acc").over(W.orderBy("bin"))
    s = summary.withColumn("_d", F.col("acc") - prev)
    out = s.agg(
        F.min("n").alias("min_n"), F.coalesce(F.bool_and(F.col("_d") <= 0) | F.bool_and(F.col("_d") >= 0), F.lit(True)).alias("_m"),
        (F.min_by("acc", "bin") - F.max_by("acc", "bin")).alias("_f"), (F.max("acc") - F.min("acc")).alias("_s"),
    )
    thick = F.col("min_n") >= min_n
    return out.select(
        "min_n", F.when(thick, F.col("_m")).alias("monotone"), F.when(thick, F.col("_f")).alias("first_less_last"),
        F.when(thick, F.col("_s")).alias("spread"),
    )


def order_statistics(df: DataFrame, value: str, parts: int, tie: str | None = None) -> DataFrame:
    """The values at positions i * n // parts of the sorted column, for i from 1 to parts - 1: part, cut.

    Which of equal values stands first changes no cut, so tie is taken and not read.
    """
    placed = counted_positions(df.where(F.col(value).isNotNull()).select(F.col(value).alias("cut")), [], "cut")
    cuts = F.array(*(F.struct(F.lit(i).alias("part"), F.floor(F.col("_n") * i / parts).alias("at")) for i in range(1, parts)))
    return placed.select("cut", "_before", "_c", F.inline(cuts)).where("at >= _before AND at < _before + _c").select("part", "cut")


def cumulative_share(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows with a value, and share: of the rows of their group, those whose value is not larger."""
    kept = df.where(F.col(value).isNotNull())
    counted = counted_positions(kept.select(*by, value), by, value)
    told = counted.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate([*by, value])), ((F.col("_before") + F.col("_c")) / F.col("_n")).alias("share"))
    on = F.lit(True)
    for i, c in enumerate([*by, value]):
        on &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return kept.join(told, on).select(*df.columns, "share")


def percentiles(df: DataFrame, by: list[str], value: str, **cuts: tuple[str, int]) -> DataFrame:
    """by's columns, n, and a column for each cut: ("median", 0), or ("exclusive", q) for cut point q of 100.

    Rows are reduced to the different values and their counts; only the values at the cuts' places are gathered.
    Rows without a value are left out.
    """
    kept = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    placed = counted_positions(kept, by, "_v")
    there = lambda row: (row > F.col("_before")) & (row <= F.col("_before") + F.col("_c"))
    n, out, aggs = F.col("n"), [], []
    for name, (kind, q) in cuts.items():
        count = F.col("_n")
        if kind == "median":
            low, high = F.floor((count + 1) / 2), F.floor(count / 2) + 1
        else:
            low = F.least(F.greatest(F.floor(F.lit(q) * (count + 1) / 100), F.lit(1)), F.greatest(count - 1, F.lit(1)))
            high = F.least(low + 1, count)
        aggs += [F.max(F.when(there(low), F.col("_v"))).alias(f"_{name}l"), F.max(F.when(there(high), F.col("_v"))).alias(f"_{name}h")]
        a, b = F.col(f"_{name}l"), F.col(f"_{name}h")
        if kind == "median":
            out.append(((a + b) / 2).alias(name))
        else:
            j = F.least(F.greatest(F.floor(F.lit(q) * (n + 1) / 100), F.lit(1)), n - 1)
            delta = F.lit(q) * (n + 1) - j * 100
            out.append(F.when(n > 2, (a * (100 - delta) + b * delta) / 100).otherwise(a).alias(name))
    return placed.groupBy(*by).agg(F.sum("_c").alias("n"), *aggs).select(*by, "n", *out)


def stratified_sample(df: DataFrame, cell: list[str], per_cell: int, key: str, seed: int) -> DataFrame:
    """Up to per_cell rows of each cell, and the cell's size as pool."""
    # Ranks alone, so that each task keeps no more than per_cell rows of a cell before the shuffle.
    rank = F.row_number().over(W.partitionBy(*cell).orderBy(stable_hash(seed, F.col(key)), key))
    kept = df.withColumn("_r", rank).where(F.col("_r") <= per_cell).drop("_r")
    names = [f"_c{i}" for i in range(len(cell))]
    pools = df.groupBy(*(F.col(c).alias(n) for c, n in zip(cell, names))).agg(F.count(F.lit(1)).alias("pool"))
    on = F.lit(True)
    for c, n in zip(cell, names):
        on &= F.col(c).eqNullSafe(F.col(n))
    return kept.join(pools, on).select(*df.columns, "pool")


def seeded_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    return df.orderBy(stable_hash(seed, F.col(key)), key).limit(n)


def allocate(cells: DataFrame, weight: str, total: int, tie: str) -> DataFrame:
    """Whole numbers summing to total in proportion to the weights, by largest remainders: column given."""
    all_ = W.partitionBy(F.lit(0))
    exact = F.col(weight) * total / F.sum(weight).over(all_)
    out = cells.withColumn("_e", exact).withColumn("_f", F.floor("_e"))
    left = F.lit(total) - F.sum("_f").over(all_)
    rank = F.row_number().over(all_.orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), F.asc(tie)))
    return out.withColumn("given", (F.col("_f") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_e", "_f")


def capped_then_filled(df: DataFrame, group: str, cap: int, n: int, tie: str) -> DataFrame:
    """n rows: at most cap of a group first, further ones only if that doesn't give enough."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(tie))
    # No group gives more than n rows beyond its cap, so that each task keeps no more of it before the shuffle.
    return df.withColumn("_r", rank).where(F.col("_r") <= cap + n).orderBy(F.col("_r") > cap, group, tie).limit(n).drop("_r")


def running_total(df: DataFrame, value: str, seq: str) -> DataFrame:
    """df plus spent_before, the sum of the values before a row in the order of seq, and written, its place.

    Values are added as decimals of twelve places, so that a total does not depend on how the rows are dealt.
    """
    exact = F.coalesce(F.col(value), F.lit(0)).cast("decimal(26,12)")
    dealt = stored(df.repartitionByRange(seq).withColumn("_part", F.spark_partition_id()).withColumn("_exact", exact), "ranges")
    sums = dealt.groupBy("_part").agg(F.sum("_exact").alias("_t"), F.count(F.lit(1)).alias("_c"))
    # One row a range.
    prior = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_t").over(prior), F.lit(0)).alias("_at"), F.coalesce(F.sum("_c").over(prior), F.lit(0)).alias("_k"))
    w = W.partitionBy("_part").orderBy(seq)
    own = F.coalesce(F.sum("_exact").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = dealt.withColumn("_own", own).withColumn("_i", F.row_number().over(w)).join(sums, F.col("_part") == F.col("_p"))
    return rows.select(*df.columns, (F.col("_at") + F.col("_own")).cast("double").alias("spent_before"), (F.col("_k") + F.col("_i")).alias("written"))


def affordable(df: DataFrame, cost: str, cap: float, seq: str) -> DataFrame:
    """Rows admitted while what was spent before them stays under the cap; spent_before is added."""
    return running_total(df, cost, seq).where(F.col("spent_before") < cap).drop("written")


def spend(calls: DataFrame, prices: DataFrame, by: list[str], limit: float | None = None) -> DataFrame:
    """by's columns, calls, usd (tokens at the model's prices of a million) and exhausted: whether the limit is reached.

    prices: model, usd_in, usd_out; a call of a model without a price raises nothing but counts no dollars.
    """
    usd = F.col("in_tokens") / 1e6 * F.col("usd_in") + F.col("out_tokens") / 1e6 * F.col("usd_out")
    out = calls.join(small_side(prices), "model", "left").groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(usd), F.lit(0.0)).alias("usd"))
    return out.withColumn("exhausted", F.lit(False) if limit is None else F.col("usd") >= limit)


def submission_window(df: DataFrame, cost: str, seq: str, limit: float, concurrency: int, first: int = 8) -> DataFrame:
    """df plus spent, calls and window: how many calls may be in flight after a row.

    Before any call has come back that is the first wave, at most `first`; afterwards as many as the
    rest of the limit pays for at the mean cost so far, from 1 to concurrency. exhausted tells where
    the spend has reached the limit: nothing is submitted any more.
    """
    total = running_total(df, cost, seq)
    spent = F.col("spent_before") + F.coalesce(F.col(cost), F.lit(0.0))
    mean = spent / F.col("written")
    afford = F.when(mean > 0, F.floor((F.lit(limit) - spent) / mean)).otherwise(F.lit(concurrency))
    window = F.greatest(F.lit(1), F.least(F.lit(max(concurrency, 1)), afford)).cast("int")
    return total.select(
        *df.columns, spent.alias("spent"), F.col("written").alias("calls"), F.lit(min(max(concurrency, 1), first)).alias("first_wave"),
        window.alias("window"), (spent >= limit).alias("exhausted"),
    )


def failure_rate(df: DataFrame, failed: Column, seq: str, last: int = 200, chunk: int = 20_000) -> DataFrame:
    """Share of failures among the last rows up to each, and how many those are.

    Rows are taken in chunks of the order; a chunk is preceded by the last rows of the one before.
    """
    if chunk < last:
        raise ValueError("a chunk must hold the last rows")
    rows = positions(df.withColumn("_f", failed.cast("double")), [seq]).withColumn("_chunk", F.floor((F.col("_row") - 1) / chunk))
    # The end of a chunk also stands before the next one.
    ends = (F.col("_row") - 1) % chunk >= chunk - (last - 1)
    at = F.when(ends, F.array("_chunk", F.col("_chunk") + 1)).otherwise(F.array("_chunk"))
    both = rows.withColumn("_in", F.explode(at))
    w = W.partitionBy("_in").orderBy("_row").rowsBetween(-(last - 1), 0)
    both = both.withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("failure_rate", F.avg("_f").over(w))
    return both.where("_in = _chunk").select(*df.columns, "recent", "failure_rate")


#: What the text of an error that repeating can't mend holds.
FATAL = ("credit balance", "billing", "spend limit", "quota")


def retry_plan(df: DataFrame, error: Column, attempt: Column, most: int = 3) -> DataFrame:
    """df plus action (done, abort, retry, give_up) and wait: seconds before the next attempt, doubling from 1.

    attempt counts from 0. An error that names billing aborts the run; any other is retried until `most` attempts are spent.
    """
    told = F.lower(error)
    fatal = F.lit(False)
    for words in FATAL:
        fatal |= told.contains(words)
    action = F.when(error.isNull(), "done").when(fatal, "abort").when(attempt >= most - 1, "give_up").otherwise("retry")
    return df.withColumn("action", action).withColumn("wait", F.when(F.col("action") == "retry", F.pow(F.lit(2.0), attempt)))


def extremes(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Best, worst and upper-middle row of each group: column pick."""
    ranked = positions(df, [score, tie], [group])
    at = {"worst": F.lit(1), "best": F.col("_n"), "median": F.floor(F.col("_n") / 2) + 1}
    picks = F.array(*(F.struct(F.lit(k).alias("pick"), v.cast("long").alias("at")) for k, v in at.items()))
    return ranked.select(*df.columns, "_row", F.inline(picks)).where("_row = at").drop("_row", "at")


def advantages(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and spread of each group and each row's standardised value; a group without spread is dead."""
    # Combined before the shuffle; rows then meet one row a group.
    own = df.groupBy(F.col(group).alias("_g")).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma"))
    out = df.join(own, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    dead = F.col("sigma") <= 1e-9
    return out.withColumn("dead", dead).withColumn("advantage", F.when(~dead, (F.col(value) - F.col("mu")) / F.col("sigma")))


def group_statistics(df: DataFrame, group: list[str], value: str, samples: int) -> DataFrame:
    """A row a group: n (values), mean, pstdev, best, worst, dead (no spread), and truncated: fewer values than samples were asked for."""
    out = df.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("pstdev"), F.max(value).alias("best"), F.min(value).alias("worst")
    )
    return out.withColumn("dead", F.col("pstdev") <= 1e-9).withColumn("truncated", F.col("n") < samples)


def shuffled(df: DataFrame, order: list[str], seed: int, out: str = "place") -> DataFrame:
    """df plus a place from 0: a permutation, keyed by the seed, of the rows' positions in the order."""
    placed = stored(positions(df, order).withColumn("_at", F.col("_row") - 1).drop("_row", "_n"), "placed")
    return placed.withColumn(out, permute.permuted(F.col("_at"), placed.count(), F.lit(seed))).drop("_at")


#: Positions that one task turns.
_TURNED = 2_000_000


def permutation_null(df: DataFrame, order: list[str], left: list[str], right: list[str], hit: Column, shuffles: int) -> DataFrame:
    """A row a shuffle: rep (from 1) and rate, the share of rows for which hit holds when they get the right columns of other rows.

    Rows are placed in the order once. In each shuffle the row at a position gets the columns of the row at its
    permuted position, so all shuffles are one join on positions, and nothing is sorted for them.
    """
    placed = positions(df.select(*dict.fromkeys([*order, *left, *right])), order)
    placed = stored(placed.select(*left, *(F.col(c).alias(f"_r_{c}") for c in right), (F.col("_row") - 1).alias("_at")), "placed")
    n = placed.count()
    # A row becomes one a shuffle, so tasks are cut by those and not by the few files that hold the rows.
    asked = placed.select(*left, "_at").repartition(max(1, -(-n * shuffles // _TURNED)))
    asked = asked.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(shuffles).cast("long"))).alias("rep"))
    asked = asked.withColumn("_to", permute.permuted(F.col("_at"), n, F.col("rep"))).drop("_at")
    drawn = placed.select(F.col("_at").alias("_to"), *(F.col(f"_r_{c}").alias(c) for c in right))
    # By sorting: what the stored rows take as files, and not what they become, would pass for small.
    return asked.join(drawn.hint("merge"), "_to").groupBy("rep").agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("rate"))


#: Rows of a shuffle that one group sorts, places that one group compares, and rows that a task hashes at once.
_DEALT, _PLACES, _HASHED = 1 << 19, 1 << 17, 100_000


def _dealt(batches: Iterator[pa.RecordBatch], shuffles: int, bins: int, kind: str) -> Iterator[pa.RecordBatch]:
    """A row a shuffle and range of hashes: the first 64 bits, the keys and the codes of the rows that fall there."""

    def packed(keys: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts = [b"%d" % k for k in keys.tolist()]
        for rep in range(1, shuffles + 1):
            lead = b"%d:" % rep
            h = np.frombuffer(b"".join([hashlib.sha1(lead + t).digest()[:8] for t in texts]), ">u8").astype("u8")
            at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            by = np.argsort(at, kind="stable")
            found, starts = np.unique(at[by], return_index=True)
            cuts = [*starts.tolist(), len(by)]
            columns = [pa.array([x[by[i:j]].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for x in (h, keys, codes)]
            told = [pa.array([rep] * len(found), pa.int64()), pa.array(found.astype("i8"), pa.int64())]
            yield pa.RecordBatch.from_arrays([*told, *columns], names=["rep", "bin", "hashes", "keys", "codes"])

    held: list[tuple] = []
    for b in batches:
        held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(kind)))
        if sum(len(k) for k, _ in held) >= _HASHED:
            yield from packed(*map(np.concatenate, zip(*held)))
            held = []
    if any(len(k) for k, _ in held):
        yield from packed(*map(np.concatenate, zip(*held)))


def _in_order(rep: int, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The order of the whole hashes, then of the keys; all 160 bits are asked only where 64 do not tell two rows apart."""
    order = np.lexsort((keys, hashes))
    if (np.diff(hashes[order]) == 0).any():
        whole = [(hashlib.sha1(b"%d:%d" % (rep, k)).digest(), k) for k in keys.tolist()]
        order = np.array(sorted(range(len(whole)), key=whole.__getitem__))
    return order


def hash_order_null(df: DataFrame, key: str, left: str, right: str, shuffles: int) -> DataFrame:
    """A row a shuffle: rep (from 1) and rate, the share of rows whose left value is the right value of the row dealt to their place.

    Rows stand in the order of key, unique whole numbers. Shuffle rep deals them in the order of sha1("rep:key"). Hashes
    spread evenly, so their ranges hold about as many rows each; a range is packed (8 bytes of hash, the key, a code of
    the value) when it is dealt, sorted in one group, and only the codes in their order are kept, a byte each as a rule.
    """
    values = df.select(F.explode(F.array(left, right)).alias("_v")).where("_v IS NOT NULL").distinct()
    values = stored(positions(values, ["_v"]).select("_v", F.col("_row").alias("_id")), "values")
    kinds, n = values.count(), df.count()
    kind = "u1" if kinds < 255 else "i8"
    code = lambda c, none: df.join(small_side(values), F.col(c) == F.col("_v"), "left").select(key, F.coalesce("_id", F.lit(none).cast("long")).alias("_c"))
    bins = max(1, -(-n // _DEALT))
    # Every row is hashed once a shuffle, so tasks are cut by rows and not by the stored files.
    drawn = code(right, kinds + 1).select(F.col(key).cast("long"), "_c").repartition(max(1, -(-n // (5 * _HASHED))))
    drawn = drawn.mapInArrow(lambda batches: _dealt(batches, shuffles, bins, kind), "rep long, bin long, hashes binary, keys binary, codes binary")

    def ordered(frame: pd.DataFrame) -> pd.DataFrame:
        h, keys, codes = (np.frombuffer(b"".join(frame[c]), t) for c, t in (("hashes", "u8"), ("keys", "i8"), ("codes", kind)))
        rep = int(frame["rep"].iloc[0])
        return pd.DataFrame({"rep": [rep], "bin": [int(frame["bin"].iloc[0])], "n": [len(codes)], "codes": [codes[_in_order(rep, h, keys)].tobytes()]})

    runs = stored(drawn.groupBy("rep", "bin").applyInPandas(ordered, "rep long, bin long, n long, codes binary"), "runs")
    # One row a range; _first is the place of its first row.
    prior = W.partitionBy("_rep").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    firsts = runs.select(F.col("rep").alias("_rep"), F.col("bin").alias("_bin"), "n").withColumn("_first", F.coalesce(F.sum("n").over(prior), F.lit(0))).drop("n")
    runs = runs.join(firsts, (F.col("rep") == F.col("_rep")) & (F.col("bin") == F.col("_bin")))
    width = np.dtype(kind).itemsize
    blocks = F.sequence(F.floor(F.col("_first") / _PLACES), F.floor((F.col("_first") + F.col("n") - 1) / _PLACES))
    pieces = runs.withColumn("block", F.explode(blocks)).withColumn("_from", F.greatest(F.col("block") * _PLACES, F.col("_first")))
    size = F.least((F.col("block") + 1) * _PLACES, F.col("_first") + F.col("n")) - F.col("_from")
    cut = F.substring("codes", ((F.col("_from") - F.col("_first")) * width + 1).cast("int"), (size * width).cast("int"))
    pieces = pieces.select("rep", "block", (F.col("_from") - F.col("block") * _PLACES).alias("at"), cut.alias("codes"))
    at = F.col("_row") - 1
    asked = positions(code(left, 0), [key]).select(F.floor(at / _PLACES).alias("block"), (at % _PLACES).cast("int").alias("at"), "_c")

    def compared(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        own = np.empty(len(mine), kind)
        own[mine["at"].to_numpy()] = mine["_c"].to_numpy()
        told = [np.frombuffer(c, kind) for c in theirs["codes"]]
        hits = [int((own[i : i + len(c)] == c).sum()) for i, c in zip(theirs["at"].tolist(), told)]
        return pd.DataFrame({"rep": theirs["rep"], "hits": hits})

    hits = asked.groupBy("block").cogroup(pieces.groupBy("block")).applyInPandas(compared, "rep long, hits long")
    return hits.groupBy("rep").agg((F.sum("hits") / F.lit(n)).alias("rate"))
