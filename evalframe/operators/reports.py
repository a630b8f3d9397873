"""Published tables in one call each, put together from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions import stats
from evalframe.operators import aggregates as ag
from evalframe.operators import dedup, joins, windows


def benchmark_suite(log: DataFrame, examples: DataFrame, verdicts: DataFrame, usable: Column, score: Column, key: str = "uid") -> DataFrame:
    """A row a dataset, and one of all (whole is true): n, acc, ci_lo, ci_hi, string_acc, judged.

    The latest usable row of each example that has one is scored; where there is a verdict (key, judge_score) that counts, and
    string_acc says what the scores were without. Rows of the log without an example are left out.
    """
    rows = dedup.latest_usable(log, [key], usable).where(usable).join(examples, key)
    scored = joins.override(rows.withColumn("score", score), verdicts, key, "score", "judge_score")
    out = scored.rollup("dataset").agg(
        F.count("score").alias("n"), F.avg("score").alias("acc"), F.avg("string_score").alias("string_acc"), F.count("judge_score").alias("judged"),
        (F.grouping_id() > 0).alias("whole"),
    )
    ci = stats.wilson_of_mean(F.col("acc"), F.col("n"))
    return out.withColumn("ci_lo", ci["lo"]).withColumn("ci_hi", ci["hi"])


def precision_ladder(points: DataFrame, x: str, y: str, box: str) -> DataFrame:
    """grid (0: the exact box), chance, acc, ratio of both: the same answers read at each tolerance, all resolutions pooled."""
    return ag.precision_curve(points, x, y, box).select("grid", "n", "chance", "acc", F.try_divide("acc", "chance").alias("ratio"))


def where_misses_land(points: DataFrame, by: str, scene: str, key: str, x: str, y: str, box: str) -> DataFrame:
    """A row a group: n_miss, the shares of its bands, the median distance, and the share of misses that lie in another box of the scene. points have hit."""
    bands = ag.miss_summary(points, [by], x, y, box)
    other = joins.misses_on_other_box(points, points.select(scene, key, box), scene, key).groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_k"))
    both = bands.join(other, F.col(by).eqNullSafe(F.col("_by")), "left")
    share = lambda c: F.try_divide(F.coalesce(F.col(c), F.lit(0)), F.col("n_miss"))
    return both.select(by, "n_miss", *(share(c).alias(c) for c in ("near", "moderate", "wrong_region")), "median_d", share("_k").alias("on_other"))


def tertile(df: DataFrame, value: str, name: str) -> DataFrame:
    """df plus name: 0, 1 or 2 by the thresholds at a third and two thirds of the sorted values; null without a value."""
    cuts = windows.order_statistics(df, value, 3).agg(F.max(F.when(F.col("part") == 1, F.col("cut"))).alias("_lo"), F.max(F.when(F.col("part") == 2, F.col("cut"))).alias("_hi"))
    v = F.col(value)
    told = F.when(v < F.col("_lo"), 0).when(v < F.col("_hi"), 1).when(v.isNotNull(), 2)
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, told).drop("_lo", "_hi")  # cuts is one row


def polarity(df: DataFrame, exposed: Column, hit: Column, stratum: str, sizes: list[str]) -> DataFrame:
    """Two rows, exposed or not: n, k, acc, with the crude odds ratio and the one adjusted for stratum and the tertiles of sizes, and its interval.

    Rows of which exposed or hit is null are left out.
    """
    rows = df.withColumn("_e", exposed).withColumn("_h", hit).where("_e IS NOT NULL AND _h IS NOT NULL")
    names = [f"_t{i}" for i in range(len(sizes))]
    for size, name in zip(sizes, names):
        rows = tertile(rows, size, name)
    adjusted = ag.mantel_haenszel(rows, [stratum, *names], F.col("_e"), F.col("_h"))
    n = lambda e, h: F.sum(F.when((F.col("exposed") == e), F.col("k" if h else "miss")).otherwise(0)).cast("double")
    cells = rows.groupBy(F.col("_e").alias("exposed")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_h").alias("k"), F.count_if(~F.col("_h")).alias("miss"))
    crude = cells.agg(stats.crude_odds_ratio(n(True, True), n(True, False), n(False, True), n(False, False)).alias("crude"))
    # One row each.
    out = cells.crossJoin(F.broadcast(crude)).crossJoin(F.broadcast(adjusted))
    return out.select("exposed", "n", "k", F.try_divide("k", "n").alias("acc"), "crude", "odds_ratio", "lo", "hi", "n_strata")


def wrong_numbers(df: DataFrame, by: str, key: str, gold: str, pred: str, pool: list[str], shuffles: int = 20) -> DataFrame:
    """Whether wrong numbers are near misses or other numbers of the page: a row a group, with n (wrong ones), median_error
    (relative to a gold that is not 0), within_tenth, and of all groups together seen (the answer is one of the page's
    numbers, in the columns of pool) and by_chance (the same after the answers were shuffled over the questions).
    """
    g, p = F.col(gold), F.col(pred)
    wrong = df.where(g.isNotNull() & p.isNotNull() & (F.abs(p - g) > 1e-6 * F.greatest(F.lit(1.0), F.abs(g))))
    error = F.try_divide(F.abs(p - g), F.abs(g))
    told = wrong.withColumn("_e", error)
    share = F.avg(F.when(F.col("_e").isNotNull(), (F.col("_e") <= 0.1).cast("double")))
    cells = told.groupBy(by).agg(F.count(F.lit(1)).alias("n"), share.alias("within_tenth"))
    middle = windows.percentiles(told, [by], "_e", median_error=("median", 0)).select(F.col(by).alias("_by"), "median_error")
    there = F.lit(False)
    for c in pool:
        there |= F.coalesce(F.abs(p - F.col(c)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(c)), F.lit(False))
    seen = wrong.agg(F.avg(there.cast("double")).alias("seen"))
    null = windows.permutation_null(wrong, [key], pool, [pred], there, shuffles).agg(F.avg("rate").alias("by_chance"))
    out = cells.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left")
    return out.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(null)).select(by, "n", "median_error", "within_tenth", "seen", "by_chance")  # one row each
