"""Intervals, tests and order statistics as column expressions over aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
#: Critical values at 5 %: chi-square with one and with three degrees of freedom.
CHI2_1, CHI2_3 = 3.841, 7.815


def _wilson(p: Column, n: Column, z: float) -> tuple[Column, Column]:
    z2 = z * z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z / (1 + z2 / n) * F.sqrt(F.greatest(p * (1 - p) / n + z2 / (4 * n * n), F.lit(0.0)))
    return mid - half, mid + half


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """(lo, hi) of k hits in n, not clamped; nothing seen says nothing: (0, 1)."""
    lo, hi = _wilson(k / n, n, z)
    return F.when(n > 0, F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(
        F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    )


def wilson_of_mean(mean: Column, n: Column, z: float = Z) -> Column:
    """(lo, hi) around a mean of fractional scores, clamped to [0, 1]; null where there are none."""
    lo, hi = _wilson(mean, n, z)
    return F.when(
        n > 0, F.struct(F.greatest(lo, F.lit(0.0)).alias("lo"), F.least(hi, F.lit(1.0)).alias("hi"))
    )


def wilson_percent(k: Column, n: Column, z: float = Z) -> Column:
    """(lo, hi) in percent, clamped; (0, 0) where nothing was seen."""
    lo, hi = _wilson(k / n, n, z)
    return F.when(
        n > 0,
        F.struct((100 * F.greatest(lo, F.lit(0.0))).alias("lo"), (100 * F.least(hi, F.lit(1.0))).alias("hi")),
    ).otherwise(F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")))


def mcnemar(b: Column, c: Column) -> Column:
    """Chi-square of discordant pairs with continuity correction; null where no pair disagrees."""
    return F.when(b + c > 0, F.pow(F.abs(b - c) - 1, F.lit(2.0)) / (b + c))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of discordant pairs, at most 1; null where no pair disagrees."""
    n, k = b + c, F.least(b, c)
    first = -n * F.lit(math.log(2.0))
    total = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("t"), F.exp(first).alias("s")),
        lambda a, i: F.struct(
            (a["t"] + F.log((n - i + 1) / i)).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i))).alias("s")
        ),
        lambda a: a["s"],
    )
    return F.when(n > 0, F.least(F.lit(1.0), 2 * total))


def crude_odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))


def exclusive_percentile(values: Column, q: int) -> Column:
    """Cut point q of 100 of a sorted array by the exclusive method, which may pass the ends; of up to two values, the first."""
    n = F.size(values)
    j = F.least(F.greatest(F.floor(F.lit(q) * (n + 1) / 100), F.lit(1)), n - 1).cast("int")
    delta = F.lit(q) * (n + 1) - j * 100
    cut = (F.get(values, j - 1) * (100 - delta) + F.get(values, j) * delta) / 100
    return F.when(n > 2, cut).when(n > 0, F.get(values, F.lit(0)))


def equal_count_bin(rank: Column, n: Column, k: int) -> Column:
    """Bin from 0 of the rank (from 1) among n, cut at i * n // k."""
    return F.floor((rank * k - 1) / n).cast("int")
