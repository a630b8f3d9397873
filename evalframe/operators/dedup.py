"""One row per key out of an append-only log, under named policies. `seq` gives the order of writing.

All policies pick with aggregates over structs rather than a window, so a key with very many
rows is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(log: DataFrame, keys: list[str], order: Column, biggest: bool = True) -> DataFrame:
    rest = [c for c in log.columns if c not in keys]
    best = (F.max_by if biggest else F.min_by)(F.struct(*rest), order)
    return log.groupBy(*keys).agg(best.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def latest_usable(log: DataFrame, keys: list[str], usable: Column, seq: str = "seq") -> DataFrame:
    """The latest usable row; a key that has none keeps its latest."""
    return _pick(log, keys, F.struct(usable, F.col(seq)))


def latest_usable_first_null(log: DataFrame, keys: list[str], usable: Column, seq: str = "seq") -> DataFrame:
    """The latest usable row; a key that has none keeps its first."""
    return _pick(log, keys, F.struct(usable, F.when(usable, F.col(seq)).otherwise(-F.col(seq))))


def last_then_usable(log: DataFrame, keys: list[str], usable: Column, seq: str = "seq") -> DataFrame:
    """The last row, and the key is lost if that isn't usable."""
    return _pick(log.withColumn("_u", usable), keys, F.col(seq)).where("_u").drop("_u")


def usable_then_last(log: DataFrame, keys: list[str], usable: Column, seq: str = "seq") -> DataFrame:
    return _pick(log.where(usable), keys, F.col(seq))


def last(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return _pick(log, keys, F.col(seq))


def first(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return _pick(log, keys, F.col(seq), biggest=False)


def conflicts(log: DataFrame, key: str, usable: Column, arm: str) -> DataFrame:
    """Keys that have usable rows in more than one arm."""
    return log.where(usable).groupBy(key).agg(F.count_distinct(arm).alias("n_arms")).where("n_arms > 1")


def duplicate_stats(log: DataFrame, key: str, by: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return log.groupBy(*by).agg(
        n.alias("lines"), F.count_distinct(key).alias("unique"), (n - F.count_distinct(key)).alias("duplicate_lines")
    )


def disagreeing(log: DataFrame, key: str, value: str) -> DataFrame:
    """Keys written more than once with different values, and how many."""
    return (
        log.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(value).alias("n_values"))
        .where("n_rows > 1 and n_values > 1")
    )
