"""A run log as a stream: ingest in files, the latest usable row per key, spend and failures under limits.

The log arrives as one file per wave of calls (a file source does not see lines appended to a
file it has read). Each micro-batch is appended once to the log table, also when it is replayed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalframe.operators import dedup
from evalframe.operators.windows import FATAL

SCHEMA = "seq long, uid string, model string, pred string, error string, cost double"


def read_waves(spark: SparkSession, path: str, schema: str = SCHEMA, per_trigger: int | None = None) -> DataFrame:
    """Rows of the JSON files in a folder, in waves of at most per_trigger files; torn lines come as nulls and are left out."""
    reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(path).where("uid IS NOT NULL")


def append_log(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch under its own number: a replayed batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/wave={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def todo(examples: DataFrame, log: DataFrame, usable: Column) -> DataFrame:
    """What a resumed run still has to do."""
    done = dedup.latest_usable(log, ["uid"], usable).where(usable).select("uid")
    return examples.join(done, "uid", "left_anti")


@dataclass(frozen=True)
class Limits:
    spend: float
    window: int = 200
    failure_rate: float = 0.5
    concurrency: int = 32
    first_wave: int = 8

    def in_flight(self, spent: float, calls: int) -> int:
        """Calls that may be in flight: the first wave before any came back, then what the rest of the spend pays for."""
        if not calls:
            return max(1, min(self.concurrency, self.first_wave))
        afford = int((self.spend - spent) / (spent / calls)) if spent else self.concurrency
        return max(1, min(self.concurrency, afford))


def guard(stream: DataFrame, limits: Limits) -> DataFrame:
    """Per model, after each wave: spent, calls, failures among the last calls, how many may be in flight, and whether to stop.

    State per model is the running spend and a ring of the last outcomes, so it is bounded. Rows
    of a wave may be out of order between files; they count in the order of seq within the wave.
    """
    window, spend, rate = limits.window, limits.spend, limits.failure_rate

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, calls, ring = state.get if state.exists else (0.0, 0, "")
        rows = pd.concat(list(frames)).sort_values("seq")
        for cost, error in zip(rows["cost"].fillna(0.0), rows["error"]):
            spent, calls = spent + float(cost), calls + 1
            ring = (ring + ("1" if isinstance(error, str) else "0"))[-window:]
        state.update((spent, calls, ring))
        failing = len(ring) >= window and ring.count("1") > rate * len(ring)
        why = "spend" if spent >= spend else "failures" if failing else None
        yield pd.DataFrame({"model": [key[0]], "spent": [spent], "calls": [calls], "failures": [ring.count("1")], "in_flight": [limits.in_flight(spent, calls)], "stop": [why]})

    return stream.groupBy("model").applyInPandasWithState(
        step, "model string, spent double, calls long, failures long, in_flight int, stop string", "spent double, calls long, ring string",
        "update", GroupStateTimeout.NoTimeout,
    )


def latest_table(spark: SparkSession, table: str, usable: Column) -> DataFrame:
    """The log table reduced to the latest usable row per key; rows that came twice count once."""
    return dedup.latest_usable(spark.read.parquet(table).drop("wave").distinct(), ["uid"], usable)


def is_fatal(error: Column) -> Column:
    """Errors that repeating can't mend, told as windows.retry_plan tells them."""
    told = F.lower(error)
    return reduce(lambda p, q: p | q, (told.contains(words) for words in FATAL))
