"""The run loop as keyed state: what each model has spent, how its last calls went, whether it stops; the last usable row of each key.

Waves of a log are reduced in the tasks that read them (a row a key and task, with the last outcomes), so a
model or key with most of the rows is not carried whole to one task. Whole numbers of nano-dollars, and the
calls' own order for what came last, make the state the same for any order and cutting of the waves.

State survives in the checkpoint: totals as a value, the last outcomes as a list, kinds of error as a map, and
the last usable row of a key as a value that expires after a time without rows. A run over a log that is stored
already starts from it as the initial state.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evalframe.storage import small_side
from evalframe.streaming.runlog import is_fatal

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Budget:
    nano: int
    window: int = 200
    failure_rate: float = 0.5


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls plus nano: nano-dollars of their tokens at prices (model, nano_in, nano_out a token); 0 without a price."""
    cost = F.col("in_tokens") * F.col("nano_in") + F.col("out_tokens") * F.col("nano_out")
    return calls.join(small_side(prices), "model", "left").withColumn("nano", F.coalesce(cost, F.lit(0).cast("long"))).drop("nano_in", "nano_out")


_OUTCOME = "array<struct<seq:bigint,failed:boolean>>"
_PART = f"model string, nano bigint, calls bigint, fatal bigint, failed bigint, ring {_OUTCOME}"


def _told(calls: DataFrame) -> DataFrame:
    error = F.col("error")
    return calls.select("model", "seq", "nano", error.isNotNull().alias("failed"), F.coalesce(is_fatal(error), F.lit(False)).alias("fatal"))


def _parts(calls: DataFrame, window: int) -> DataFrame:
    """A row a model and task: sums, and the last outcomes by seq."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for model, seq, nano, failed, fatal in zip(*(c.to_pylist() for c in b.columns)):
                s = sums.get(model)
                if s is None:
                    s = sums[model] = [0, 0, 0, 0, []]
                s[0], s[1], s[2], s[3] = s[0] + nano, s[1] + 1, s[2] + fatal, s[3] + failed
                (heapq.heappush if len(s[4]) < window else heapq.heappushpop)(s[4], (seq, failed))
        rings = [[{"seq": q, "failed": f} for q, f in s[4]] for s in sums.values()]
        columns = [pa.array([*sums], pa.string())] + [pa.array([s[i] for s in sums.values()], pa.int64()) for i in range(4)]
        ring = pa.list_(pa.struct([("seq", pa.int64()), ("failed", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([*columns, pa.array(rings, ring)], names=["model", "nano", "calls", "fatal", "failed", "ring"])

    return _told(calls).mapInArrow(reduce, _PART)


def stored_totals(log: DataFrame, budget: Budget) -> DataFrame:
    """The state that a stored log leaves: a row a model, in the form of the parts."""
    told = _told(log)
    last = told.withColumn("_r", F.row_number().over(W.partitionBy("model").orderBy(F.desc("seq")))).where(F.col("_r") <= budget.window)
    ring = last.groupBy(F.col("model").alias("_m")).agg(F.collect_list(F.struct("seq", "failed")).alias("ring"))
    sums = told.groupBy("model").agg(F.sum("nano").alias("nano"), F.count(F.lit(1)).alias("calls"), F.count_if("fatal").alias("fatal"), F.count_if("failed").alias("failed"))
    return sums.join(ring, F.col("model").eqNullSafe(F.col("_m"))).select("model", "nano", "calls", "fatal", "failed", F.col("ring").cast(_OUTCOME).alias("ring"))


class _Ledger(StatefulProcessor):
    def __init__(self, budget: Budget) -> None:
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "nano bigint, calls bigint")
        self.kinds = handle.getMapState("kinds", "kind string", "n bigint")
        self.ring = handle.getListState("ring", "seq bigint, failed boolean")

    def _add(self, frames: Iterator[pd.DataFrame]) -> tuple:
        nano, calls = self.totals.get() if self.totals.exists() else (0, 0)
        kinds = {k: (self.kinds.getValue((k,))[0] if self.kinds.containsKey((k,)) else 0) for k in ("fatal", "failed")}
        ring = [(int(r[0]), bool(r[1])) for r in self.ring.get()] if self.ring.exists() else []
        for part in (row for f in frames for row in f.itertuples(index=False)):
            nano, calls = nano + int(part.nano), calls + int(part.calls)
            kinds = {"fatal": kinds["fatal"] + int(part.fatal), "failed": kinds["failed"] + int(part.failed)}
            ring += [(int(o["seq"]), bool(o["failed"])) for o in part.ring]
        ring = heapq.nlargest(self.budget.window, ring)
        self.totals.update((nano, calls))
        for k, n in kinds.items():
            self.kinds.updateValue((k,), (n,))
        if ring:
            self.ring.put(ring)
        return nano, calls, kinds, ring

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._add(iter([initialState]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        nano, calls, kinds, ring = self._add(rows)
        yield pd.DataFrame({"model": [key[0]], "nano": [nano], "calls": [calls], "fatal": [kinds["fatal"]], "failed": [kinds["failed"]], "recent": [len(ring)], "recent_failed": [sum(f for _, f in ring)]})


def stored_states(log: DataFrame, budget: Budget) -> DataFrame:
    """What ledger says of a stored log."""
    recent = [F.size("ring").cast("long").alias("recent"), F.size(F.filter("ring", lambda o: o["failed"])).cast("long").alias("recent_failed")]
    return stored_totals(log, budget).select("model", "nano", "calls", "fatal", "failed", *recent)


_STATE = "model string, nano bigint, calls bigint, fatal bigint, failed bigint, recent bigint, recent_failed bigint"


def stop_reason(budget: Budget) -> Column:
    """fatal, failures or spend, whichever holds first in that order; null while the run goes on."""
    failing = (F.col("recent") >= budget.window) & (F.col("recent_failed") > budget.failure_rate * F.col("recent"))
    return F.when(F.col("fatal") > 0, "fatal").when(failing, "failures").when(F.col("nano") >= budget.nano, "spend")


def in_flight(budget: Budget, concurrency: int, first: int = 8) -> Column:
    """Calls that may be in flight: the first wave before any came back, then what the rest of the budget pays for at the mean cost so far; 0 once the run stops."""
    mean = F.col("nano") / F.col("calls")
    afford = F.when(mean > 0, F.floor((budget.nano - F.col("nano")) / mean)).otherwise(F.lit(concurrency))
    going = F.when(F.col("calls") == 0, F.least(F.lit(concurrency), F.lit(first))).otherwise(F.least(F.lit(concurrency), afford))
    return F.when(stop_reason(budget).isNotNull(), 0).otherwise(F.greatest(F.lit(1), going)).cast("int")


def ledger(stream: DataFrame, budget: Budget, log: DataFrame | None = None) -> DataFrame:
    """After each wave, of the models it has: nano, calls, fatal, failed, recent, recent_failed; carried on from the stored log."""
    begun = None if log is None else stored_totals(log, budget).groupBy("model")
    return _parts(stream, budget.window).groupBy("model").transformWithStateInPandas(_Ledger(budget), _STATE, "Update", "None", begun)


_LAST = "uid string, rows bigint, seq bigint, pred string"


class _Latest(StatefulProcessor):
    """Taken as rows: keys are many and have a part or two a wave, for which a frame each costs more than the state."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "rows bigint, seq bigint, pred string", self.ttl_ms)

    def _add(self, parts: Iterator[Row]) -> tuple:
        n, seq, pred = self.last.get() or (0, None, None)
        for part in parts:
            n += part.rows
            if part.seq is not None and (seq is None or part.seq > seq):
                seq, pred = part.seq, part.pred
        self.last.update((n, seq, pred))
        return n, seq, pred

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._add(iter([initialState]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, seq, pred = self._add(rows)
        yield Row(uid=key[0], rows=n, seq=seq, pred=pred)


def stored_last(log: DataFrame, usable: Column) -> DataFrame:
    """What latest says of a stored log."""
    at = F.when(F.coalesce(usable, F.lit(False)), F.col("seq"))
    return log.groupBy("uid").agg(F.count(F.lit(1)).alias("rows"), F.max(at).alias("seq"), F.max_by("pred", at).alias("pred"))


def _last_parts(rows: DataFrame) -> DataFrame:
    """A row a key and task: how many rows, and the last usable of them."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict = {}
            for uid, seq, pred, usable in zip(*(c.to_pylist() for c in b.columns)):
                h = held.setdefault(uid, [0, None, None])
                h[0] += 1
                if usable and (h[1] is None or seq > h[1]):
                    h[1], h[2] = seq, pred
            kinds = [pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([*held], pa.string())] + [pa.array([h[i] for h in held.values()], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "rows", "seq", "pred"])

    return rows.mapInArrow(reduce, _LAST)


def latest(stream: DataFrame, usable: Column, ttl_ms: int = 7 * 24 * 3_600_000, log: DataFrame | None = None) -> DataFrame:
    """After each wave, of the keys it has: rows so far, and seq and pred of the last usable one.

    A key without rows for ttl_ms is forgotten; late and repeated rows change nothing that came after them.
    """
    told = stream.select("uid", "seq", "pred", F.coalesce(usable, F.lit(False)).alias("usable"))
    begun = None if log is None else stored_last(log, usable).groupBy("uid")
    return _last_parts(told).groupBy("uid").transformWithState(_Latest(ttl_ms), _LAST, "Update", "ProcessingTime", begun)


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """State of this kind needs the RocksDB provider, and expiry must not ask for batches without rows for ever; the session's own settings are put back."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def run_to_table(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Take all waves there are, and keep what each says under its own number; a wave that is replayed replaces itself."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/wave={number}")

    with _settings(spark):
        query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def last_states(spark: SparkSession, table: str, key: str, schema: str, begun: DataFrame | None = None) -> DataFrame:
    """What the last wave that had a key said of it, or what was stored before of a key that none had."""
    rows = spark.read.schema(f"{schema}, wave bigint").parquet(table)
    rest = [c for c in rows.columns if c not in (key, "wave")]
    if begun is not None:
        rows = rows.unionByName(begun.select(key, *rest).withColumn("wave", F.lit(-1).cast("long")))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "wave").alias("_s")).select(key, "_s.*")


def ledger_table(spark: SparkSession, table: str, begun: DataFrame | None = None) -> DataFrame:
    return last_states(spark, table, "model", _STATE, begun)


def latest_table(spark: SparkSession, table: str, begun: DataFrame | None = None) -> DataFrame:
    return last_states(spark, table, "uid", _LAST, begun)
