"""The run loop replayed as a stream over a log of which a part is stored already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.plans.base import query
from evalframe.plans.rules import _PRICES
from evalframe.storage import scratch
from evalframe.streaming import ledger as lg

#: A dollar a million tokens is a thousand nano-dollars a token.
_NANO = tuple((m, int(i * 1000), int(o * 1000)) for m, i, o in _PRICES)
_BUDGET = lg.Budget(25_000_000_000)
#: Of five rows two are in the stored log; the others come in waves, late or not.
_STORED = "seq % 5 < 2"


def _waves(df: DataFrame) -> DataFrame:
    """df written as files, a sixth of them a wave, and read as a stream."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "waves")
    df.repartitionByRange("seq").write.json(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path").count()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // 6))).json(path)


@query("x02_streamed_ledger", f"""WITH p AS (SELECT *, in_tokens * i + out_tokens * o AS nano, error IS NOT NULL AS bad,
  coalesce(regexp_matches(lower(error), 'credit balance|billing|spend limit|quota'), false) AS fatal, row_number() OVER (PARTITION BY model ORDER BY seq DESC) AS back
  FROM calls LEFT JOIN (VALUES {", ".join(f"('{m}', {i}::BIGINT, {o}::BIGINT)" for m, i, o in _NANO)}) AS v(m, i, o) ON m = model),
s AS (SELECT model, coalesce(sum(nano), 0)::BIGINT AS nano, count(*) AS calls, count(*) FILTER (WHERE fatal) AS fatal, count(*) FILTER (WHERE bad) AS failed,
  count(*) FILTER (WHERE back <= 200) AS recent, count(*) FILTER (WHERE back <= 200 AND bad) AS recent_failed FROM p GROUP BY model),
r AS (SELECT *, CASE WHEN fatal > 0 THEN 'fatal' WHEN recent >= 200 AND recent_failed > 0.5 * recent THEN 'failures' WHEN nano >= {_BUDGET.nano} THEN 'spend' END AS stop FROM s)
SELECT *, CASE WHEN stop IS NOT NULL THEN 0 ELSE greatest(1, least(3000, CASE WHEN nano > 0 THEN floor(({_BUDGET.nano} - nano) / (nano / calls)) ELSE 3000 END)) END::INT AS in_flight FROM r""")
def _(t):
    prices = t.spark.createDataFrame(list(_NANO), "model string, nano_in long, nano_out long")
    told = ["seq", "model", "in_tokens", "out_tokens", "error"]
    log = lg.priced(t.calls.where(_STORED).select(*told), prices)
    stream = lg.priced(_waves(t.calls.where(f"NOT ({_STORED})").select(*told)), prices)
    table, mark = scratch(t.spark, "ledger"), scratch(t.spark, "mark")
    lg.run_to_table(lg.ledger(stream, _BUDGET, log), table, mark)
    return lg.ledger_table(t.spark, table, lg.stored_states(log, _BUDGET)).withColumn("stop", lg.stop_reason(_BUDGET)).withColumn("in_flight", lg.in_flight(_BUDGET, 3000))


@query("x08_streamed_latest", "SELECT uid, count(*) AS n_rows, max(seq) FILTER (WHERE pred IS NOT NULL AND NOT failed) AS last_usable, max_by(pred, seq) FILTER (WHERE pred IS NOT NULL AND NOT failed) AS pred FROM log GROUP BY uid")
def _(t):
    usable = F.col("pred").isNotNull() & ~F.col("failed")
    told = t.log.select("seq", "uid", "pred", "failed")
    log, stream = told.where(_STORED), _waves(told.where(f"NOT ({_STORED})"))
    table, mark = scratch(t.spark, "latest"), scratch(t.spark, "mark")
    lg.run_to_table(lg.latest(stream, usable, log=log), table, mark)
    found = lg.latest_table(t.spark, table, lg.stored_last(log, usable))
    return found.select("uid", F.col("rows").alias("n_rows"), F.col("seq").alias("last_usable"), "pred")
