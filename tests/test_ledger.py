import random

from pyspark.sql import functions as F

from evalframe.storage import scratch
from evalframe.streaming import ledger as lg

SCHEMA = "seq long, uid string, model string, pred string, error string, nano long"


def case(n=400):
    rnd = random.Random(6)
    error = lambda m: None if rnd.random() < 0.6 else "Monthly QUOTA" if m == "c" and rnd.random() < 0.1 else "timed out"
    rows = []
    for i in range(n):
        m = rnd.choice(["a", "a", "a", "b", "c", None])
        rows.append((i, f"q{rnd.randrange(40)}", m, None if rnd.random() < 0.3 else f"v{i}", error(m), rnd.randrange(1000)))
    rnd.shuffle(rows)
    return rows


def brute(rows, budget):
    out = {}
    for m in {r[2] for r in rows}:
        mine = sorted(r for r in rows if r[2] == m)
        last = mine[-budget.window :]
        nano, failed = sum(r[5] for r in mine), [r[4] is not None for r in mine]
        fatal = sum("quota" in (r[4] or "").lower() for r in mine)
        recent_failed = sum(r[4] is not None for r in last)
        stop = "fatal" if fatal else "failures" if len(last) >= budget.window and recent_failed > budget.failure_rate * len(last) else "spend" if nano >= budget.nano else None
        out[m] = (nano, len(mine), fatal, sum(failed), len(last), recent_failed, stop)
    return out


def latest(rows):
    out = {}
    for seq, uid, _, pred, error, _ in sorted(rows, key=lambda r: r[0]):
        n, s, p = out.get(uid, (0, None, None))
        out[uid] = (n + 1, seq, pred) if pred is not None and error is None else (n + 1, s, p)
    return out


def test_waves_restarts_and_a_stored_log_give_the_same(spark):
    rows, budget = case(), lg.Budget(50_000, window=25, failure_rate=0.4)
    usable = F.col("pred").isNotNull() & F.col("error").isNull()

    for stored in (0, 150):
        log = spark.createDataFrame(rows[:stored], SCHEMA) if stored else None
        waves, later = scratch(spark, "waves"), scratch(spark, "later")
        spark.createDataFrame(rows[stored:280], SCHEMA).repartition(3).write.json(waves)
        spark.createDataFrame(rows[280:], SCHEMA).repartition(2).write.json(later)
        source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).json(waves)
        tables = [scratch(spark, k) for k in ("ledger", "latest")]
        marks = [scratch(spark, "mark") for _ in tables]
        for again in range(2):  # the second run goes on from the checkpoint with files that came later
            if again:
                spark.read.schema(SCHEMA).json(later).write.mode("append").json(waves)
            lg.run_to_table(lg.ledger(source(), budget, log), tables[0], marks[0])
            lg.run_to_table(lg.latest(source(), usable, log=log), tables[1], marks[1])
        begun = [None, None] if log is None else [lg.stored_states(log, budget), lg.stored_last(log, usable)]
        got = lg.ledger_table(spark, tables[0], begun[0]).withColumn("stop", lg.stop_reason(budget)).collect()
        assert {r.model: tuple(r)[1:] for r in got} == brute(rows, budget)
        last = lg.latest_table(spark, tables[1], begun[1]).collect()
        assert {r.uid: (r.rows, r.seq, r.pred) for r in last} == latest(rows)



def test_a_model_of_the_stored_log_alone_keeps_its_state(spark):
    budget = lg.Budget(10, window=2)
    log = spark.createDataFrame([(1, "q", "old", "v", None, 12)], SCHEMA)
    waves, table = scratch(spark, "waves"), scratch(spark, "table")
    spark.createDataFrame([(2, "q", "new", "v", "x", 1)], SCHEMA).write.json(waves)
    lg.run_to_table(lg.ledger(spark.readStream.schema(SCHEMA).json(waves), budget, log), table, scratch(spark, "mark"))
    got = lg.ledger_table(spark, table, lg.stored_states(log, budget)).withColumn("stop", lg.stop_reason(budget))
    assert sorted((r.model, r.nano, r.recent, r.stop) for r in got.collect()) == [("new", 1, 1, None), ("old", 12, 1, "spend")]


def test_latest_is_told_in_rows_without_frames():
    class Held:
        state = None

        def get(self):
            return self.state

        def update(self, state):
            self.state = state

    from pyspark.sql import Row

    p = lg._Latest(1000)
    p.last = Held()
    p.handleInitialState(("a",), Row(uid="a", rows=2, seq=None, pred=None), None)
    parts = [Row(uid="a", rows=1, seq=7, pred="x"), Row(uid="a", rows=3, seq=5, pred="y")]
    assert [r.asDict() for r in p.handleInputRows(("a",), iter(parts), None)] == [{"uid": "a", "rows": 6, "seq": 7, "pred": "x"}]
