import statistics

from pyspark.sql import functions as F

from evalframe.functions import permute
from evalframe.operators import windows


def test_every_key_permutes_every_size(spark):
    for n in (1, 2, 3, 7, 10, 50, 101, 1000):
        df = spark.range(n).withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(6))))
        got = df.withColumn("to", permute.permuted(F.col("id"), n, F.col("key"))).collect()
        by_key = {}
        for r in got:
            by_key.setdefault(r.key, {})[r.id] = r.to
        for to in by_key.values():
            assert sorted(to.values()) == list(range(n))
        if n >= 50:
            assert len({tuple(sorted(to.items())) for to in by_key.values()}) == 7


def test_places_are_spread(spark):
    """Each of 16 places is hit by each of 16 positions about as often, and positions do not keep their neighbours."""
    n, keys = 16, 4000
    df = spark.range(n).withColumn("key", F.explode(F.sequence(F.lit(1), F.lit(keys))))
    cells = df.withColumn("to", permute.permuted(F.col("id"), n, F.col("key"))).groupBy("id", "to").count().collect()
    chi2 = sum((c["count"] - keys / n) ** 2 / (keys / n) for c in cells) + (n * n - len(cells)) * keys / n
    assert chi2 < 330  # 225 degrees of freedom: mean 225, spread 21
    far = spark.range(9999).select(permute.permuted(F.col("id"), 10_000, F.lit(3)).alias("a"), permute.permuted(F.col("id") + 1, 10_000, F.lit(3)).alias("b"))
    assert 3000 < far.agg(F.avg(F.abs(F.col("a") - F.col("b")))).first()[0] < 3700


def test_permutation_null_of_independent_columns(spark):
    rows = [(i, i % 4, (i * 7) % 4) for i in range(2000)]
    df = spark.createDataFrame(rows, "uid int, a int, b int").repartition(5)
    rates = windows.permutation_null(df, ["uid"], ["a"], ["b"], F.col("a") == F.col("b"), 20).collect()
    assert sorted(r.rep for r in rates) == list(range(1, 21))
    assert abs(statistics.mean(r.rate for r in rates) - 0.25) < 0.01 and len({r.rate for r in rates}) > 10
    plan = windows.permutation_null(df, ["uid"], ["a"], ["b"], F.col("a") == F.col("b"), 20)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_a_value_of_half_of_the_rows_is_one_row(spark):
    rows = [(i % 3, 5.0 if i % 2 else float(i % 11), i) for i in range(3000)] + [(9, 1.0, -1), (9, None, -2), (None, 2.0, -3), (None, 4.0, -4)]
    df = spark.createDataFrame(rows, "g int, v double, id int").repartition(7)
    counted = windows.counted_positions(df.where("v is not null"), ["g"], "v")
    assert counted.count() == 3 * 11 + 1 + 2
    got = {r.g: (r.n, r.m, r.p) for r in windows.percentiles(df, ["g"], "v", m=("median", 0), p=("exclusive", 90)).collect()}
    for g in (0, 1, 2, None, 9):
        vs = [v for k, v, _ in rows if k == g and v is not None]
        p90 = statistics.quantiles(vs, n=100)[89] if len(vs) > 2 else sorted(vs)[0]
        assert got[g] == (len(vs), statistics.median(vs), p90)
    shares = {r.id: r.share for r in windows.cumulative_share(df, ["g"], "v").collect()}
    for g, v, i in rows:
        vs = [x for k, x, _ in rows if k == g and x is not None]
        assert (i not in shares) if v is None else abs(shares[i] - sum(x <= v for x in vs) / len(vs)) < 1e-12


def test_groups_are_numbered_in_ranges(spark):
    rows = [("hot", float(i % 50), i) for i in range(500)] + [("b", 1.0, 1), (None, 3.0, 2), (None, 1.0, 3)]
    df = spark.createDataFrame(rows, "g string, v double, id int").repartition(4)
    got = {(r.g, r.pick): r.id for r in windows.extremes(df, "g", "v", "id").collect()}
    hot = sorted(rows[:500], key=lambda r: (r[1], r[2]))
    assert (got["hot", "worst"], got["hot", "best"], got["hot", "median"]) == (hot[0][2], hot[-1][2], hot[250][2])
    assert (got[None, "worst"], got[None, "best"]) == (3, 2)
    for r in windows.advantages(df, "g", "v").where("g is null or g = 'b'").collect():
        assert (r.dead, r.advantage) == ((True, None) if r.g == "b" else (False, 1.0 if r.v == 3.0 else -1.0))


def test_positions_are_turned_as_arrays(spark):
    df = spark.range(1000).select("id", (F.col("id") % 5).alias("key"))
    plan = df.select(permute.permuted(F.col("id"), 1000, F.col("key")).alias("to"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
    odd = df.select(permute.permuted(F.when(F.col("id") > 0, F.col("id")), 1000, F.lit(2)).alias("to")).where("to < 0").count()
    assert odd == 1


def test_shuffles_against_chance_are_never_broadcast(spark):
    df = spark.range(1000).select("id", F.lit("a").alias("l"), F.lit("b").alias("r"))
    rates = windows.permutation_null(df, ["id"], ["l"], ["r"], F.col("l") == F.col("r"), 4)
    assert rates.count() == 4 and "SortMergeJoin" in rates._jdf.queryExecution().executedPlan().toString()
