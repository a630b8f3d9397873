"""Policies, guards and streams on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalframe.operators import aggregates, dedup, generation, graph, joins, windows
from evalframe.sources import adapters, logs
from evalframe.streaming import runlog


def log(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, "a", None), (4, "a", "y"), (5, "a", None), (6, "b", None), (7, "b", None), (8, "c", "z"), (9, "c", None)]
    return spark.createDataFrame(rows, "seq long, uid string, pred string")


@pytest.mark.parametrize(
    "policy, want",
    [(dedup.latest_usable, {"a": 4, "b": 7, "c": 8}), (dedup.latest_usable_first_null, {"a": 4, "b": 6, "c": 8}), (dedup.last_then_usable, {}), (dedup.usable_then_last, {"a": 4, "c": 8})],
)
def test_dedup_policies(spark, policy, want):
    assert {r.uid: r.seq for r in policy(log(spark), ["uid"], F.col("pred").isNotNull()).collect()} == want
    assert policy(log(spark).limit(0), ["uid"], F.col("pred").isNotNull()).count() == 0


def test_last_of_all(spark):
    assert {r.uid: r.seq for r in dedup.last(log(spark), ["uid"]).collect()} == {"a": 5, "b": 7, "c": 9}


def test_positions_and_bins_are_those_of_a_sorted_list(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("pqr") if i % 9 else None, float(rnd.randrange(12)) if i % 13 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    kept = sorted((v, i, g) for i, g, v in rows if v is not None)
    got = {r.id: r.bin for r in windows.equal_count_bins(df, "v", 7, "id").collect()}
    edges = [b * len(kept) // 7 for b in range(8)]
    assert got == {i: sum(at >= e for e in edges[1:-1]) for at, (_, i, _) in enumerate(kept)}
    placed = windows.positions(df.where("v IS NOT NULL"), ["v", "id"], ["g"]).collect()
    for group in {g for _, _, g in kept}:
        own = [i for _, i, g in kept if g == group]
        assert {r.id: (r._row, r._n) for r in placed if r.g == group} == {i: (k + 1, len(own)) for k, i in enumerate(own)}
    cuts = windows.order_statistics(df, "v", 3, "id").orderBy("part").collect()
    assert [r.cut for r in cuts] == [kept[len(kept) // 3][0], kept[2 * len(kept) // 3][0]]
    assert windows.positions(df.limit(0), ["v"]).count() == 0


def test_percentiles_per_group(spark):
    import statistics

    rnd = random.Random(3)
    groups = {"a": [rnd.random() for _ in range(57)], None: [rnd.random() for _ in range(4)], "b": [0.4, 0.9], "c": [0.7]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    got = {r.g: r for r in windows.percentiles(df.repartition(4), ["g"], "v", med=("median", 0), p90=("exclusive", 90)).collect()}
    for g, vs in groups.items():
        assert (got[g].n, got[g].med) == (len(vs), pytest.approx(statistics.median(vs)))
        assert got[g].p90 == pytest.approx(statistics.quantiles(vs, n=100)[89] if len(vs) > 2 else min(vs))


def test_running_figures(spark):
    rnd = random.Random(1)
    rows = [(3 * i, rnd.random() * 2, rnd.random() < 0.4) for i in range(700)]
    df = spark.createDataFrame(rows, "seq long, cost double, failed boolean").repartition(6)
    rate = {r.seq: (r.recent, r.failure_rate) for r in windows.failure_rate(df, F.col("failed"), "seq", last=50, chunk=60).collect()}
    spent = 0.0
    window = {r.seq: r for r in windows.submission_window(df, "cost", "seq", 100.0, 20).collect()}
    admitted = {r.seq for r in windows.affordable(df, "cost", 100.0, "seq").collect()}
    for k, (seq, cost, _) in enumerate(rows):
        last = [f for *_, f in rows[max(0, k - 49) : k + 1]]
        assert rate[seq] == (len(last), pytest.approx(sum(last) / len(last)))
        assert (seq in admitted) == (spent < 100)
        spent += cost
        r = window[seq]
        assert (r.calls, r.spent, r.first_wave) == (k + 1, pytest.approx(spent), 8)
        assert r.window == max(1, min(20, int((100 - spent) // (spent / (k + 1))))) and r.exhausted == (spent >= 100)
    with pytest.raises(ValueError):
        windows.failure_rate(df, F.col("failed"), "seq", last=50, chunk=10)


def test_no_operator_sorts_a_table_in_one_task(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 1.0).withColumn("f", F.col("id") % 2 == 0)
    for made in (windows.equal_count_bins(df, "v", 4, "id"), windows.failure_rate(df, F.col("f"), "id"), windows.order_statistics(df, "v", 3, "id")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        # Windows without a group see the counts of the ranges only.
        assert all("_part" in w or "_in" in w or "_c" in w for w in plan.split("\n") if "Window [" in w)


def test_allocate_and_sample(spark):
    cells = spark.createDataFrame([("x", 5.0), ("y", 3.0), ("z", 1.0)], "c string, w double")
    given = lambda n: [r.given for r in windows.allocate(cells, "w", n, "c").orderBy("c").collect()]
    assert given(9) == [5, 3, 1] and given(1) == [1, 0, 0] and given(10) == [6, 3, 1] and given(0) == [0, 0, 0]
    sizes = {"north": 41, "south": 12, "west": 2, None: 9}
    pool = spark.createDataFrame([(c, f"{c}-{i}") for c, n in sizes.items() for i in range(n)], "cell string, uid string")
    take = lambda seed: windows.stratified_sample(pool, ["cell"], 9, "uid", seed).collect()
    first = take(4)
    for c, n in sizes.items():
        rows = [r for r in first if r.cell == c]
        assert len(rows) == min(n, 9) and all(r.pool == n for r in rows)
    assert sorted(r.uid for r in first) == sorted(r.uid for r in take(4)) != sorted(r.uid for r in take(5))


def test_retries_prices_and_wanted_keys(spark):
    calls = spark.createDataFrame(
        [("a", 2_000_000, 0, None, 0), ("a", 0, 1_000_000, "Overloaded", 1), ("b", 5, 5, "out of CREDIT BALANCE", 0), ("a", 1, 1, "timeout", 2)],
        "model string, in_tokens long, out_tokens long, error string, attempt int",
    )
    plan = windows.retry_plan(calls, F.col("error"), F.col("attempt")).collect()
    assert [(r.action, r.wait) for r in plan] == [("done", None), ("retry", 2.0), ("abort", None), ("give_up", None)]
    prices = spark.createDataFrame([("a", 1.0, 5.0)], "model string, usd_in double, usd_out double")
    spent = {r.model: (r.calls, round(r.usd, 5), r.exhausted) for r in windows.spend(calls, prices, ["model"], 7.0).collect()}
    assert spent == {"a": (3, 7.00001, True), "b": (1, 0.0, False)}
    with pytest.raises(ValueError, match="zz"):
        joins.whitelist(calls, spark.createDataFrame([("a",), ("zz",)], "model string"), "model")


def test_paired_takes_the_last_of_a_repeated_key(spark):
    a = spark.createDataFrame([(1, True, 1), (1, False, 2), (2, True, 1)], "k int, hit boolean, seq int")
    b = spark.createDataFrame([(1, True, 5), (2, False, 9), (2, True, 3)], "k int, hit boolean, seq int")
    r = aggregates.paired(a, b, ["k"], order="seq").first()
    assert (r.n, r.both, r.only_a, r.only_b, r.neither) == (2, 0, 1, 1, 0)


def test_boxes_meet_in_cells_as_they_do_pairwise(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(160):
        x, y, w, h = rnd.uniform(-0.1, 1), rnd.uniform(-0.1, 1), rnd.random() ** 3 * 0.4, rnd.random() ** 3 * 0.4
        rows.append((i, i % 2, (x, y, x + w, y + h), rnd.random(), rnd.random(), rnd.random() < 0.5))
    df = spark.createDataFrame(rows, "uid int, scene int, box struct<x0:double,y0:double,x1:double,y1:double>, x double, y double, hit boolean")
    others = lambda r: [o for o in rows if o[1] == r[1] and o[0] != r[0]]
    over = lambda a, b: a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    holds = lambda a, b: a[0] <= b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3]
    area = lambda a: (a[2] - a[0]) * (a[3] - a[1])
    mid = lambda a: ((a[0] + a[2]) / 2, (a[1] + a[3]) / 2)
    assert {r.uid for r in joins.without_overlap(df, "scene", "uid").collect()} == {r[0] for r in rows if not any(over(r[2], o[2]) for o in others(r))}
    on = {r[0] for r in rows if not r[5] and any(o[2][0] <= r[3] <= o[2][2] and o[2][1] <= r[4] <= o[2][3] for o in others(r))}
    assert {r.uid for r in joins.misses_on_other_box(df, df, "scene", "uid").collect()} == on
    inside = {r[0]: min((area(o[2]), o[0]) for o in others(r) if holds(o[2], r[2]) and area(o[2]) <= 0.06)[1] for r in rows if any(holds(o[2], r[2]) and area(o[2]) <= 0.06 for o in others(r))}
    assert {r.uid: r.outer for r in joins.smallest_enclosing(df, "scene", "uid", 0.06).collect()} == inside and inside
    near = {}
    for r in rows:
        (cx, cy), found = mid(r[2]), []
        for o in others(r):
            ox, oy = mid(o[2])
            if ox > cx and abs(oy - cy) <= 0.03:
                found.append((ox - cx, o[0]))
        if found:
            near[r[0]] = min(found)[1]
    assert {r.uid: r.neighbour for r in joins.nearest_right(df, "scene", "uid", 0.03).collect()} == near


def test_unconnected_pairs_and_styles(spark):
    nodes = spark.createDataFrame([(g, f"{g}{i}", lab) for g in "uv" for i, lab in enumerate(("ant", "bee", "cat", "doe"))], "gid string, id string, label string")
    edges = spark.createDataFrame([("u", "u0", "u1", "solid", 1), ("u", "u1", "u0", "open", 0), ("u", "u2", "u1", "thick", 2)], "gid string, src string, dst string, style string, seq int")
    full = [("v", f"v{a}", f"v{b}", "solid", 9) for a in range(4) for b in range(a)]
    edges = edges.unionByName(spark.createDataFrame(full, edges.schema))
    free = {("ant", "cat"), ("ant", "doe"), ("bee", "doe"), ("cat", "doe")}
    picks = {(r.gid, (r.a, r.b)) for seed in range(12) for r in graph.unconnected_pair(nodes, edges, seed).collect()}
    assert {g for g, _ in picks} == {"u"} and {p for _, p in picks} <= free and len(picks) > 1
    asked = spark.createDataFrame([("u", "ant", "bee"), ("u", "bee", "cat"), ("u", "ant", "doe"), ("u", "ant", "elk")], "gid string, a string, b string")
    assert {(r.a, r.b): r.style for r in graph.edge_style(asked, nodes, edges).collect()} == {("ant", "bee"): "open", ("bee", "cat"): "thick", ("ant", "doe"): None, ("ant", "elk"): None}


def test_word_choices_hold_one_word_that_is_there(spark):
    pool = ["harbour", "granite", "orchard", "lantern", "velvet"]
    rows = [(i, [f"The {w} by the Harbour", "wide path"]) for i, w in enumerate(("mill", "granite", "tower", "ox"))] + [(9, ["a b"]), (10, [" ".join(pool)])]
    df = spark.createDataFrame(rows, "scene int, labels array<string>")
    got = {r.scene: r for r in generation.word_choice(df, pool, 3).collect()}
    assert set(got) == {0, 1, 2, 3}
    for i, labels in rows[:4]:
        r, text = got[i], " ".join(labels).lower()
        there = [w for w in r.options if w.lower() in text]
        assert len(r.options) == 4 and there == [r.answer_text] and r.options["ABCD".index(r.answer)] == r.answer_text


def test_arms_are_refused_or_chosen(spark):
    rows = [("s__m1_think0_plain_r1.jsonl", "m1", 0, "plain"), ("s__m1_think0_edge_r1.jsonl", "m1", 0, "edge"), ("s__m2_think0_plain_r1.jsonl", "m2", 0, "plain")]
    runs = spark.createDataFrame(rows, "source_file string, model string, budget int, condition string")
    m1 = runs.where("model = 'm1'")
    assert logs.resolve_arm(m1, canonical="plain") == [rows[0][0]]
    assert len(logs.resolve_arm(m1, across=True)) == 2
    for bad in (lambda: logs.resolve_arm(m1), lambda: logs.resolve_arm(runs, across=True), lambda: logs.resolve_arm(runs, wanted="none")):
        with pytest.raises(ValueError):
            bad()


def test_guards(spark, tmp_path):
    path = f"{tmp_path}/out"
    assert logs.write_unless_empty(spark.range(3), path) == 3
    with pytest.raises(ValueError):
        logs.write_unless_empty(spark.range(0), path)
    assert spark.read.json(path).count() == 3
    with pytest.raises(ValueError):
        logs.require_rows(spark.range(3).withColumn("g", F.lit("x")), "g", 4)
    with pytest.raises(KeyError):
        adapters.load("none", spark.range(1))
    assert logs.compare_shapes('{"a": [1], "b": 1}', '{"a": ["x"], "c": 1}') == {"missing": ["$.b"], "extra": ["$.c"], "changed": ["$.a[]"]}
    before = logs.fingerprint(spark, path)
    assert logs.changed(before, before).count() == 0
    assert logs.markdown_table(spark.range(1)).splitlines()[-1] == "| 0 |"


def test_stream_guard_stops_on_spend_and_failures(spark, tmp_path):
    waves = tmp_path / "waves"
    waves.mkdir()
    for wave in range(3):
        rows = [{"seq": wave * 10 + i, "uid": f"u{i}", "model": m, "pred": "p", "error": "e" if m == "bad" else None, "cost": 0.5} for i in range(10) for m in ("bad", "good")]
        (waves / f"{wave}.json").write_text("\n".join(map(json.dumps, rows)) + '\n{"seq": 1, "ui')
    stream = runlog.guard(runlog.read_waves(spark, str(waves), per_trigger=1), runlog.Limits(spend=12.0, window=20))
    q = stream.writeStream.format("memory").queryName("guarded").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.table("guarded").collect():
        got.setdefault(r.model, []).append((r.calls, r.spent, r.stop))
    assert sorted(got["good"]) == [(10, 5.0, None), (20, 10.0, None), (30, 15.0, "spend")]
    assert sorted(got["bad"])[1] == (20, 10.0, "failures")
    flight = {(r.model, r.calls): r.in_flight for r in spark.table("guarded").collect()}
    assert (flight["good", 10], flight["good", 20], flight["good", 30]) == (14, 4, 1)
    limits = runlog.Limits(spend=5.0, concurrency=3)
    assert (limits.in_flight(0.0, 0), runlog.Limits(spend=5.0).in_flight(0.0, 0), limits.in_flight(0.0, 9)) == (3, 8, 3)
    told = spark.createDataFrame([("Your Credit Balance is low",), ("timeout",), (None,)], "e string")
    assert [r.v for r in told.select(runlog.is_fatal(F.col("e")).alias("v")).collect()] == [True, False, None]
