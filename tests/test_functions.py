"""Literal cases of the functions."""

import pytest
from pyspark.sql import functions as F

from evalframe.functions import answers as an
from evalframe.functions import geometry as geo
from evalframe.functions import stats
from evalframe.functions import text as tx
from evalframe.operators import generation as gen


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(*golds):
    return F.array(*(F.lit(g) for g in golds)) if golds else F.array().cast("array<string>")


def rows(spark, cases, make):
    """make(pred, golds) over a table of (pred, golds, want)."""
    df = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(cases)], "i int, pred string, golds array<string>")
    got = {r.i: r.v for r in df.select("i", make(F.col("pred"), F.col("golds")).alias("v")).collect()}
    return [got[i] for i in range(len(cases))]


def test_anls(spark):
    cases = [
        ("lantern", ["lanterns"], 7 / 8), ("  LANTERN ", ["lantern"], 1), ("oak", ["elm"], 0), ("pine", ["pies"], 0), ("cedars", ["cedaxs"], 5 / 6),
        ("", ["", "q"], 1), ("q", [""], 0), ("q", [], 0), (None, ["q"], 0), ("silver", ["gold", "silvers", "tin"], 6 / 7),
    ]
    assert rows(spark, cases, tx.anls) == pytest.approx([w for *_, w in cases])


def test_numeric_or_text(spark):
    cases = [
        ("7.50", ["7.5"], 1), ("\t7.5 ", ["7.5"], 1), ("63%", ["63"], 1), ("$12", ["12.0"], 1), ("2,750", ["2750"], 1), ("7.5", ["7.6"], 0),
        ("2500000.9", ["2500000"], 1), ("2500009", ["2500000"], 0), ("nine", ["NINE"], 1), ("9", ["nine"], 0), ("9f", ["9"], 0), ("x", ["y", " X"], 1), (None, ["x"], 0),
    ]
    assert rows(spark, cases, tx.numeric_or_text) == [w for *_, w in cases]


def test_token_f1(spark):
    cases = [
        ("red kite", ["red kite over hills"], (0, 2 / 3)), ("over hills red kite", ["red kite over hills"], (0, 1)), ("Red  Kite,", ["red kite"], (1, 1)),
        ("", [""], (1, 1)), ("", ["kite"], (0, 0)), ("kite kite", ["kite"], (0, 2 / 3)), ("a b", ["a", "b a", "a b"], (1, 1)),
    ]
    got = rows(spark, cases, tx.token_f1)
    assert [(r.em, round(r.f1, 9)) for r in got] == [(w[0], round(w[1], 9)) for *_, w in cases]


def test_count(spark):
    cases = [("12", ["9"], (0, 3, 3)), (" 12 ", ["12"], (1, 0, 0)), ("-4", ["2"], (0, 6, -6)), ("8", ["6", "8"], (0, 2, 2)), ("many", ["8"], (0, None, None)), ("8", [], (0, None, None))]
    assert [tuple(r) for r in rows(spark, cases, tx.count_score)] == [w for *_, w in cases]


def test_failure_mode(spark):
    cases = [
        ("beech; ash", ["ash; beech"], "order_only"), ("Ash ; BEECH.", ["ash; beech"], "format_only"), ("ash; beech; yew", ["ash; beech"], "extra_items"),
        ("ash, beech", ["ash"], "extra_items"), ("ash", ["ash, beech"], "missing_items"), ("ash, yew", ["ash, beech"], "partial_overlap"),
        ("yew, fir", ["ash, beech"], "unclassified"), ("", ["ash, beech"], "missing_items"), (None, ["ash, beech"], "missing_items"),
        ("fir, yew", ["ash, beech", "yew, fir"], "order_only"), ("ash, ash", ["ash"], "order_only"),
        ("8 (b)", ["8"], "format_only"), ("44 billion", ["44"], "format_only"), ("44 billion", ["$44 bn"], "format_only"), ("Low tide.", ["low  tide"], "format_only"),
        ("four users", ["four"], "format_only"), ("four", ["4"], "unclassified"), ("4.50", ["4.5"], "unclassified"), ("ebb", ["flow", "ebb."], "format_only"),
    ]
    assert rows(spark, cases, tx.failure_mode) == [w for *_, w in cases]


def test_equivalence_rules_differ(spark):
    cases = [  # report, causes, drill-down, slides
        ("6 million", ["6"], (False, True, False, True)), ("6m", ["6,000,000"], (True, True, True, False)), ("-6", ["6"], (False, False, False, False)),
        ("6 boats", ["6"], (True, False, False, False)), ("$6", ["6%"], (True, True, True, True)), ("6b", ["6000000000"], (False, True, True, False)),
        ("Far-Shore", ["far shore"], (True, True, True, False)), ("the far shore", ["far shore"], (False, False, False, True)), ("homage", ["age"], (False, False, False, False)),
        ("percentage", ["age"], (False, False, False, False)), ("6.00000000001", ["6"], (False, True, True, True)), (None, ["6"], (False, False, False, False)), ("", [""], (False, False, False, False)),
        ("7", ["x", "7.0"], (True, True, True, True)), ("6 euros", ["6"], (True, False, False, True)),
    ]
    rules = (tx.format_equivalent, tx.cause_equivalent, tx.drill_equivalent, tx.slide_equivalent)
    got = list(zip(*(rows(spark, cases, r) for r in rules)))
    assert got == [w for *_, w in cases]


def test_pages_slips_and_units(spark):
    pages = lambda t: one(spark, tx.cited_pages(F.lit(t)))
    assert pages("Slide 4 and the Second page; IMAGE # 11, slides 5, page 40, page 123") == [2, 4, 11] and pages(None) == []
    slip = lambda e, t, right=False, same=False: one(spark, an.arithmetic_slip(F.lit(right), F.lit(same), F.lit(e), F.lit(t)))
    assert slip("1,400 / 7", "1400 over 7.002") == "wrong_operation" and slip("1,400/7", "140 and 7") == "wrong_operand"
    assert slip("1 + 2 + 3", "1 2 3") == "unparsed_expr" and slip(None, None) == "unparsed_expr"
    assert slip("1+2", "", right=True) == "exact" and slip("1+2", "", same=True) == "format_only"
    unit = lambda v, w, h: one(spark, an.to_unit(F.array(*map(F.lit, v)), F.lit(w), F.lit(h)))
    assert tuple(unit([0.3, 1.0], 10, 10)) == ([0.3, 1.0], False)
    assert unit([500.0, 0.9], 1000, 500)["values"] == pytest.approx([0.5, 0.0018])
    assert unit([784.0, 98.0, 1568.0, 196.0], 3136, 392)["values"] == pytest.approx([0.5, 0.5, 1.0, 1.0])


def searched(expression, pred, trace):
    """By trying everything."""
    import itertools
    import re

    mentioned = lambda x: [float(n.replace(",", "")) for n in re.findall(r"-?\d[\d,]*(?:\.\d+)?", x or "")]
    parts = re.split(r"([+\-*/])", (expression or "").replace(",", ""))
    try:
        vals, ops = [float(p) for p in parts[0::2]], parts[1::2]
    except ValueError:
        return "unclassified"
    aims = [float(pred)] if re.fullmatch(r"\d+", pred or "") else sorted(mentioned(pred))[:1]

    def run(values, signs):
        out = values[0]
        for s, v in zip(signs, values[1:]):
            if s == "/" and v == 0:
                return None
            out = {"+": out + v, "-": out - v, "*": out * v, "/": out / v if v else 0}[s]
        return out

    near = lambda v: v is not None and any(abs(v - a) <= max(1e-6, 1e-6 * abs(a)) for a in aims)
    if len(vals) < 2:
        return "unclassified"
    if any(near(run(vals, c)) for c in itertools.product("+-*/", repeat=len(ops)) if list(c) != ops):
        return "wrong_operation"
    if len(vals) == 2 and any(near(run(vals[::-1], [s])) for s in "+-*/"):
        return "wrong_operation"
    pool = mentioned(trace) + mentioned(pred)
    if any(near(run([*vals[:i], c, *vals[i + 1 :]], ops)) for i in range(len(vals)) for c in pool):
        return "wrong_operand"
    return "unclassified"


def test_operand_search_equals_trying_everything(spark):
    import random

    rnd = random.Random(5)
    cases = [("10 - 4", "-6", ""), ("10 - 4", "40", ""), ("10 - 4", "3", "we saw 7"), ("10 - 4", "1", "we saw 7"), ("x - 4", "1", ""), (None, "1", ""), ("5", "5", ""), ("8 / 0", "8", "0 and 1"), ("-5 + 3", "2", "")]
    for _ in range(150):
        n = rnd.randrange(2, 5)
        e = "".join(f"{rnd.randrange(12)}{rnd.choice(' +-*/')}".replace(" ", "+") for _ in range(n - 1)) + str(rnd.randrange(1, 12))
        cases.append((e, str(rnd.randrange(40)), f"reads {rnd.randrange(20)} and 1,{rnd.randrange(100, 999)}"))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e string, p string, t string")
    got = {r.i: r.v for r in df.select("i", gen.operand_search(F.col("e"), F.col("p"), F.col("t")).alias("v")).collect()}
    want = {i: searched(*c) for i, c in enumerate(cases)}
    assert got == want and len(set(want.values())) == 3


def test_wilson(spark):
    w = lambda k, n: tuple(one(spark, stats.wilson(F.lit(k), F.lit(n))))
    assert w(0, 0) == (0.0, 1.0)
    assert w(57, 412) == pytest.approx((0.1084, 0.1750), abs=1e-4)
    assert w(53, 793) == pytest.approx((0.0515, 0.0864), abs=1e-4)
    assert one(spark, stats.wilson_of_mean(F.lit(None).cast("double"), F.lit(0))) is None
    assert tuple(one(spark, stats.wilson_percent(F.lit(0), F.lit(0)))) == (0.0, 0.0)


def test_mcnemar(spark):
    assert one(spark, stats.mcnemar(F.lit(0), F.lit(0))) is None
    assert one(spark, stats.mcnemar(F.lit(10), F.lit(2))) == pytest.approx(49 / 12)
    assert one(spark, stats.mcnemar_exact(F.lit(5), F.lit(5))) == 1.0
    assert one(spark, stats.mcnemar_exact(F.lit(0), F.lit(4))) == pytest.approx(2 / 16)


def test_exclusive_percentile(spark):
    p = lambda *v: one(spark, stats.exclusive_percentile(F.array(*map(F.lit, v)), 90))
    assert p(0.05, 0.2) == 0.05 and p(1.0, 2.0, 3.0, 4.0, 10.0) == pytest.approx(13.6 - 1.2) and p(0.05, 0.2, 0.35) == pytest.approx(0.44)


def box(*v):
    return geo.box(*(F.lit(float(x)) for x in v))


def test_geometry(spark):
    b = box(0.4, 0.4, 0.6, 0.6)
    inside = lambda x, y: one(spark, geo.in_box(F.lit(x), F.lit(y), b))
    assert inside(0.4, 0.6) and inside(0.6, 0.4) and not inside(0.39999, 0.5)
    assert [one(spark, geo.miss_band(F.lit(d))) for d in (0.099999, 0.10, 0.25, 0.2500001)] == ["near", "moderate", "moderate", "wrong_region"]
    mode = lambda x: one(spark, geo.miss_mode(F.lit(x), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert [mode(x) for x in (0.10, 0.11, 0.25, 0.2501, None)] == ["near_miss", "moderate_miss", "moderate_miss", "wrong_region", "unclassified"]
    assert [one(spark, geo.cell(F.lit(v), 4)) for v in (0.3, 0.6, 1.0, 0.25, -0.3)] == [1, 2, 3, 1, -1]
    assert one(spark, geo.iou(box(0, 0, 1, 1), box(2, 2, 3, 3))) == 0 and one(spark, geo.iou(b, b)) == pytest.approx(1)
    assert one(spark, geo.iou(box(0, 0, 30, 9), box(-1, -1, 31, 10))) == pytest.approx(270 / 352)
    n = one(spark, geo.normalized_box(box(10, -5, 30, 30), F.lit(100), F.lit(100)))
    assert n.clamped and n.box.y0 == 0 and n.box.x1 == 0.3
    assert tuple(one(spark, geo.delivered(F.lit(3136), F.lit(100)))) == (1568, 50)
    assert [one(spark, geo.required_contrast(F.lit(px))) for px in (23, 24)] == [4.5, 3.0]
    assert one(spark, geo.contrast(F.lit("#000000"), F.lit("#ffffff"))) == pytest.approx(21.0)
