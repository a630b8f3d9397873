import random

from pyspark.sql import functions as F

from evalframe.functions import geometry as geo
from evalframe.operators import joins

SCHEMA = "scene int, uid int, x double, y double, x0 double, y0 double, x1 double, y1 double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("box", F.struct("x0", "y0", "x1", "y1")).withColumn("hit", F.expr("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")).repartition(4)


def corner(n=900):
    """Small boxes in one corner of a scene, few of which meet, and a scene with few."""
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        x, y, w = rnd.random() * 0.004, rnd.random() * 0.004, rnd.random() * 0.0002
        px, py = (x, y) if i % 3 else (rnd.random() * 0.004, rnd.random() * 0.004)
        rows.append((1, i, px, py, x, y, x + w, y + w / 2))
    rows += [(2, n + i, 0.5, 1.7, 0.1 * i, 0.2, 0.1 * i + 0.15, 1.9) for i in range(5)] + [(2, -1, None, None, None, 0.0, 1.0, 1.0), (None, -2, 0.1, 0.1, 0.0, 0.0, 1.0, 1.0)]
    return rows


def test_results_are_those_of_all_pairs(spark):
    rows = corner()
    df = table(spark, rows)
    good = [r for r in rows if r[0] is not None and r[4] is not None]
    holds = lambda o, x, y: o[4] <= x <= o[6] and o[5] <= y <= o[7]
    on = {r[1] for r in good if not holds(r, r[2], r[3]) and any(o[0] == r[0] and o[1] != r[1] and holds(o, r[2], r[3]) for o in good)}
    assert {r.uid for r in joins.misses_on_other_box(df, df, "scene", "uid").collect()} == on and len(on) > 1
    pairs = df.alias("a").join(df.alias("b"), (F.col("a.scene") == F.col("b.scene")) & (F.col("a.uid") != F.col("b.uid")) & geo.overlaps(F.col("a.box"), F.col("b.box")))
    over = {r.uid for r in pairs.select("a.uid").distinct().collect()}
    assert {r.uid for r in joins.overlapping(df, "scene", "uid").collect()} == over and over
    area = lambda o: (o[6] - o[4]) * (o[7] - o[5])
    outer = {}
    for r in good:
        inside = [o for o in good if o[0] == r[0] and o[1] != r[1] and area(o) <= 0.06 and holds(o, r[4], r[5]) and holds(o, r[6], r[7])]
        if inside:
            outer[r[1]] = min(inside, key=lambda o: (area(o), o[1]))[1]
    assert {r.uid: r.outer for r in joins.smallest_enclosing(df, "scene", "uid", 0.06).collect()} == outer


def test_a_crowded_corner_is_split_and_a_stack_is_not(spark):
    rows = spark.createDataFrame(corner(3000), SCHEMA).where("x0 is not null and scene is not null")
    placed = rows.select(F.col("scene").alias("_s"), "uid", *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    cells = joins.split_cells(placed, most=100)
    sizes = [r["count"] for r in cells.groupBy(*joins.CELL).count().collect()]
    assert max(sizes) <= 100 and sum(sizes) < 2 * 3005
    stack = spark.range(500).select(F.lit(1).alias("_s"), "id", *(F.lit(v).alias(c) for c, v in (("_x0", 0.1), ("_y0", 0.1), ("_x1", 0.9), ("_y1", 0.9))))
    assert joins.split_cells(stack, most=100).count() == 500


def test_nearest_to_the_right_in_narrow_cells_first(spark):
    rows = [r for r in corner(500) if r[0] is not None and r[4] is not None]
    rows += [(1, 9000, 0.0, 0.0, 0.9, 0.001, 0.95, 0.002)]
    df = table(spark, rows)
    tolerance, want = 0.0004, {}
    centre = lambda r: ((r[4] + r[6]) / 2, (r[5] + r[7]) / 2)
    for r in rows:
        x, y = centre(r)
        near = [(centre(o)[0] - x, o[1]) for o in rows if o[0] == r[0] and o[1] != r[1] and centre(o)[0] - x > 0 and abs(centre(o)[1] - y) <= tolerance]
        if near:
            want[r[1]] = min(near)[1]
    for most in (256, 20):
        assert {r.uid: r.neighbour for r in joins.nearest_right(df, "scene", "uid", tolerance, most=most).collect()} == want
