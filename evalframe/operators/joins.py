"""Joins of logs with examples, controls, verdicts and geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalframe.functions import geometry as geo
from evalframe.operators import windows
from evalframe.storage import stored


def todo(examples: DataFrame, log: DataFrame, usable: Column, key: str = "uid") -> DataFrame:
    """Examples without a usable row: what a resumed run has to do, and after a run what is missing."""
    return examples.join(log.where(usable).select(key).distinct(), key, "left_anti")


def orphans(log: DataFrame, examples: DataFrame, key: str = "uid") -> DataFrame:
    return log.join(examples.select(key), key, "left_anti")


def override(scores: DataFrame, verdicts: DataFrame, key: str, score: str, verdict: str) -> DataFrame:
    """The verdict's score where there is one; the own score stays as string_score."""
    out = scores.withColumnRenamed(score, "string_score").join(verdicts.select(key, verdict), key, "left")
    return out.withColumn(score, F.coalesce(verdict, "string_score"))


def control_pairs(sighted: DataFrame, control: DataFrame, score: str = "score") -> DataFrame:
    """uid, sighted, blind of control rows whose src_uid names a sighted row."""
    c = control.select(F.col("src_uid").alias("uid"), F.col(score).alias("blind"))
    return sighted.select("uid", F.col(score).alias("sighted")).join(c, "uid")


def complete_keys(df: DataFrame, key: list[str], condition: str, n: int) -> DataFrame:
    """Keys seen under all n conditions."""
    return df.groupBy(*key).agg(F.count_distinct(condition).alias("_n")).where(F.col("_n") == n).drop("_n")


def join_check(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """How many rows of a agree with b in all values, differ, or have no match."""
    y = b.select(key, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_there"))
    same = F.lit(True)
    for v in values:
        same &= F.col(v).eqNullSafe(F.col(f"_{v}"))
    there = F.coalesce("_there", F.lit(False))
    return a.join(y, key, "left").agg(
        F.count_if(there & same).alias("ok"), F.count_if(there & ~same).alias("bad"), F.count_if(~there).alias("unmatched")
    )


#: Where a row of split_cells stands: its scene and the level and place of its cell.
CELL = ("_s", "_l", "_cx", "_cy")


def split_cells(rows: DataFrame, most: int = 256, deepest: int = 20) -> DataFrame:
    """rows (_s, a scene, and _x0, _y0, _x1, _y1 in the unit square) with the cells they touch, a row each: _l, _cx, _cy.

    A scene is one cell, and a cell of more than `most` rows is split in four, again and again, so that cells are
    small where rows lie close. A split that would give more than half again as many rows is not made: rows that cover
    most of a cell come no further apart by it. What lies beyond the square counts to its outermost cells, and rows
    with a common point have a common cell, whatever was split.
    """
    cell = list(CELL)
    cur = rows.withColumns({"_l": F.lit(0), "_cx": F.lit(0).cast("long"), "_cy": F.lit(0).cast("long")})
    done: list[DataFrame] = []
    for level in range(1, deepest + 1):
        counts = cur.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
        if counts.isEmpty():
            break
        cur, counts = stored(cur, "cells"), stored(counts, "large")
        side = 1 << level
        at = lambda v: F.least(F.greatest(F.floor(F.col(v) * side), F.lit(0)), F.lit(side - 1))  # noqa: E731, B023
        # Of the two halves of a cell those that the row reaches.
        halves = lambda c, low, high: F.sequence(F.greatest(2 * F.col(c), at(low)), F.least(2 * F.col(c) + 1, at(high)))  # noqa: E731, B023
        xs, ys = halves("_cx", "_x0", "_x1"), halves("_cy", "_y0", "_y1")
        inside = cur.join(counts.select(*cell), cell, "left_semi")
        made = inside.groupBy(*cell).agg(F.sum(F.size(xs) * F.size(ys)).alias("_k"), F.count(F.lit(1)).alias("_n"))
        split = stored(made.where("2 * _k <= 3 * _n").select(*cell), "split")
        if split.isEmpty():
            break
        done.append(cur.join(split, cell, "left_anti"))
        kids = cur.join(split, cell, "left_semi").withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))
        cur = kids.withColumn("_l", F.lit(level))
    return reduce(DataFrame.unionByName, [*done, cur])


def _placed(df: DataFrame, scene: str, box: Column, size: float = 1.0, **kept: Column) -> DataFrame:
    corners = {f"_{c}": (box[c] / size).cast("double") for c in ("x0", "y0", "x1", "y1")}
    rows = df.select(F.col(scene).alias("_s"), *(v.alias(k) for k, v in kept.items()), *(v.alias(k) for k, v in corners.items()))
    # A box of which an end is missing, or that ends before it begins, meets nothing.
    return rows.where("_x0 <= _x1 AND _y0 <= _y1")


def _meeting(own: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with cells split by the rows of both."""
    both = own.withColumn("_own", F.lit(True)).unionByName(others.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    cells = split_cells(both)
    other = [c for c in others.columns if c[:2] not in ("_x", "_y")]
    return cells.where("_own").select(*own.columns, *CELL[1:]), cells.where("NOT _own").select(*other, *CELL[1:])


def misses_on_other_box(points: DataFrame, boxes: DataFrame, scene: str, key: str) -> DataFrame:
    """Misses that lie in some other box of their scene; points have x, y, hit and key, boxes key and box.

    Points and boxes meet in cells of the scene.
    """
    x, y = F.col("x"), F.col("y")
    own = _placed(points.where("not hit"), scene, geo.box(x, y, x, y), _row=F.struct(*points.columns))
    a, b = _meeting(own, _placed(boxes, scene, F.col("box"), _k=F.col(key), _b=F.col("box")))
    inside = geo.in_box(F.col("_row.x"), F.col("_row.y"), F.col("_b"))
    found = a.alias("a").join(b.alias("b"), _same_cell() & (F.col(f"_row.{key}") != F.col("_k")) & inside, "left_semi")
    return found.select("_row.*")


def overlapping(boxes: DataFrame, scene: str, key: str, own: str = "box", others: str = "box", size: float = 1.0) -> DataFrame:
    """Distinct (scene, key) whose own box overlaps another's `others` box in the scene; size is the extent of coordinates.

    Overlapping boxes share a cell of the scene.
    """
    a, b = _meeting(
        _placed(boxes, scene, F.col(own), size, _key=F.col(key), _a=F.col(own)), _placed(boxes, scene, F.col(others), size, _k=F.col(key), _b=F.col(others))
    )
    found = a.alias("a").join(b.alias("b"), _same_cell() & (F.col("_key") != F.col("_k")) & geo.overlaps(F.col("_a"), F.col("_b")), "left_semi")
    return found.select(F.col("_s").alias(scene), F.col("_key").alias(key)).distinct()


def _same_cell() -> Column:
    return reduce(lambda p, q: p & q, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in CELL))


def without_overlap(boxes: DataFrame, scene: str, key: str) -> DataFrame:
    """Boxes that overlap no other box of their scene."""
    return boxes.join(overlapping(boxes, scene, key), [scene, key], "left_anti")


def nearest_right(boxes: DataFrame, scene: str, key: str, tolerance: float, most: int = 256, steps: int = 10) -> DataFrame:
    """For each box the nearest other whose centre lies to its right within tolerance in height: key, neighbour, distance.

    Boxes meet in bands of height, as high as the tolerance, and the bands next to their own. Where a band of a scene
    holds more than `most` boxes, bands are cut into cells, narrow ones first: a box looks no further right than its
    cell is wide, and only those that have found none go on to cells four times as wide, up to the whole width.
    """
    box = F.col("box")
    cx, cy = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    all_ = boxes.select(scene, key, cx.alias("_x"), cy.alias("_y"), F.floor(cy / tolerance).alias("_h")).where("_x IS NOT NULL AND _y IS NOT NULL")
    crowd = all_.groupBy(scene, "_h").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("a"), F.max("_x").alias("b"))
    told = crowd.agg(F.max("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).first()
    if told.n is None or told.n <= most or told.a == told.b:
        return _right_of(all_, all_, scene, key, tolerance, None, None)
    all_ = left = stored(all_, "centres")
    found: list[DataFrame] = []
    for k in range(steps, -1, -1):
        # A little less than the width, so that no rounding of cells leaves out what a box can reach; at last, all.
        width = (told.b - told.a) / 4**k
        near = stored(_right_of(left, all_, scene, key, tolerance, told.a, width, width * (1 - 1e-9) if k else None), "right")
        found.append(near)
        if k:
            done = near.select(F.col(scene).alias("_ds"), F.col(key).alias("_dk"))
            left = stored(left.join(done, (F.col(scene) == F.col("_ds")) & (F.col(key) == F.col("_dk")), "left_anti"), "left")
            if left.isEmpty():
                break
    return reduce(DataFrame.unionByName, found)


def _right_of(left: DataFrame, all_: DataFrame, scene: str, key: str, tolerance: float, start: float | None, width: float | None, reach: float | None = None) -> DataFrame:
    """The nearest of all_ to the right of each of left, no further than reach if one is given, met in cells of a width."""
    cell = F.lit(0) if width is None else F.floor((F.col("_x") - start) / width)
    o = all_.select(F.col(scene).alias("_s"), F.col(key).alias("_k"), F.col("_x").alias("_ox"), F.col("_y").alias("_oy"), F.col("_h").alias("_oh"), cell.alias("_oc"))
    rows = left.withColumn("_band", F.explode(F.array(*(F.col("_h") + i for i in (-1, 0, 1)))))
    rows = rows.withColumn("_c", cell if width is None else F.explode(F.array(cell, cell + 1)))
    dx = F.col("_ox") - F.col("_x")
    near = (dx > 0) & (F.abs(F.col("_oy") - F.col("_y")) <= tolerance)
    if reach is not None:
        near &= dx <= reach
    j = rows.join(o, (F.col(scene) == F.col("_s")) & (F.col("_band") == F.col("_oh")) & (F.col("_c") == F.col("_oc")) & (F.col(key) != F.col("_k")) & near)
    j = j.withColumn("_d", dx)
    return j.groupBy(scene, key).agg(F.min_by("_k", F.struct("_d", "_k")).alias("neighbour"), F.min("_d").alias("distance"))


def smallest_enclosing(boxes: DataFrame, scene: str, key: str, max_area: float) -> DataFrame:
    """For each box the smallest other that contains it and is no larger than max_area: key, outer.

    A box that contains another touches the cell of the other's first corner.
    """
    a, b = F.col("box"), F.col("_b")
    corner = geo.box(a["x0"], a["y0"], a["x0"], a["y0"])
    x, y = _meeting(_placed(boxes, scene, corner, _key=F.col(key), _a=a), _placed(boxes.where(geo.area(a) <= max_area), scene, a, _k=F.col(key), _b=a))
    own = F.col("_a")
    holds = (b["x0"] <= own["x0"]) & (b["y0"] <= own["y0"]) & (b["x1"] >= own["x1"]) & (b["y1"] >= own["y1"])
    j = x.alias("a").join(y.alias("b"), _same_cell() & (F.col("_key") != F.col("_k")) & holds)
    found = j.groupBy(F.col("a._s").alias("_s"), "_key").agg(F.min_by("_k", F.struct(geo.area(b), F.col("_k"))).alias("outer"))
    return found.select(F.col("_s").alias(scene), F.col("_key").alias(key), "outer")


def whitelist(df: DataFrame, wanted: DataFrame, key: str = "uid") -> DataFrame:
    """Rows whose key is wanted; raises if there are none for a wanted key."""
    missing = wanted.select(key).distinct().join(df.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError("not found: " + ", ".join(str(r[0]) for r in missing))
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def batches(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Rows numbered into batches of size within each group."""
    placed = windows.positions(df, [order], [by])
    return placed.withColumn("batch", F.floor((F.col("_row") - 1) / size)).drop("_row", "_n")
