"""Checks of generated questions: arithmetic of the manifest, and which labels of a scene may be asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions import geometry as geo
from evalframe.operators import joins

#: Share of a label that may be covered, the smallest readable type, the smallest ink.
MAX_OCCLUDED, MIN_FONT, MIN_ELIGIBLE_FONT, MIN_INK = 0.005, 10, 7, (6, 5)


def _inside(outer: Column, inner: Column) -> Column:
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (inner["x1"] <= outer["x1"]) & (inner["y1"] <= outer["y1"])


def check_manifest(rows: DataFrame) -> DataFrame:
    """(uid, issue, detail) of every rule that a row breaks; a row may break several.

    rows: uid, qtype, image (w, h), box and ink (x0, y0, x1, y1), centre and probe (x, y), all in
    pixels, font_px, contrast and occluded. Contrast and occlusion that aren't known break nothing.
    """
    b, ink, image = F.col("box"), F.col("ink"), F.col("image")
    whole = lambda *v: F.concat(F.lit("("), F.concat_ws(",", *(F.round(x).cast("long").cast("string") for x in v)), F.lit(")"))
    sides = lambda x: whole(x["x0"], x["y0"], x["x1"], x["y1"])
    placed = (b["x0"] >= 0) & (b["x0"] < b["x1"]) & (b["x1"] <= image["w"]) & (b["y0"] >= 0) & (b["y0"] < b["y1"]) & (b["y1"] <= image["h"])
    point, reverse = F.col("qtype") == "point", F.col("qtype") == "reverse"
    size = F.concat(F.col("font_px").cast("long").cast("string"), F.lit("px"))
    rules = [
        (~placed, "box outside image or inverted", F.concat(F.lit("box "), sides(b), F.lit(" image "), whole(image["w"], image["h"]))),
        (point & ~_inside(b, ink), "ink outside hit box", F.concat(F.lit("ink "), sides(ink), F.lit(" hit "), sides(b))),
        (point & ~geo.in_box(F.col("centre.x"), F.col("centre.y"), b), "centre outside box", F.concat(F.lit("centre "), whole(F.col("centre.x"), F.col("centre.y")))),
        (F.col("contrast") < geo.required_contrast(F.col("font_px")), "contrast too low", size),
        (F.col("font_px") < MIN_FONT, "type too small", size),
        (F.col("occluded") > MAX_OCCLUDED, "text covered", F.concat(F.floor(F.col("occluded") * 1000).cast("string"), F.lit(" in 1000"))),
        (reverse & ~geo.in_box(F.col("probe.x"), F.col("probe.y"), b), "probe outside its text", F.concat(F.lit("probe "), whole(F.col("probe.x"), F.col("probe.y")))),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(issue).alias("issue"), detail.alias("detail"))) for test, issue, detail in rules)))
    return rows.select("uid", F.inline(found))


def eligibility(labels: DataFrame, scene: str = "scene", key: str = "uid", min_font: float = MIN_ELIGIBLE_FONT, size: float = 1568.0) -> DataFrame:
    """labels plus reason: the first rule that rejects a label, null if it may be asked about.

    labels: scene, key, text, eligible, box and ink in pixels of a scene, in_bounds, font_px, occluded,
    contrast, required. In order: not eligible, a text that the scene has twice, ink too small, out
    of bounds, type too small, covered, low contrast, ink overlapping another label's, hit box
    overlapping another label's ink. size is the extent of the scenes, which only deals boxes into cells.
    """
    ink, box = F.col("ink"), F.col("box")
    twice = labels.groupBy(scene, "text").agg(F.count(F.lit(1)).alias("_same"))
    names = {scene: "_sc", "text": "_tx"}
    df = labels.join(twice.withColumnsRenamed(names), (F.col(scene) == F.col("_sc")) & F.col("text").eqNullSafe(F.col("_tx"))).drop("_sc", "_tx")
    df = _beside_flag(df, joins.overlapping(labels, scene, key, "ink", "ink", size=size), scene, key, "_over")
    df = _beside_flag(df, joins.overlapping(labels, scene, key, "box", "ink", size=size), scene, key, "_holds")
    reason = (
        F.when(~F.col("eligible"), "ineligible").when(F.col("_same") > 1, "duplicate")
        .when((ink["x1"] - ink["x0"] < MIN_INK[0]) | (ink["y1"] - ink["y0"] < MIN_INK[1]), "tiny")
        .when(~F.coalesce("in_bounds", F.lit(True)), "out_of_bounds").when(F.col("font_px") < min_font, "font_too_small")
        .when(F.col("occluded") > MAX_OCCLUDED, "occluded").when(F.col("contrast") < F.col("required"), "low_contrast")
        .when(F.col("_over"), "overlap").when(F.col("_holds"), "hitbox_contains_other")
    )
    return df.select(*labels.columns, reason.alias("reason"))


def box_checks(rows: DataFrame) -> DataFrame:
    """uid and five flags of a delivered box.

    rows: uid, box in pixels, image (w, h) as told, file (w, h) as it is, shrunk (whether the service
    shrank it), and ink: the extent in pixels of what is painted inside the box, null if nothing is.
    in_bounds, non_degenerate (two pixels a side), undownscaled (delivered as it is), has_ink, and
    tight: the ink reaches all four edges.
    """
    b, image, file, ink = (F.col(c) for c in ("box", "image", "file", "ink"))
    inside = (b["x0"] >= 0) & (b["x0"] < b["x1"]) & (b["x1"] <= image["w"]) & (b["y0"] >= 0) & (b["y0"] < b["y1"]) & (b["y1"] <= image["h"])
    sent = geo.delivered(file["w"], file["h"])
    edge = lambda side, end: F.floor(ink[side]) == F.floor(b[side]) if not end else F.ceil(ink[side]) == F.ceil(b[side])
    tight = edge("x0", False) & edge("y0", False) & edge("x1", True) & edge("y1", True)
    return rows.select(
        "uid", (inside & (file["w"] == image["w"]) & (file["h"] == image["h"])).alias("in_bounds"),
        ((b["x1"] - b["x0"] >= 2) & (b["y1"] - b["y0"] >= 2)).alias("non_degenerate"),
        ((sent["w"] == file["w"]) & (sent["h"] == file["h"]) & ~F.col("shrunk")).alias("undownscaled"), ink.isNotNull().alias("has_ink"),
        F.coalesce(tight, F.lit(False)).alias("tight"),
    )


def _beside_flag(df: DataFrame, keys: DataFrame, scene: str, key: str, flag: str) -> DataFrame:
    return df.join(keys.withColumn(flag, F.lit(True)), [scene, key], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
