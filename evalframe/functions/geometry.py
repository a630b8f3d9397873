"""Boxes and points in unit coordinates. A box is a struct x0, y0, x1, y1; a point x, y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def normalized_box(b: Column, w: Column, h: Column) -> Column:
    """Pixels to [0, 1], clamped, and whether clamping changed any side."""
    raw = [b["x0"] / w, b["y0"] / h, b["x1"] / w, b["y1"] / h]
    fit = [F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for v in raw]
    changed = fit[0] != raw[0]
    for f, r in zip(fit[1:], raw[1:]):
        changed = changed | (f != r)
    return F.struct(box(*fit).alias("box"), changed.alias("clamped"))


def in_box(x: Column, y: Column, b: Column) -> Column:
    """Inside or on an edge."""
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def to_centre(x: Column, y: Column, b: Column) -> Column:
    return F.hypot(x - (b["x0"] + b["x1"]) / 2, y - (b["y0"] + b["y1"]) / 2)


def to_box(x: Column, y: Column, b: Column) -> Column:
    """Distance to the nearest point of the box; 0 inside."""
    dx = F.greatest(b["x0"] - x, F.lit(0.0), x - b["x1"])
    return F.hypot(dx, F.greatest(b["y0"] - y, F.lit(0.0), y - b["y1"]))


def miss_band(d: Column) -> Column:
    """By distance: under a tenth near, to a quarter moderate."""
    return F.when(d < 0.10, "near").when(d <= 0.25, "moderate").when(d > 0.25, "wrong_region")


def miss_mode(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """By the larger offset on an axis; unusable points are unclassified."""
    d = F.greatest(F.abs(x - cx), F.abs(y - cy))
    usable = x.isNotNull() & y.isNotNull() & cx.isNotNull() & cy.isNotNull()
    return (
        F.when(~usable, "unclassified").when(d <= 0.10, "near_miss").when(d > 0.25, "wrong_region").otherwise("moderate_miss")
    )


def cell(v: Column, g: int) -> Column:
    """Index on a grid of g; truncates towards zero, and the far edge belongs to the last cell."""
    return F.least((v * g).cast("int"), F.lit(g - 1))


def cell_name(x: Column, y: Column, g: int = 4) -> Column:
    return F.concat(F.substring(F.lit("ABCDEFGH"), cell(x, g) + 1, F.lit(1)), (cell(y, g) + 1).cast("string"))


def touches_cell(x: Column, y: Column, b: Column, g: int) -> Column:
    """Whether the point's cell is one that the box touches."""
    return cell(x, g).between(cell(b["x0"], g), cell(b["x1"], g)) & cell(y, g).between(cell(b["y0"], g), cell(b["y1"], g))


def quadrant(x: Column, y: Column) -> Column:
    return F.when(y < 0.5, F.when(x < 0.5, "A").otherwise("B")).otherwise(F.when(x < 0.5, "C").otherwise("D"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def overlaps(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def growth(inner: Column, outer: Column) -> Column:
    """Per side, rounded half even to a tenth."""
    sides = [inner["x0"] - outer["x0"], inner["y0"] - outer["y0"], outer["x1"] - inner["x1"], outer["y1"] - inner["y1"]]
    return F.array(*(F.bround(s, 1) for s in sides))


#: Delivered images: longest edge and most pixels.
MAX_EDGE, MAX_PIXELS = 1568, 1_150_000


def delivered(w: Column, h: Column) -> Column:
    """Size under both caps."""
    s = F.least(F.lit(1.0), F.lit(float(MAX_EDGE)) / F.greatest(w, h), F.sqrt(F.lit(float(MAX_PIXELS)) / (w * h)))
    return F.struct(F.bround(w * s).cast("int").alias("w"), F.bround(h * s).cast("int").alias("h"))


def crop_remap(b: Column, window: Column) -> Column:
    """A box in the coordinates of a crop window; null if it straddles the window's edge."""
    w, h = window["x1"] - window["x0"], window["y1"] - window["y0"]
    inside = (b["x0"] >= window["x0"]) & (b["y0"] >= window["y0"]) & (b["x1"] <= window["x1"]) & (b["y1"] <= window["y1"])
    moved = box(
        (b["x0"] - window["x0"]) / w, (b["y0"] - window["y0"]) / h, (b["x1"] - window["x0"]) / w, (b["y1"] - window["y0"]) / h
    )
    return F.when(inside, moved)


def luminance(hex_colour: Column) -> Column:
    """Relative luminance of #rrggbb (WCAG)."""

    def channel(at: int) -> Column:
        v = F.conv(F.substring(hex_colour, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def required_contrast(px: Column) -> Column:
    return F.when(px >= 24, 3.0).otherwise(4.5)
