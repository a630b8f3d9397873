"""Set-based parts of question generation: canvases, choices without giveaways, spread selection, records."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalframe.functions import geometry as geo
from evalframe.functions import text as tx
from evalframe.functions.geometry import MAX_EDGE, MAX_PIXELS
from evalframe.operators import windows

#: Fixed value: height at which scenes are laid out before they are scaled.
BASE_HEIGHT = 950
#: Fixed value: what counts as a word of a label.
WORD = r"[A-Za-z][A-Za-z-]{3,}"


def largest_canvas(ratio: Column) -> Column:
    """Size at an aspect ratio that no delivery cap would shrink: truncated, and exact on the edge if that cap binds."""
    w, h = F.bround(ratio * BASE_HEIGHT), F.lit(float(BASE_HEIGHT))
    edge = F.lit(float(MAX_EDGE)) / F.greatest(w, h)
    pixels = F.sqrt(F.lit(float(MAX_PIXELS)) / (w * h))
    scaled = lambda v: F.floor(v * F.least(edge, pixels)).cast("int")
    capped = lambda v, longer: F.when((edge <= pixels) & longer, F.lit(MAX_EDGE)).otherwise(scaled(v))
    return F.struct(capped(w, w >= h).alias("w"), capped(h, w < h).alias("h"))


def ladder(spark, aspects: dict[str, float], rungs: dict[str, float], scenes: int) -> DataFrame:
    """Every scene under every aspect and rung, with the canvas and its size at the rung's scale."""
    a = spark.createDataFrame([(k, float(v)) for k, v in aspects.items()], "aspect string, ratio double")
    r = spark.createDataFrame([(k, float(v)) for k, v in rungs.items()], "rung string, scale double")
    # Scenes are the long side; aspects and rungs are parameters.
    grid = spark.range(scenes).select(F.col("id").alias("scene")).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(r))
    grid = grid.withColumn("c", largest_canvas(F.col("ratio")))
    return grid.select(
        "scene", "aspect", "rung", F.floor(F.col("c.w") * F.col("scale")).cast("int").alias("w"), F.floor(F.col("c.h") * F.col("scale")).cast("int").alias("h")
    )


#: How a scene's seed follows from the set's and the scene's number.
SEED_STEP, SCENE_STEP = 100_003, 7919


def scene_seeds(spark, scenes: int, seed: int) -> DataFrame:
    """scene and seed: a seed of its own for each scene, whichever task makes it."""
    return spark.range(scenes).select(F.col("id").alias("scene"), (F.lit(seed * SEED_STEP).cast("long") + F.col("id") * SCENE_STEP).alias("seed"))


def words_of(text: Column) -> Column:
    """Words of a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b({WORD})\b"), F.lit(1)))


def word_choice(scenes: DataFrame, pool: list[str], seed: int, scene: str = "scene", labels: str = "labels", n: int = 4) -> DataFrame:
    """scene, options, answer (letter), answer_text: a word of the labels among words that are nowhere in them.

    Scenes without a word, or with too few absent ones in the pool, give no row.
    """
    blob = F.lower(F.array_join(labels, " "))
    order = lambda salt: lambda w: F.sha1(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col(scene).cast("string"), w))
    pick = lambda a, salt: F.transform(F.array_sort(F.transform(a, lambda w: F.struct(order(salt)(w).alias("h"), w.alias("w")))), lambda s: s["w"])
    there = words_of(F.array_join(labels, " "))
    absent = F.filter(F.array(*map(F.lit, pool)), lambda w: ~F.contains(blob, F.lower(w)))
    df = scenes.withColumn("_a", F.get(pick(there, "answer"), F.lit(0))).withColumn("_d", F.slice(pick(absent, "other"), 1, n - 1))
    df = df.where(F.col("_a").isNotNull() & (F.size("_d") == n - 1)).withColumn("options", pick(F.concat(F.array("_a"), F.col("_d")), "order"))
    letter = F.substring(F.lit("ABCDEFGH"), F.array_position("options", F.col("_a")).cast("int"), F.lit(1))
    return df.select(scene, "options", letter.alias("answer"), F.col("_a").alias("answer_text"))


def banded_quota(df: DataFrame, value: str, bands: int, total: int, key: str) -> DataFrame:
    """Rows with their band of equal counts and the band's quota of a total, by largest remainder."""
    banded = windows.equal_count_bins(df, value, bands, key)
    sizes = windows.allocate(banded.groupBy("bin").agg(F.count(F.lit(1)).alias("_n")), "_n", total, "bin")
    return banded.join(F.broadcast(sizes.select("bin", F.col("given").alias("quota"))), "bin")


def pick_spread(df: DataFrame, axes: list[str], key: str, seed: int) -> DataFrame:
    """Each band's quota of rows, in band order, each time the row whose values on the axes were taken least.

    The choice depends on all choices before it, so it is one sequential task. Rows of a band with the
    same values on the axes are taken in the order of (hash, key), so that task sees the first `quota`
    of each combination of values, and no row that it leaves out could be chosen.
    """
    rank = F.row_number().over(W.partitionBy("bin", *axes).orderBy("_h", key))
    rows = df.withColumn("_h", windows.stable_hash(seed, F.col(key))).withColumn("_r", rank).where("_r <= quota")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = Counter(), []
        frame = frame.sort_values(["bin", "_h", key]).reset_index(drop=True)
        for _, band in frame.groupby("bin", sort=True):
            heads = {}
            for i, values in zip(band.index, band[axes].itertuples(index=False, name=None)):
                heads.setdefault(tuple(None if pd.isna(v) else v for v in values), []).append(i)
            heads = {v: left[::-1] for v, left in heads.items()}
            for _ in range(min(int(band["quota"].iloc[0]), len(band))):
                best = min(heads, key=lambda v: (sum(taken[x] for x in zip(axes, v)), heads[v][-1]))
                out.append(heads[best].pop())
                taken.update(zip(axes, best))
                if not heads[best]:
                    del heads[best]
        return frame.loc[out].drop(columns=["_h", "_r", "_all"])

    return rows.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(choose, df.schema)


def arms(points: DataFrame, box: str, question: str, wordings: dict[str, str], box_wording: str) -> DataFrame:
    """points plus arm, answer_type, ask (the text to send), gold_box and gold_text, a row for each arm that a point can be asked in.

    repeat: as it is; quadrant_mc: which quarter, as a choice of four; crop: the half-size window around
    the target, moved into the image, with the box remapped (a target that straddles its edge has no
    such row); bbox: the box is asked for; and one arm for each wording, put before the question.
    """
    b, q = F.col(box), F.col(question)
    cx, cy = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    corner = lambda c: F.least(F.greatest(c - 0.25, F.lit(0.0)), F.lit(0.5))
    cropped = geo.crop_remap(b, geo.box(corner(cx), corner(cy), corner(cx) + 0.5, corner(cy) + 0.5))
    quarter = F.concat(F.lit("Which quarter of the image contains "), q, F.lit("?"))
    letter = geo.quadrant(cx, cy)

    def row(arm: str, kind: str, ask: Column, gold: Column | None = None, text: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(arm).alias("arm"), F.lit(kind).alias("answer_type"), ask.alias("ask"), (none if gold is None else gold).alias("gold_box"),
            (none if text is None else text).cast("string").alias("gold_text"),
        )

    rows = [row("repeat", "point", q, b), row("quadrant_mc", "choice", quarter, text=letter), row("crop", "point", q, cropped)]
    rows += [row("bbox", "bbox", F.concat(F.lit(box_wording), q), b)]
    rows += [row(name, "point", F.concat(F.lit(words), q), b) for name, words in wordings.items()]
    made = points.select(*points.columns, F.inline(F.array(*rows)))
    return made.where((F.col("arm") != "crop") | F.col("gold_box").isNotNull())


def training_records(df: DataFrame, prompt: Column, completion: Column, key: str = "uid", **nested: Column) -> DataFrame:
    """key and one nested JSON record per row."""
    parts = [prompt.alias("prompt"), completion.alias("completion"), *(v.alias(k) for k, v in nested.items())]
    return df.select(key, F.to_json(F.struct(*parts)).alias("record"))


def operand_search(expression: Column, pred: Column, trace: Column, most_values: int = 65_536) -> Column:
    """How a calculation, run from left to right, must change to give the answer: wrong_operation (any other choice of
    operators, or the two operands of a single one swapped), wrong_operand (one operand replaced by a number of the
    trace or the answer), else unclassified, as is what can't be read as numbers and operators.

    Choices of operators are followed as the different values that they reach, operand by operand. Up to eight
    operators these are never more than 4 ** 8; a longer calculation that reaches more than most_values is undecided,
    as to decide it in general is as hard as to split numbers into two equal sums.
    """
    e = F.regexp_replace(F.coalesce(expression, F.lit("")), ",", "")
    numbers = F.transform(F.split(e, r"[+\-*/]"), lambda t: F.trim(t).try_cast("double"))
    signs = F.transform(F.regexp_extract_all(e, F.lit(r"[+\-*/]"), F.lit(0)), lambda o: F.instr(F.lit("+-*/"), o) - 1)
    mentioned = lambda x: F.transform(
        F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"-?\d[\d,]*(?:\.\d+)?"), F.lit(0)),
        lambda n: F.regexp_replace(n, ",", "").try_cast("double"),
    )
    told = F.coalesce(tx.readings(pred), F.slice(F.array_sort(mentioned(pred)), 1, 1))
    read = F.struct(numbers.alias("vals"), signs.alias("ops"), told.alias("answers"))
    return _bound(read, lambda r: _searched(r["vals"], r["ops"], r["answers"], F.array_distinct(F.concat(mentioned(trace), mentioned(pred))), most_values))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once a row; an expression is otherwise worked out wherever it stands, in lambdas for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _searched(vals: Column, ops: Column, answers: Column, pool: Column, most_values: int) -> Column:
    def step(acc: Column, v: Column, o: Column) -> Column:
        return F.when(o == 0, acc + v).when(o == 1, acc - v).when(o == 2, acc * v).otherwise(F.try_divide(acc, v))

    def run(numbers: Column, op: Callable[[Column], Column]) -> Column:
        rest = F.sequence(F.lit(1), F.size(numbers) - 1)
        return F.aggregate(rest, F.get(numbers, F.lit(0)), lambda acc, i: step(acc, F.get(numbers, i), op(i - 1)))

    def near(v: Column) -> Column:
        return F.coalesce(F.exists(answers, lambda p: F.abs(v - p) <= F.greatest(F.lit(1e-6), 1e-6 * F.abs(p))), F.lit(False))

    # What the own operators have reached, and all that others have: null once those are too many.
    number, every = F.lit(None).cast("double"), F.array(*map(F.lit, range(4)))

    def reach(s: Column, i: Column) -> Column:
        x, o = F.get(vals, i), F.get(ops, i - 1)
        changed = F.transform(F.filter(every, lambda c: c != o), lambda c: step(s["own"], x, c))
        further = F.flatten(F.transform(s["others"], lambda v: F.transform(every, lambda c: step(v, x, c))))
        others = F.array_distinct(F.array_compact(F.concat(further, changed)))
        return F.struct(step(s["own"], x, o).alias("own"), F.when(F.size(others) <= most_values, others).alias("others"))

    start = F.struct(F.coalesce(F.get(vals, F.lit(0)), number).alias("own"), F.array().cast("array<double>").alias("others"))
    reached = F.aggregate(F.sequence(F.lit(1), F.size(vals) - 1), start, reach, lambda s: s["others"])
    # true or false; null where too many values were reached.
    others = _bound(reached, lambda found: F.exists(found, near))
    swapped = (F.size(vals) == 2) & F.exists(F.array(*map(F.lit, range(4))), lambda o: near(step(F.get(vals, F.lit(1)), F.get(vals, F.lit(0)), o)))
    put = lambda k, v: F.transform(vals, lambda x, i: F.when(i == k, v).otherwise(x))
    replaced = _bound(pool, lambda held: F.exists(
        F.sequence(F.lit(0), F.size(vals) - 1), lambda k: F.exists(held, lambda v: near(run(put(k, v), lambda i: F.get(ops, i))))
    ))
    readable = (F.size(vals) >= 2) & ~F.exists(vals, lambda v: v.isNull())
    how = lambda found: (
        F.when(F.coalesce(found, F.lit(False)) | swapped, "wrong_operation").when(found.isNull(), "undecided")
        .when(replaced, "wrong_operand").otherwise("unclassified")
    )
    return F.when(~readable | (F.coalesce(F.size(answers), F.lit(0)) <= 0), "unclassified").otherwise(_bound(others, how))
