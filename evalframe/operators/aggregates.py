"""Cells, contrasts, curves and drill-downs over scored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalframe.functions import answers as an
from evalframe.functions import geometry as geo
from evalframe.functions import stats
from evalframe.operators import drill, windows
from evalframe.storage import small_side

SUPPRESS_BELOW = 30


def accuracy_cell(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """acc, n, ci_lo, ci_hi of the scores that are not null."""
    out = df.groupBy(*by).agg(F.avg(score).alias("acc"), F.count(score).alias("n"))
    ci = stats.wilson_of_mean(F.col("acc"), F.col("n"))
    return out.withColumn("ci_lo", ci["lo"]).withColumn("ci_hi", ci["hi"])


def slice_by(df: DataFrame, by: list[str], min_n: int, score: str = "score") -> DataFrame:
    return accuracy_cell(df, by, score).where(F.col("n") >= min_n)


def rate_cell(df: DataFrame, by: list[str], hit: Column, chance: Column | None = None) -> DataFrame:
    """n, k, acc, lo, hi, suppressed and, given a chance per row, chance and ratio."""
    usable = hit.isNotNull()
    aggs = [F.count_if(usable).alias("n"), F.count_if(hit).alias("k")]
    if chance is not None:
        aggs.append(F.avg(F.when(usable, chance)).alias("chance"))
    out = df.groupBy(*by).agg(*aggs)
    ci = stats.wilson(F.col("k"), F.col("n"))
    out = out.withColumn("acc", F.try_divide("k", "n")).withColumn("lo", ci["lo"]).withColumn("hi", ci["hi"])
    out = out.withColumn("suppressed", F.col("n") < SUPPRESS_BELOW)
    return out if chance is None else out.withColumn("ratio", F.try_divide("acc", "chance"))


def pivot_matrix(df: DataFrame, row: str, col: str, score: str = "score") -> DataFrame:
    """Cells of row x col with the totals of rows and of columns and of all, in one pass."""
    out = df.cube(row, col).agg(
        F.avg(score).alias("acc"), F.count(score).alias("n"), F.grouping_id().alias("level")
    )
    return out


def signed_errors(df: DataFrame, by: list[str], pred: str, truth: str) -> DataFrame:
    d = F.col(pred) - F.col(truth)
    out = df.groupBy(*by).agg(
        F.avg(d).alias("mean_signed"), F.avg(F.when(d != 0, d)).alias("mean_signed_when_wrong"),
        F.count_if(d < 0).alias("under"), F.count_if(d > 0).alias("over"),
    )
    middle = windows.percentiles(df.withColumn("_d", F.abs(d)), by, "_d", median_abs=("median", 0)).drop("n")
    return _beside(out, middle, by).select(*by, "mean_signed", "mean_signed_when_wrong", "median_abs", "under", "over")


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a with the columns of b for the same groups; a group may be null."""
    names = {c: f"_{c}" for c in by}
    on = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()))
    return a.join(b.withColumnsRenamed(names), on, "left").drop(*names.values())


def with_empty_bins(cells: DataFrame, bins: list[str], name: str) -> DataFrame:
    """Every bin in its order, those without rows included with n = 0."""
    order = cells.sparkSession.createDataFrame(list(enumerate(bins)), f"bin_order int, {name} string")
    return F.broadcast(order).join(cells, name, "left").fillna(0, ["n"])


def top_with_rest(df: DataFrame, category: str, k: int, other: str = "other") -> DataFrame:
    """Counts of the k most frequent categories and of all others together."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc(category)).limit(k).select(F.col(category).alias("_top"), F.lit(True).alias("_is"))
    ranked = counts.join(F.broadcast(top), F.col(category).eqNullSafe(F.col("_top")), "left")
    name = F.when(F.col("_is"), F.col(category)).otherwise(other)
    return ranked.groupBy(name.alias(category)).agg(F.sum("n").alias("n"))


def precision_curve(df: DataFrame, x: str, y: str, box: str, grids: tuple[int, ...] = (2, 3, 4, 8, 16)) -> DataFrame:
    """Hit rates at each grid, strict (the box's centre cell) and lenient (a touched cell), and exact (grid 0)."""
    b = F.col(box)
    cx, cy = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    px, py = F.col(x), F.col(y)
    aggs = []
    for g in grids:
        strict = (geo.cell(px, g) == geo.cell(cx, g)) & (geo.cell(py, g) == geo.cell(cy, g))
        lenient = geo.touches_cell(px, py, b, g)
        aggs.append(F.struct(F.lit(g).alias("grid"), F.count_if(strict).alias("k"), F.count_if(lenient).alias("k_lenient"), F.lit(1.0 / g / g).alias("chance")))
    exact = geo.in_box(px, py, b)
    aggs.append(F.struct(F.lit(0).alias("grid"), F.count_if(exact).alias("k"), F.count_if(exact).alias("k_lenient"), F.avg(geo.area(b)).alias("chance")))
    out = df.agg(F.count(px).alias("n"), F.array(*aggs).alias("c")).select("n", F.inline("c"))
    return out.withColumn("acc", F.try_divide("k", "n")).withColumn("acc_lenient", F.try_divide("k_lenient", "n"))


def miss_summary(df: DataFrame, by: list[str], x: str, y: str, box: str) -> DataFrame:
    """Of the misses: number, median and 90th percentile (exclusive) of the distance, counts per band."""
    b = F.col(box)
    d = geo.to_box(F.col(x), F.col(y), b)
    misses = df.where(~geo.in_box(F.col(x), F.col(y), b)).withColumn("_d", d).withColumn("_b", geo.miss_band(d))
    out = misses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_miss"), *(F.count_if(F.col("_b") == name).alias(name) for name in ("near", "moderate", "wrong_region"))
    )
    cuts = windows.percentiles(misses, by, "_d", median_d=("median", 0), p90_d=("exclusive", 90)).drop("n")
    return _beside(out, cuts, by)


def judged_clicks(df: DataFrame, response: str, box: str, width: str, height: str) -> DataFrame:
    """df plus strict, parsed, followed (all values within 0 and 1, as asked) and hit (a box counts by its centre)."""
    told = an.official_answer(F.col(response))
    rows = df.withColumn("_t", told).withColumn("_v", F.col("_t.values"))
    unit = an.to_unit(F.col("_v"), F.col(width), F.col(height))["values"]
    at = lambda k: F.when(F.size(unit) == 4, (unit[k] + F.get(unit, F.lit(k + 2))) / 2).otherwise(unit[k])
    hit = F.coalesce(geo.in_box(at(0), at(1), F.col(box)), F.lit(False))
    followed = F.coalesce(F.forall("_v", lambda v: F.abs(v) <= 1), F.lit(False))
    return rows.select(
        *df.columns, F.col("_t.strict").alias("strict"), F.col("_v").isNotNull().alias("parsed"), followed.alias("followed"), hit.alias("hit")
    )


def funnel(judged: DataFrame) -> DataFrame:
    """Of all responses, how many could be read, matched the format, kept to the range and hit."""
    return judged.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(c) for c in ("parsed", "strict", "followed", "hit")))


def independence(judged: DataFrame) -> DataFrame:
    """Hit rates of what could be read, by whether it kept to the range."""
    return judged.where("parsed").groupBy("followed").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("rate"))


def frame_audit(df: DataFrame, by: list[str], x: str, y: str, sent: tuple[str, str], delivered: tuple[str, str]) -> DataFrame:
    """Of points quoted in a sent image's pixels, how many lie outside the delivered one; and the rescaling, by groups."""
    outside = (F.col(x) > F.col(delivered[0])) | (F.col(y) > F.col(delivered[1]))
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("outside"), F.min(F.col(delivered[0]) / F.col(sent[0])).alias("rescale")
    )
    return out.withColumn("frac", F.try_divide("outside", "n"))


def three_costs(evidence: DataFrame, whole: DataFrame, key: str, score: str, equivalent: str, several: Column, computed: Column) -> DataFrame:
    """cost, as_scored, corrected: what finding, combining and computing cost, in points of the mean score.

    retrieval: all pages against the evidence alone, over the keys that both have; integration:
    questions on several pages against those on one; derivation: computed answers against quoted ones,
    both with the evidence. Corrected scores count an answer that is equivalent as right.
    """
    fixed = lambda: F.when(F.col(equivalent), F.lit(1.0)).otherwise(F.col(score))
    e = evidence.select(F.col(key).alias("_k"), F.col(score).alias("_s"), fixed().alias("_f"), several.alias("_several"), computed.alias("_computed"))
    w = whole.select(F.col(key).alias("_k"), F.col(score).alias("_ws"), fixed().alias("_wf"))
    both = e.join(w, "_k").agg((F.avg("_ws") - F.avg("_s")).alias("s"), (F.avg("_wf") - F.avg("_f")).alias("f"))
    split = lambda by, c: F.avg(F.when(F.col(by), F.col(c))) - F.avg(F.when(~F.col(by), F.col(c)))
    named = lambda name, s, f: F.struct(F.lit(name).alias("cost"), (100 * s).alias("as_scored"), (100 * f).alias("corrected"))
    own = e.agg(F.array(*(named(n, split(b, "_s"), split(b, "_f")) for n, b in (("integration", "_several"), ("derivation", "_computed")))).alias("c"))
    return both.select(F.inline(F.array(named("retrieval", F.col("s"), F.col("f"))))).unionByName(own.select(F.inline("c")))


def reweighted_rate(df: DataFrame, stratum: str, bad: Column, population: DataFrame) -> DataFrame:
    """Rate of bad over the population's strata sizes (stratum, size), by the strata observed."""
    rates = df.groupBy(stratum).agg(F.avg(bad.cast("double")).alias("rate"), F.count(F.lit(1)).alias("audited"))
    both = rates.join(small_side(population), stratum)
    return both.agg(
        F.try_divide(F.sum(F.col("rate") * F.col("size")), F.sum("size")).alias("rate"), F.sum("audited").alias("audited")
    )


def mantel_haenszel(df: DataFrame, stratum: list[str], exposed: Column, hit: Column) -> DataFrame:
    """Common odds ratio over strata with the Robins-Breslow-Greenland interval; strata with an empty margin are left out."""
    cell = lambda e, h: F.count_if(e & h).cast("double")
    t = df.groupBy(*stratum).agg(
        cell(exposed, hit).alias("a"), cell(exposed, ~hit).alias("b"), cell(~exposed, hit).alias("c"), cell(~exposed, ~hit).alias("d")
    )
    a, b, c, d = map(F.col, "abcd")
    n = a + b + c + d
    t = t.where((a + b > 0) & (c + d > 0) & (a + c > 0) & (b + d > 0))
    p, q, r, s = (a + d) / n, (b + c) / n, a * d / n, b * c / n
    out = t.agg(
        F.count(F.lit(1)).alias("n_strata"), F.sum(r).alias("r"), F.sum(s).alias("s"), F.sum(p * r).alias("pr"),
        F.sum(p * s + q * r).alias("psqr"), F.sum(q * s).alias("qs"),
    )
    var = F.try_divide(F.col("pr"), 2 * F.col("r") * F.col("r")) + F.try_divide(
        F.col("psqr"), 2 * F.col("r") * F.col("s")
    ) + F.try_divide(F.col("qs"), 2 * F.col("s") * F.col("s"))
    ratio = F.try_divide("r", "s")
    return out.select(
        "n_strata", ratio.alias("odds_ratio"), F.exp(F.log(ratio) - stats.Z * F.sqrt(var)).alias("lo"),
        F.exp(F.log(ratio) + stats.Z * F.sqrt(var)).alias("hi"),
    )


def paired(a: DataFrame, b: DataFrame, key: list[str], hit: str = "hit", order: str | None = None) -> DataFrame:
    """Paired outcomes of two conditions: n, both, only_a, only_b, neither, chi2, significant.

    Of rows that repeat a key in a condition the last by `order` counts; without an order keys must not repeat.
    """
    if order is not None:
        a, b = (d.groupBy(*key).agg(F.max_by(hit, order).alias(hit)) for d in (a, b))
    x = a.select(*(F.col(k).alias(f"_{k}") for k in key), F.col(hit).alias("_a"))
    y = b.select(*key, F.col(hit).alias("_b"))
    # Keys may be null and then match each other.
    on = reduce(lambda p, q: p & q, (F.col(f"_{k}").eqNullSafe(F.col(k)) for k in key))
    j = x.join(y, on)
    out = j.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_a") & F.col("_b")).alias("both"),
        F.count_if(F.col("_a") & ~F.col("_b")).alias("only_a"), F.count_if(~F.col("_a") & F.col("_b")).alias("only_b"),
        F.count_if(~F.col("_a") & ~F.col("_b")).alias("neither"),
    )
    chi2 = stats.mcnemar(F.col("only_a"), F.col("only_b"))
    return out.withColumn("chi2", chi2).withColumn("significant", F.coalesce(chi2 > stats.CHI2_1, F.lit(False)))


def confusion(df: DataFrame, by: list[str], said: Column, true: Column) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(said & true).alias("tp"), F.count_if(~said & true).alias("fn"),
        F.count_if(said & ~true).alias("fp"), F.count_if(~said & ~true).alias("tn"),
    )


def chi2_against(df: DataFrame, option: str, expected: DataFrame) -> DataFrame:
    """Chi-square of the options' counts against expected (option, share); options without expectation count nothing."""
    seen = df.groupBy(option).agg(F.count(F.lit(1)).alias("o"))
    both = F.broadcast(expected).join(seen, option, "left").fillna(0, ["o"])
    n = both.agg(F.sum("o").alias("n"))
    e = F.col("share") * F.col("n")
    out = both.crossJoin(n).agg(
        F.sum("o").alias("n"), F.sum(F.when(e > 0, F.pow(F.col("o") - e, F.lit(2.0)) / e)).alias("chi2")
    )
    return out.withColumn("biased", F.coalesce(F.col("chi2") > stats.CHI2_3, F.lit(False)))


def drill_down(df: DataFrame, dims: list[str], score: str = "score", min_n: int = SUPPRESS_BELOW) -> DataFrame:
    """Every path prefix of the dimensions: path (as drill.path_text), depth, n, value, delta to the parent, spread of its large children."""
    nested: tuple[drill.Dim, ...] = ()
    for d in reversed(dims):
        nested = (drill.Dim(d, F.col(d), nested),)
    tree = drill.drill_tree(df, nested, F.col(score), min_n=min_n)
    return tree.select(drill.path_text(F.col("path")).alias("path"), "depth", "n", "value", "delta", F.get("splits", F.lit(0))["spread"].alias("spread"))


def conservation_violations(tree: DataFrame) -> DataFrame:
    """Parents in the text form of drill_down whose children's counts don't add up to their own; drill.violations takes whole trees."""
    parent = F.when(F.col("depth") > 0, F.regexp_replace("path", r"/?(?:[^/\\]|\\.)*$", ""))
    kids = tree.where("depth > 0").groupBy(parent.alias("path"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n").alias("of_children"))
    return tree.select("path", "depth", "n").join(kids, ["path", "depth"]).where("n <> of_children")
