"""Risk-controlled quality rules, in DataFrame functions only.

Each document gets text counts; each rule rejects a document whose ratio exceeds a cutoff. A
cutoff may be used in a stratum only if the labelled good documents show, by an exact binomial
test, that it rejects no more than a share `risk` of them. All cutoffs, rules and strata are
tested together, so the level is divided by their number (Bonferroni).

The risk holds for each rule. A document is kept if no rule rejects it, so up to as many times the
risk as there are rules of the good documents of a stratum may be rejected together. A cutoff
needs some hundred labelled good documents even if it rejects none of them (1,400 for the default
risk and level with four strata); strata with fewer are judged by the base rules alone.

Edge cases: null or empty text has no words and fails the base rules; null strata form one
stratum; repeated rows are judged alike; strata without labels get no rule; labels that are
missing or null are not used; very long texts are counted whole; an empty table gives an empty
result. Other columns are ignored, whatever their names but those of the counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import materialize, words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]+"
#: Words in a window; a power of two.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Reject when 100 * part > cutoff * whole."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[int, ...]


#: Grids are parameters of the operator, not fitted.
RULES = (
    Rule("symbols", "n_symbols", "word_chars", (1, 2, 3, 5, 8, 12, 20)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (5, 10, 20, 30, 50)),
    Rule("repeats", "n_repeat_words", "n_words", (2, 5, 10, 15, 20, 25)),
    Rule("long_words", "word_chars", "n_words", (800, 900, 1000, 1200, 1500)),
)


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_pct: int = 30
    risk: float = 0.005  # of good documents that one rule may reject in a stratum
    level: float = 0.05  # chance that any chosen cutoff exceeds the risk
    rules: tuple[Rule, ...] = field(default=RULES)


def text_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """keep + n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(
        *keep,
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).alias("n_symbols"),
        lines.alias("_lines"),
        words(F.col(text)).alias("_w"),
    )
    df = df.select(
        *keep, "n_symbols",
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.size("_w").alias("n_words"),
        F.length(F.array_join("_w", "")).alias("word_chars"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    # Hashes of 1, 2, 4 and 8 words, each from two of the step before; the last WINDOW - 1 are cut off.
    step = 1
    while step < WINDOW:
        rest = F.slice("_h", step + 1, F.greatest(F.size("_h") - step, F.lit(0)))
        df = df.withColumn("_h", F.zip_with("_h", rest, lambda a, b: F.xxhash64(a, b)))
        step *= 2
    df = df.withColumn("_h", F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))))
    # Only texts in which a window recurs pay for the sort that finds where.
    recurs = F.size(F.array_distinct("_h")) < F.size("_h")
    ranked = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("_s", F.when(recurs, ranked))
    same = lambda x, i: F.coalesce(F.get("_s", i)["h"] == x["h"], F.lit(False))
    twins = F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.withColumn("_p", F.sort_array(F.transform(twins, lambda x: x["p"])))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")
        ),
        lambda acc: acc["n"],
    )
    long = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")]
    return df.select(*keep, *long, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), by summing the terms with their logarithms' recurrence; native."""
    odds, none = math.log(p / (1 - p)), math.log1p(-p)
    first = n * F.lit(none)
    return F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("t"), F.exp(first).alias("s")),
        lambda acc, i: F.struct(
            (acc["t"] + F.log((n - i + 1) / i) + F.lit(odds)).alias("t"),
            (acc["s"] + F.exp(acc["t"] + F.log((n - i + 1) / i) + F.lit(odds))).alias("s"),
        ),
        lambda acc: acc["s"],
    )


def _exceeds(rule: Rule, cutoff: Column) -> Column:
    return F.col(rule.part) * 100 > cutoff * F.col(rule.whole)


def choose_cutoffs(labelled: DataFrame, limits: Limits = Limits(), stratum: str = "stratum") -> DataFrame:
    """One row per stratum: n_good and for each rule its smallest admissible cutoff, or null.

    labelled holds good documents (those whose rejection is false) with counts and the stratum.
    """
    counts = [
        F.count_if(_exceeds(r, F.lit(c))).alias(f"k_{r.name}_{c}") for r in limits.rules for c in r.cutoffs
    ]
    seen = labelled.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_good"), *counts)
    # One row per stratum: as many as strata, each a few dozen numbers.
    seen = seen.crossJoin(seen.agg(F.count(F.lit(1)).alias("n_strata")))
    per_stratum = sum(len(r.cutoffs) for r in limits.rules)
    level = F.lit(limits.level) / (F.col("n_strata") * per_stratum)

    def admitted(rule: Rule, cutoff: int) -> Column:
        k = F.col(f"k_{rule.name}_{cutoff}")
        # From the expected count on, the probability is about a half or more: no need to sum.
        ok = F.when(k < F.col("n_good") * limits.risk, binomial_cdf(k, F.col("n_good"), limits.risk) <= level)
        return F.when(ok, F.lit(cutoff).cast("long"))

    return seen.select(
        stratum, "n_good",
        *(F.least(*(admitted(r, c) for c in r.cutoffs)).alias(f"cut_{r.name}") for r in limits.rules),
    )


def quality_rules(
    docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), stratum: str = "lang", key: str = "doc_id"
) -> DataFrame:
    """key, counts, base_failed, kept, and failed: the names of the rules that reject the document."""
    counts = text_counts(docs, keep=(key, stratum)).withColumn(
        "base_failed",
        (F.col("n_words") < limits.min_words)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * limits.max_repeat_pct),
    )
    counts = materialize(counts.withColumnRenamed(stratum, "stratum").fillna("", ["stratum"]), "counts")
    good = labels.where("quality = 1").select(key).distinct()
    cuts = choose_cutoffs(counts.where(~F.col("base_failed")).join(good, key, "left_semi"), limits)
    judged = counts.join(cuts, "stratum", "left")
    failed = F.array_compact(
        F.array(*(F.when(_exceeds(r, F.col(f"cut_{r.name}")), F.lit(r.name)) for r in limits.rules))
    )
    return judged.withColumn("failed", failed).select(
        key, "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed",
    )
