"""Answer comparison as native column expressions; golds are arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's float() reads of finite numbers, without digit separators.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_WS = r"(?U)\s+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize(x: Column) -> Column:
    """Stripped, lower case, no commas, single spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(x)), ",", ""), _WS, " ")


def as_float(x: Column) -> Column:
    """Number of a text with $, % and commas taken off; null if it is none."""
    t = strip(F.regexp_replace(normalize(x), "[%$]", ""))
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def anls(pred: Column, golds: Column) -> Column:
    """Best normalised Levenshtein similarity to a gold; 0 from a distance of half the longer text."""

    def one(g: Column) -> Column:
        a, b = F.lower(strip(F.coalesce(pred, F.lit("")))), F.lower(strip(g))
        longest = F.greatest(F.length(a), F.length(b))
        nl = F.levenshtein(a, b) / longest
        return F.when(longest == 0, 1.0).when(nl < 0.5, 1 - nl).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(golds, one)), F.lit(0.0))


def numeric_or_text(pred: Column, golds: Column, tol: float = 1e-6) -> Column:
    """1 if some gold matches as a number, or, unless both are numbers, as normalised text."""
    p = as_float(pred)

    def one(g: Column) -> Column:
        v = as_float(g)
        close = F.abs(p - v) <= tol * F.greatest(F.lit(1.0), F.abs(v))
        return F.when(p.isNotNull() & v.isNotNull(), close).otherwise(normalize(pred) == normalize(g))

    return F.when(F.coalesce(F.exists(golds, one), F.lit(False)), 1.0).otherwise(0.0)


def boolean_match(pred: Column, golds: Column) -> Column:
    same = F.exists(golds, lambda g: F.lower(strip(g)) == F.lower(strip(pred)))
    return F.when(F.coalesce(same, F.lit(False)), 1.0).otherwise(0.0)


def count_score(pred: Column, golds: Column) -> Column:
    """(exact, abs_error, signed_error) against the first gold; errors are null if either isn't a whole number."""
    whole = lambda x: F.when(strip(x).rlike(r"^[+-]?\d+$"), strip(x).try_cast("long"))
    d = whole(pred) - whole(F.get(golds, F.lit(0)))
    return F.struct(
        F.when(F.coalesce(d == 0, F.lit(False)), 1.0).otherwise(0.0).alias("exact"),
        F.abs(d).alias("abs_error"), d.alias("signed_error"),
    )


def tokens(x: Column) -> Column:
    t = F.regexp_replace(F.lower(F.regexp_replace(x, ",", " ")), _WS, " ")
    return F.array_remove(F.split(F.trim(t), " "), "")


def token_f1(pred: Column, golds: Column) -> Column:
    """(em, f1), each the best over the golds: equal token lists, and multiset overlap."""
    p = tokens(F.coalesce(pred, F.lit("")))
    n_of = lambda a, t: F.size(F.filter(a, lambda x: x == t))

    def f1(g: Column) -> Column:
        q = tokens(g)
        both = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, t: n + F.least(n_of(p, t), n_of(q, t)))
        return F.when(F.size(p) + F.size(q) == 0, 1.0).otherwise(
            F.coalesce(F.try_divide(2.0 * both, F.size(p) + F.size(q)), F.lit(0.0))
        )

    em = F.coalesce(F.exists(golds, lambda g: tokens(g) == p), F.lit(False))
    return F.struct(
        F.when(em, 1.0).otherwise(0.0).alias("em"), F.coalesce(F.array_max(F.transform(golds, f1)), F.lit(0.0)).alias("f1")
    )


def fold(x: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


#: Ways to say that a question has no answer.
NOT_APPLICABLE = ("not applicable", "n/a", "na", "none", "not available")


def says_not_applicable(x: Column) -> Column:
    return F.rtrim(F.lower(strip(x)), F.lit(".")).isin(*NOT_APPLICABLE)


def bare(x: Column) -> Column:
    """Lower case, single spaces, without spaces and full stops at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(x)), _WS, " "), r"^[ .]+|[ .]+$", "")


def is_said(x: Column, words: str, anywhere: bool = False) -> Column:
    """Whether a text is the words, stripped and in any case, or with anywhere holds them."""
    t = F.lower(F.coalesce(x, F.lit("")))
    return t.contains(words.lower()) if anywhere else strip(t) == words.lower()


def refers_to(x: Column, marks: tuple[str, ...]) -> Column:
    """Whether a text names one of the marks (patterns) as a whole word, in any case."""
    return x.rlike(r"(?i)\b(" + "|".join(marks) + r")\b")


def list_items(x: Column) -> Column:
    """Items split at the first of comma, semicolon or line feed that occurs; bare, blanks left out."""
    t = strip(F.coalesce(x, F.lit("")))
    parts = (
        F.when(t.contains(","), F.split(t, ",")).when(t.contains(";"), F.split(t, ";")).when(t.contains("\n"), F.split(t, "\n"))
        .otherwise(F.array(t))
    )
    return F.array_remove(F.transform(parts, bare), "")


def numbers_in(x: Column) -> Column:
    """Sorted distinct numbers that a text mentions."""
    found = F.regexp_extract_all(F.regexp_replace(x, r"(?<=\d),(?=\d{3})", ""), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.try_cast("double"))))


#: Fixed value: words that an answer may carry beside its value.
UNIT_WORDS = r"(?Ui)\b(million|billion|thousand|percent|pct|usd|dollars?|people|users?|countries|cases|years?|days?|m|bn|k)\b"


def failure_mode(pred: Column, golds: Column) -> Column:
    """How a wrong answer differs from the golds.

    Lists come first, over all golds: an answer and a gold of which either has two items or more are
    compared as sets, then in order. Only then the surface: the same bare text, the same numbers, or
    the same text without unit words.
    """
    p = F.coalesce(pred, F.lit(""))
    mine = list_items(p)

    def listed(g: Column) -> Column:
        items = list_items(g)
        extra, missing = F.size(F.array_except(mine, items)), F.size(F.array_except(items, mine))
        return (
            F.when(((F.size(items) < 2) & (F.size(mine) < 2)) | (F.size(items) == 0), None)
            .when((extra == 0) & (missing == 0), F.when(items == mine, "format_only").otherwise("order_only"))
            .when(missing == 0, "extra_items").when(extra == 0, "missing_items")
            .when(F.size(F.array_intersect(mine, items)) > 0, "partial_overlap")
        )

    digits = lambda x: F.regexp_extract_all(F.regexp_replace(x, ",", ""), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    unitless = lambda x: bare(F.regexp_replace(F.regexp_replace(x, "[%$]", ""), UNIT_WORDS, ""))

    def same_value(g: Column) -> Column:
        numbers = (F.size(digits(g)) > 0) & (digits(g) == digits(p))
        return (bare(g) == bare(p)) | numbers | ((unitless(g) != "") & (unitless(g) == unitless(p)))

    modes = F.array_compact(F.transform(golds, listed))
    surface = F.when(F.coalesce(F.exists(golds, same_value), F.lit(False)), "format_only").otherwise("unclassified")
    return F.coalesce(F.get(modes, F.lit(0)), surface)


#: Scale words and their factors; the first rule below does not know the single b.
SCALES = {
    "k": 1e3, "thousand": 1e3, "thousands": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "millions": 1e6,
    "bn": 1e9, "b": 1e9, "billion": 1e9, "billions": 1e9, "tn": 1e12, "trillion": 1e12,
}


def _either(pred: Column, golds: Column, read, same) -> Column:
    """Whether some gold equals pred: by same where both can be read as numbers, else as letters and digits."""
    p = read(pred)

    def one(g: Column) -> Column:
        v = read(g)
        return F.when(p.isNotNull() & v.isNotNull(), same(v, p)).otherwise((fold(pred) == fold(g)) & (fold(pred) != ""))

    return F.coalesce(F.exists(golds, one), F.lit(False))


def report_number(x: Column) -> Column:
    """A number with a scale word anywhere applied, the longest that occurs; words of letters after it are ignored."""
    t = F.regexp_replace(F.lower(strip(x)), "[,$€£%]", "")
    left, factor = t, F.lit(1.0)
    for word in sorted((w for w in SCALES if w != "b"), key=len):
        held = rf"(?U)(?<![a-z]){word}\b"
        left = F.when(t.rlike(held), F.regexp_replace(t, held, "")).otherwise(left)
        factor = F.when(t.rlike(held), F.lit(SCALES[word])).otherwise(factor)
    number = F.regexp_extract(left, r"^\s*(-?\d+\.?\d*)\s*[a-z]*\s*$", 1)
    return number.try_cast("double") * factor


def format_equivalent(pred: Column, golds: Column) -> Column:
    """The report's rule: numbers are compared exactly."""
    return _either(pred, golds, report_number, lambda v, p: v == p)


def readings(x: Column) -> Column:
    """The numbers that a text of one number may mean, bare and with its scale word applied; null for anything else."""
    t = F.regexp_replace(F.regexp_replace(F.translate(strip(x), "−", "-"), "[$€£]", ""), _WS, " ")
    pattern = r"^\s*([+-]?)\s*(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?|\.\d+)\s*%?\s*([a-zA-Z]*)\s*$"
    sign, number, word = (F.regexp_extract(t, pattern, k) for k in (1, 2, 3))
    v = F.regexp_replace(number, ",", "").try_cast("double") * F.when(sign == "-", -1.0).otherwise(1.0)
    factor = F.create_map(*(c for w, by in SCALES.items() for c in (F.lit(w), F.lit(by))))[F.lower(word)]
    return F.when(v.isNotNull() & (word == ""), F.array(v)).when(v.isNotNull() & factor.isNotNull(), F.array(v, v * factor))


def cause_equivalent(pred: Column, golds: Column) -> Column:
    """The causes' rule: some reading of one equals some reading of the other, but for rounding of the ninth digit."""
    close = lambda a, b: (a == b) | ((a != 0) & (F.abs(a - b) <= 1e-9 * F.abs(a)))
    return _either(pred, golds, readings, lambda gs, ps: F.exists(gs, lambda a: F.exists(ps, lambda b: close(a, b))))


def drill_number(x: Column) -> Column:
    """A number with a known scale word at its end applied; null with any other word."""
    t = F.regexp_replace(F.lower(strip(x)), "[,$€£% ]", "")
    pattern = r"^([+-]?\d*\.?\d+)\s*([a-z]*)$"
    number, word = F.regexp_extract(t, pattern, 1).try_cast("double"), F.regexp_extract(t, pattern, 2)
    factor = F.create_map(*(c for w, by in SCALES.items() for c in (F.lit(w), F.lit(by))))[word]
    return number * F.when(word == "", 1.0).otherwise(factor)


def drill_equivalent(pred: Column, golds: Column) -> Column:
    """The drill-down's rule: numbers may differ by 1e-9 of the larger, or by 1e-12."""
    close = lambda a, b: F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
    return _either(pred, golds, drill_number, close)


#: Fixed value: units that a slide's number may carry, as whole words.
SLIDE_UNITS = (
    r"(?U)\b(bn|billion|billions|million|millions|mn|thousand|k|usd|dollars?|euros?|eur|gbp|percent|pct|tonnes?|tons?|units?"
    r"|people|users?|trillion|crores?|lakhs?|percentage\s*points?|points?|pts?)\b"
)


def slide_text(x: Column) -> Column:
    """Lower case without commas, currency signs, units and other signs, single spaces."""
    t = F.regexp_replace(F.regexp_replace(F.lower(strip(x)), "[,$€£%]", ""), SLIDE_UNITS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s.+\-]", " "), _WS, " "))


def slide_equivalent(pred: Column, golds: Column) -> Column:
    """The slides' rule: equal slide texts or numbers, or texts of which one, of four letters or more, is whole words of the other."""
    p = slide_text(pred)
    number = lambda t: F.when(t.rlike(r"^[+\-]?\d*\.?\d+$"), t.try_cast("double"))

    def one(g: Column) -> Column:
        t = slide_text(g)
        short, long = F.when(F.length(p) < F.length(t), p).otherwise(t), F.when(F.length(p) < F.length(t), t).otherwise(p)
        held = F.regexp_like(long, F.concat(F.lit(r"(?U)(?<!\w)\Q"), short, F.lit(r"\E(?!\w)")))
        a, b = number(p), number(t)
        return (
            F.when((p == "") | (t == ""), False).when(p == t, True)
            .when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b)))
            .when(a.isNotNull() | b.isNotNull(), False).otherwise((F.length(short) >= 4) & held)
        )

    return F.coalesce(F.exists(golds, one), F.lit(False))


def answer_surface(x: Column) -> Column:
    """What kind of sign an answer carries, the first that holds."""
    return (
        F.when(x.contains("%"), "percent").when(x.rlike(r"[$€£¥]"), "currency").when(x.rlike(r"\d,\d{3}"), "comma")
        .when(x.rlike(r"\d\s*[A-Za-z]"), "unit").otherwise("other")
    )


def cell_label(x: Column, anchored: bool = True) -> Column:
    """A grid label A1 to D4 at the start of a text, or anywhere in it; null if there is none."""
    found = F.regexp_extract(F.upper(x), (r"^\s*" if anchored else "") + r"([A-D][1-4])", 1)
    return F.nullif(found, F.lit(""))


def coordinates(x: Column, n: int) -> Column:
    """The first n comma-separated numbers in parentheses or brackets as doubles; null if there are none."""
    num = r"\s*(-?\d+(?:\.\d+)?)\s*"
    pattern = r"[\[(]" + ",".join([num] * n) + r"[\])]"
    parts = F.array(*(F.regexp_extract(x, pattern, k + 1).try_cast("double") for k in range(n)))
    return F.when(x.rlike(pattern), parts)


#: Ordinals from 1 on.
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth",
    "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
)


def cited_pages(x: Column, most: int = 20) -> Column:
    """Sorted distinct pages that a text names: slide, page or image with a number up to most, or an ordinal before it."""
    t = F.lower(F.coalesce(x, F.lit("")))
    numbers = F.regexp_extract_all(t, F.lit(r"\b(?:slide|page|image)\s*#?\s*(\d{1,2})\b"), F.lit(1))
    named = F.regexp_extract_all(t, F.lit(r"\b(" + "|".join(ORDINALS) + r")\s+(?:slide|page|image)\b"), F.lit(1))
    place = F.create_map(*(c for i, w in enumerate(ORDINALS) for c in (F.lit(w), F.lit(i + 1))))
    pages = F.filter(F.transform(numbers, lambda n: n.cast("int")), lambda n: n.between(1, most))
    return F.array_sort(F.array_distinct(F.concat(pages, F.transform(named, lambda w: place[w]))))
