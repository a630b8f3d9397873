"""Prompts, response parsing, taxonomies and verdicts by answer type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.functions import text as tx
from evalframe.functions.geometry import MAX_EDGE


def prompt(question: Column, kind: Column, options: Column | None = None, own: Column | None = None) -> Column:
    """The text to send: an own prompt first, else the question with what its answer type asks for."""
    asks = {
        "point": "Give the point as integers from 0 to 1000.", "bbox": "Give the box as integers from 0 to 1000.",
        "boolean": "Answer yes or no.", "count": "Answer with a whole number.", "span": "Answer as briefly as possible.",
    }
    told = F.lit(None).cast("string")
    for name, words in asks.items():
        told = F.when(kind == name, F.concat_ws("\n", question, F.lit(words))).otherwise(told)
    if options is not None:
        lines = F.transform(options, lambda o, i: F.concat(F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)), F.lit(") "), o))
        told = F.when(kind == "choice", F.concat_ws("\n", question, F.array_join(lines, "\n"))).otherwise(told)
    return told if own is None else F.coalesce(own, told)


def parse_response(raw: Column, kind: Column) -> Column:
    """A response's JSON as text, point, box and count, by answer type; coordinates from 0-1000 to 0-1, anything else null."""
    j = F.from_json(raw, "answer string, x int, y int, x0 int, y0 int, x1 int, y1 int, count long")
    point = F.struct((j["x"] / 1000).alias("x"), (j["y"] / 1000).alias("y"))
    box = F.struct(*((j[c] / 1000).alias(c) for c in ("x0", "y0", "x1", "y1")))
    text = F.when(kind == "boolean", F.lower(j["answer"])).when(kind == "choice", F.upper(j["answer"])).when(kind == "span", j["answer"])
    return F.struct(
        text.alias("text"), F.when((kind == "point") & j["x"].isNotNull() & j["y"].isNotNull(), point).alias("point"),
        F.when((kind == "bbox") & j["x0"].isNotNull() & j["x1"].isNotNull(), box).alias("box"), F.when(kind == "count", j["count"]).alias("count"),
    )


def first_known(operations: Column, known: dict[str, str]) -> Column:
    """The primitive of the first operation in the list that the taxonomy has."""
    names = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.lit(v))))
    return F.get(F.filter(F.transform(operations, lambda o: names[o]), lambda p: p.isNotNull()), F.lit(0))


def decimals_asked(answer: Column) -> Column:
    """How a numeric answer's precision is put into words."""
    n = F.length(F.get(F.split(answer, r"\."), F.lit(1)))
    whole = F.lit("Answer with a whole number.")
    return F.when(~answer.contains("."), whole).when(n == 1, "Answer with one decimal place.").otherwise(
        F.concat(F.lit("Answer with "), n.cast("string"), F.lit(" decimal places."))
    )


def lenient_point(x: Column) -> Column:
    """(kind, x, y) of a box's centre or a point in a text; null if it has neither."""
    b, p = tx.coordinates(x, 4), tx.coordinates(x, 2)
    of_box = F.struct(F.lit("box").alias("kind"), ((b[0] + b[2]) / 2).alias("x"), ((b[1] + b[3]) / 2).alias("y"))
    return F.when(b.isNotNull(), of_box).when(p.isNotNull(), F.struct(F.lit("point").alias("kind"), p[0].alias("x"), p[1].alias("y")))


#: The protocol's answer formats, strict, and with signs, spaces and single brackets allowed.
_PLAIN, _LOOSE = r"(\d+\.\d+|\d+)", r"\s*([-+]?\d*\.?\d+)\s*"


def official_answer(response: Column) -> Column:
    """(strict, values) of a response: whether it holds a box or point as asked for, and the first box, or else point,
    that it holds in any form; null values if none."""
    strict, loose = (lambda n: r"\[\[" + ",".join([_PLAIN] * n) + r"\]\]"), (lambda n: r"\[?\[" + ",".join([_LOOSE] * n) + r"\]\]?")
    read = lambda n: F.when(response.rlike(loose(n)), F.array(*(F.regexp_extract(response, loose(n), k + 1).try_cast("double") for k in range(n))))
    told = F.coalesce(response.rlike(strict(4)) | response.rlike(strict(2)), F.lit(False))
    return F.struct(told.alias("strict"), F.coalesce(read(4), read(2)).alias("values"))


def panel_steps(question: Column) -> Column:
    """Rows and columns from the first panel to the one that a question names by both; null if it names none so."""
    row, column = (F.regexp_extract(question, r"^For the subplot at row (\d+) and column (\d+)", k).try_cast("int") for k in (1, 2))
    return row - 1 + column - 1


def to_unit(values: Column, width: Column, height: Column, max_edge: int = MAX_EDGE) -> Column:
    """(values, violated) of a point or box: if any value passes 1, all are pixels and divided by the size that was
    delivered, the sent one with its longer edge capped."""
    shrink = F.least(F.lit(1.0), max_edge / F.greatest(width, height))
    beyond = F.coalesce(F.exists(values, lambda v: F.abs(v) > 1), F.lit(False))
    scaled = F.transform(values, lambda v, i: v / (F.when(i % 2 == 0, width).otherwise(height) * shrink))
    return F.struct(F.when(beyond, scaled).otherwise(values).alias("values"), beyond.alias("violated"))


def verdict(error: Column, point: Column, hit: Column) -> Column:
    return F.when(error.isNotNull(), "call_error").when(point.isNull(), "wrong_format").when(hit, "correct").otherwise("wrong")


def checked_box(x: Column) -> Column:
    """A JSON list of four numbers with its corners in order; null otherwise."""
    b = F.from_json(x, "array<double>")
    return F.when((F.size(b) == 4) & (b[0] < b[2]) & (b[1] < b[3]), b)


_EXPRESSION = r"^\s*(-?\d+(?:\.\d+)?)\s*([-+*/])\s*(-?\d+(?:\.\d+)?)\s*$"


def expression_value(x: Column) -> Column:
    """Value of a two-operand expression; null if it is none or divides by zero."""
    a, op, b = (F.regexp_extract(x, _EXPRESSION, k) for k in (1, 2, 3))
    a, b = a.try_cast("double"), b.try_cast("double")
    return F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "/", F.try_divide(a, b))


def trace_numbers(x: Column) -> Column:
    """Numbers that a trace mentions, without signs."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(x, F.lit("")), ",", ""), F.lit(r"\d+\.?\d*"), F.lit(0))
    return F.transform(found, lambda n: n.try_cast("double"))


def arithmetic_slip(right: Column, equivalent: Column, expression: Column, trace: Column) -> Column:
    """Why a computed answer is off: exact, format_only, unparsed_expr, or by whether the trace names both
    operands (to half a hundredth) wrong_operation, else wrong_operand."""
    e = F.trim(F.regexp_replace(F.coalesce(expression, F.lit("")), ",", ""))
    pattern = r"^([\d.]+)\s*[-+*/]\s*([\d.]+)$"
    a, b = (F.regexp_extract(e, pattern, k).try_cast("double") for k in (1, 2))
    seen = lambda v: F.exists(trace_numbers(trace), lambda n: F.abs(n - v) < 0.005)
    return (
        F.when(right, "exact").when(equivalent, "format_only").when(a.isNull() | b.isNull(), "unparsed_expr")
        .when(seen(a) & seen(b), "wrong_operation").otherwise("wrong_operand")
    )


def bucket(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-open buckets; the last label is what lies past the last edge."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges")
    out = F.lit(labels[-1])
    for edge, label in zip(reversed(edges), reversed(labels[:-1])):
        out = F.when(value < edge, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def by_group(value: Column, groups: dict[str, tuple], other: str) -> Column:
    """The name of the first group that holds the value, else other."""
    out = F.lit(other)
    for name, members in reversed(groups.items()):
        out = F.when(value.isin(*members), name).otherwise(out)
    return out


def cell_name(several: Column, computed: Column) -> Column:
    """Name of a cell of evidence by arithmetic."""
    return F.concat_ws("_", F.when(several, "multi").otherwise("single"), F.when(computed, "arith").otherwise("plain"))


def vision_status(exempt: Column, blind: Column, threshold: float = 0.5) -> Column:
    """Whether an item was answered without its image: exempt, untested, answerable, or confirmed to need it."""
    return F.when(exempt, "exempt").when(blind.isNull(), "untested").when(blind >= threshold, "answerable").otherwise("confirmed")


def corrected_score(score: Column, equivalent: Column) -> Column:
    """An answer that is equivalent to the gold counts as right."""
    return F.when(equivalent, F.lit(1.0)).otherwise(score)


def legible(size: Column, floor: int = 9) -> Column:
    """(size, raised): a type size raised to the floor, and whether it was."""
    return F.struct(F.greatest(size, F.lit(floor)).alias("size"), (size < floor).alias("raised"))
