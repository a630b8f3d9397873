"""Rules of answers, run control, arms and validation over tables that hold their cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import answers as an
from evalframe.functions import geometry as geo
from evalframe.functions import text as tx
from evalframe.operators import aggregates as ag
from evalframe.operators import generation as gen
from evalframe.operators import graph, joins, validation, windows
from evalframe.plans.base import query
from evalframe.sources import logs


def _golds():
    return F.array_compact(F.array("gold", "other"))


def _strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _bare(x):
    return f"regexp_replace(regexp_replace(lower({_strip(x)}), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"


def _items(x):
    t = _strip(x)
    cut = f"CASE WHEN contains({t}, ',') THEN string_split({t}, ',') WHEN contains({t}, ';') THEN string_split({t}, ';') WHEN contains({t}, chr(10)) THEN string_split({t}, chr(10)) ELSE [{t}] END"
    return f"list_filter(list_transform({cut}, lambda e: {_bare('e')}), lambda e: e <> '')"


def _digits(x):
    return f"regexp_extract_all(replace({x}, ',', ''), '-?\\d+(?:\\.\\d+)?')"


def _unitless(x):
    words = "million|billion|thousand|percent|pct|usd|dollars?|people|users?|countries|cases|years?|days?|m|bn|k"
    return _bare(f"regexp_replace(regexp_replace({x}, '[%$]', '', 'g'), '(?i)\\b({words})\\b', '', 'g')")


_EACH = "e AS (SELECT uid, 1 AS k, gold AS g, {p} AS p FROM pairs UNION ALL SELECT uid, 2 AS k, other AS g, {p} AS p FROM pairs WHERE other IS NOT NULL)"
_FOLD = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query("f11_failure_mode", f"""WITH {_EACH.format(p="coalesce(pred, '')")}, i AS (SELECT *, {_items('g')} AS gi, {_items('p')} AS pi FROM e),
m AS (SELECT uid, k, CASE WHEN (len(gi) < 2 AND len(pi) < 2) OR len(gi) = 0 THEN NULL WHEN list_sort(list_distinct(gi)) = list_sort(list_distinct(pi)) THEN CASE WHEN gi = pi THEN 'format_only' ELSE 'order_only' END
   WHEN list_has_all(pi, gi) THEN 'extra_items' WHEN list_has_all(gi, pi) THEN 'missing_items' WHEN list_has_any(gi, pi) THEN 'partial_overlap' END AS mode,
  {_bare('g')} = {_bare('p')} OR (len({_digits('g')}) > 0 AND {_digits('g')} = {_digits('p')}) OR ({_unitless('g')} <> '' AND {_unitless('g')} = {_unitless('p')}) AS surface FROM i)
SELECT uid, coalesce(arg_min(mode, k) FILTER (WHERE mode IS NOT NULL), CASE WHEN bool_or(surface) THEN 'format_only' ELSE 'unclassified' END) AS mode FROM m GROUP BY uid""")
def _(t):
    return t.pairs.select("uid", tx.failure_mode(F.col("pred"), _golds()).alias("mode"))


_SCALE = {"k": "1e3", "thousand": "1e3", "thousands": "1e3", "m": "1e6", "mn": "1e6", "million": "1e6", "millions": "1e6", "bn": "1e9", "billion": "1e9", "billions": "1e9", "tn": "1e12", "trillion": "1e12"}


def _report_number(x):
    t = f"regexp_replace(lower({_strip(x)}), '[,$€£%]', '', 'g')"
    cases = "".join(f" WHEN regexp_matches({t}, '(^|[^a-z]){w}\\b') THEN [regexp_replace({t}, '(^|[^a-z]){w}\\b', '\\1', 'g'), '{f}']" for w, f in sorted(_SCALE.items(), key=lambda c: -len(c[0])))
    held = f"(CASE{cases} ELSE [{t}, '1'] END)"
    return f"try_cast(nullif(regexp_extract({held}[1], '^\\s*(-?\\d+\\.?\\d*)\\s*[a-z]*\\s*$', 1), '') AS DOUBLE) * CAST({held}[2] AS DOUBLE)"


def _drill_number(x):
    t = f"regexp_replace(lower({_strip(x)}), '[,$€£% ]', '', 'g')"
    rule = "'^([+-]?\\d*\\.?\\d+)\\s*([a-z]*)$'"
    cases = "".join(f" WHEN '{w}' THEN {f}" for w, f in (_SCALE | {"b": "1e9", "": "1"}).items())
    return f"try_cast(nullif(regexp_extract({t}, {rule}, 1), '') AS DOUBLE) * CASE regexp_extract({t}, {rule}, 2){cases} END"


def _readings(x):
    t = f"regexp_replace(regexp_replace(replace({_strip(x)}, '−', '-'), '[$€£]', '', 'g'), '\\s+', ' ', 'g')"
    rule = "'^\\s*([+-]?)\\s*(\\d{1,3}(?:,\\d{3})+|\\d+(?:\\.\\d+)?|\\.\\d+)\\s*%?\\s*([a-zA-Z]*)\\s*$'"
    v = f"try_cast(nullif(replace(regexp_extract({t}, {rule}, 2), ',', ''), '') AS DOUBLE) * CASE WHEN regexp_extract({t}, {rule}, 1) = '-' THEN -1 ELSE 1 END"
    cases = "".join(f" WHEN '{w}' THEN {f}" for w, f in (_SCALE | {"b": "1e9"}).items())
    word = f"lower(regexp_extract({t}, {rule}, 3))"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {word} = '' THEN [{v}] WHEN CASE {word}{cases} END IS NOT NULL THEN [{v}, {v} * CASE {word}{cases} END] END"


def _folded(same):
    return f"CASE WHEN pn IS NOT NULL AND gn IS NOT NULL THEN {same} ELSE {_FOLD.format('p')} = {_FOLD.format('g')} AND {_FOLD.format('p')} <> '' END"


def _equivalence(number, same):
    return f"WITH {_EACH.format(p='pred')}, n AS (SELECT uid, g, p, {number('g')} AS gn, {number('p')} AS pn FROM e) SELECT uid, coalesce(bool_or({_folded(same)}), false) AS same FROM n GROUP BY uid"


@query("f30_format_equivalent", _equivalence(_report_number, "pn = gn"))
def _(t):
    return t.pairs.select("uid", tx.format_equivalent(F.col("pred"), _golds()).alias("same"))


@query("f31_cause_equivalent", _equivalence(_readings, "len(list_filter(gn, lambda a: len(list_filter(pn, lambda b: a = b OR (a <> 0 AND abs(a - b) <= 1e-9 * abs(a)))) > 0)) > 0"))
def _(t):
    return t.pairs.select("uid", tx.cause_equivalent(F.col("pred"), _golds()).alias("same"))


@query("f32_drill_equivalent", _equivalence(_drill_number, "abs(pn - gn) <= greatest(1e-9 * greatest(abs(pn), abs(gn)), 1e-12)"))
def _(t):
    return t.pairs.select("uid", tx.drill_equivalent(F.col("pred"), _golds()).alias("same"))


def _slide(x):
    units = "bn|billion|billions|million|millions|mn|thousand|k|usd|dollars?|euros?|eur|gbp|percent|pct|tonnes?|tons?|units?|people|users?|trillion|crores?|lakhs?|percentage\\s*points?|points?|pts?"
    t = f"regexp_replace(regexp_replace(lower({_strip(x)}), '[,$€£%]', '', 'g'), '\\b({units})\\b', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, '[^\\w\\s.+\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("f33_slide_equivalent", f"""WITH {_EACH.format(p='pred')}, c AS (SELECT uid, {_slide('p')} AS p, {_slide('g')} AS g FROM e),
n AS (SELECT *, CASE WHEN regexp_full_match(p, '[+\\-]?\\d*\\.?\\d+') THEN CAST(p AS DOUBLE) END AS pn, CASE WHEN regexp_full_match(g, '[+\\-]?\\d*\\.?\\d+') THEN CAST(g AS DOUBLE) END AS gn,
  CASE WHEN length(p) < length(g) THEN p ELSE g END AS short, CASE WHEN length(p) < length(g) THEN g ELSE p END AS long FROM c)
SELECT uid, coalesce(bool_or(CASE WHEN p = '' OR g = '' THEN false WHEN p = g THEN true WHEN pn IS NOT NULL AND gn IS NOT NULL THEN abs(pn - gn) <= 1e-9 * greatest(1, abs(gn))
  WHEN pn IS NOT NULL OR gn IS NOT NULL THEN false ELSE length(short) >= 4 AND regexp_matches(long, '(^|\\W)' || regexp_escape(short) || '(\\W|$)') END), false) AS same FROM n GROUP BY uid""")
def _(t):
    return t.pairs.select("uid", tx.slide_equivalent(F.col("pred"), _golds()).alias("same"))


_TRACE = "list_transform(regexp_extract_all(replace(coalesce(trace, ''), ',', ''), '\\d+\\.?\\d*'), lambda x: CAST(x AS DOUBLE))"
_EXPR = "'^([\\d.]+)\\s*[-+*/]\\s*([\\d.]+)$'"


@query("f35_arithmetic_slip", f"""WITH n AS (SELECT *, {_TRACE} AS seen, try_cast(nullif(regexp_extract(trim(replace(expression, ',', '')), {_EXPR}, 1), '') AS DOUBLE) AS a,
  try_cast(nullif(regexp_extract(trim(replace(expression, ',', '')), {_EXPR}, 2), '') AS DOUBLE) AS b FROM traces)
SELECT uid, CASE WHEN em THEN 'exact' WHEN equivalent THEN 'format_only' WHEN a IS NULL OR b IS NULL THEN 'unparsed_expr'
  WHEN len(list_filter(seen, lambda x: abs(x - a) < 0.005)) > 0 AND len(list_filter(seen, lambda x: abs(x - b) < 0.005)) > 0 THEN 'wrong_operation' ELSE 'wrong_operand' END AS slip FROM n""")
def _(t):
    return t.traces.select("uid", an.arithmetic_slip(F.col("em"), F.col("equivalent"), F.col("expression"), F.col("trace")).alias("slip"))


@query("f36_operand_search")
def _(t):
    pred = F.concat(F.lit("about "), (F.col("uid") % 400).cast("string"))
    pred = F.when(F.col("uid") % 3 == 0, F.concat((F.col("uid") % 60 * 17).cast("string"), F.lit("%"))).otherwise(pred)
    return t.traces.select("uid", "expression", "trace", pred.alias("pred"), gen.operand_search(F.col("expression"), pred, F.col("trace")).alias("how"))


_ORDINALS = "['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth','thirteenth','fourteenth','fifteenth','sixteenth','seventeenth','eighteenth','nineteenth','twentieth']"


@query("f20_cited_pages", f"""WITH w AS (SELECT uid, lower(coalesce(trace, '')) AS s FROM traces),
p AS (SELECT uid, list_concat(list_filter(list_transform(regexp_extract_all(s, '\\b(?:slide|page|image)\\s*#?\\s*(\\d{{1,2}})\\b', 1), lambda x: CAST(x AS INT)), lambda x: x BETWEEN 1 AND 20),
  list_transform(regexp_extract_all(s, '\\b([a-z]+)\\s+(?:slide|page|image)\\b', 1), lambda x: list_position({_ORDINALS}, x))) AS l FROM w)
SELECT uid, array_to_string(list_sort(list_distinct(list_filter(l, lambda x: x > 0))), ',') AS pages FROM p""")
def _(t):
    return t.traces.select("uid", F.array_join(F.transform(tx.cited_pages(F.col("trace")), lambda p: p.cast("string")), ",").alias("pages"))


@query("f17_to_unit", """WITH s AS (SELECT event_id, user_id % 2200 AS x, CASE WHEN event_id % 3 = 0 THEN 0.25 ELSE value END AS y, 800 + event_id % 2000 AS w, 700 AS h FROM events),
d AS (SELECT *, least(1, 1568 / greatest(w, h)) AS s, abs(x) > 1 OR abs(y) > 1 AS violated FROM s)
SELECT event_id, round(CASE WHEN violated THEN x / (w * s) ELSE x END, 9) AS x, round(CASE WHEN violated THEN y / (h * s) ELSE y END, 9) AS y, violated FROM d""")
def _(t):
    v = F.array((F.col("user_id") % 2200).cast("double"), F.when(F.col("event_id") % 3 == 0, 0.25).otherwise(F.col("value")))
    u = an.to_unit(v, 800 + F.col("event_id") % 2000, F.lit(700))
    return t.events.select("event_id", F.round(u["values"][0], 9).alias("x"), F.round(u["values"][1], 9).alias("y"), u["violated"].alias("violated"))


_NUM = r"\s*([-+]?\d*\.?\d+)\s*"
_FOUR, _TWO = (r"\[?\[" + ",".join([_NUM] * n) + r"\]\]?" for n in (4, 2))
_P = r"(\d+\.\d+|\d+)"


def _values():
    four = ", ".join(f"CAST(regexp_extract(response, '{_FOUR}', {k}) AS DOUBLE)" for k in range(1, 5))
    two = ", ".join(f"CAST(regexp_extract(response, '{_TWO}', {k}) AS DOUBLE)" for k in (1, 2))
    return f"CASE WHEN regexp_matches(response, '{_FOUR}') THEN [{four}] WHEN regexp_matches(response, '{_TWO}') THEN [{two}] END"


_CLICKS = f"""WITH r AS (SELECT *, {_values()} AS v, coalesce(regexp_matches(response, '\\[\\[{_P},{_P},{_P},{_P}\\]\\]') OR regexp_matches(response, '\\[\\[{_P},{_P}\\]\\]'), false) AS strict FROM clicks),
f AS (SELECT *, v IS NOT NULL AS parsed, coalesce(list_max(list_transform(v, lambda x: abs(x))) <= 1, false) AS followed, least(1, 1568 / greatest(w, h)) AS s FROM r),
u AS (SELECT *, CASE WHEN followed THEN v WHEN len(v) = 4 THEN [v[1] / (w * s), v[2] / (h * s), v[3] / (w * s), v[4] / (h * s)] ELSE [v[1] / (w * s), v[2] / (h * s)] END AS q FROM f),
j AS (SELECT *, coalesce(CASE WHEN len(q) = 4 THEN (q[1] + q[3]) / 2 BETWEEN x0 AND x1 AND (q[2] + q[4]) / 2 BETWEEN y0 AND y1 ELSE q[1] BETWEEN x0 AND x1 AND q[2] BETWEEN y0 AND y1 END, false) AS hit FROM u)
"""


@query("a23_funnel", _CLICKS + "SELECT count(*) AS n, count(*) FILTER (WHERE parsed) AS parsed, count(*) FILTER (WHERE strict) AS strict, count(*) FILTER (WHERE followed) AS followed, count(*) FILTER (WHERE hit) AS hit FROM j")
def _(t):
    return ag.funnel(ag.judged_clicks(t.clicks, "response", "box", "w", "h"))


@query("a24_independence", _CLICKS + "SELECT followed, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9) AS rate FROM j WHERE parsed GROUP BY followed")
def _(t):
    return ag.independence(ag.judged_clicks(t.clicks, "response", "box", "w", "h")).withColumn("rate", F.round("rate", 9))


_PROBE = "CASE WHEN uid % 5 = 0 THEN x1 + 9 ELSE (x0 + x1) / 2 END"


@query("a40_reverse_frame", f"SELECT rung, count(*) AS n, count(*) FILTER (WHERE {_PROBE} > eff_w OR (y0 + y1) / 2 > eff_h) AS outside, round(min(eff_w / w), 9) AS rescale, round(count(*) FILTER (WHERE {_PROBE} > eff_w OR (y0 + y1) / 2 > eff_h) / count(*), 9) AS frac FROM manifest WHERE qtype = 'reverse' GROUP BY rung")
def _(t):
    m = t.manifest.where("qtype = 'reverse'").withColumn("px", F.expr(_PROBE)).withColumn("py", F.expr("(y0 + y1) / 2"))
    a = ag.frame_audit(m, ["rung"], "px", "py", ("w", "h"), ("eff_w", "eff_h"))
    return a.withColumn("rescale", F.round("rescale", 9)).withColumn("frac", F.round("frac", 9))


@query("a42_addressing_distance", """WITH d AS (SELECT CAST(regexp_extract(question, '^For the subplot at row (\\d+) and column (\\d+)', 1) AS INT) - 1 + CAST(regexp_extract(question, '^For the subplot at row (\\d+) and column (\\d+)', 2) AS INT) - 1 AS steps, score
  FROM panels WHERE regexp_matches(question, '^For the subplot at row (\\d+) and column (\\d+)')) SELECT steps, count(*) AS n, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS acc FROM d GROUP BY steps HAVING count(*) >= 40""")
def _(t):
    hit = F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0)
    g = t.panels.withColumn("steps", an.panel_steps(F.col("question"))).where("steps IS NOT NULL").groupBy("steps").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 9).alias("acc"))
    return g.where("n >= 40")


def _int(x):
    return f"CAST(CAST(round({x}) AS BIGINT) AS VARCHAR)"


def _tuple(*xs):
    return "'(' || " + " || ',' || ".join(map(_int, xs)) + " || ')'"


_BOX = _tuple("x0", "y0", "x1", "y1")
_INK = ("x0 + 1 - spill", "y0", "x1", "y1")
_CENTRE = ("(x0 + x1) / 2 + off", "(y0 + y1) / 2")


@query("v01_manifest_checks", f"""SELECT uid, unnest(f).issue AS issue, unnest(f).detail AS detail FROM (SELECT uid, list_filter([
 CASE WHEN NOT (x0 >= 0 AND x0 < x1 AND x1 <= w AND y0 >= 0 AND y0 < y1 AND y1 <= h) THEN {{'issue': 'box outside image or inverted', 'detail': 'box ' || {_BOX} || ' image ' || {_tuple('w', 'h')}}} END,
 CASE WHEN qtype = 'point' AND NOT (x0 <= x0 + 1 - spill) THEN {{'issue': 'ink outside hit box', 'detail': 'ink ' || {_tuple(*_INK)} || ' hit ' || {_BOX}}} END,
 CASE WHEN qtype = 'point' AND NOT ({_CENTRE[0]} BETWEEN x0 AND x1) THEN {{'issue': 'centre outside box', 'detail': 'centre ' || {_tuple(*_CENTRE)}}} END,
 CASE WHEN contrast < CASE WHEN font_px >= 24 THEN 3.0 ELSE 4.5 END THEN {{'issue': 'contrast too low', 'detail': font_px || 'px'}} END,
 CASE WHEN font_px < 10 THEN {{'issue': 'type too small', 'detail': font_px || 'px'}} END,
 CASE WHEN occluded > 0.005 THEN {{'issue': 'text covered', 'detail': CAST(floor(occluded * 1000) AS BIGINT) || ' in 1000'}} END,
 CASE WHEN qtype = 'reverse' AND NOT ({_PROBE} BETWEEN x0 AND x1) THEN {{'issue': 'probe outside its text', 'detail': 'probe ' || {_tuple(_PROBE, '(y0 + y1) / 2')}}} END], lambda x: x IS NOT NULL) AS f FROM manifest)""")
def _(t):
    point = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    m = t.manifest.select(
        "uid", "qtype", F.struct("w", "h").alias("image"), "box", geo.box(*map(F.expr, _INK)).alias("ink"), point(*_CENTRE).alias("centre"),
        point(_PROBE, "(y0 + y1) / 2").alias("probe"), "font_px", "contrast", "occluded",
    )
    return validation.check_manifest(m)


_TOUCH = "a.scene = b.scene AND a.uid <> b.uid AND {0} < b.x1 AND b.x0 < {1} AND {2} < b.y1 AND b.y0 < {3}"


@query("v02_eligibility", f"""WITH twice AS (SELECT scene, text, count(*) AS c FROM marks GROUP BY 1, 2),
o AS (SELECT DISTINCT a.uid FROM marks a JOIN marks b ON {_TOUCH.format('a.x0', 'a.x1', 'a.y0', 'a.y1')}), p AS (SELECT DISTINCT a.uid FROM marks a JOIN marks b ON {_TOUCH.format('a.x0 - a.pad', 'a.x1 + a.pad', 'a.y0 - a.pad', 'a.y1 + a.pad')})
SELECT uid, CASE WHEN NOT eligible THEN 'ineligible' WHEN c > 1 THEN 'duplicate' WHEN x1 - x0 < 6 OR y1 - y0 < 5 THEN 'tiny' WHEN NOT in_bounds THEN 'out_of_bounds' WHEN font_px < 7 THEN 'font_too_small'
 WHEN occluded > 0.005 THEN 'occluded' WHEN contrast < 4.5 THEN 'low_contrast' WHEN uid IN (SELECT uid FROM o) THEN 'overlap' WHEN uid IN (SELECT uid FROM p) THEN 'hitbox_contains_other' END AS reason FROM marks JOIN twice USING (scene, text)""")
def _(t):
    box = geo.box(F.expr("x0 - pad"), F.expr("y0 - pad"), F.expr("x1 + pad"), F.expr("y1 + pad"))
    m = t.marks.withColumn("ink", F.struct("x0", "y0", "x1", "y1")).withColumn("box", box).withColumn("required", F.lit(4.5))
    return validation.eligibility(m).select("uid", "reason")


@query("v02_rejections", f"""WITH twice AS (SELECT scene, text, count(*) AS c FROM marks GROUP BY 1, 2)
SELECT scene, count(*) FILTER (WHERE NOT eligible) AS ineligible, count(*) FILTER (WHERE eligible AND c > 1) AS duplicate FROM marks JOIN twice USING (scene, text) GROUP BY scene""")
def _(t):
    box = geo.box(F.expr("x0 - pad"), F.expr("y0 - pad"), F.expr("x1 + pad"), F.expr("y1 + pad"))
    m = t.marks.withColumn("ink", F.struct("x0", "y0", "x1", "y1")).withColumn("box", box).withColumn("required", F.lit(4.5))
    r = F.col("reason")
    return validation.eligibility(m).groupBy("scene").agg(F.count_if(r == "ineligible").alias("ineligible"), F.count_if(r == "duplicate").alias("duplicate"))


@query("k07_fingerprint", "SELECT count(*) AS n_lines, CAST(0 AS BIGINT) AS changed, CAST(2 AS BIGINT) AS changed_later, true AS refused FROM log")
def _(t):
    path = logs.scratch(t.spark, "log")
    t.log.select(F.to_json(F.struct("seq", "uid", "pred")).alias("value")).write.text(path)
    was = logs.scratch(t.spark, "fingerprint")
    logs.fingerprint(t.spark, path).write.parquet(was)
    stored = t.spark.read.parquet(was)
    same = logs.changed(stored, logs.fingerprint(t.spark, path)).count()
    logs.require_unchanged(stored, logs.fingerprint(t.spark, path))
    t.spark.range(0, 2, 1, 2).select(F.lit("{}").alias("value")).write.mode("append").text(path)
    now = logs.fingerprint(t.spark, path)
    later, refused = logs.changed(stored, now).count(), False
    try:
        logs.require_unchanged(stored, now)
    except ValueError:
        refused = True
    n = stored.agg(F.sum("n_lines").alias("n_lines"))
    return n.withColumn("changed", F.lit(same).cast("long")).withColumn("changed_later", F.lit(later).cast("long")).withColumn("refused", F.lit(refused))


@query("p06_whitelist", "SELECT uid FROM examples WHERE CAST(substr(uid, 2) AS BIGINT) IN (SELECT DISTINCT item FROM (SELECT doc_id AS item FROM labels WHERE toxic = 1) JOIN documents ON doc_id = item)")
def _(t):
    wanted = t.labels.where("toxic = 1").join(t.documents.select("doc_id"), "doc_id").select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("uid"))
    return joins.whitelist(t.examples, wanted).select("uid")


@query("j07_paired_last_wins", """WITH l AS (SELECT user, condition, arg_max(pred = 'v1', seq) AS hit FROM (SELECT seq, uid AS user, tag AS condition, coalesce(pred, '') AS pred FROM log) GROUP BY 1, 2),
j AS (SELECT a.hit AS x, b.hit AS y FROM l a JOIN l b ON a.user = b.user AND a.condition = 'arm_a' AND b.condition = 'arm_b')
SELECT count(*) AS n, count(*) FILTER (WHERE x AND y) AS both, count(*) FILTER (WHERE x AND NOT y) AS only_a, count(*) FILTER (WHERE NOT x AND y) AS only_b, count(*) FILTER (WHERE NOT x AND NOT y) AS neither FROM j""")
def _(t):
    hit = F.coalesce(F.col("pred"), F.lit("")) == "v1"
    one = lambda tag: t.log.where(F.col("tag") == tag).select("uid", "seq", hit.alias("hit"))
    return ag.paired(one("arm_a"), one("arm_b"), ["uid"], order="seq").select("n", "both", "only_a", "only_b", "neither")


_WORDS = {"careful": "Look closely, the target is small. ", "coarse_to_fine": "Name the cell of a 4 by 4 grid first. "}


@query("q07_arms", f"""WITH b AS (SELECT uid, 'label ' || CAST(label AS VARCHAR) AS q, x0, y0, x1, y1, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM boxes),
c AS (SELECT *, least(greatest(cx - 0.25, 0), 0.5) AS u, least(greatest(cy - 0.25, 0), 0.5) AS v FROM b),
a AS (SELECT uid, 'repeat' AS arm, 'point' AS answer_type, q AS ask, x0 AS left_edge, NULL AS gold_text FROM c UNION ALL SELECT uid, 'bbox', 'bbox', 'Give its box: ' || q, x0, NULL FROM c
 UNION ALL SELECT uid, 'careful', 'point', '{_WORDS['careful']}' || q, x0, NULL FROM c UNION ALL SELECT uid, 'coarse_to_fine', 'point', '{_WORDS['coarse_to_fine']}' || q, x0, NULL FROM c
 UNION ALL SELECT uid, 'quadrant_mc', 'choice', 'Which quarter of the image contains ' || q || '?', NULL, CASE WHEN cy < 0.5 THEN CASE WHEN cx < 0.5 THEN 'A' ELSE 'B' END ELSE CASE WHEN cx < 0.5 THEN 'C' ELSE 'D' END END FROM c
 UNION ALL SELECT uid, 'crop', 'point', q, (x0 - u) / 0.5, NULL FROM c WHERE u <= x0 AND x1 <= u + 0.5 AND v <= y0 AND y1 <= v + 0.5)
SELECT uid, arm, answer_type, ask, round(left_edge, 9) AS left_edge, gold_text FROM a""")
def _(t):
    p = t.boxes.select("uid", "box", F.concat(F.lit("label "), F.col("label").cast("string")).alias("q"))
    a = gen.arms(p, "box", "q", _WORDS, "Give its box: ")
    return a.select("uid", "arm", "answer_type", "ask", F.round("gold_box.x0", 9).alias("left_edge"), "gold_text")


_STYLES = "SELECT l_orderkey AS gid, CAST(l_partkey % 6 AS VARCHAR) AS src, CAST(l_suppkey % 6 AS VARCHAR) AS dst, l_returnflag AS style, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey % 100000 AS seq FROM lineitem"


def _charts(t):
    """Charts of orders, with six nodes and an edge a line."""
    n = lambda c: (F.col(c) % 6).cast("string")
    edges = t.lineitem.select(F.col("l_orderkey").alias("gid"), n("l_partkey").alias("src"), n("l_suppkey").alias("dst"), F.col("l_returnflag").alias("style"), F.expr("CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey % 100000 AS seq"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: i.cast("string"))
    nodes = t.orders.select(F.col("o_orderkey").alias("gid"), F.explode(ids).alias("id")).withColumn("label", F.concat(F.lit("n"), "id"))
    return nodes, edges


@query("r03_first_style", f"""WITH e AS ({_STYLES}), u AS (SELECT gid, src, dst, style, seq FROM e UNION ALL SELECT gid, dst, src, style, seq FROM e), f AS (SELECT gid, src, dst, arg_min(style, seq) AS style FROM u GROUP BY 1, 2, 3)
SELECT o_orderkey AS gid, style FROM orders LEFT JOIN f ON gid = o_orderkey AND src = '1' AND dst = '4'""")
def _(t):
    nodes, edges = _charts(t)
    pairs = t.orders.select(F.col("o_orderkey").alias("gid"), F.lit("n1").alias("a"), F.lit("n4").alias("b"))
    return graph.edge_style(pairs, nodes, edges).select("gid", "style")


@query("r06_unconnected_pairs")
def _(t):
    return graph.unconnected_pair(*_charts(t), seed=7)


_PRICES = (("view", 1.0, 5.0), ("click", 3.0, 15.0), ("signup", 5.0, 25.0), ("error", 1.0, 5.0), ("purchase", 5.0, 25.0))
_PRICED = "calls LEFT JOIN (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in _PRICES) + ") AS v(m, i, o) ON m = model"


@query("x02_spend_by_model", f"SELECT model, count(*) AS calls, round(coalesce(sum(in_tokens / 1e6 * i + out_tokens / 1e6 * o), 0), 9) AS usd, coalesce(sum(in_tokens / 1e6 * i + out_tokens / 1e6 * o), 0) >= 0.5 AS exhausted FROM {_PRICED} GROUP BY model")
def _(t):
    prices = t.spark.createDataFrame(list(_PRICES), "model string, usd_in double, usd_out double")
    return windows.spend(t.calls, prices, ["model"], 0.5).withColumn("usd", F.round("usd", 9))


@query("x03_submission_window", """WITH s AS (SELECT seq, sum(cost) OVER w AS spent, row_number() OVER (ORDER BY seq) AS calls FROM calls WINDOW w AS (ORDER BY seq))
SELECT seq, round(spent, 6) AS spent, calls, 8 AS first_wave, greatest(1, least(32, CASE WHEN spent / calls > 0 THEN floor((20000 - spent) / (spent / calls)) ELSE 32 END))::INT AS window_size, spent >= 20000 AS exhausted FROM s""")
def _(t):
    w = windows.submission_window(t.calls, "cost", "seq", 20000.0, 32)
    return w.select("seq", F.round("spent", 6).alias("spent"), "calls", "first_wave", F.col("window").alias("window_size"), "exhausted")


_FATAL = " OR ".join(f"contains(lower(error), '{w}')" for w in windows.FATAL)


@query("x05_retryable", f"SELECT seq, a AS action, CASE WHEN a = 'retry' THEN pow(2, attempt) END AS wait FROM (SELECT *, CASE WHEN error IS NULL THEN 'done' WHEN {_FATAL} THEN 'abort' WHEN attempt >= 2 THEN 'give_up' ELSE 'retry' END AS a FROM calls)")
def _(t):
    return windows.retry_plan(t.calls, F.col("error"), F.col("attempt")).select("seq", "action", "wait")
