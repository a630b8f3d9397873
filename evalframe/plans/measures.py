"""Text, number and geometry measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import geometry as geo
from evalframe.functions import text as tx
from evalframe.operators import aggregates as ag
from evalframe.plans.base import query

def golds():
    return F.array("gold", "other")


@query("f01_levenshtein", "SELECT uid, CAST(levenshtein(coalesce(pred, ''), gold) AS INT) AS d FROM answers")
def _(t):
    return t.answers.select("uid", F.levenshtein(F.coalesce("pred", F.lit("")), "gold").alias("d"))


_NL = "levenshtein(lower(trim(coalesce(pred, ''))), lower(trim({g}))) / greatest(length(trim(coalesce(pred, ''))), length(trim({g})))"
_ONE = "CASE WHEN " + _NL + " < 0.5 THEN 1 - " + _NL + " ELSE 0.0 END"


@query("f02_anls", f"SELECT uid, round(greatest({_ONE.format(g='gold')}, {_ONE.format(g='other')}), 9) AS anls FROM answers")
def _(t):
    return t.answers.select("uid", F.round(tx.anls(F.col("pred"), golds()), 9).alias("anls"))


_NORM = r"regexp_replace(regexp_replace(lower(trim({x})), ',', '', 'g'), '\s+', ' ', 'g')"


@query("f03_normalize", f"SELECT uid, {_NORM.format(x='pred')} AS norm FROM answers")
def _(t):
    return t.answers.select("uid", tx.normalize(F.col("pred")).alias("norm"))


_FLOAT = "try_cast(trim(regexp_replace(" + _NORM + ", '[%$]', '', 'g')) AS DOUBLE)"


@query("f04_as_float", f"SELECT uid, {_FLOAT.format(x='num_pred')} AS p, {_FLOAT.format(x='num_gold')} AS g FROM answers")
def _(t):
    return t.answers.select("uid", tx.as_float(F.col("num_pred")).alias("p"), tx.as_float(F.col("num_gold")).alias("g"))


@query("f05_numeric_or_text", f"""WITH f AS (SELECT uid, num_pred, num_gold, {_FLOAT.format(x='num_pred')} AS p, {_FLOAT.format(x='num_gold')} AS g FROM answers)
SELECT uid, CASE WHEN p IS NOT NULL AND g IS NOT NULL THEN CASE WHEN abs(p - g) <= 1e-6 * greatest(1, abs(g)) THEN 1.0 ELSE 0.0 END
  WHEN {_NORM.format(x='num_pred')} = {_NORM.format(x='num_gold')} THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM f""")
def _(t):
    return t.answers.select("uid", tx.numeric_or_text(F.col("num_pred"), F.array("num_gold")).alias("score"))


@query("f06_boolean_match", "SELECT uid, CASE WHEN lower(trim(pred)) IN (lower(trim(gold)), lower(trim(other))) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM answers")
def _(t):
    return t.answers.select("uid", tx.boolean_match(F.col("pred"), golds()).alias("score"))


@query("f07_count_score", """SELECT uid, CASE WHEN n_pred = n_true THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, abs(n_pred - n_true) AS abs_error, n_pred - n_true AS signed_error FROM scored""")
def _(t):
    s = tx.count_score(F.col("n_pred").cast("string"), F.array(F.col("n_true").cast("string")))
    return t.scored.select("uid", s["exact"].alias("exact"), s["abs_error"].alias("abs_error"), s["signed_error"].alias("signed_error"))


_TOK = r"list_filter(string_split(regexp_replace(lower(replace(coalesce({x}, ''), ',', ' ')), '\s+', ' ', 'g'), ' '), lambda x: x <> '')"


@query("f08_token_f1", f"""WITH k AS (SELECT uid, {_TOK.format(x='pred')} AS p, {_TOK.format(x='gold')} AS g FROM answers)
SELECT uid, CASE WHEN p = g THEN 1.0 ELSE 0.0 END::DOUBLE AS em, round(coalesce(CASE WHEN len(p) + len(g) = 0 THEN 1.0 ELSE
  2.0 * coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) / (len(p) + len(g)) END, 0), 9) AS f1 FROM k""")
def _(t):
    s = tx.token_f1(F.col("pred"), F.array("gold"))
    return t.answers.select("uid", s["em"].alias("em"), F.round(s["f1"], 9).alias("f1"))


@query("f09_score_dispatch", f"""SELECT uid, round(CASE CAST(uid % 3 AS INT) WHEN 0 THEN {_ONE.format(g='gold')}
  WHEN 1 THEN CASE WHEN lower(trim(pred)) = lower(trim(gold)) THEN 1.0 ELSE 0.0 END
  ELSE CASE WHEN coalesce(lower(trim(pred)) = lower(trim(other)), false) THEN 1.0 ELSE 0.0 END END, 9)::DOUBLE AS score,
  CASE CAST(uid % 3 AS INT) WHEN 0 THEN 'anls' WHEN 1 THEN 'boolean' ELSE 'choice' END AS metric FROM answers""")
def _(t):
    kind = F.pmod("uid", F.lit(3))
    p = F.col("pred")
    score = F.when(kind == 0, tx.anls(p, F.array("gold"))).when(kind == 1, tx.boolean_match(p, F.array("gold"))).otherwise(tx.boolean_match(p, F.array("other")))
    metric = F.when(kind == 0, "anls").when(kind == 1, "boolean").otherwise("choice")
    return t.answers.select("uid", F.round(score, 9).alias("score"), metric.alias("metric"))


@query("f10_list_items", r"""SELECT uid, CAST(len(list_filter(list_transform(string_split(coalesce(pred, ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS INT) AS n_items,
  array_to_string(list_filter(list_transform(string_split(coalesce(pred, ''), ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS items FROM answers""")
def _(t):
    items = tx.list_items(F.col("pred"))
    return t.answers.select("uid", F.size(items).alias("n_items"), F.array_join(items, "|").alias("items"))



@query("f12_fold", "SELECT uid, regexp_replace(lower(pred), '[^a-z0-9]', '', 'g') AS folded FROM answers")
def _(t):
    return t.answers.select("uid", tx.fold(F.col("pred")).alias("folded"))


@query("f13_not_applicable", "SELECT user_id, count(*) FILTER (WHERE rtrim(lower(trim(CASE WHEN event_type = 'error' THEN ' N/A. ' ELSE event_type END)), '.') IN ('not applicable', 'n/a', 'na', 'none', 'not available')) AS n FROM events GROUP BY user_id")
def _(t):
    said = F.when(F.col("event_type") == "error", " N/A. ").otherwise(F.col("event_type"))
    return t.events.groupBy("user_id").agg(F.count_if(tx.says_not_applicable(said)).alias("n"))


@query("f14_cell_label", r"SELECT uid, nullif(regexp_extract(upper(other), '([A-D][1-4])', 1), '') AS anywhere, nullif(regexp_extract(upper(num_pred), '^\s*([A-D][1-4])', 1), '') AS at_start FROM answers")
def _(t):
    return t.answers.select("uid", tx.cell_label(F.col("other"), anchored=False).alias("anywhere"), tx.cell_label(F.col("num_pred")).alias("at_start"))


@query("f15_coordinates", r"""SELECT event_id, try_cast(regexp_extract(t, '\((\d+\.\d+), (\d+)\)', 1) AS DOUBLE) AS x, try_cast(regexp_extract(t, '\((\d+\.\d+), (\d+)\)', 2) AS DOUBLE) AS y
FROM (SELECT event_id, 'click at (' || CAST(round(value, 1) AS STRING) || ', ' || CAST(user_id AS STRING) || ') now' AS t FROM events)""")
def _(t):
    text = F.concat(F.lit("click at ("), F.round("value", 1).cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit(") now"))
    c = tx.coordinates(text, 2)
    return t.events.select("event_id", c[0].alias("x"), c[1].alias("y"))


@query("f21_numbers_in", r"SELECT event_id, array_to_string(list_transform(regexp_extract_all(props, '-?\d+(?:\.\d+)?'), lambda x: CAST(CAST(x AS DOUBLE) AS INT)), ',') AS numbers FROM events")
def _(t):
    n = F.transform(tx.numbers_in(F.col("props")), lambda v: v.cast("int").cast("string"))
    return t.events.select("event_id", F.array_join(n, ",").alias("numbers"))


@query("f22_answer_surface", r"""SELECT uid, CASE WHEN contains(num_pred, '%') THEN 'percent' WHEN regexp_matches(num_pred, '[$€£¥]') THEN 'currency'
  WHEN regexp_matches(num_pred, '\d,\d{3}') THEN 'comma' WHEN regexp_matches(num_pred, '\d\s*[A-Za-z]') THEN 'unit' ELSE 'other' END AS kind FROM answers""")
def _(t):
    return t.answers.select("uid", tx.answer_surface(F.col("num_pred")).alias("kind"))


@query("f40_size_bucket", "SELECT uid, CASE WHEN s < 200 THEN '<200px' WHEN s < 400 THEN '200-399px' WHEN s < 600 THEN '400-599px' ELSE '>=600px' END AS bucket FROM (SELECT uid, sqrt((x1 - x0) * (y1 - y0) * 1568 * 882) AS s FROM boxes)")
def _(t):
    s = F.sqrt(F.expr("(x1 - x0) * (y1 - y0) * 1568 * 882"))
    return t.boxes.select("uid", F.when(s < 200, "<200px").when(s < 400, "200-399px").when(s < 600, "400-599px").otherwise(">=600px").alias("bucket"))


@query("f42_count_bin", "SELECT n_true, CASE WHEN n_true BETWEEN 1 AND 4 THEN '1-4' WHEN n_true BETWEEN 5 AND 6 THEN '5-6' WHEN n_true BETWEEN 7 AND 9 THEN '7-9' WHEN n_true BETWEEN 10 AND 15 THEN '10-15' WHEN n_true >= 16 THEN '16+' ELSE '?' END AS bin, count(*) AS n FROM scored GROUP BY n_true")
def _(t):
    n = F.col("n_true")
    label = F.when(n.between(1, 4), "1-4").when(n.between(5, 6), "5-6").when(n.between(7, 9), "7-9").when(n.between(10, 15), "10-15").when(n >= 16, "16+").otherwise("?")
    return t.scored.groupBy("n_true", label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _point_and_box():
    return F.col("x"), F.col("y"), F.col("box")


@query("g01_normalized_box", """SELECT uid, round(least(greatest((x0 * 900 - 200) / 500, 0.0), 1.0), 9) AS nx0, (x0 * 900 - 200) / 500 NOT BETWEEN 0 AND 1 OR (y0 * 900) / 500 NOT BETWEEN 0 AND 1
  OR (x1 * 900 - 200) / 500 NOT BETWEEN 0 AND 1 OR (y1 * 900) / 500 NOT BETWEEN 0 AND 1 AS clamped FROM boxes""")
def _(t):
    px = geo.box(F.expr("x0 * 900 - 200"), F.expr("y0 * 900"), F.expr("x1 * 900 - 200"), F.expr("y1 * 900"))
    n = geo.normalized_box(px, F.lit(500), F.lit(500))
    return t.boxes.select("uid", F.round(n["box"]["x0"], 9).alias("nx0"), n["clamped"].alias("clamped"))


_D = "sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2))"


@query("g02_point_in_box", "SELECT uid, x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AS inside FROM boxes")
def _(t):
    x, y, b = _point_and_box()
    return t.boxes.select("uid", geo.in_box(x, y, b).alias("inside"))


@query("g03_distances", f"SELECT uid, round(sqrt(pow(x - (x0 + x1) / 2, 2) + pow(y - (y0 + y1) / 2, 2)), 9) AS d_centre, round({_D}, 9) AS d_box FROM boxes")
def _(t):
    x, y, b = _point_and_box()
    return t.boxes.select("uid", F.round(geo.to_centre(x, y, b), 9).alias("d_centre"), F.round(geo.to_box(x, y, b), 9).alias("d_box"))


@query("g04_miss_band", f"SELECT uid, CASE WHEN {_D} < 0.1 THEN 'near' WHEN {_D} <= 0.25 THEN 'moderate' ELSE 'wrong_region' END AS band FROM boxes")
def _(t):
    x, y, b = _point_and_box()
    return t.boxes.select("uid", geo.miss_band(geo.to_box(x, y, b)).alias("band"))


@query("g05_miss_mode", "SELECT uid, CASE WHEN m <= 0.1 THEN 'near_miss' WHEN m > 0.25 THEN 'wrong_region' ELSE 'moderate_miss' END AS mode FROM (SELECT uid, greatest(abs(x - (x0 + x1) / 2), abs(y - (y0 + y1) / 2)) AS m FROM boxes)")
def _(t):
    x, y, _ = _point_and_box()
    return t.boxes.select("uid", geo.miss_mode(x, y, F.expr("(x0 + x1) / 2"), F.expr("(y0 + y1) / 2")).alias("mode"))


@query("g06_grid_cells", "SELECT uid, least(CAST(trunc(x * 4) AS INT), 3) AS cx, least(CAST(trunc(y * 4) AS INT), 3) AS cy, least(CAST(trunc(x * 4) AS INT), 3) BETWEEN least(CAST(trunc(x0 * 4) AS INT), 3) AND least(CAST(trunc(x1 * 4) AS INT), 3) AND least(CAST(trunc(y * 4) AS INT), 3) BETWEEN least(CAST(trunc(y0 * 4) AS INT), 3) AND least(CAST(trunc(y1 * 4) AS INT), 3) AS touched FROM boxes")
def _(t):
    x, y, b = _point_and_box()
    return t.boxes.select("uid", geo.cell(x, 4).alias("cx"), geo.cell(y, 4).alias("cy"), geo.touches_cell(x, y, b, 4).alias("touched"))


@query("g07_cell_name", "SELECT uid, substr('ABCD', least(CAST(trunc(x * 4) AS INT), 3) + 1, 1) || CAST(least(CAST(trunc(y * 4) AS INT), 3) + 1 AS STRING) AS name FROM boxes")
def _(t):
    x, y, _ = _point_and_box()
    return t.boxes.select("uid", geo.cell_name(x, y).alias("name"))


@query("g08_quadrant", "SELECT uid, CASE WHEN y < 0.5 THEN CASE WHEN x < 0.5 THEN 'A' ELSE 'B' END ELSE CASE WHEN x < 0.5 THEN 'C' ELSE 'D' END END AS quadrant FROM boxes")
def _(t):
    x, y, _ = _point_and_box()
    return t.boxes.select("uid", geo.quadrant(x, y).alias("quadrant"))


@query("g09_crop_remap", "SELECT uid, round((x0 - 0.2) / 0.5, 9) AS cx0, round((y1 - 0.3) / 0.4, 9) AS cy1 FROM boxes WHERE x0 >= 0.2 AND y0 >= 0.3 AND x1 <= 0.7 AND y1 <= 0.7")
def _(t):
    _, _, b = _point_and_box()
    w = geo.box(F.lit(0.2), F.lit(0.3), F.lit(0.7), F.lit(0.7))
    c = t.boxes.withColumn("c", geo.crop_remap(b, w)).where("c IS NOT NULL")
    return c.select("uid", F.round("c.x0", 9).alias("cx0"), F.round("c.y1", 9).alias("cy1"))


@query("g10_tiles", "SELECT size, tx * 300 AS left_px, ty * 300 AS top_px FROM (SELECT DISTINCT CAST(size AS BIGINT) AS size FROM answers), range(4) AS a(tx), range(4) AS b(ty) WHERE tx * 300 < size * 30 AND ty * 300 < size * 20")
def _(t):
    s = t.answers.select(F.col("size").cast("long").alias("size")).distinct()
    s = s.withColumn("tx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("ty", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return s.select("size", (F.col("tx") * 300).alias("left_px"), (F.col("ty") * 300).alias("top_px")).where("left_px < size * 30 and top_px < size * 20")


@query("g11_iou", """SELECT a.uid, b.uid AS other, round(i / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - i), 9) AS iou
FROM boxes a JOIN boxes b ON a.scene = b.scene AND a.uid < b.uid, LATERAL (SELECT greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i) WHERE i > 0""")
def _(t):
    boxes = t.boxes
    o = boxes.select("scene", F.col("uid").alias("other"), F.col("box").alias("b2"))
    both = boxes.join(o, "scene").where("uid < other")
    return both.select("uid", "other", F.round(geo.iou(F.col("box"), F.col("b2")), 9).alias("iou")).where("iou > 0")


@query("g13_delivered", "SELECT o_orderkey AS uid, CAST(round_even(w * s, 0) AS INT) AS dw, CAST(round_even(h * s, 0) AS INT) AS dh FROM (SELECT o_orderkey, w, h, least(1.0::DOUBLE, 1568.0::DOUBLE / greatest(w, h), sqrt(1150000.0::DOUBLE / (w * h))) AS s FROM (SELECT o_orderkey, 500 + o_orderkey % 3000 AS w, 400 + o_custkey % 2500 AS h FROM orders))")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("uid"), (500 + F.col("o_orderkey") % 3000).alias("w"), (400 + F.col("o_custkey") % 2500).alias("h"))
    d = geo.delivered(F.col("w"), F.col("h"))
    return o.select("uid", d["w"].alias("dw"), d["h"].alias("dh"))


@query("g17_contrast", """WITH c AS (SELECT doc_id, [lpad(to_hex(doc_id * 7 % 256), 2, '0'), lpad(to_hex(doc_id * 13 % 256), 2, '0'), lpad(to_hex(doc_id * 29 % 256), 2, '0')] AS h, [doc_id * 7 % 256, doc_id * 13 % 256, doc_id * 29 % 256] AS v FROM documents),
l AS (SELECT doc_id, list_transform(v, lambda x: CASE WHEN x / 255 <= 0.03928 THEN x / 255 / 12.92 ELSE pow((x / 255 + 0.055) / 1.055, 2.4) END) AS s FROM c)
SELECT doc_id, round(1.05 / (0.2126 * s[1] + 0.7152 * s[2] + 0.0722 * s[3] + 0.05), 6) AS ratio FROM l""")
def _(t):
    hx = lambda k: F.lpad(F.hex(F.col("doc_id") * k % 256), 2, "0")
    c = F.concat(F.lit("#"), hx(7), hx(13), hx(29))
    return t.documents.select("doc_id", F.round(geo.contrast(c, F.lit("#ffffff")), 6).alias("ratio"))


@query("a17_precision_curve", """WITH g AS (SELECT unnest([2, 3, 4, 8, 16]) AS grid), c AS (SELECT grid,
  least(CAST(trunc(x * grid) AS INT), grid - 1) AS cx, least(CAST(trunc(y * grid) AS INT), grid - 1) AS cy,
  least(CAST(trunc((x0 + x1) / 2 * grid) AS INT), grid - 1) AS bx, least(CAST(trunc((y0 + y1) / 2 * grid) AS INT), grid - 1) AS by_,
  least(CAST(trunc(x0 * grid) AS INT), grid - 1) AS a0, least(CAST(trunc(y0 * grid) AS INT), grid - 1) AS b0,
  least(CAST(trunc(x1 * grid) AS INT), grid - 1) AS a1, least(CAST(trunc(y1 * grid) AS INT), grid - 1) AS b1 FROM boxes, g)
SELECT grid, count(*) AS n, count(*) FILTER (WHERE cx = bx AND cy = by_) AS k, count(*) FILTER (WHERE cx BETWEEN a0 AND a1 AND cy BETWEEN b0 AND b1) AS k_lenient FROM c GROUP BY grid
UNION ALL SELECT 0, count(*), count(*) FILTER (WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), count(*) FILTER (WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) FROM boxes""")
def _(t):
    return ag.precision_curve(t.boxes, "x", "y", "box").select("grid", "n", "k", "k_lenient")


@query("a16_miss_summary", f"""WITH m AS (SELECT rung, {_D} AS d FROM boxes WHERE NOT (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)),
s AS (SELECT rung, count(*) AS n, median(d) AS md, list(d ORDER BY d) AS l, count(*) FILTER (WHERE d < 0.1) AS near, count(*) FILTER (WHERE d >= 0.1 AND d <= 0.25) AS moderate, count(*) FILTER (WHERE d > 0.25) AS wrong_region FROM m GROUP BY rung),
j AS (SELECT *, least(greatest(90 * (n + 1) // 100, 1), n - 1) AS j FROM s)
SELECT rung, n AS n_miss, round(md, 9) AS median_d, near, moderate, wrong_region, round((l[j] * (100 - (90 * (n + 1) - j * 100)) + l[j + 1] * (90 * (n + 1) - j * 100)) / 100, 9) AS p90_d FROM j""")
def _(t):
    m = ag.miss_summary(t.boxes, ["rung"], "x", "y", "box")
    return m.select("rung", "n_miss", F.round("median_d", 9).alias("median_d"), "near", "moderate", "wrong_region", F.round("p90_d", 9).alias("p90_d"))
