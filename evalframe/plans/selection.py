"""Dedup, joins, windows, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import answers as an
from evalframe.functions import text as tx
from evalframe.operators import dedup, joins, windows
from evalframe.plans.base import query
from evalframe.sources import logs

def usable():
    return F.col("pred").isNotNull() & ~F.col("failed")


_PICK = "SELECT uid, seq, pred FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY {}) AS r FROM log{}) WHERE r = 1{}"


@query("d01_latest_usable", _PICK.format("(pred IS NOT NULL AND NOT failed) DESC, seq DESC", "", ""))
def _(t):
    return dedup.latest_usable(t.log, ["uid"], usable()).select("uid", "seq", "pred")


@query("d02_latest_usable_first_null", _PICK.format("(pred IS NOT NULL AND NOT failed) DESC, CASE WHEN pred IS NOT NULL AND NOT failed THEN -seq ELSE seq END", "", ""))
def _(t):
    return dedup.latest_usable_first_null(t.log, ["uid"], usable()).select("uid", "seq", "pred")


@query("d03_last_then_usable", _PICK.format("seq DESC", "", " AND pred IS NOT NULL AND NOT failed"))
def _(t):
    return dedup.last_then_usable(t.log, ["uid"], usable()).select("uid", "seq", "pred")


@query("d04_usable_then_last", _PICK.format("seq DESC", " WHERE pred IS NOT NULL AND NOT failed", ""))
def _(t):
    return dedup.usable_then_last(t.log, ["uid"], usable()).select("uid", "seq", "pred")


@query("d05_last", _PICK.format("seq DESC", "", ""))
def _(t):
    return dedup.last(t.log, ["uid"]).select("uid", "seq", "pred")


@query("d06_arm_conflicts", "SELECT uid, count(DISTINCT tag) AS n_arms FROM log WHERE pred IS NOT NULL AND NOT failed GROUP BY uid HAVING count(DISTINCT tag) > 1")
def _(t):
    return dedup.conflicts(t.log, "uid", usable(), "tag")


@query("d07_duplicate_stats", 'SELECT tag, count(*) AS lines, count(DISTINCT uid) AS "unique", count(*) - count(DISTINCT uid) AS duplicate_lines FROM log GROUP BY tag')
def _(t):
    return dedup.duplicate_stats(t.log, "uid", ["tag"])


@query("d08_repeat_disagreement", "SELECT uid, count(*) AS n_rows, count(DISTINCT pred) AS n_values FROM log GROUP BY uid HAVING count(*) > 1 AND count(DISTINCT pred) > 1")
def _(t):
    return dedup.disagreeing(t.log, "uid", "pred")


@query("d09_ordered_distinct", "SELECT uid, min(seq) AS seq FROM log GROUP BY uid")
def _(t):
    return dedup.first(t.log, ["uid"]).select("uid", "seq")


@query("d10_one_per_group_then_fill", """SELECT uid, category FROM (
  SELECT uid, category, size, row_number() OVER (PARTITION BY category ORDER BY size, uid) AS r FROM examples) ORDER BY r > 1, category, size, uid LIMIT 60""")
def _(t):
    ex = t.examples.withColumn("o", F.struct("size", "uid"))
    return windows.capped_then_filled(ex, "category", 1, 60, "o").select("uid", "category")


@query("j01_results_with_examples", "SELECT l.uid, l.seq, e.dataset, l.pred = e.gold AS correct FROM log l JOIN examples e USING (uid)")
def _(t):
    return t.log.join(t.examples, "uid").select("uid", "seq", "dataset", (F.col("pred") == F.col("gold")).alias("correct"))


@query("j01_orphans", "SELECT uid, seq FROM log WHERE uid NOT IN (SELECT uid FROM examples WHERE size > 2000)")
def _(t):
    return joins.orphans(t.log, t.examples.where("size > 2000")).select("uid", "seq")


@query("j02_judge_override", """SELECT uid, score AS string_score, coalesce(judge_score, score) AS score FROM scored LEFT JOIN judged USING (uid)""")
def _(t):
    return joins.override(t.scored, t.judged, "uid", "score", "judge_score").select("uid", "string_score", "score")


@query("j03_equivalence_patch", """SELECT uid, CASE WHEN equivalent AND failure_mode = 'unclassified' THEN 'format_only' ELSE failure_mode END AS failure_mode
FROM scored LEFT JOIN judged USING (uid)""")
def _(t):
    j = t.scored.join(t.judged.select("uid", "equivalent"), "uid", "left")
    patched = F.when(F.col("equivalent") & (F.col("failure_mode") == "unclassified"), "format_only").otherwise(F.col("failure_mode"))
    return j.select("uid", patched.alias("failure_mode"))


@query("j04_todo", "SELECT uid, dataset FROM examples WHERE uid NOT IN (SELECT uid FROM log WHERE pred IS NOT NULL AND NOT failed)")
def _(t):
    return joins.todo(t.examples, t.log, usable()).select("uid", "dataset")


@query("j05_missing_by_dataset", """SELECT dataset, count(*) AS selected, count(*) FILTER (WHERE NOT done) AS missing FROM (
  SELECT dataset, uid IN (SELECT uid FROM log WHERE pred IS NOT NULL AND NOT failed) AS done FROM examples) GROUP BY dataset""")
def _(t):
    missing = joins.todo(t.examples, t.log, usable()).groupBy("dataset").agg(F.count(F.lit(1)).alias("missing"))
    return t.examples.groupBy("dataset").agg(F.count(F.lit(1)).alias("selected")).join(missing, "dataset", "left").fillna(0, ["missing"])


@query("j06_control_pairs", "SELECT s.uid, s.score AS sighted, c.score AS blind FROM scored s JOIN control c ON c.src_uid = s.uid")
def _(t):
    return joins.control_pairs(t.scored, t.control)


@query("j09_complete_triples", "SELECT graph_id, target FROM rungs GROUP BY graph_id, target HAVING count(DISTINCT rung) = 3")
def _(t):
    return joins.complete_keys(t.rungs, ["graph_id", "target"], "rung", 3)


@query("j10_attribute_join", "SELECT uid, e.size, e.category, CAST(length(l.pred) AS INT) AS pred_len FROM log l JOIN examples e USING (uid) WHERE e.size > 1000")
def _(t):
    j = t.log.join(t.examples.where("size > 1000"), "uid")
    return j.select("uid", "size", "category", F.length("pred").alias("pred_len"))


_HIT = "x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"


@query("j11_misses_on_other_box", f"""SELECT uid FROM (SELECT *, {_HIT} AS hit FROM boxes) p WHERE NOT hit AND EXISTS (
  SELECT 1 FROM boxes o WHERE o.scene = p.scene AND o.uid <> p.uid AND p.x BETWEEN o.x0 AND o.x1 AND p.y BETWEEN o.y0 AND o.y1)""")
def _(t):
    p = t.boxes.withColumn("hit", F.expr(_HIT))
    return joins.misses_on_other_box(p, t.boxes, "scene", "uid").select("uid")


@query("j12_without_overlap", """SELECT uid FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE a.scene = b.scene AND a.uid <> b.uid
  AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)""")
def _(t):
    return joins.without_overlap(t.boxes, "scene", "uid").select("uid")


@query("j13_nearest_right", """SELECT uid, neighbour, round(distance, 9) AS distance FROM (
  SELECT a.uid, b.uid AS neighbour, (b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2 AS distance,
         row_number() OVER (PARTITION BY a.uid ORDER BY (b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2, b.uid) AS r
  FROM boxes a JOIN boxes b ON a.scene = b.scene AND a.uid <> b.uid
  WHERE (b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2 > 0 AND abs((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2) <= 0.05) WHERE r = 1""")
def _(t):
    n = joins.nearest_right(t.boxes, "scene", "uid", 0.05)
    return n.select("uid", "neighbour", F.round("distance", 9).alias("distance"))


@query("j14_smallest_enclosing", """SELECT uid, "outer" FROM (
  SELECT a.uid, b.uid AS "outer", row_number() OVER (PARTITION BY a.uid ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), b.uid) AS r
  FROM boxes a JOIN boxes b ON a.scene = b.scene AND a.uid <> b.uid AND b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1
  WHERE (b.x1 - b.x0) * (b.y1 - b.y0) <= 0.06) WHERE r = 1""")
def _(t):
    return joins.smallest_enclosing(t.boxes, "scene", "uid", 0.06).select("uid", "outer")


@query("j16_join_check", """SELECT count(*) FILTER (WHERE l.d IS NOT NULL AND l.d IS NOT DISTINCT FROM e.dataset) AS ok,
  count(*) FILTER (WHERE l.d IS NOT NULL AND l.d IS DISTINCT FROM e.dataset) AS bad, count(*) FILTER (WHERE l.d IS NULL) AS unmatched
FROM examples e LEFT JOIN (SELECT uid, CASE WHEN size % 3 = 0 THEN 'xx' ELSE dataset END AS d FROM examples WHERE size % 2 = 0) l USING (uid)""")
def _(t):
    other = t.examples.where("size % 2 = 0").withColumn("dataset", F.expr("CASE WHEN size % 3 = 0 THEN 'xx' ELSE dataset END"))
    return joins.join_check(t.examples, other, "uid", ["dataset"])


@query("j17_judge_agreement", """SELECT dataset, count(*) AS n, count(*) FILTER (WHERE (score >= 0.5) = (judge_score >= 0.5)) AS agree,
  round(avg(CASE WHEN (score >= 0.5) = (judge_score >= 0.5) THEN 1.0 ELSE 0.0 END), 9) AS agreement
FROM scored JOIN judged USING (uid) WHERE score IS NOT NULL GROUP BY dataset""")
def _(t):
    j = t.scored.where("score IS NOT NULL").join(t.judged, "uid")
    same = (F.col("score") >= 0.5) == (F.col("judge_score") >= 0.5)
    return j.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("agree"), F.round(F.avg(F.when(same, 1.0).otherwise(0.0)), 9).alias("agreement")
    )


@query("j19_contested_excluded", "SELECT uid, score FROM scored WHERE uid NOT IN (SELECT uid FROM judged WHERE gt_quality = 'wrong' UNION SELECT uid FROM judged WHERE verdict = 'prediction_correct')")
def _(t):
    contested = t.judged.where("gt_quality = 'wrong'").select("uid").union(t.judged.where("verdict = 'prediction_correct'").select("uid"))
    return t.scored.join(contested.distinct(), "uid", "left_anti").select("uid", "score")


@query("w01_equal_count_bins", """SELECT uid, bin FROM (SELECT uid, CAST(floor((row_number() OVER (ORDER BY size, uid) * 5 - 1) / count(*) OVER ()) AS INT) AS bin
  FROM scored WHERE size IS NOT NULL)""")
def _(t):
    return windows.equal_count_bins(t.scored, "size", 5, "uid").select("uid", "bin")


@query("w02_bins_within_group", """SELECT uid, dataset, CAST(floor((row_number() OVER (PARTITION BY dataset ORDER BY size, uid) * 5 - 1) / count(*) OVER (PARTITION BY dataset)) AS INT) AS bin
  FROM scored WHERE size IS NOT NULL""")
def _(t):
    return windows.equal_count_bins(t.scored, "size", 5, "uid", ["dataset"]).select("uid", "dataset", "bin")


_BINS = """b AS (SELECT bin, min(size) AS lo, max(size) AS hi, count(score) AS n, avg(score) AS acc FROM (
  SELECT *, CAST(floor((row_number() OVER (ORDER BY size, uid) * 5 - 1) / count(*) OVER ()) AS INT) AS bin FROM scored WHERE size IS NOT NULL) GROUP BY bin)"""


@query("w03_bin_summary", f"WITH {_BINS} SELECT bin, lo, hi, n, round(acc, 9) AS acc FROM b")
def _(t):
    b = windows.bin_summary(windows.equal_count_bins(t.scored, "size", 5, "uid"), "size", "score")
    return b.withColumn("acc", F.round("acc", 9))


@query("w03_bin_trend", f"""WITH {_BINS}, d AS (SELECT *, acc - lag(acc) OVER (ORDER BY bin) AS d FROM b)
SELECT min(n) AS min_n, bool_and(d <= 0) OR bool_and(d >= 0) AS monotone, round(min_by(acc, bin) - max_by(acc, bin), 9) AS first_less_last,
  round(max(acc) - min(acc), 9) AS spread FROM d""")
def _(t):
    b = windows.bin_summary(windows.equal_count_bins(t.scored, "size", 5, "uid"), "size", "score")
    out = windows.bin_trend(b, 30)
    return out.withColumn("first_less_last", F.round("first_less_last", 9)).withColumn("spread", F.round("spread", 9))


@query("w04_tertiles", """WITH r AS (SELECT size AS cut, row_number() OVER (ORDER BY size, uid) - 1 AS r, count(*) OVER () AS n FROM scored WHERE size IS NOT NULL)
SELECT CAST(part AS INT) AS part, cut FROM r, range(1, 3) AS g(part) WHERE r = n * part // 3""")
def _(t):
    return windows.order_statistics(t.scored, "size", 3)


@query("w05_stratified_sample", """SELECT dataset, primitive, uid, pool FROM (SELECT *, count(*) OVER (PARTITION BY dataset, primitive) AS pool,
  row_number() OVER (PARTITION BY dataset, primitive ORDER BY sha1('17:' || uid::VARCHAR), uid) AS r FROM scored) WHERE r <= 25""")
def _(t):
    return windows.stratified_sample(t.scored, ["dataset", "primitive"], 25, "uid", 17).select("dataset", "primitive", "uid", "pool")


@query("w06_seeded_sample", "SELECT uid FROM scored ORDER BY sha1('3:' || uid::VARCHAR), uid LIMIT 100")
def _(t):
    return windows.seeded_sample(t.scored, 100, "uid", 3).select("uid")


@query("w07_rung_by_tertile_sample", """WITH b AS (SELECT uid, rung, CAST(floor((row_number() OVER (PARTITION BY rung ORDER BY (x1 - x0) * (y1 - y0), uid) * 3 - 1) / count(*) OVER (PARTITION BY rung)) AS INT) AS bin FROM boxes)
SELECT rung, bin, uid FROM (SELECT *, row_number() OVER (PARTITION BY rung, bin ORDER BY sha1('5:' || uid::VARCHAR), uid) AS r FROM b) WHERE r <= 10""")
def _(t):
    b = t.boxes.withColumn("area", F.expr("(x1 - x0) * (y1 - y0)"))
    b = windows.equal_count_bins(b, "area", 3, "uid", ["rung"])
    return windows.stratified_sample(b, ["rung", "bin"], 10, "uid", 5).select("rung", "bin", "uid")


@query("w08_audit_sample_per_mode", """SELECT failure_mode, uid FROM (SELECT *, row_number() OVER (PARTITION BY failure_mode ORDER BY sha1('9:' || uid::VARCHAR), uid) AS r
  FROM scored WHERE failure_mode IS NOT NULL) WHERE r <= 20""")
def _(t):
    return windows.stratified_sample(t.scored.where("failure_mode IS NOT NULL"), ["failure_mode"], 20, "uid", 9).select("failure_mode", "uid")


@query("w10_worst_first", "SELECT uid, score FROM scored WHERE score IS NOT NULL ORDER BY score, uid LIMIT 50")
def _(t):
    return t.scored.where("score IS NOT NULL").orderBy("score", "uid").limit(50).select("uid", "score")


@query("w12_capped_then_filled", """SELECT uid, dataset FROM (SELECT uid, dataset, row_number() OVER (PARTITION BY dataset ORDER BY uid) AS r FROM scored)
ORDER BY r > 3, dataset, uid LIMIT 40""")
def _(t):
    return windows.capped_then_filled(t.scored, "dataset", 3, 40, "uid").select("uid", "dataset")


@query("w14_largest_remainder", """WITH c AS (SELECT dataset, count(*) AS w FROM scored GROUP BY dataset), e AS (SELECT *, w * 37.0 / sum(w) OVER () AS e FROM c),
f AS (SELECT *, floor(e) AS f, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, dataset) AS r FROM e)
SELECT dataset, w, CAST(f + CASE WHEN r <= 37 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS given FROM f""")
def _(t):
    return windows.allocate(t.scored.groupBy("dataset").agg(F.count(F.lit(1)).alias("w")), "w", 37, "dataset")


@query("w16_extremes", """WITH r AS (SELECT dataset, uid, row_number() OVER (PARTITION BY dataset ORDER BY score, uid) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM scored WHERE score IS NOT NULL)
SELECT dataset, uid, pick FROM r, (VALUES ('worst'), ('best'), ('median')) AS p(pick)
WHERE r = CASE pick WHEN 'worst' THEN 1 WHEN 'best' THEN n ELSE n // 2 + 1 END""")
def _(t):
    return windows.extremes(t.scored.where("score IS NOT NULL"), "dataset", "score", "uid").select("dataset", "uid", "pick")


@query("w18_batches_of_five", "SELECT uid, qid, CAST((row_number() OVER (PARTITION BY qid ORDER BY uid) - 1) // 5 AS BIGINT) AS batch FROM examples")
def _(t):
    return joins.batches(t.examples, "qid", "uid", 5).select("uid", "qid", "batch")


@query("w20_distance_cdf", "SELECT uid, round(cume_dist() OVER (PARTITION BY rung ORDER BY x), 9) AS share FROM boxes")
def _(t):
    return windows.cumulative_share(t.boxes.select("uid", "rung", "x"), ["rung"], "x").select("uid", F.round("share", 9).alias("share"))


@query("u01_union_arms", "SELECT uid, score, 'sighted' AS arm FROM scored UNION ALL SELECT src_uid AS uid, score, 'blind' AS arm FROM control")
def _(t):
    a = t.scored.select("uid", "score", F.lit("sighted").alias("arm"))
    return a.unionByName(t.control.select(F.col("src_uid").alias("uid"), "score", F.lit("blind").alias("arm")), allowMissingColumns=True)


@query("u02_common_keys", "SELECT uid FROM scored INTERSECT SELECT src_uid FROM control")
def _(t):
    return t.scored.select("uid").intersect(t.control.select(F.col("src_uid").alias("uid")))


@query("u03_symmetric_difference", """SELECT uid, 'only_a' AS side FROM (SELECT uid FROM judged EXCEPT ALL SELECT src_uid FROM control)
UNION ALL SELECT uid, 'only_b' FROM (SELECT src_uid AS uid FROM control EXCEPT ALL SELECT uid FROM judged)""")
def _(t):
    a, b = t.judged.select("uid"), t.control.select(F.col("src_uid").alias("uid"))
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))



@query("x04_failure_rate", """SELECT seq, recent, round(r, 9) AS failure_rate FROM (SELECT seq, count(*) OVER w AS recent, avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END) OVER w AS r
FROM log WINDOW w AS (ORDER BY seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))""")
def _(t):
    f = windows.failure_rate(t.log, F.col("failed"), "seq")
    return f.select("seq", "recent", F.round("failure_rate", 9).alias("failure_rate"))



@query("x06_affordable", """SELECT seq, round(s, 6) AS spent_before FROM (SELECT seq, coalesce(sum(cost) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM log) WHERE s < 5000""")
def _(t):
    return windows.affordable(t.log, "cost", 5000.0, "seq").select("seq", F.round("spent_before", 6).alias("spent_before"))


@query("q06_stable_hash", "SELECT uid, sha1('0:' || uid) AS h FROM examples")
def _(t):
    return t.examples.select("uid", windows.stable_hash(0, F.col("uid")).alias("h"))



@query("q08_blind_control", "SELECT 'blind:' || uid AS uid, uid AS src_uid, dataset FROM examples")
def _(t):
    return logs.blind_control(t.examples).select("uid", "src_uid", "dataset")


@query("s16_tags", """SELECT DISTINCT tag, regexp_extract(tag, '^([a-z]+)_', 1) AS model, regexp_replace(tag, '^[a-z]+_', '') AS protocol FROM log""")
def _(t):
    return t.log.select("tag", *logs.tag_parts(F.col("tag"), ["ar", "arm", "model"])).distinct()


@query("p04_not_applicable", "SELECT uid, lower(trim(coalesce(pred, ''))) = 'small ring' AS na, contains(lower(coalesce(pred, '')), 'ring') AS na_contains FROM answers")
def _(t):
    p = F.col("pred")
    return t.answers.select("uid", tx.is_said(p, "Small ring").alias("na"), tx.is_said(p, "ring", anywhere=True).alias("na_contains"))


@query("p07_refers_to_mark", r"SELECT uid, regexp_matches(gold, '(?i)\b(ring|bolt|letter|labell?ed)\b') AS refers FROM answers")
def _(t):
    return t.answers.select("uid", tx.refers_to(F.col("gold"), ("ring", "bolt", "letter", "labell?ed")).alias("refers"))


@query("p13_vision_status", """SELECT s.uid, CASE WHEN s.family = 0 THEN 'exempt' WHEN c.score IS NULL THEN 'untested' WHEN c.score >= 0.5 THEN 'answerable' ELSE 'confirmed' END AS status
FROM scored s LEFT JOIN control c ON c.src_uid = s.uid""")
def _(t):
    c = t.control.select(F.col("src_uid").alias("uid"), F.col("score").alias("blind"))
    status = an.vision_status(F.col("family") == 0, F.col("blind"))
    return t.scored.join(c, "uid", "left").select("uid", status.alias("status"))
