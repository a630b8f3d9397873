"""Tables of evaluation rows made from the driver's tables, in SQL that both engines read.

`@k` stands for the k-th component of an embedding, which the engines count from 0 and from 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = {
    "log": """
SELECT event_id AS seq, 'q' || CAST(user_id AS STRING) AS uid,
       CASE event_type WHEN 'view' THEN 'arm_a' WHEN 'click' THEN 'arm_b' WHEN 'signup' THEN 'arm_c' ELSE 'arm_d' END AS tag,
       CASE WHEN event_type = 'error' OR value < 3 THEN NULL ELSE 'v' || CAST(CAST(floor(value) AS INT) % 5 AS STRING) END AS pred,
       event_type = 'error' AS failed, value AS cost, value / 10 AS latency_s, event_type AS model
FROM {events}""",
    "examples": """
SELECT 'q' || CAST(doc_id AS STRING) AS uid, lang AS dataset, source AS category, n_chars AS size,
       CAST(doc_id % 4 AS INT) AS qid, 'v' || CAST(doc_id % 5 AS STRING) AS gold
FROM {documents}""",
    "scored": """
SELECT o_orderkey AS uid, o_orderpriority AS dataset, o_orderstatus AS primitive, CAST(o_custkey % 7 AS INT) AS family,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 END AS score,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS size,
       CAST(o_orderkey % 13 AS BIGINT) AS n_true, CAST(o_orderkey % 13 + (o_orderkey * 7) % 5 - 2 AS BIGINT) AS n_pred,
       substr('ABCD', CAST(o_orderkey % 4 AS INT) + 1, 1) AS gold_option,
       substr('ABCD', CAST((o_orderkey * 3 + o_custkey % 3) % 4 AS INT) + 1, 1) AS picked,
       CASE WHEN o_orderkey % 5 = 0 THEN 'unclassified' WHEN o_orderkey % 5 = 1 THEN NULL ELSE 'mode' || CAST(o_custkey % 4 AS STRING) END AS failure_mode
FROM {orders}""",
    "control": """
SELECT 'blind:' || CAST(o_orderkey AS STRING) AS uid, o_orderkey AS src_uid,
       CAST((o_orderkey * 53) % 89 AS DOUBLE) / 100 AS score
FROM {orders} WHERE o_orderkey % 3 = 0""",
    "judged": """
SELECT o_orderkey AS uid, CAST((o_orderkey * 29) % 2 AS DOUBLE) AS judge_score, o_orderkey % 6 = 0 AS equivalent,
       CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'gold_correct' WHEN 1 THEN 'prediction_correct' WHEN 2 THEN 'both_acceptable' ELSE 'neither_correct' END AS verdict,
       CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'unambiguous' WHEN 1 THEN 'ambiguous' ELSE 'wrong' END AS gt_quality
FROM {orders} WHERE o_orderkey % 2 = 0""",
    "rungs": """
SELECT l_orderkey AS graph_id, l_linenumber AS target, l_returnflag AS rung,
       CASE WHEN max(l_quantity) > 40 THEN NULL ELSE l_linestatus END AS anchor,
       sum(CAST(l_quantity AS BIGINT)) % 3 = 0 AS hit
FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_returnflag, l_linestatus""",
    "answers": """
SELECT p_partkey AS uid, p_name AS gold, p_type AS other,
       CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN substr(p_name, 1, length(p_name) - 1)
            WHEN 3 THEN p_name || ', ' || p_type WHEN 4 THEN '  ' || p_name || '  ' WHEN 5 THEN p_type WHEN 6 THEN NULL ELSE 'big ' || p_name END AS pred,
       CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN CAST(p_size AS STRING) || '%' WHEN 1 THEN '$' || CAST(p_size AS STRING) || ',000'
            WHEN 2 THEN CAST(p_size AS STRING) || '.0' WHEN 3 THEN CAST(p_size AS STRING) || ' million' ELSE 'about ' || CAST(p_size AS STRING) END AS num_pred,
       CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN CAST(p_size * 1000 AS STRING) ELSE CAST(p_size AS STRING) || ' Million' END AS num_gold,
       p_size AS size
FROM {part}""",
    "boxes": """
SELECT vec_id AS uid, CAST(floor(vec_id / 40) AS BIGINT) AS scene, label, CAST(label % 3 AS INT) AS rung,
       (CAST(embedding[@0] AS DOUBLE) + 1) / 2 AS x, (CAST(embedding[@1] AS DOUBLE) + 1) / 2 AS y,
       least((CAST(embedding[@2] AS DOUBLE) + 1) / 2, (CAST(embedding[@4] AS DOUBLE) + 1) / 2) AS x0,
       least((CAST(embedding[@3] AS DOUBLE) + 1) / 2, (CAST(embedding[@5] AS DOUBLE) + 1) / 2) AS y0,
       greatest((CAST(embedding[@2] AS DOUBLE) + 1) / 2, (CAST(embedding[@4] AS DOUBLE) + 1) / 2) AS x1,
       greatest((CAST(embedding[@3] AS DOUBLE) + 1) / 2, (CAST(embedding[@5] AS DOUBLE) + 1) / 2) AS y1
FROM {embeddings}""",
}
#: Answers against golds; # is a number, ~ a line feed.
_PAIRS = (
    ("amber, teal", None, "teal, amber"), ("amber; teal", None, "amber; teal; jade"), ("amber, teal, jade", None, "Teal, amber."),
    ("amber, teal", None, "amber, onyx"), ("amber", None, "amber, teal"), ("amber, teal", None, "jade, onyx"), ("amber, teal", "jade, onyx", "onyx, jade"),
    ("Amber, Teal", None, "amber , teal"), ("amber~teal", None, "teal~amber"), ("#", None, "# million"), ("#", None, "# (a)"), ("#.5", None, "#,5"),
    ("$#", None, "#"), ("#%", None, "# percent"), ("# million", None, "#m"), ("#m", None, "#000000"), ("-#", None, "#"), ("+#", None, "#"),
    ("north gate.", None, "North  Gate"), ("north", None, ""), ("", None, "north"), ("north", None, None), ("# users", None, "#"),
    ("percentage", None, "age"), ("the north gate", None, "north gate"), ("gate", None, "investigate"), ("# billion", "#", "#bn"), ("#,000", None, "#000"),
    (".5", None, "0.5"), ("# tons", None, "# t"), ("#k", None, "# thousand"), ("4#.0", None, "4#"), ("#", "seven", "Seven."), ("# widgets", None, "#"),
    ("#b", None, "#000000000"), ("n/a", None, "N.A."), ("1#e", None, "1#E"), ("# crores", None, "#"), ("five points", None, "five"), ("#", None, "#.0000000001"),
    ("oak (old)", None, "oak old"), ("# - #", None, "#-#"),
)


def _value(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _filled(column: str) -> str:
    return f"replace(replace({column}, '#', CAST(o_custkey % 97 + 3 AS STRING)), '~', chr(10)) AS {column}"


BASE["pairs"] = f"""
SELECT o_orderkey AS uid, {", ".join(map(_filled, ("gold", "other", "pred")))}
FROM {{orders}} JOIN (VALUES {", ".join(f"({k}, {_value(g)}, {_value(o)}, {_value(p)})" for k, (g, o, p) in enumerate(_PAIRS))}) AS v(k, gold, other, pred)
  ON k = (o_orderkey + o_custkey) % {len(_PAIRS)}"""
BASE["traces"] = """
SELECT o_orderkey AS uid, o_orderkey % 5 = 0 AS em, o_orderkey % 7 = 0 AS equivalent,
       CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN '1,200 - ' || CAST(o_custkey % 90 AS STRING) WHEN 1 THEN CAST(o_custkey % 50 AS STRING) || ' / 4'
            WHEN 2 THEN 'sum of all' WHEN 3 THEN NULL WHEN 4 THEN '2 + 3 + 4' ELSE '17*' || CAST(o_custkey % 9 AS STRING) || '.5' END AS expression,
       CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'Slide ' || CAST(o_custkey % 25 AS STRING) || ' shows 1200 and ' || CAST(o_custkey % 90 AS STRING) || '.'
            WHEN 1 THEN 'On the third page and image #7 (not slides 9): ' || CAST(o_custkey % 50 AS STRING) || '.001 of 4'
            WHEN 2 THEN 'The TWENTIETH slide, page 12, page 012 and page 21; 17 times ' || CAST(o_custkey % 9 AS STRING) || '.5' ELSE NULL END AS trace
FROM {orders}"""
BASE["clicks"] = """
SELECT vec_id AS uid, CAST(vec_id % 3 AS INT) AS rung, 900 + vec_id % 1500 AS w, 700 AS h,
       least((CAST(embedding[@2] AS DOUBLE) + 1) / 2, (CAST(embedding[@4] AS DOUBLE) + 1) / 2) - 0.05 AS x0,
       least((CAST(embedding[@3] AS DOUBLE) + 1) / 2, (CAST(embedding[@5] AS DOUBLE) + 1) / 2) - 0.05 AS y0,
       greatest((CAST(embedding[@2] AS DOUBLE) + 1) / 2, (CAST(embedding[@4] AS DOUBLE) + 1) / 2) + 0.05 AS x1,
       greatest((CAST(embedding[@3] AS DOUBLE) + 1) / 2, (CAST(embedding[@5] AS DOUBLE) + 1) / 2) + 0.05 AS y1,
       CASE CAST(vec_id % 6 AS INT) WHEN 0 THEN '[[0.' || CAST(400 + vec_id % 200 AS STRING) || ',0.' || CAST(350 + vec_id % 300 AS STRING) || ']]'
            WHEN 1 THEN 'Box: [[0.4, 0.' || CAST(300 + vec_id % 99 AS STRING) || ', 0.6, 0.7]].' WHEN 2 THEN '[[' || CAST(300 + vec_id % 900 AS STRING) || ',' || CAST(200 + vec_id % 300 AS STRING) || ']]'
            WHEN 3 THEN 'at [ 0.5 , 0.' || CAST(400 + vec_id % 200 AS STRING) || ' ] I think' WHEN 4 THEN 'it is not visible' ELSE NULL END AS response
FROM {embeddings}"""
BASE["manifest"] = """
SELECT vec_id AS uid, CASE CAST(vec_id % 3 AS INT) WHEN 0 THEN 'point' WHEN 1 THEN 'relation' ELSE 'reverse' END AS qtype, CAST(vec_id % 4 AS INT) AS rung,
       1000 AS w, 800 AS h, 1000 - 150 * (vec_id % 4) AS eff_w, 800 - 120 * (vec_id % 4) AS eff_h,
       CAST(vec_id * 37 % 960 AS DOUBLE) AS x0, CAST(vec_id * 53 % 790 AS DOUBLE) AS y0,
       CAST(vec_id * 37 % 960 + vec_id % 60 AS DOUBLE) AS x1, CAST(vec_id * 53 % 790 + 1 + vec_id % 17 AS DOUBLE) AS y1,
       CASE WHEN vec_id % 7 = 0 THEN 5.0 ELSE 0.0 END AS spill, CASE WHEN vec_id % 11 = 0 THEN 80.5 ELSE 0.0 END AS off,
       6 + vec_id % 25 AS font_px, CASE WHEN vec_id % 13 <> 0 THEN CAST(vec_id % 8 AS DOUBLE) + 0.5 END AS contrast,
       CASE WHEN vec_id % 9 = 0 THEN 0.0125 ELSE 0.004 END AS occluded
FROM {embeddings}"""
BASE["marks"] = """
SELECT vec_id AS uid, CAST(floor(vec_id / 40) AS BIGINT) AS scene, 't' || CAST(vec_id % 37 AS STRING) AS text, vec_id % 10 <> 0 AS eligible,
       CAST(vec_id * 37 % 900 AS DOUBLE) AS x0, CAST(vec_id * 53 % 700 AS DOUBLE) AS y0,
       CAST(vec_id * 37 % 900 + 4 + vec_id % 50 AS DOUBLE) AS x1, CAST(vec_id * 53 % 700 + 3 + vec_id % 20 AS DOUBLE) AS y1,
       CAST(vec_id % 30 AS DOUBLE) AS pad, vec_id % 21 <> 0 AS in_bounds, CAST(5 + vec_id % 20 AS INT) AS font_px,
       CASE WHEN vec_id % 19 = 0 THEN 0.02 ELSE 0.0 END AS occluded, CASE WHEN vec_id % 13 <> 0 THEN CAST(vec_id % 9 AS DOUBLE) + 0.4 END AS contrast
FROM {embeddings}"""
BASE["panels"] = """
SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 END AS score,
       CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'For the subplot at row ' || CAST(o_custkey % 3 + 1 AS STRING) || ' and column ' || CAST(o_custkey % 12 + 1 AS STRING) || ', what is the title?'
            WHEN 1 THEN 'For the left-most subplot, what is the title?' WHEN 2 THEN 'For the current plot, how many lines are there?' ELSE 'How many subplots are there at row 2 and column 3?' END AS question
FROM {orders}"""
BASE["calls"] = """
SELECT event_id AS seq, event_type AS model, value AS cost, CAST(floor(value * 50) AS BIGINT) AS in_tokens, CAST(floor(value * 3) AS BIGINT) AS out_tokens, CAST(event_id % 4 AS INT) AS attempt,
       CASE WHEN event_type = 'error' THEN CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'Your credit balance is too low' WHEN 1 THEN 'Overloaded, try again' WHEN 2 THEN 'Monthly QUOTA reached' ELSE 'timed out' END END AS error
FROM {events}"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


class Tables:
    """The driver's tables and the evaluation tables made of them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in BASE:
            raise AttributeError(name)
        text = re.sub(r"@(\d+)", r"\1", BASE[name])
        df = self.spark.sql(text, **{t: getattr(self, t) for t in re.findall(r"\{(\w+)\}", text)})
        return df.withColumn("box", F.struct("x0", "y0", "x1", "y1")) if name in ("boxes", "clicks", "manifest") else df


def duck(sql: str) -> str:
    """The SQL with those evaluation tables that it names put before it."""
    text = ""
    used = [n for n in BASE if re.search(rf"\b{n}\b", sql)]
    for n in used:
        body = re.sub(r"\{(\w+)\}", r"\1", BASE[n])
        text += f"{n} AS ({re.sub(r'@(\d+)', lambda m: str(int(m[1]) + 1), body)}),\n"
    if not used:
        return sql
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        rest = sql[5:].lstrip()
        recursive = rest[:10].upper() == "RECURSIVE "
        return "WITH " + "RECURSIVE " * recursive + text + (rest[10:] if recursive else rest)
    return "WITH " + text.rstrip(",\n") + "\n" + sql


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register make(tables) -> DataFrame under the name, with the SQL that gives the same rows."""

    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = duck(sql)
        return make

    return register
