"""Shapes of JSON texts made of events: paths and types over the whole table, and how two renderings differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.operators import shapes
from evalframe.plans.base import query


def _s(x: Column) -> Column:
    return x.cast("string")


def _before(t) -> DataFrame:
    """Events as JSON: nested, with lists, nulls, types that change, a name with a dot, and torn texts."""
    e = F.col("event_id")
    tags = F.concat_ws(",", *(F.when(e % 3 >= i, F.lit(f'"t{i}"')) for i in (1, 2)), F.when(e % 5 == 0, F.lit('{"t": 1}')))
    value = F.when(e % 7 == 0, "null").when(e % 11 == 0, F.concat(F.lit('"'), _s(F.col("user_id")), F.lit('"'))).otherwise(_s(F.floor("value")))
    text = F.concat(
        F.lit('{"id": '), _s(e), F.lit(', "user": {"id": '), _s(F.col("user_id")), F.lit(', "kind": "'), F.col("event_type"), F.lit('"}, "tags": ['), tags,
        F.lit('], "value": '), value, F.when(e % 13 == 0, ', "a.b": true').otherwise(""), F.lit("}"),
    )
    return t.events.select(F.when(e % 97 == 0, F.substr(text, F.lit(1), F.lit(9))).otherwise(text).alias("json"))


def _after(t) -> DataFrame:
    e = F.col("event_id")
    value = F.concat(F.lit('"'), _s(F.floor("value")), F.lit('"'))
    told = [F.lit('{"id": '), _s(e), F.lit(', "user": {"id": '), _s(F.col("user_id")), F.lit('}, "tags": [], "value": '), value, F.lit(', "more": {"n": [[1]]}}')]
    return t.events.select(F.concat(*told).alias("json"))


#: before(path, type, n) and after(path, type): the shapes, counted without any JSON.
_SHAPES = """e AS (SELECT event_id AS i FROM events WHERE event_id % 97 <> 0),
before AS (SELECT * FROM (
  SELECT '$' AS path, 'unreadable' AS type, count(*) AS n FROM events WHERE event_id % 97 = 0
  UNION ALL SELECT '$', 'object', count(*) FROM e UNION ALL SELECT '$.id', 'number', count(*) FROM e UNION ALL SELECT '$.user', 'object', count(*) FROM e
  UNION ALL SELECT '$.user.id', 'number', count(*) FROM e UNION ALL SELECT '$.user.kind', 'string', count(*) FROM e UNION ALL SELECT '$.tags', 'array', count(*) FROM e
  UNION ALL SELECT '$.tags[]', 'string', CAST(sum(i % 3) AS BIGINT) FROM e UNION ALL SELECT '$.tags[]', 'object', count(*) FROM e WHERE i % 5 = 0
  UNION ALL SELECT '$.tags[].t', 'number', count(*) FROM e WHERE i % 5 = 0 UNION ALL SELECT '$.value', 'null', count(*) FROM e WHERE i % 7 = 0
  UNION ALL SELECT '$.value', 'string', count(*) FROM e WHERE i % 7 <> 0 AND i % 11 = 0 UNION ALL SELECT '$.value', 'number', count(*) FROM e WHERE i % 7 <> 0 AND i % 11 <> 0
  UNION ALL SELECT '$[''a.b'']', 'boolean', count(*) FROM e WHERE i % 13 = 0) WHERE n > 0),
after AS (SELECT v.path, v.type FROM (VALUES ('$', 'object'), ('$.id', 'number'), ('$.user', 'object'), ('$.user.id', 'number'), ('$.tags', 'array'), ('$.value', 'string'),
  ('$.more', 'object'), ('$.more.n', 'array'), ('$.more.n[]', 'array'), ('$.more.n[][]', 'number')) AS v(path, type) WHERE (SELECT count(*) FROM events) > 0)"""


@query("v06_json_shapes", f"WITH {_SHAPES} SELECT path, type, n FROM before")
def _(t):
    return shapes.shapes(_before(t), "json")


@query("v06_shape_changes", f"""WITH {_SHAPES}, a AS (SELECT path, string_agg(type, '|' ORDER BY type) AS types_a FROM before GROUP BY path), b AS (SELECT path, string_agg(type, '|' ORDER BY type) AS types_b FROM after GROUP BY path)
SELECT path, CASE WHEN types_b IS NULL THEN 'missing' WHEN types_a IS NULL THEN 'extra' ELSE 'changed' END AS change, types_a, types_b FROM a FULL JOIN b USING (path) WHERE types_a IS DISTINCT FROM types_b""")
def _(t):
    return shapes.compare(shapes.shapes(_before(t), "json"), shapes.shapes(_after(t), "json"))


@query("u03_shape_difference", f"""WITH {_SHAPES} SELECT path, type, 'only_a' AS side FROM (SELECT path, type FROM before EXCEPT ALL SELECT path, type FROM after)
UNION ALL SELECT path, type, 'only_b' FROM (SELECT path, type FROM after EXCEPT ALL SELECT path, type FROM before)""")
def _(t):
    return shapes.difference(shapes.shapes(_before(t), "json"), shapes.shapes(_after(t), "json"))
