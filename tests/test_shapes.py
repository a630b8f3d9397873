import json

from evalframe.operators import shapes
from evalframe.sources.logs import compare_shapes, json_shape


def table(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "j string").repartition(3)


def test_counts_by_path_and_type(spark):
    texts = ['{"a": [1, "x", [true, null]], "b c": {"d.e": 1.5}}', '{"a": {}}', "[[], [2]]", "7", None, "{torn", '{"it\'s": []}']
    got = {(r.path, r.type): r.n for r in shapes.shapes(table(spark, texts), "j").collect()}
    assert got == {
        ("$", "object"): 3, ("$", "array"): 1, ("$", "number"): 1, ("$", "unreadable"): 2, ("$.a", "array"): 1, ("$.a", "object"): 1, ("$.a[]", "number"): 1,
        ("$.a[]", "string"): 1, ("$.a[]", "array"): 1, ("$.a[][]", "boolean"): 1, ("$.a[][]", "null"): 1, ("$['b c']", "object"): 1, ("$['b c']['d.e']", "number"): 1,
        ("$[]", "array"): 2, ("$[][]", "number"): 1, ("$['it\\'s']", "array"): 1,
    }


def test_changes_are_those_of_single_texts(spark):
    a, b = '{"a": [1], "b": 1, "c": {"d": null}}', '{"a": ["x"], "e": 1, "c": {"d": "now"}}'
    got = {(r.path, r.change) for r in shapes.compare(shapes.shapes(table(spark, [a] * 5), "j"), shapes.shapes(table(spark, [b] * 9), "j")).collect()}
    want = compare_shapes(a, b)
    assert got == {(p, kind) for kind, paths in want.items() for p in paths}
    assert {r.path for r in shapes.shapes(table(spark, [a]), "j").collect()} == set(json_shape(json.loads(a)))
    assert shapes.compare(shapes.shapes(table(spark, [a]), "j"), shapes.shapes(table(spark, [a]), "j")).count() == 0


def test_difference_and_empty_tables(spark):
    a, none = shapes.shapes(table(spark, ['{"x": 1}']), "j"), shapes.shapes(table(spark, []), "j")
    assert none.count() == 0
    assert sorted((r.path, r.side) for r in shapes.difference(a, none).collect()) == [("$", "only_a"), ("$.x", "only_a")]
    assert [r.change for r in shapes.compare(none, a).collect()] == ["extra", "extra"]
