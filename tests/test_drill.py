from pyspark.sql import functions as F

from evalframe.operators import aggregates as ag
from evalframe.operators import drill


def rows_of(df):
    return {drill_path(r.path): r for r in df.collect()}


def drill_path(path):
    return tuple((p.value, p.merged) for p in path)


def test_null_text_null_and_separators_are_keys_of_their_own(spark):
    df = spark.createDataFrame([("(null)", "z", 1.0), (None, "z", 0.0), ("a/b", "c", 1.0), ("a", "b/c", 0.5), ("a", None, None)], "x string, y string, score double")
    tree = drill.drill_tree(df, (drill.Dim("x", F.col("x"), (drill.Dim("y", F.col("y")),)),), F.col("score"), min_n=1)
    got = rows_of(tree)
    assert len(got) == 1 + 4 + 5 == tree.count()
    assert got[(("(null)", 0), ("z", 0))].value == 1.0 and got[((None, 0), ("z", 0))].value == 0.0
    assert got[(("(null)", 0), ("z", 0))].delta == 0.0
    assert (got[(("a", 0),)].n, got[(("a", 0),)].n_null) == (1, 1) and got[(("a", 0), (None, 0))].value is None
    assert [(s.dim, s.children, s.spread) for s in got[()].splits] == [("x", 4, 1.0)]
    text = ag.drill_down(df, ["x", "y"], min_n=1)
    assert text.count() == 10 == text.select("path", "depth").distinct().count()
    assert {r.path for r in text.where("depth = 2").collect()} == {"(null)/z", "\\N/z", "a\\/b/c", "a/b\\/c", "a/\\N"}
    assert ag.conservation_violations(text).count() == 0


def test_the_remainder_of_the_largest(spark):
    rows = [("g", f"v{i}", 1.0 if i else 0.0) for i in range(6) for _ in range(10 - i)] + [("h", "others", 0.0), ("h", None, 1.0)]
    df = spark.createDataFrame(rows, "x string, y string, score double")
    dims = (drill.Dim("x", F.col("x"), (drill.Dim("y", F.col("y"), top_k=2, then=(drill.Dim("s", F.col("score")),)),)),)
    got = rows_of(drill.drill_tree(df, dims, F.col("score"), min_n=1))
    assert {k for k in got if len(k) == 2} == {(("g", 0), ("v0", 0)), (("g", 0), ("v1", 0)), (("g", 0), ("others", 4)), (("h", 0), ("others", 0)), (("h", 0), (None, 0))}
    assert got[(("g", 0), ("others", 4))].n == 8 + 7 + 6 + 5
    assert got[(("g", 0), ("others", 4), ("1.0", 0))].n == 26
    assert [s.spread for s in got[(("g", 0), ("v0", 0))].splits] == [None]  # one child


def test_a_lost_leaf_is_told(spark):
    rows = [(f"x{i % 3}", f"y{i % 4}", None if i % 5 == 0 else 1.0) for i in range(60)] + [("x0", "empty", None)]
    df = spark.createDataFrame(rows, "x string, y string, score double")
    tree = drill.drill_tree(df, (drill.Dim("x", F.col("x"), (drill.Dim("y", F.col("y")),)), drill.Dim("y", F.col("y"))), F.col("score"))
    assert drill.violations(tree).count() == 0
    lost = tree.where("NOT (depth = 2 AND path[1].value = 'empty')")
    assert [(r.dimension, r.children_made, r.children_left, r.parent_null - r.children_null) for r in drill.violations(lost).collect()] == [("y", 5, 4, 1)]
    none_left = drill.violations(tree.where("depth < 2")).collect()
    assert {(r.path[0].value, r.children_n) for r in none_left} == {("x0", 0), ("x1", 0), ("x2", 0)}
    kinds = [r.kind for r in drill.flat_rows(tree).where("depth < 2").collect()]
    assert sorted(kinds) == ["dim", "dim"] + ["node"] * 8 + ["root"]


def test_an_empty_table_has_a_root(spark):
    df = spark.createDataFrame([], "x string, score double")
    for top in (None, 1):
        got = drill.drill_tree(df, (drill.Dim("x", F.col("x"), top_k=top),), F.col("score")).collect()
        assert [(r.path, r.n, r.n_null, r.value, r.splits) for r in got] == [([], 0, 0, None, [])]
