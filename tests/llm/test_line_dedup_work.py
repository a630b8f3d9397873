"""What the operator's steps do only once."""

from evalframe.llm import line_dedup as ld

CFG = ld.Settings()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lines(spark, *texts):
    return ld._lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), CFG, "doc_id", "text")


def test_a_line_is_normalised_once(spark):
    df = lines(spark, "One  line\tof Some length here\n \n\x01 \x1f\n\r\nx\n\xa0", "", None)
    assert plan(df).count("lower(") == 1
    assert sorted((r.key, r.pos, r.line) for r in df.collect()) == [(0, 0, "one line of some length here"), (0, 4, None), (0, 5, None)]


def test_the_members_of_a_set_are_taken_outside_the_lambda_that_makes_it(spark):
    texts = lines(spark, "abcdefghijkl" * 20, "a line of which no piece is repeated").selectExpr("h1 AS id", "line")
    facts = ld._facts(texts, CFG.shingle)
    assert not [x for x in plan(facts).split("\n") if "Generate" in x and "explode" in x and "lambda" in x]
    assert sorted(r["size"] for r in facts.collect()) == [12, 25]


def test_signatures_are_written_once(spark):
    """Only lines of which every hash was dropped are signed again; each line stands in as many buckets as there are bands."""
    df = lines(spark, "\n".join(["=" * 5000, "a line of some length, the first", "another line of some length", "too short"]))
    signed = ld._signatures(df, CFG)
    assert [x.count() for x in signed] == [3, 1]
    assert sorted(r["count"] for r in ld._bands(signed, CFG).groupBy("id").count().collect()) == [CFG.bands] * 3
