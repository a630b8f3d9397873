from pyspark.sql import functions as F

from evalframe.operators import generation as gen
from tests.test_functions import searched


def found(spark, cases, **settings):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e string, p string, t string")
    return {r.i: r.v for r in df.select("i", gen.operand_search(F.col("e"), F.col("p"), F.col("t"), **settings).alias("v")).collect()}


def test_up_to_eight_operands_as_by_trying_everything(spark):
    cases = [("3 + 5 - 2 * 4 / 6 + 7", "12", ""), ("1+2+3+4+5+6+7+8", "-34", ""), ("9-8+7-6+5-4+3-2", "1,234", "saw 1,230"), ("2*2*2*2*2*2*2*2", "0.5", ""), ("7+7+7+7+7+7+7+7", "9999", "")]
    assert found(spark, cases) == {i: searched(*c) for i, c in enumerate(cases)}


def test_long_calculations(spark):
    ones = "+".join(["1"] * 30)
    primes = "+".join(map(str, (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 101, 103, 107, 109, 113)))
    assert found(spark, [(ones, "28", ""), (primes, "123456", "")], most_values=2000) == {0: "wrong_operation", 1: "undecided"}


def test_a_calculation_is_read_once_a_row(spark):
    df = spark.createDataFrame([("1+2", "3", "")], "e string, p string, t string").select(gen.operand_search(F.col("e"), F.col("p"), F.col("t")).alias("v"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1 and plan.count("[+\\-*/], 0") == 1
