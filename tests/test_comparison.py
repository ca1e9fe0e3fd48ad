"""Order of numeric strings against exact decimals, around the length from which keys are compared."""

import operator
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from fieldwarden.functions.comparison import compare

getcontext().prec = 200
OPS = {"=": operator.eq, "<>": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
NUMBERS = [
    "0", "-0", "+0.0", "5.", ".5", "-.5", "007", "4000", "4000.0", "3999.9999999999999", "-12.50", "123456789012345678", "-99999999999999999",
    "1234567890123456789", "12345678901234567.8901", "0.00000000000000001", "99999999999999999999999999999999999999999999999.5", "-99999999999999999999999999999999999999999999999.5",
]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(n,) for n in NUMBERS], "a string")


@pytest.mark.parametrize("literal", ["0", "4000", "-12.5", ".5", "123456789012345678", "1234567890123456789", "12345678901234567.8901"])
def test_literal(numbers, literal):
    row = {(r.a, op): r[op] for r in numbers.select("a", *[compare(op, F.col("a"), literal).alias(op) for op in OPS]).collect() for op in OPS}
    assert row == {(n, op): f(Decimal(n), Decimal(literal)) for n in NUMBERS for op, f in OPS.items()}


def test_literal_against_other_values(spark):
    frame = spark.createDataFrame([("",), ("abc",), (" 7\n",), (None,), ("1e3",), ("٣",)], "a string")
    got = [tuple(r) for r in frame.select(*[compare(op, F.col("a"), "7").alias(op) for op in ("=", ">", "<")]).collect()]
    assert got == [(False, False, True), (False, False, False), (True, False, False), (None, None, None), (False, False, False), (False, False, False)]


def test_columns(numbers):
    pairs = numbers.crossJoin(numbers.withColumnRenamed("a", "b"))  # a fixture of 18 rows
    got = {(r.a, r.b): r.less for r in pairs.select("a", "b", compare("<", F.col("a"), F.col("b")).alias("less")).collect()}
    assert got == {(x, y): Decimal(x) < Decimal(y) for x in NUMBERS for y in NUMBERS}
