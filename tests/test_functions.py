import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from basketry import functions as fn
from tests.samples import frame, when


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'timestamp_ntz' if hasattr(v, 'year') else type(v).__name__.replace('str', 'string').replace('float', 'double')}" for k, v in values.items())
    return frame(spark, [tuple(values.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "start, end, days",
    [
        ("2020-01-02 12:00:00", "2020-01-02 11:00:00", -1),
        ("2020-01-01 23:00:00", "2020-01-02 01:00:00", 0),
        ("2020-01-01 00:00:00", "2020-01-03 00:00:00", 2),
        ("2020-01-03 00:00:00", "2020-01-01 00:00:00", -2),
        # a change to summer time in the session's zone does not matter
        ("2018-11-03 23:00:00", "2018-11-04 23:00:00", 1),
        ("2020-01-02 12:00:00.500000", "2020-01-02 12:00:00", -1),
    ],
)
def test_elapsed_days_are_floored(spark, start, end, days):
    assert one(spark, fn.elapsed_days("b", "a"), a=when(start), b=when(end)) == days


def test_late_flag_without_estimate_is_zero(spark):
    df = frame(spark, [(when("2020-01-02"), None), (when("2020-01-02"), when("2020-01-01"))], "d timestamp_ntz, e timestamp_ntz")
    assert [r[0] for r in df.select(fn.late_flag("d", "e")).collect()] == [0, 1]


def test_month_and_weekday(spark):
    monday, sunday = when("2018-10-15 00:30:00"), when("2018-11-04 00:15:00")
    assert one(spark, fn.month_key("a"), a=monday) == "2018-10"
    assert one(spark, fn.day_of_week("a"), a=monday) == 1
    assert one(spark, fn.day_of_week("a"), a=sunday) == 7


def test_parse_timestamp(spark):
    assert one(spark, fn.parse_timestamp("a"), a="2017-10-02 10:56:33") == when("2017-10-02 10:56:33")
    assert one(spark, fn.parse_timestamp("a", strict=False), a="bad") is None
    with pytest.raises(PySparkException):
        one(spark, fn.parse_timestamp("a"), a="bad")


def test_texts(spark):
    assert one(spark, fn.format_currency("a"), a=1234567.891) == "R$ 1,234,567.89"
    # half to even on the binary value, as in the reports that are matched
    assert one(spark, fn.format_fixed("a"), a=0.125) == "0.12"
    assert one(spark, fn.format_fixed("a"), a=12345.675) == f"{12345.675:.2f}"
    assert one(spark, fn.format_percent("a"), a=0.03) == "3.00%"
    assert one(spark, fn.abbreviate_id("a"), a="abcdefghij") == "abcdef..."


def test_numbers(spark):
    assert one(spark, fn.round_digits("a"), a=0.0078125) == 0.007812
    df = frame(spark, [(0.1,), (0.2,), (None,)], "x double")
    row = df.select(fn.money_sum("x").alias("s"), fn.money_mean("x").alias("m")).first()
    assert (row["s"], row["m"]) == (0.3, 0.15)
    empty = df.where("x > 1").agg(fn.money_sum("x").alias("s"), fn.money_mean("x").alias("m")).first()
    assert (empty["s"], empty["m"]) == (0.0, None)
    assert df.select(fn.ratio(F.lit(1), F.lit(0))).first()[0] is None
