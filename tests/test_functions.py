"""Scalar functions F1-F17 on hand-made values (FIXTURES.md section 3)."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripmart import functions as fn
from tripmart.functions import casts
from pyspark.sql import types as T


def _one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], names) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_boundary_minute(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 5, 0, 0, 59), dt.datetime(2020, 1, 5, 0, 1, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(fn.minutes_between("a", "b").alias("m"),
                  F.timestamp_diff("MINUTE", F.col("a"), F.col("b")).alias("elapsed")).first()
    assert r["m"] == 1 and r["elapsed"] == 0


def test_boundary_second_with_micros(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 5, 0, 0, 59, 900000),
                                 dt.datetime(2020, 1, 5, 0, 1, 0, 100000))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(fn.seconds_between("a", "b")).first()[0] == 1


def test_boundary_before_1970_and_negative(spark):
    df = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 59, 30), dt.datetime(1970, 1, 1, 0, 0, 10)),
                                (dt.datetime(2020, 1, 1, 0, 2, 0), dt.datetime(2020, 1, 1, 0, 0, 59))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(fn.minutes_between("a", "b")).collect()] == [1, -2]


def test_time_functions_do_not_depend_on_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 3, 8, 2, 30), dt.datetime(2020, 3, 8, 3, 10))],
                               "a timestamp_ntz, b timestamp_ntz")
    exprs = [fn.minutes_between("a", "b"), fn.hour_of("a"), fn.day_name("a"), fn.date_of("a")]
    before = df.select(*exprs).first()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        after = df.select(*exprs).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert before == after and before[0] == 40


@settings(max_examples=40, deadline=None)
@given(st.datetimes(min_value=dt.datetime(1960, 1, 1), max_value=dt.datetime(2030, 1, 1)),
       st.integers(min_value=-10**10, max_value=10**10))
def test_minutes_between_matches_python(spark, a, delta_us):
    b = a + dt.timedelta(microseconds=delta_us)
    if not dt.datetime(1900, 1, 1) < b < dt.datetime(2100, 1, 1):
        return
    epoch = dt.datetime(1970, 1, 1)

    def floor_min(t):
        return (t - epoch) // dt.timedelta(minutes=1)
    df = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(fn.minutes_between("a", "b")).first()[0] == floor_min(b) - floor_min(a)


def test_weekend_and_day_names(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 5, 12),), (dt.datetime(2020, 1, 6, 12),), (None,)],
                               "t timestamp_ntz")
    rows = df.select(fn.day_name("t"), fn.is_weekend("t")).collect()
    assert [tuple(r) for r in rows] == [("Sun", True), ("Mon", False), (None, False)]


def test_tip_pct_and_speed_guards(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0, 0), (-10.0, -1.0, 2.0, 600), (None, 1.0, 1.0, 3600)],
                               "fare double, tip double, dist double, secs long")
    rows = df.select(fn.tip_pct("tip", "fare"), fn.speed_mph("dist", "secs")).collect()
    assert rows[0][0] is None and rows[0][1] is None
    assert abs(rows[1][0] - 0.1) < 1e-12 and abs(rows[1][1] - 12.0) < 1e-12
    assert rows[2][0] is None and rows[2][1] == 1.0


def test_number_cast_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.49,), (None,)], "x double")
    assert [r[0] for r in df.select(casts.to_number(F.col("x"), T.DoubleType())).collect()] == [3, -3, 0, None]


def test_float_to_varchar_and_code_keys(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (9.0,), (None,)], "x double")
    out = [r[0] for r in df.select(casts.to_varchar(F.col("x"), T.DoubleType())).collect()]
    assert out == ["1", "1.5", "9", None]
    codes = spark.createDataFrame([("1",), ("1.0",), ("CMT",), ("",), (None,)], "c string")
    assert [r[0] for r in codes.select(fn.code_key("c")).collect()] == [1, 1, None, None, None]


def test_name_parsing_is_anchored(spark):
    df = spark.createDataFrame([("TRIPS_GREEN_2019_01",), ("TRIPS_GREEN_2019_01_TINY",), ("TRIPS_ALL",),
                                ("trips_yellow_2020_12",)], "n string")
    rows = df.select(fn.extract_int("n", fn.TABLE_PATTERN, 2), fn.extract_int("n", fn.TABLE_PATTERN, 3),
                     fn.split_part_int("n", "_", 3)).collect()
    assert [tuple(r) for r in rows] == [(2019, 1, 2019), (None, None, 2019), (None, None, None),
                                        (2020, 12, 2020)]


def test_month2_and_names(spark):
    df = spark.createDataFrame([("green", 2019, 1)], "s string, y int, m int")
    r = df.select(fn.table_name("s", "y", "m"), fn.file_name("s", "y", "m"), fn.month2("m")).first()
    assert tuple(r) == ("TRIPS_GREEN_2019_01", "green_tripdata_2019-01.parquet", "01")


def test_text_numbers_round_once(spark):
    from tripmart.functions import casts
    df = spark.createDataFrame([("1.4999999",), ("2.5",), ("9300000000000000000",), ("CMT",), (None,)], "x string")
    out = [r[0] for r in df.select(casts.to_number("x", df.schema["x"].dataType)).collect()]
    assert out == [1, 3, None, None, None]


def test_numbers_of_38_digits_survive(spark):
    from decimal import Decimal

    from tripmart.functions import casts
    texts = ["9300000000000000000", "123456789012345678901234567890", "1.4999999", "2.5", "-0.5", "9" * 38, "9" * 39, "CMT", "", None]
    df = spark.createDataFrame([(t, None if t in (None, "", "CMT") else float(t)) for t in texts], "t string, d double")
    got = [r[0] for r in df.select(casts.to_number38("t", df.schema["t"].dataType)).collect()]
    assert got == [Decimal(9300000000000000000), Decimal(123456789012345678901234567890), 1, 3, -1, Decimal("9" * 38), None, None,
                   None, None]
    assert df.select(casts.to_number38("d", df.schema["d"].dataType)).first()[0] == Decimal(9300000000000000000)
