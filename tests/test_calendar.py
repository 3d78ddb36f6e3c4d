import datetime as dt

from pyspark.sql import functions as F

from dawnchorus.functions import (
    de_date, de_number, floor_hour, hour24, iso_week, iso_year, pick, season_label,
    season_ordinal, simple_week, week_start_sunday,
)


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_hour24(spark):
    df = spark.createDataFrame([(ts("2024-01-01 00:00:00"),), (ts("2024-01-01 00:59:59"),),
                                (ts("2024-01-01 01:00:00"),), (ts("2024-01-01 23:59:00"),)],
                               "t timestamp_ntz")
    assert [r[0] for r in df.select(hour24("t")).collect()] == [24, 24, 1, 23]


def test_floor_hour_stays_ntz(spark):
    df = spark.createDataFrame([(ts("2024-03-31 02:30:15"),)], "t timestamp_ntz")
    out = df.select(floor_hour("t").alias("h"))
    assert out.schema["h"].dataType.typeName() == "timestamp_ntz"
    assert out.first().h == ts("2024-03-31 02:00:00")


def test_weeks(spark):
    days = [dt.date(2024, 12, 30), dt.date(2021, 1, 1), dt.date(2024, 3, 2), dt.date(2024, 3, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    rows = df.select(iso_year("d"), iso_week("d"), simple_week("d"), week_start_sunday("d")).collect()
    assert tuple(rows[0])[:3] == (2025, 1, 53)          # ISO 2025-W01, non-ISO week 53
    assert tuple(rows[1])[:3] == (2020, 53, 1)
    assert rows[2][3] == dt.date(2024, 2, 25)            # Saturday -> previous Sunday
    assert rows[3][3] == dt.date(2024, 3, 3)             # Sunday starts its own week


def test_seasons(spark):
    days = [dt.date(2024, 12, 31), dt.date(2023, 2, 28), dt.date(2024, 2, 29), dt.date(2024, 3, 1),
            dt.date(2024, 8, 31), dt.date(2024, 9, 1), None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [tuple(r) for r in df.select(season_label("d"), season_ordinal("d")).collect()]
    assert got == [("Winter", 4), ("Winter", 4), ("Winter", 4), ("Frühling", 1),
                   ("Sommer", 2), ("Herbst", 3), (None, None)]


def test_pick_null_index(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (3,)], "i int")
    assert [r[0] for r in df.select(pick("i", ["a", "b"])).collect()] == ["a", "b", None, None]


def test_german_format(spark):
    df = spark.createDataFrame([(1234567.891, dt.date(2024, 3, 1))], "x double, d date")
    r = df.select(de_number("x"), de_number("x", 2), de_date("d")).first()
    assert tuple(r) == ("1.234.568", "1.234.567,89", "01.03.2024")
