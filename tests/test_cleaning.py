import datetime as dt

from pyspark.sql import functions as F

from dawnchorus.operators import cleaning
from dawnchorus.sources.detections import clean_names, snake_name


def _dets(spark, days, extra=None):
    rows = []
    for i, d in enumerate(days):
        rows.append((dt.datetime.combine(d, dt.time(8, 0)), "Amsel", (extra or {}).get(i, 1.0)))
    return spark.createDataFrame(rows, "zeitstempel timestamp_ntz, deutscher_name string, x double")


def test_outage_gaps(spark):
    base = dt.date(2024, 3, 1)
    # 0 missing days, 1 missing (gap 2), 2 missing (gap 3), 10 missing (gap 11)
    offsets = [0, 1, 3, 6, 17]
    df = _dets(spark, [base + dt.timedelta(days=o) for o in offsets])
    out = sorted(tuple(r) for r in cleaning.outages(df).collect())
    assert out == [(base + dt.timedelta(days=1), base + dt.timedelta(days=3), 3),
                   (base + dt.timedelta(days=3), base + dt.timedelta(days=6), 4),
                   (base + dt.timedelta(days=6), base + dt.timedelta(days=17), 12)]


def test_outage_strict_na(spark):
    base = dt.date(2024, 3, 1)
    df = _dets(spark, [base, base + dt.timedelta(days=3)], extra={1: None})
    assert cleaning.outages(df).count() == 1
    assert cleaning.outages(df, strict_na=True).count() == 0


def test_outages_per_station(spark):
    rows = [(dt.datetime(2024, 3, d, 9), s) for s, days in (("a", [1, 2, 5]), ("b", [1, 4])) for d in days]
    df = spark.createDataFrame(rows, "zeitstempel timestamp_ntz, station string")
    out = sorted(tuple(r) for r in cleaning.outages(df, partition="station").collect())
    assert out == [("a", dt.date(2024, 3, 2), dt.date(2024, 3, 5), 4),
                   ("b", dt.date(2024, 3, 1), dt.date(2024, 3, 4), 4)]


def test_observation_period_and_complete_days(spark):
    rows = []
    for day, n in ((1, 5), (2, 1), (3, 3), (4, 3), (8, 4), (9, 1)):
        rows += [(dt.datetime(2024, 3, day, 10, i), "A") for i in range(n)]
    rows.append((dt.datetime(2024, 2, 28, 10), "A"))  # before `from`
    df = spark.createDataFrame(rows, "zeitstempel timestamp_ntz, deutscher_name string")
    per = cleaning.observation_period(df, from_ts="2024-03-02", min_per_day=3).first()
    assert (per.beginn, per.ende, per.dauer) == (dt.date(2024, 3, 3), dt.date(2024, 3, 9), 7)
    period = cleaning.observation_period(df, from_ts="2024-03-02", min_per_day=3)
    out = cleaning.outages(df)
    kept = cleaning.complete_days(df, period, out)
    days = sorted({r[0] for r in kept.select(F.to_date("zeitstempel")).collect()})
    # 4th ends no gap? gap 4 -> 8 removes both edges
    assert days == [dt.date(2024, 3, 3), dt.date(2024, 3, 9)]


def test_clean_names():
    assert snake_name("Sci_Name") == "sci_name"
    assert snake_name("ComName") == "com_name"
    assert snake_name("TT_TU.Lufttemperatur") == "tt_tu_lufttemperatur"
    assert snake_name("R1.Niederschlagshöhe", german=True) == "r1_niederschlagshoehe"
    assert snake_name("Straße", german=True) == "strasse"
    assert snake_name("1st value") == "x1st_value"


def test_clean_names_unique(spark):
    df = spark.createDataFrame([(1, 2)], "`A b` int, `a_b` int")
    assert clean_names(df).columns == ["a_b", "a_b_2"]


def test_freq_rank_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "s string")
    got = [tuple(r) for r in cleaning.freq_rank(df, "s").orderBy("s_rang").collect()]
    assert got == [("c", 2, 1), ("a", 1, 2), ("b", 1, 3)]


def test_profile_quartiles(spark):
    df = spark.createDataFrame([(float(x), None if x == 3 else 1) for x in range(1, 6)], "x double, y int")
    r = {row.spalte: row for row in cleaning.profile(df).collect()}
    assert (r["x"].minimum, r["x"].q1, r["x"].median, r["x"].q3, r["x"].maximum) == (1, 2, 3, 4, 5)
    assert r["y"].anzahl_na == 1 and r["x"].anzahl_na == 0


def test_read_detections_extra_columns_and_bad_values(spark):
    import tempfile
    from dawnchorus.sources.detections import read_detections, to_detections
    from dawnchorus.sources.schemas import RAW_DETECTIONS
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{d}/detections.csv", "w", encoding="utf-8") as f:
        f.write("Date,Time,Sci_Name,Com_Name,Confidence,Cutoff,Sens,Lat,Lon,Overlap,File_Name\n")
        f.write("2024-03-01,06:15:00,Turdus merula,Amsel,0.91,0.7,1.25,51.8,6.6,0.0,a.wav\n")
        f.write("2024-03-01,25:99:00,Erithacus rubecula,Rotkehlchen,n/a,0.7,1.25,51.8,6.6,0.0,b.wav\n")
    rows = to_detections(read_detections(spark, d)).orderBy("deutscher_name").collect()
    assert rows[0].zeitstempel == dt.datetime(2024, 3, 1, 6, 15) and rows[0].erkennungswahrscheinlichkeit == 0.91
    assert rows[1].zeitstempel is None and rows[1].erkennungswahrscheinlichkeit is None
    typed = read_detections(spark, f"{d}/detections.csv", schema=RAW_DETECTIONS)
    assert typed.schema["Confidence"].dataType.simpleString() == "double"


def test_profile_approx(spark):
    df = spark.range(1, 1001).selectExpr("cast(id as double) as x")
    r = cleaning.profile(df, exact=False).first()
    assert abs(r.median - 500) <= 2 and r.minimum == 1 and r.maximum == 1000


def test_exact_quartiles_are_dealt_out(spark):
    import numpy as np
    df = spark.range(2000).selectExpr(
        "cast(id * id % 977 as double) / 4 as x", "if(id % 3 = 0, null, cast(id % 7 as int)) as y",
        "cast(null as double) as z", "if(id = 5, 8.5D, null) as w",
        "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * id % 5003) as t").repartition(5)
    rows = df.toPandas()
    profile = cleaning.profile(df, ["x", "y", "z", "w"], exact=True)
    got = {r.spalte: r for r in profile.collect()}
    for c in ("x", "y", "w"):
        want = np.quantile(rows[c].dropna(), [0, 0.25, 0.5, 0.75, 1])
        assert np.allclose([got[c].minimum, got[c].q1, got[c].median, got[c].q3, got[c].maximum], want, rtol=1e-12)
        assert got[c].anzahl_na == rows[c].isna().sum()
    assert (got["z"].q1, got["z"].median, got["z"].q3, got["z"].anzahl_na) == (None, None, None, 2000)
    times = cleaning.profile_times(df, ["t"], exact=True)
    seconds = np.quantile([(t - dt.datetime(2024, 1, 1)).total_seconds() for t in rows["t"]], [0.25, 0.5, 0.75])
    r = times.first()
    assert [r.q1, r.median, r.q3] == [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(x)) for x in seconds]
    for frame in (profile, times):  # no aggregate that holds every value of a column
        assert "percentile" not in frame._jdf.queryExecution().toString()


def test_complete_days_independent_of_session_zone(spark):
    rows = [(dt.datetime(2024, 3, d, h), "A") for d in (1, 2, 3, 6) for h in (0, 12, 23)]
    df = spark.createDataFrame(rows, "zeitstempel timestamp_ntz, deutscher_name string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = {}
        for tz in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            period = cleaning.observation_period(df, from_ts="2024-03-02", min_per_day=3)
            kept = cleaning.complete_days(df, period, cleaning.outages(df))
            got[tz] = sorted(r[0] for r in kept.select("zeitstempel").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got["UTC"] == got["America/Los_Angeles"] == got["Asia/Tokyo"]
    assert [t.day for t in got["UTC"]] == [2, 2, 2]      # Mar 3 and Mar 6 end/start the outage


def test_periods_and_complete_days_of_each_station(spark):
    """Every station by its own period; an outage of one station does not touch another."""
    import datetime as dt
    day = lambda n: dt.datetime(2024, 1, n, 10)
    rows = [(day(n), "a") for n in (2, 3, 3, 4, 9) for _ in (0, 1)] + [(day(n), "b") for n in (3, 5, 5, 6, 7, 8)]
    rows += [(day(4), "c"), (None, "a"), (day(4), None)]
    df = spark.createDataFrame(rows, "zeitstempel timestamp_ntz, station string")
    periods = cleaning.station_periods(df, from_ts="2024-01-03", min_per_day=2)
    assert {(r.station, r.beginn.day, r.ende.day, r.dauer) for r in periods.collect()} == {("a", 3, 9, 7), ("b", 5, 8, 4)}
    gaps = cleaning.outages(df, partition="station")
    got = sorted((r.station, r.zeitstempel.day) for r in cleaning.complete_station_days(df, periods, gaps).collect())
    # station a: 4 and 9 are an outage's edges; b: 3 and 5 are, and 3 lies before its period
    assert got == [("a", 3)] * 4 + [("b", 6), ("b", 7), ("b", 8)]
    assert cleaning.complete_station_days(df.limit(0), periods, gaps).collect() == []
