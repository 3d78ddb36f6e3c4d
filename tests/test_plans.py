import os
import tempfile

import pytest

from pyspark.sql import functions as F

from dawnchorus.plans import report
from dawnchorus.plans.catalog import Tables
from dawnchorus.plans.ingest import import_detections, weather_from_stations
from dawnchorus.plans.study import event_study
from dawnchorus.sources.weather import PRODUCT_NAMES, write_observation_file
from tests.conftest import SF


def test_import_flow(spark):
    t = Tables(spark, SF)
    det = t.by_user()
    flow = import_detections(det, t.observations(), t.stations(), from_ts="2024-01-02",
                             min_per_day=5, partition="station")
    n_det, n_complete, n_enriched = det.count(), flow.detections.count(), flow.enriched.count()
    assert 0 < n_enriched <= n_complete <= n_det
    assert flow.period.count() == 1
    st = flow.stations.collect()
    assert len({r.wettervariable for r in st}) == len(st) >= 1      # one station per variable
    assert all(r.entfernung <= 50 for r in st)
    assert {"wetterzeit", "jahreszeit", "lufttemperatur"} <= set(flow.enriched.columns)


def test_weather_from_chosen_stations(spark):
    t = Tables(spark, SF)
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    obs = t.observations()
    files = {"a.csv": (1, {"tt_tu_lufttemperatur": "TT_TU"}),
             "b.csv": (3, {"v_n_bedeckungsgrad": "V_N"})}
    for name, (station, cols) in files.items():
        write_observation_file(obs.where(F.col("stations_id") == station).select(
            F.col("stations_id").alias("STATIONS_ID"), F.col("mess_datum").alias("MESS_DATUM"),
            *[F.col(a).alias(b) for a, b in cols.items()]), os.path.join(base, name))
    chosen = spark.createDataFrame([(1, "a.csv"), (3, "b.csv")], "station long, link string")
    with pytest.raises(ValueError):
        weather_from_stations(spark, chosen, base)
    absent = tuple(c for c in PRODUCT_NAMES.values() if c not in ("tt_tu_lufttemperatur", "v_n_bedeckungsgrad"))
    wx = weather_from_stations(spark, chosen, base, absent)
    assert wx.count() == obs.select("mess_datum").distinct().count()
    assert wx.where(F.col("lufttemperatur").isNull()).count() == 0
    assert wx.where(F.col("luftdruck").isNotNull()).count() == 0     # no file for it -> NULL
    assert wx.where(F.col("niederschlagsindikator").isNotNull()).count() == 0


def test_report_datasets_and_sink(spark):
    t = Tables(spark, SF)
    det = t.by_user()
    out = t.user_outages()
    per = t.user_period()
    tabs = report.report_tables(det, out, "2024-01-22")
    charts = report.report_charts(det, per, out)
    assert set(tabs) == {"top_bottom_vogelarten", "vogelarten_haeufigkeiten",
                         "woechentliche_veraenderungen", "neue_vogelarten", "unterbrechungen"}
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    paths = report.write_report(tabs, d)
    assert sorted(os.path.basename(p) for p in paths.values()) == [
        "1_top_bottom_vogelarten", "2_vogelarten_haeufigkeiten", "3_woechentliche_veraenderungen",
        "4_neue_vogelarten", "5_unterbrechungen"]
    assert spark.read.parquet(paths["unterbrechungen"]).count() == out.count()
    assert charts["heatmap_erkennungen"].count() % 24 == 0
    assert charts["taegliche_erkennungen_trend"].where(F.col("trend").isNull()).count() == 0


def test_event_study_plan(spark):
    t = Tables(spark, SF)
    res = event_study(t.orders(), "1-URGENT", "1996-03-01", "1996-12-31", "1996-05-01")
    weeks = res["wochen"].collect()
    assert weeks and all(0 <= r.anteil_art <= 1 for r in weeks)
    assert res["gesamt"].first().gesamt == sum(r.erkennungen for r in weeks)
    assert 1 <= res["extrema"].count() <= len(weeks)


def test_write_report_csv(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    paths = report.write_report({"eins": df, "zwei": df}, d, fmt="csv")
    assert os.path.basename(paths["zwei"]) == "2_zwei"
    back = spark.read.option("header", True).csv(paths["eins"]).collect()
    assert [tuple(r) for r in back] == [("1", "a")]


def test_verified_report_notices_what_is_missing_or_changed(spark, tmp_path):
    from dawnchorus.plans import report
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "n int, s string")
    report.write_verified_report(spark, {"a": a, "leer": a.limit(0), "b": a.select("n"), "c": a}, str(tmp_path))
    rows = report.verify_report(spark, str(tmp_path)).orderBy("nr").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 3, 3, True), (2, "leer", 0, 0, True), (3, "b", 3, 3, True), (4, "c", 3, 3, True)]
    a.withColumn("s", a.n.cast("string")).write.mode("overwrite").parquet(str(tmp_path / "1_a"))
    (tmp_path / "3_b").rename(tmp_path / "moved")
    a.limit(2).write.mode("overwrite").parquet(str(tmp_path / "4_c"))
    rows = report.verify_report(spark, str(tmp_path)).orderBy("nr").collect()
    assert [(r.gelesen, r.stimmt) for r in rows] == [(3, False), (0, True), (None, False), (2, False)]
