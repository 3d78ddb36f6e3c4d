"""Registered queries: each ``(spark, sf_dir) -> DataFrame`` over whole test tables.

The adapters in ``dawnchorus.sources.testdata`` cast the test tables into the
detection data model; ``dawnchorus.plans.oracle`` holds the independent SQL of
each query.  Floating outputs are rounded with ``q6`` (same expression in the
SQL) so that summation order cannot change a value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.functions.calendar import simple_week
from dawnchorus.functions.labels import TABLE_LABELS
from dawnchorus.operators import cleaning, grids, models, species, study, tables, weather
from dawnchorus.plans import report
from dawnchorus.plans.cube import detection_cube, distinct_at, distinct_exactly, distinct_sketches, sketch_bound
from dawnchorus.session import scratch_path, written
from dawnchorus.sources import archive, detections as det_src, testdata as td
from dawnchorus.sources.weather import PRODUCT_NAMES, load_weather, write_observation_file

# Parameters of the queries over the test tables (the reference's defaults
# refer to its own calendar; the test tables cover other dates).
EVENTS_FROM = "2024-01-03"      # observation period start for `events`
ORDERS_AS_OF = "1998-07-01"     # "today" of the weekly change on `orders`
# Columns of the wide outputs, the same at every scale factor.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LAST_WEEKS = [(2001, 23), (2001, 24), (2001, 25), (2001, 26)]
STUDY_SPECIES = "1-URGENT"
STUDY_START, STUDY_END, STUDY_MARK = "1996-03-01", "1996-12-31", "1996-05-01"


def q6(c, digits: int = 6) -> F.Column:
    """Round to ``digits`` decimals as round(x·10^d)/10^d (identical in the SQL oracle)."""
    c = F.col(c) if isinstance(c, str) else c
    m = float(10 ** digits)
    return F.round(c * m) / m + 0.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Apply ``q6`` to every double column."""
    return df.withColumns({f.name: q6(f.name, digits) for f in df.schema.fields
                           if isinstance(f.dataType, T.DoubleType)})


class Tables:
    """Lazy access to the adapted test tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name):
        return td.table(self.spark, self.dir, name)

    def by_type(self):
        return td.detections_by_type(self.raw("events"))

    def by_user(self):
        return td.detections_by_user(self.raw("events"))

    def orders(self):
        return td.detections_from_orders(self.raw("orders"))

    def by_customer(self):
        return td.detections_by_customer(self.raw("orders"))

    def observations(self):
        return td.weather_observations(self.raw("events"))

    def weather(self):
        return weather.weather_table(self.observations())

    def enriched(self):
        return weather.enrich(td.detections_without_errors(self.raw("events")), self.weather())

    def stations(self):
        return td.station_index(self.raw("supplier"), self.raw("lineitem"))

    def user_outages(self):
        return cleaning.outages(self.by_user(), partition="station")

    def user_period(self):
        return cleaning.observation_period(self.by_user(), from_ts=EVENTS_FROM)


def _t(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


# --- ingest -----------------------------------------------------------------

def q_detections_csv(spark, sf_dir):
    """I1 + I2 + I3: detections written as the raw CSV layout, read back typed."""
    d = _t(spark, sf_dir).by_type()
    raw = d.select(
        F.date_format("zeitstempel", "yyyy-MM-dd").alias("Date"),
        F.date_format("zeitstempel", "HH:mm:ss").alias("Time"),
        F.col("wissenschaftlicher_name").alias("Sci_Name"),
        F.col("deutscher_name").alias("Com_Name"),
        F.col("erkennungswahrscheinlichkeit").alias("Confidence"),
        F.col("schwellenwert").alias("Cutoff"), F.col("empfindlichkeit").alias("Sens"),
        F.col("breitengrad").alias("Lat"), F.col("laengengrad").alias("Lon"),
        F.col("ueberlappung").alias("Overlap"))
    path = scratch_path(spark, "detections_csv")
    raw.write.mode("overwrite").option("header", True).csv(path)
    return det_src.to_detections(det_src.read_detections(spark, path))


def q_species_rank(spark, sf_dir):
    """I4"""
    return cleaning.freq_rank(_t(spark, sf_dir).by_user(), "deutscher_name")


def q_station_outages(spark, sf_dir):
    """I5"""
    return _t(spark, sf_dir).user_outages()


def q_observation_period(spark, sf_dir):
    """I6"""
    return cleaning.observation_period(_t(spark, sf_dir).by_type(), from_ts=EVENTS_FROM)


def q_complete_days(spark, sf_dir):
    """I7"""
    t = _t(spark, sf_dir)
    return cleaning.complete_days(t.by_user(), t.user_period(), t.user_outages(),
                                  partition="station")


def q_weather_profile(spark, sf_dir):
    """I8"""
    return rounded(cleaning.profile(_t(spark, sf_dir).weather(), exact=True))


def q_weather_levels(spark, sf_dir):
    """I8 for text columns: how often each label occurs"""
    return cleaning.profile_levels(_t(spark, sf_dir).weather(), ["niederschlagsindikator", "bedeckungsgrad"])


def q_weather_times(spark, sf_dir):
    """I8 for time columns: extremes and quartiles"""
    return cleaning.profile_times(_t(spark, sf_dir).weather(), ["wetterzeit"], exact=True)


# --- weather ----------------------------------------------------------------

def q_nearby_stations(spark, sf_dir):
    """W1"""
    t = _t(spark, sf_dir)
    return rounded(weather.nearby_stations(t.stations(), weather.last_position(t.by_type())))


def q_best_stations(spark, sf_dir):
    """W2"""
    t = _t(spark, sf_dir)
    return rounded(weather.best_station(
        weather.nearby_stations(t.stations(), weather.last_position(t.by_type()))))


def _stations_by_user(t, stations):
    return weather.stations_near(stations, weather.last_positions(t.by_user()).withColumnRenamed("station", "position"), "position")


def q_stations_near(spark, sf_dir):
    """W1 for the position of every user: figures of the stations in reach"""
    t = _t(spark, sf_dir)
    found = _stations_by_user(t, t.stations())
    return rounded(found.groupBy("position").agg(
        F.count(F.lit(1)).alias("stationen"), F.min("dist").alias("naechste"), F.max("dist").alias("fernste")))


def q_best_stations_near(spark, sf_dir):
    """W2 for the position of every user"""
    t = _t(spark, sf_dir)
    return rounded(weather.best_station(_stations_by_user(t, weather.newest_at_each_place(t.stations())), "position"))


# Observation files as the weather service ships them: one per station, headers
# are the product codes.
_STATION_PRODUCTS = {1: ("TT_TU", "RF_TU"), 2: ("P", "V_TE005"),
                     3: ("RS_IND", "V_N", "R1", "SD_SO", "F")}


def q_weather_files(spark, sf_dir):
    """W3 (+W4–W6): each station's observations staged as a service file (product
    codes, padded cells, -999), loaded, stacked and collapsed."""
    obs = written(_t(spark, sf_dir).observations(), "observations")
    base = scratch_path(spark, "weather_files")
    paths = []
    for station, codes in _STATION_PRODUCTS.items():
        out = (obs.where(F.col("stations_id") == station)
               .select(F.col("stations_id").alias("STATIONS_ID"),
                       F.col("mess_datum").alias("MESS_DATUM"),
                       *[F.col(PRODUCT_NAMES[c]).alias(c) for c in codes]))
        p = f"{base}/station_{station}"
        write_observation_file(out, p)
        paths.append(p)
    return rounded(weather.weather_table(load_weather(spark, paths)))


def q_weather_collapse(spark, sf_dir):
    """W4"""
    return rounded(weather.collapse_stations(_t(spark, sf_dir).observations()))


def q_hourly_weather(spark, sf_dir):
    """W5 + W6"""
    return rounded(_t(spark, sf_dir).weather())


# --- enrichment and archive -------------------------------------------------

def q_enriched(spark, sf_dir):
    """E1 + E2"""
    return rounded(_t(spark, sf_dir).enriched())


def q_orders_by_season(spark, sf_dir):
    """E2 on a multi-year calendar"""
    d = weather.season(_t(spark, sf_dir).orders())
    return d.groupBy("jahreszeit", "jahreszeit_nr").agg(F.count(F.lit(1)).alias("erkennungen"))


def q_snapshot_archive(spark, sf_dir):
    """E3 + E4: dated snapshots (one repeats the current rows, one lacks a column)
    and one under another name, merged with the current rows."""
    cur = written(_t(spark, sf_dir).enriched(), "enriched")
    d = scratch_path(spark, "archive")
    archive.write_snapshot(cur, d, "2024-01-30")
    archive.write_snapshot(cur.drop("jahreszeit_nr"), d, "2024-01-31")
    cur.write.options(**archive.CSV_OPTIONS).csv(f"{d}/older/garden backup.csv")
    return rounded(archive.merge_snapshots(spark, cur, d))


def q_archive_stream(spark, sf_dir):
    """E3 + E4 incrementally: parquet snapshots (the current rows, a copy without
    one column, then a repeat) streamed into a date-partitioned archive."""
    from dawnchorus.streaming import archive_stream, read_archive
    cur = _t(spark, sf_dir).enriched()
    base = scratch_path(spark, "archive_stream")
    incoming, arch = f"{base}/incoming", f"{base}/archive"
    cur.persist(StorageLevel.MEMORY_AND_DISK)   # written three times below
    try:
        for i, snap in enumerate([cur, cur.drop("jahreszeit_nr"), cur]):
            archive.write_snapshot(snap, incoming, f"run{i}", fmt="parquet")
            archive_stream(spark, incoming, arch, f"{base}/checkpoint").awaitTermination()
    finally:
        cur.unpersist()
    return rounded(read_archive(spark, arch))


# --- species statistics -----------------------------------------------------

def q_species_count(spark, sf_dir):
    """R1"""
    return species.species_count(_t(spark, sf_dir).by_user())


def q_daily(spark, sf_dir):
    """R2"""
    return species.daily(_t(spark, sf_dir).by_type())


def q_top_species(spark, sf_dir):
    """R3"""
    return rounded(species.top_species(_t(spark, sf_dir).by_user()))


def q_bottom_species(spark, sf_dir):
    """R4"""
    return rounded(species.bottom_species(_t(spark, sf_dir).by_user()))


def q_species_frequency(spark, sf_dir):
    """R5"""
    return rounded(species.species_frequency(_t(spark, sf_dir).by_user()))


def q_new_species(spark, sf_dir):
    """R6"""
    return species.new_species(_t(spark, sf_dir).by_user())


def q_running_species(spark, sf_dir):
    """R6b / R6c"""
    r = species.running_species_set(_t(spark, sf_dir).by_user())
    return r.select("jahr", "kalenderwoche",
                    F.size("alle_vogelarten").alias("anzahl_alle"),
                    F.array_join("alle_vogelarten", ", ").alias("alle_vogelarten"),
                    F.array_join("neue_vogelarten", ", ").alias("neue_vogelarten"))


def q_weekly_change(spark, sf_dir):
    """R7"""
    return rounded(species.weekly_change(_t(spark, sf_dir).orders(), ORDERS_AS_OF))


# --- models -----------------------------------------------------------------

def q_hour_matrix(spark, sf_dir):
    """M1"""
    return models.hour_matrix(_t(spark, sf_dir).by_type(), names=EVENT_TYPES)


def q_species_kendall(spark, sf_dir):
    """M2"""
    d = _t(spark, sf_dir).by_type()
    names = models.top_names(d)
    k = models.kendall(models.hour_matrix(d, names=names), names)
    return rounded(k.select("term", "vogelart", "korrelation", "n"))


def q_corr_pairs(spark, sf_dir):
    """M3"""
    return rounded(models.corr_pairs(_t(spark, sf_dir).by_type()))


def q_features_count(spark, sf_dir):
    """M4"""
    return rounded(models.hourly_features(_t(spark, sf_dir).enriched(), "count"))


def q_features_confidence(spark, sf_dir):
    """M5"""
    return rounded(models.hourly_features(_t(spark, sf_dir).enriched(), "confidence"))


def q_normalized_features(spark, sf_dir):
    """M6"""
    f = models.hourly_features(_t(spark, sf_dir).enriched(), "count")
    cols = ["anzahl_erkennungen"] + models.FEATURES
    return rounded(models.normalize(f, cols))


_REG_Y, _REG_X = "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]


def _lineitem_fit(spark, sf_dir):
    return models.ols(td.regression_frame(_t(spark, sf_dir).raw("lineitem")), _REG_Y, _REG_X)


def q_ols_coefficients(spark, sf_dir):
    """M7 + M9 (estimates, standard errors, t values)"""
    return rounded(_lineitem_fit(spark, sf_dir).tidy(p_values=False))


def q_ols_glance(spark, sf_dir):
    """M8 (closed-form fields)"""
    return rounded(_lineitem_fit(spark, sf_dir).glance(p_value=False), 4)


def q_ols_tidy(spark, sf_dir):
    """M9 with p-values"""
    return rounded(_lineitem_fit(spark, sf_dir).tidy())


def _weather_fit(spark, sf_dir, target):
    f = models.hourly_features(_t(spark, sf_dir).enriched(), target)
    y = "anzahl_erkennungen" if target == "count" else "erkennungswahrscheinlichkeit_in_prozent"
    return models.ols(f, y, models.FEATURES)


def q_weather_regression(spark, sf_dir):
    """M4 → M6 → M7 → M9"""
    return rounded(_weather_fit(spark, sf_dir, "count").tidy())


def q_weather_coefficients(spark, sf_dir):
    """M4 → M6 → M7 → M9 without p-values (estimates, std. errors, t values)"""
    return rounded(_weather_fit(spark, sf_dir, "count").tidy(p_values=False))


def q_confidence_regression(spark, sf_dir):
    """M5 → M6 → M7 → M8"""
    return rounded(_weather_fit(spark, sf_dir, "confidence").glance())


def q_confidence_glance(spark, sf_dir):
    """M5 → M6 → M7 → M8 (closed-form fields, without the F test's p-value)"""
    return rounded(_weather_fit(spark, sf_dir, "confidence").glance(p_value=False), 4)


def q_weather_forest(spark, sf_dir):
    """M10"""
    return rounded(models.forest(_weather_fit(spark, sf_dir, "count").tidy()))


def q_daily_trend(spark, sf_dir):
    """M11 / C4"""
    return rounded(report.chart_daily_detections(_t(spark, sf_dir).orders()))


def q_species_trend(spark, sf_dir):
    """M11 / C5"""
    return rounded(report.chart_daily_species(_t(spark, sf_dir).by_user()))


def q_top_trend(spark, sf_dir):
    """M12 / C7"""
    return rounded(report.chart_top_daily(_t(spark, sf_dir).by_type()))


# --- grids and chart data ---------------------------------------------------

def q_daily_grid(spark, sf_dir):
    """C1"""
    return grids.daily_counts_grid(_t(spark, sf_dir).orders())


def q_season_spans(spark, sf_dir):
    """C2 (seasons per year)"""
    return grids.season_spans(_t(spark, sf_dir).orders(), by_year=True)


def q_season_spans_reference(spark, sf_dir):
    """C2 (the reference's season test, all years merged)"""
    return grids.season_spans(_t(spark, sf_dir).orders(), mode="reference")


def q_outage_labels(spark, sf_dir):
    """C3"""
    t = _t(spark, sf_dir)
    return grids.outage_labels(t.user_outages(), t.user_period())


def q_top_shares(spark, sf_dir):
    """C6"""
    return rounded(grids.top_shares(_t(spark, sf_dir).by_user()))


def q_top_daily(spark, sf_dir):
    """C7"""
    return grids.top_daily(_t(spark, sf_dir).by_user())


def q_hour_grid_detections(spark, sf_dir):
    """C8"""
    return grids.hour_grid(_t(spark, sf_dir).orders(), "count")


def q_hour_grid_species(spark, sf_dir):
    """C9"""
    return grids.hour_grid(_t(spark, sf_dir).by_type(), "species")


def q_hour_grid_clock(spark, sf_dir):
    """C8 with every hour of the clock and missing days"""
    return grids.hour_grid(td.detections_round_the_clock(_t(spark, sf_dir).raw("orders")), "count")


def q_hour_grid_clock_species(spark, sf_dir):
    """C9 with every hour of the clock and missing days"""
    return grids.hour_grid(td.detections_round_the_clock(_t(spark, sf_dir).raw("orders")), "species")


def q_corr_pairs_users(spark, sf_dir):
    """M3 where the top ten restricts"""
    return rounded(models.corr_pairs(_t(spark, sf_dir).by_user()))


def q_distinct_sketches(spark, sf_dir):
    """R2 / C5 from daily sketches united to weeks, months and years: exact counts, and whether the estimate keeps its bound"""
    cube = detection_cube(_t(spark, sf_dir).by_customer())
    daily = written(distinct_sketches(cube), "day-sketches")
    out = None
    for grain in ("day", "week", "month", "year"):
        near = F.abs(F.col("geschaetzt") - F.col("genau")) <= F.greatest(F.lit(sketch_bound()) * F.col("genau"), F.lit(1.0))
        one = (distinct_exactly(cube, grain).join(distinct_at(daily, grain), "beginn")
               .select(F.lit(grain).alias("einheit"), "beginn", "genau", near.alias("im_rahmen")))
        out = one if out is None else out.unionByName(one)
    return out


def q_caption(spark, sf_dir):
    """C10"""
    t = _t(spark, sf_dir)
    d = t.by_type()
    return rounded(tables.caption(d, cleaning.observation_period(d, from_ts=EVENTS_FROM)))


def q_caption_regression(spark, sf_dir):
    """C10 with the R² of the weather regression"""
    t = _t(spark, sf_dir)
    d = t.by_type()
    r2 = _weather_fit(spark, sf_dir, "count").r2
    return rounded(tables.caption(d, cleaning.observation_period(d, from_ts=EVENTS_FROM), r_squared=r2))


# --- report tables ----------------------------------------------------------

def q_top_bottom(spark, sf_dir):
    """T1"""
    return tables.top_bottom(_t(spark, sf_dir).by_user())


def q_frequency_table(spark, sf_dir):
    """T2"""
    return tables.frequency_table(_t(spark, sf_dir).by_user())


def q_weekly_change_wide(spark, sf_dir):
    """T3"""
    return rounded(tables.weekly_change_wide(_t(spark, sf_dir).orders(), ORDERS_AS_OF, slots=LAST_WEEKS))


def q_new_species_wide(spark, sf_dir):
    """T4"""
    return tables.new_species_wide(_t(spark, sf_dir).by_user(), weeks=[1, 2, 3, 4, 5])


def q_outage_table(spark, sf_dir):
    """T5"""
    return tables.outage_table(_t(spark, sf_dir).user_outages())


def q_labelled_frequency(spark, sf_dir):
    """T6"""
    return tables.labelled(tables.frequency_table(_t(spark, sf_dir).by_user()),
                           TABLE_LABELS["vogelarten_haeufigkeiten"])


def q_labelled_top_bottom(spark, sf_dir):
    """T6 of T1"""
    return tables.labelled(q_formatted_top_bottom(spark, sf_dir), TABLE_LABELS["top_bottom_vogelarten"])


def q_labelled_weekly_change(spark, sf_dir):
    """T6 of T3, numbers without decimals"""
    wide = tables.weekly_change_wide(_t(spark, sf_dir).orders(), ORDERS_AS_OF, slots=LAST_WEEKS)
    weeks = [c for c in wide.columns if c.startswith("KW ")]
    return tables.labelled(tables.fmt_number(wide, weeks), TABLE_LABELS["woechentliche_veraenderungen"])


def q_labelled_new_species(spark, sf_dir):
    """T6 of T4"""
    return tables.labelled(q_new_species_wide(spark, sf_dir), TABLE_LABELS["neue_vogelarten"])


def q_labelled_outages(spark, sf_dir):
    """T6 of T5"""
    return tables.labelled(q_outage_table(spark, sf_dir), TABLE_LABELS["unterbrechungen"])


def q_formatted_top_bottom(spark, sf_dir):
    """T7"""
    return tables.fmt_number(tables.top_bottom(_t(spark, sf_dir).by_user()),
                             ["top10_haeufigkeit", "bottom10_haeufigkeit"])


def q_report_sink(spark, sf_dir):
    """The report tables written as numbered datasets; one read back."""
    t = _t(spark, sf_dir)
    d = t.by_user()
    paths = report.write_report(
        {"top_bottom_vogelarten": tables.top_bottom(d),
         "unterbrechungen": tables.outage_table(t.user_outages())},
        scratch_path(spark, "report"))
    return spark.read.parquet(paths["top_bottom_vogelarten"])


def q_report_manifest(spark, sf_dir):
    """All datasets of a report verified after the writing"""
    t = _t(spark, sf_dir)
    d, path = t.by_user(), scratch_path(spark, "report")
    report.write_verified_report(spark, {
        "top_bottom_vogelarten": tables.top_bottom(d), "haeufigkeiten": species.species_frequency(d),
        "neue_vogelarten": species.new_species(d), "unterbrechungen": tables.outage_table(t.user_outages())}, path)
    return report.verify_report(spark, path)


def _weeks(df):
    d = F.to_date("zeitstempel")
    return df.select(F.year(d).alias("jahr"), simple_week(d).alias("kalenderwoche"), "deutscher_name")


def q_running_set(spark, sf_dir):
    """R6b / R6c in general, over weeks"""
    return species.running_set(_weeks(_t(spark, sf_dir).by_user()), ["jahr", "kalenderwoche"], "deutscher_name")


def q_running_set_customers(spark, sf_dir):
    """R6b / R6c in general, over weeks of several years"""
    return species.running_set(_weeks(_t(spark, sf_dir).by_customer()), ["jahr", "kalenderwoche"], "deutscher_name")


def q_kendall_users(spark, sf_dir):
    """M2 where the top ten restricts"""
    d = _t(spark, sf_dir).by_user()
    names = models.top_names(d)
    k = models.kendall(models.hour_matrix(d, names=names), names)
    return rounded(k.select("term", "vogelart", "korrelation", "n"))


def q_corr_pairs_principal(spark, sf_dir):
    """M3 in the order of the first principal component"""
    return rounded(models.corr_pairs(_t(spark, sf_dir).by_type(), order="principal"))


def q_grouped_ols(spark, sf_dir):
    """M7 for each supplier"""
    return rounded(models.grouped_ols(_t(spark, sf_dir).raw("lineitem"), "l_suppkey", "l_extendedprice", ["l_quantity"]), 4)


def q_station_periods(spark, sf_dir):
    """I6 for each station"""
    return cleaning.station_periods(_t(spark, sf_dir).by_user(), from_ts=EVENTS_FROM, min_per_day=3)


def q_station_complete_days(spark, sf_dir):
    """I7 for each station"""
    t = _t(spark, sf_dir)
    d = t.by_user()
    return cleaning.complete_station_days(d, cleaning.station_periods(d, from_ts=EVENTS_FROM, min_per_day=3), t.user_outages())


# --- many species over several years: thresholds cut, first weeks spread ------

def q_species_count_customers(spark, sf_dir):
    """R1"""
    return species.species_count(_t(spark, sf_dir).by_customer())


def q_top_species_customers(spark, sf_dir):
    """R3"""
    return rounded(species.top_species(_t(spark, sf_dir).by_customer()))


def q_bottom_species_customers(spark, sf_dir):
    """R4"""
    return rounded(species.bottom_species(_t(spark, sf_dir).by_customer()))


def q_species_frequency_customers(spark, sf_dir):
    """R5"""
    return rounded(species.species_frequency(_t(spark, sf_dir).by_customer()))


def q_new_species_customers(spark, sf_dir):
    """R6"""
    return species.new_species(_t(spark, sf_dir).by_customer())


def q_new_species_wide_customers(spark, sf_dir):
    """T4"""
    return tables.new_species_wide(_t(spark, sf_dir).by_customer(), weeks=list(range(1, 54)))


def q_top_trend_users(spark, sf_dir):
    """The top ten of many species, with days on which some are not seen"""
    return rounded(report.chart_top_daily(_t(spark, sf_dir).by_user()))


def q_single_trend(spark, sf_dir):
    """M12 for a single group"""
    return rounded(report.chart_top_daily(_t(spark, sf_dir).orders(), k=1))


# --- the same outputs from the count cube -----------------------------------

def _cube(frame):
    return detection_cube(frame)


def q_cube_daily(spark, sf_dir):
    """R2 from the count cube"""
    return species.daily(_cube(_t(spark, sf_dir).by_type()), weight="n")


def q_cube_top_species(spark, sf_dir):
    """R3 from the count cube"""
    return rounded(species.top_species(_cube(_t(spark, sf_dir).by_user()), weight="n"))


def q_cube_new_species(spark, sf_dir):
    """R6 from the count cube"""
    return species.new_species(_cube(_t(spark, sf_dir).by_user()), weight="n")


def q_cube_weekly_change(spark, sf_dir):
    """R7 from the count cube"""
    return rounded(species.weekly_change(_cube(_t(spark, sf_dir).orders()), ORDERS_AS_OF, weight="n"))


def q_cube_hour_matrix(spark, sf_dir):
    """M1 from the count cube"""
    return models.hour_matrix(_cube(_t(spark, sf_dir).by_type()), names=EVENT_TYPES, weight="n")


def q_cube_hour_grid(spark, sf_dir):
    """C8 from the count cube"""
    return grids.hour_grid(_cube(_t(spark, sf_dir).orders()), "count", weight="n")


def q_cube_weekly_share(spark, sf_dir):
    """U1 from the count cube"""
    return rounded(study.weekly_share(_cube(_t(spark, sf_dir).orders()), STUDY_SPECIES,
                                      STUDY_START, STUDY_END, weight="n"))


# --- event study ------------------------------------------------------------

def _weekly(spark, sf_dir):
    return study.weekly_share(_t(spark, sf_dir).orders(), STUDY_SPECIES, STUDY_START, STUDY_END)


def q_weekly_share(spark, sf_dir):
    """U1"""
    return rounded(_weekly(spark, sf_dir))


def q_share_extrema(spark, sf_dir):
    """U2 + U3"""
    return rounded(study.label(study.extrema(_weekly(spark, sf_dir))))


def q_study_total(spark, sf_dir):
    """U4"""
    return study.total(_weekly(spark, sf_dir))


def q_marked_weeks(spark, sf_dir):
    """U5"""
    return rounded(study.mark_interval(_weekly(spark, sf_dir), _t(spark, sf_dir).orders(),
                                       STUDY_MARK))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "detections_csv": q_detections_csv,
    "species_rank": q_species_rank,
    "station_outages": q_station_outages,
    "observation_period": q_observation_period,
    "complete_days": q_complete_days,
    "weather_profile": q_weather_profile,
    "nearby_stations": q_nearby_stations,
    "best_stations": q_best_stations,
    "stations_near": q_stations_near,
    "hour_grid_clock": q_hour_grid_clock,
    "hour_grid_clock_species": q_hour_grid_clock_species,
    "corr_pairs_users": q_corr_pairs_users,
    "distinct_sketches": q_distinct_sketches,
    "best_stations_near": q_best_stations_near,
    "weather_files": q_weather_files,
    "weather_collapse": q_weather_collapse,
    "hourly_weather": q_hourly_weather,
    "enriched": q_enriched,
    "orders_by_season": q_orders_by_season,
    "snapshot_archive": q_snapshot_archive,
    "archive_stream": q_archive_stream,
    "species_count": q_species_count,
    "daily": q_daily,
    "top_species": q_top_species,
    "bottom_species": q_bottom_species,
    "species_frequency": q_species_frequency,
    "new_species": q_new_species,
    "running_species": q_running_species,
    "weekly_change": q_weekly_change,
    "hour_matrix": q_hour_matrix,
    "species_kendall": q_species_kendall,
    "corr_pairs": q_corr_pairs,
    "features_count": q_features_count,
    "features_confidence": q_features_confidence,
    "normalized_features": q_normalized_features,
    "ols_coefficients": q_ols_coefficients,
    "ols_glance": q_ols_glance,
    "ols_tidy": q_ols_tidy,
    "weather_regression": q_weather_regression,
    "weather_coefficients": q_weather_coefficients,
    "confidence_regression": q_confidence_regression,
    "confidence_glance": q_confidence_glance,
    "weather_forest": q_weather_forest,
    "daily_trend": q_daily_trend,
    "species_trend": q_species_trend,
    "top_trend": q_top_trend,
    "daily_grid": q_daily_grid,
    "season_spans": q_season_spans,
    "season_spans_reference": q_season_spans_reference,
    "outage_labels": q_outage_labels,
    "top_shares": q_top_shares,
    "top_daily": q_top_daily,
    "hour_grid_detections": q_hour_grid_detections,
    "hour_grid_species": q_hour_grid_species,
    "caption": q_caption,
    "top_bottom": q_top_bottom,
    "frequency_table": q_frequency_table,
    "weekly_change_wide": q_weekly_change_wide,
    "new_species_wide": q_new_species_wide,
    "outage_table": q_outage_table,
    "labelled_frequency": q_labelled_frequency,
    "labelled_top_bottom": q_labelled_top_bottom,
    "labelled_weekly_change": q_labelled_weekly_change,
    "labelled_new_species": q_labelled_new_species,
    "labelled_outages": q_labelled_outages,
    "caption_regression": q_caption_regression,
    "weather_levels": q_weather_levels,
    "weather_times": q_weather_times,
    "formatted_top_bottom": q_formatted_top_bottom,
    "report_sink": q_report_sink,
    "report_manifest": q_report_manifest,
    "running_set": q_running_set,
    "running_set_customers": q_running_set_customers,
    "kendall_users": q_kendall_users,
    "corr_pairs_principal": q_corr_pairs_principal,
    "grouped_ols": q_grouped_ols,
    "station_periods": q_station_periods,
    "station_complete_days": q_station_complete_days,
    "species_count_customers": q_species_count_customers,
    "top_species_customers": q_top_species_customers,
    "bottom_species_customers": q_bottom_species_customers,
    "species_frequency_customers": q_species_frequency_customers,
    "new_species_customers": q_new_species_customers,
    "new_species_wide_customers": q_new_species_wide_customers,
    "top_trend_users": q_top_trend_users,
    "single_trend": q_single_trend,
    "weekly_share": q_weekly_share,
    "cube_daily": q_cube_daily,
    "cube_top_species": q_cube_top_species,
    "cube_new_species": q_cube_new_species,
    "cube_weekly_change": q_cube_weekly_change,
    "cube_hour_matrix": q_cube_hour_matrix,
    "cube_hour_grid": q_cube_hour_grid,
    "cube_weekly_share": q_cube_weekly_share,
    "share_extrema": q_share_extrema,
    "study_total": q_study_total,
    "marked_weeks": q_marked_weeks,
}
