"""Adapters: the driver's test tables seen through the detection data model.

The reference's inputs (a detections CSV, a station index, weather files) are
not shipped, so the generic test tables play their roles.  Every adapter is a
lazy projection of the whole table; the matching SQL lives in
``dawnchorus.plans.oracle`` and must stay in step with this module.

| role                        | table / columns                                        |
| --------------------------- | ------------------------------------------------------ |
| detections, few species     | events: ts, species = event_type                       |
| detections, many species    | events: ts, species = user_id, station = user_id       |
| detections, long calendar   | orders: o_orderdate, species = o_orderpriority         |
| many species, long calendar | orders: o_orderdate, species = o_custkey               |
| raw weather observations    | events of type 'error', one reading per event          |
| detections next to weather  | events of the other types                              |
| station index               | supplier + latest l_shipdate per supplier (lineitem)   |
| regression                  | lineitem: l_extendedprice ~ quantity, discount, tax    |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus.functions.calendar import floor_hour, pick
from dawnchorus.functions.labels import WEATHER_VARIABLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _detection_cols(ts, species, sci, confidence, cutoff, lat, lon, extra=()):
    return [
        F.col(ts).cast("timestamp_ntz").alias("zeitstempel"),
        sci.alias("wissenschaftlicher_name"),
        species.alias("deutscher_name"),
        confidence.cast("double").alias("erkennungswahrscheinlichkeit"),
        cutoff.cast("double").alias("schwellenwert"),
        F.lit(1.25).alias("empfindlichkeit"),
        lat.alias("breitengrad"),
        lon.alias("laengengrad"),
        F.lit(0.0).alias("ueberlappung"),
        *extra,
    ]


def _confidence(x) -> F.Column:
    """A confidence in [0, 1): whole units / 512.  Binary fractions add up
    exactly in floating point, so means do not depend on summation order."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x) / 512


def _cutoff_from_props() -> F.Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("double") / 100


def _lat() -> F.Column:
    return F.lit(51.85) + F.col("user_id") / 1000


def _lon() -> F.Column:
    return F.lit(6.62) + F.col("user_id") / 1000


def detections_by_type(events: DataFrame) -> DataFrame:
    """Few species: the event type is the species."""
    return events.select(*_detection_cols(
        "ts", F.col("event_type"), F.upper("event_type"), _confidence("value"),
        _cutoff_from_props(), _lat(), _lon()))


def detections_by_user(events: DataFrame) -> DataFrame:
    """Many species: every user is a species; ``station`` = user for outages."""
    uid = F.lpad(F.col("user_id").cast("string"), 6, "0")
    return events.select(*_detection_cols(
        "ts", F.concat(F.lit("Art "), uid), F.concat(F.lit("Species "), uid),
        _confidence("value"), _cutoff_from_props(), _lat(), _lon(),
        extra=[F.col("user_id").alias("station")]))


def detections_from_orders(orders: DataFrame) -> DataFrame:
    """Long calendar: order dates over several years, priority = species."""
    return orders.select(*_detection_cols(
        "o_orderdate", F.col("o_orderpriority"), F.lower("o_orderpriority"),
        _confidence(F.col("o_totalprice") / 1000), F.lit(0.7), F.lit(51.85), F.lit(6.62)))


def detections_round_the_clock(orders: DataFrame) -> DataFrame:
    """Hours of a real clock with gaps: order dates drawn out to every second day, at
    the hour of the order's number; priority = species."""
    first = F.lit("1992-01-01").cast("date")
    day = F.date_add(first, 2 * F.date_diff(F.to_date("o_orderdate"), first)).cast("timestamp_ntz")
    clock = orders.withColumn("_ts", day + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int")))
    return clock.select(*_detection_cols(
        "_ts", F.col("o_orderpriority"), F.lower("o_orderpriority"),
        _confidence(F.col("o_totalprice") / 1000), F.lit(0.7), F.lit(51.85), F.lit(6.62)))


def detections_by_customer(orders: DataFrame) -> DataFrame:
    """Many species over a long calendar: every customer is a species.  Some have
    fewer than ten rows, and first weeks spread over several years."""
    key = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    return orders.select(*_detection_cols(
        "o_orderdate", F.concat(F.lit("Art "), key), F.concat(F.lit("Species "), key),
        _confidence(F.col("o_totalprice") / 1000), F.lit(0.7), F.lit(51.85), F.lit(6.62)))


def weather_observations(events: DataFrame) -> DataFrame:
    """Raw hourly readings of three stations, stacked like the loaded files.

    All events of an hour give one reading (the value of the largest user id, and
    the smallest user id).  Station 1 measures temperature and humidity, station 2
    pressure and soil temperature, station 3 the sky: precipitation, cloud
    cover, sunshine and wind.  Columns a station does not measure are NULL, so
    the collapse step (W4) sums exactly one value per hour and column.  Codes
    can leave their legal range (precipitation 2, cloud 9) and wind is missing
    for a quarter of the hours.
    """
    hourly = (events.groupBy(floor_hour("ts").alias("mess_datum"))
              .agg(F.max(F.struct("user_id", "value"))["value"].alias("_v"), F.min("user_id").alias("_u")))
    v, fv, u = F.col("_v"), F.floor(F.col("_v")), F.col("_u")
    null = F.lit(None).cast("double")
    cols = {
        "tt_tu_lufttemperatur": (1, v % 30 - 5),
        "rf_tu_relative_feuchte": (1, v % 100),
        "p_luftdruck_nn": (2, (v * 7) % 40 + 990),
        "v_te005_erdbodentemperatur_005cm": (2, F.sqrt(v)),
        "rs_ind_niederschlagsindikator": (3, (fv % 3).cast("double")),
        "v_n_bedeckungsgrad": (3, (fv % 10).cast("double")),
        "r1_niederschlagshoehe": (3, (v % 7) / 10),
        "sd_so_sonnenscheindauer": (3, (fv % 61).cast("double")),
        "f_windgeschwindigkeit": (3, F.when(u % 4 == 0, null).otherwise(v / 40)),
    }
    # one row per station and hour from the single hourly aggregate (no re-scan)
    stations = F.array(*[
        F.struct(F.lit(station).cast("long").alias("stations_id"),
                 *[(expr if st == station else null).alias(name) for name, (st, expr) in cols.items()])
        for station in (1, 2, 3)])
    return hourly.select("mess_datum", F.inline(stations)).select(
        "stations_id", "mess_datum", *cols)


def detections_without_errors(events: DataFrame) -> DataFrame:
    """Detections that meet the hourly weather: all events but the 'error' ones."""
    return detections_by_type(events.where(F.col("event_type") != "error"))


def station_index(supplier: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Station index: one station per supplier.

    ``bis_datum`` (end of the station's data) is the latest ship date of the
    supplier: a partial/final hash aggregate over the whole lineitem table.
    """
    last_ship = (lineitem.groupBy("l_suppkey")
                 .agg(F.to_date(F.max("l_shipdate")).alias("bis_datum")))
    var = pick((F.col("s_suppkey") % 7 + 1).cast("int"), WEATHER_VARIABLES)
    s = supplier.select(
        F.col("s_suppkey").alias("stations_id"),
        F.col("s_name").alias("stationsname"),
        var.alias("var"),
        F.when(F.col("s_suppkey") % 5 == 4, "daily").otherwise("hourly").alias("res"),
        F.when(F.col("s_nationkey") % 4 == 0, "historical").otherwise("recent").alias("per"),
        (F.lit(51.0) + (F.col("s_suppkey") % 17) / 10).alias("geo_breite"),
        (F.lit(6.0) + (F.col("s_suppkey") % 13) / 8).alias("geo_laenge"),
        F.concat(F.lit("stations/"), F.col("s_suppkey").cast("string"), F.lit("/"),
                 var, F.lit(".csv")).alias("url"),
    )
    return s.join(last_ship, s.stations_id == last_ship.l_suppkey, "left").drop("l_suppkey")


def regression_frame(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_extendedprice", "l_quantity", "l_discount", "l_tax")
