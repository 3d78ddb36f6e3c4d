"""Weather: station search (W1, W2), collapse (W4), code recoding (W5),
renaming (W6), hourly enrichment (E1) and seasons (E2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.functions.calendar import floor_hour, pick, season_label, season_ordinal
from dawnchorus.functions.geo import SphereGrid, haversine_km
from dawnchorus.functions.labels import (
    CLOUD_LABELS, PRECIPITATION_LABELS, STATION_RADIUS_KM, WEATHER_RENAMES,
    WEATHER_VARIABLES,
)

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def last_position(det: DataFrame, ts: str = "zeitstempel", lat: str = "breitengrad",
                  lon: str = "laengengrad") -> DataFrame:
    """Latitude/longitude of the latest detection: one row (global ``max_by``).

    Ties on the time stamp are broken by the larger coordinates, so the result
    is deterministic.
    """
    key = F.struct(F.col(ts), F.col(lat), F.col(lon))
    return det.where(F.col(ts).isNotNull()).agg(
        F.max_by(F.col(lat), key).alias("lat"), F.max_by(F.col(lon), key).alias("lon"))


def nearby_stations(stations: DataFrame, position: DataFrame,
                    radius_km: float = STATION_RADIUS_KM, res: str = "hourly",
                    per: str = "recent", variables: list[str] | None = None,
                    lat: str = "geo_breite", lon: str = "geo_laenge") -> DataFrame:
    """Stations within ``radius_km`` of a point with the wanted resolution,
    period and variable; rows with any NULL are dropped.

    ``position`` is a one-row frame ``(lat, lon)``; its values enter as scalar
    subqueries, so the search is a plain filter over the station index (no
    join).  A latitude band (1° ≈ 111 km) is checked before the trigonometry.
    """
    variables = variables or WEATHER_VARIABLES
    p_lat = position.select("lat").scalar()
    p_lon = position.select("lon").scalar()
    dist = haversine_km(p_lat, p_lon, F.col(lat), F.col(lon))
    band = F.abs(F.col(lat) - p_lat) <= F.lit(radius_km / 111.0 + 0.01)
    out = (stations
           .where(band & (F.col("res") == res) & (F.col("per") == per)
                  & F.col("var").isin(*variables))
           .withColumn("dist", dist)
           .where(F.col("dist") <= radius_km))
    return out.dropna()


def last_positions(det: DataFrame, by: str = "station", ts: str = "zeitstempel", lat: str = "breitengrad",
                   lon: str = "laengengrad") -> DataFrame:
    """The latest position of each ``by`` (microphone): (by, lat, lon); ties as in ``last_position``."""
    key = F.struct(F.col(ts), F.col(lat), F.col(lon))
    return det.where(F.col(ts).isNotNull()).groupBy(by).agg(
        F.max_by(F.col(lat), key).alias("lat"), F.max_by(F.col(lon), key).alias("lon"))


def stations_near(stations: DataFrame, positions: DataFrame, by: str = "station", radius_km: float = STATION_RADIUS_KM,
                  res: str = "hourly", per: str = "recent", variables: list[str] | None = None,
                  lat: str = "geo_breite", lon: str = "geo_laenge") -> DataFrame:
    """W1 for many positions ``(by, lat, lon)``: each with every station within the radius.

    An equi-join on the cells of a grid on the sphere: a station is in one cell, a place
    in the few cells that its circle can reach, so a pair meets at most once, and only
    neighbours meet; then the exact distance.  The pairs are made last and leave the join as a
    stream: none is shuffled or sorted here.  Rows with any NULL are dropped, as in ``nearby_stations``.
    """
    variables = variables or WEATHER_VARIABLES
    grid = SphereGrid(radius_km)
    wanted = stations.where((F.col("res") == res) & (F.col("per") == per) & F.col("var").isin(*variables))
    wanted = wanted.dropna().withColumn("_cell", grid.cell(lat, lon))
    places = (positions.select(by, "lat", "lon").dropna()
              .select(by, "lat", "lon", F.explode(grid.cells_near("lat", "lon")).alias("_cell")))
    return (places.join(wanted, "_cell")
            .withColumn("dist", haversine_km("lat", "lon", F.col(lat), F.col(lon)))
            .where(F.col("dist") <= radius_km).select(by, *stations.columns, "dist"))


def newest_at_each_place(stations: DataFrame, lat: str = "geo_breite", lon: str = "geo_laenge") -> DataFrame:
    """The stations that ``best_station`` can choose: of those at one place that measure one variable
    (at one resolution and period) the newest, then the one with the smallest id.

    From any position the stations of a place are equally far, so no other can come before it; a search for
    many positions then pairs them with places, not with every station there.  Rows with any NULL, which the
    searches drop, are dropped first.
    """
    w = Window.partitionBy("var", "res", "per", lat, lon).orderBy(F.desc("bis_datum"), F.asc("stations_id"))
    return stations.dropna().withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def best_station(df: DataFrame, by: str | None = None) -> DataFrame:
    """Per variable (and per ``by``, for many positions) the station with the newest
    data; nearest breaks ties, then the station id.  Exactly one row per variable
    (``WindowGroupLimit`` keeps only the top row per partition before the final window)."""
    keys = [by] if by else []
    w = Window.partitionBy(*keys, "var").orderBy(F.desc("bis_datum"), F.asc("dist"),
                                          F.asc("stations_id"))
    top = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return top.select(
        *[F.col(k).alias("position") for k in keys],
        F.col("stations_id").alias("station"),
        F.col("stationsname").alias("ort"),
        F.col("var").alias("wettervariable"),
        F.col("dist").alias("entfernung"),
        F.col("url").alias("link"),
    )


def collapse_stations(df: DataFrame, key: str = "mess_datum",
                      missing: str = "zero") -> DataFrame:
    """Per time stamp, the sum of every numeric column ignoring NULLs.

    ``missing="zero"`` (reference behaviour): a column with no value in that
    hour sums to 0; ``missing="null"`` keeps NULL.  Partial aggregation before
    the shuffle, so a hot hour costs no more than any other.
    """
    nums = [f.name for f in df.schema.fields
            if f.name != key and isinstance(f.dataType, _NUMERIC)]
    aggs = []
    for c in nums:
        s = F.sum(F.col(c).cast("double"))
        aggs.append((F.coalesce(s, F.lit(0.0)) if missing == "zero" else s).alias(c))
    return df.groupBy(key).agg(*aggs)


def recode(code, labels: list[str]):
    """Integer code -> (label, legal code).  Codes outside 0..len-1 -> NULL."""
    c = F.col(code) if isinstance(code, str) else code
    legal = F.when(c.isin(*[float(i) for i in range(len(labels))]), c.cast("int"))
    label = pick(legal + 1, labels)
    return label, legal


def to_weather(collapsed: DataFrame, key: str = "mess_datum", optional: tuple[str, ...] = ()) -> DataFrame:
    """W5 + W6: collapsed observations -> weather schema.

    Labels and their numeric codes are both kept (the code is what a model
    uses as a number).  A measurement without a column raises, as a wrong header
    would otherwise pass for missing values; those named in ``optional`` (no
    station nearby measures them) are NULL.
    """
    have = set(collapsed.columns)
    needed = {"rs_ind_niederschlagsindikator", "v_n_bedeckungsgrad", *WEATHER_RENAMES}
    if lost := sorted(needed - have - set(optional)):
        raise ValueError(f"no column for the measurements {', '.join(lost)}")

    def src(c):
        return F.col(c) if c in have else F.lit(None).cast("double")

    p_label, p_code = recode(src("rs_ind_niederschlagsindikator"), PRECIPITATION_LABELS)
    c_label, c_code = recode(src("v_n_bedeckungsgrad"), CLOUD_LABELS)
    measures = [
        (F.col(src) if src in have else F.lit(None).cast("double")).alias(dst)
        for src, dst in WEATHER_RENAMES.items()
    ]
    return collapsed.select(
        F.col(key).cast("timestamp_ntz").alias("wetterzeit"),
        p_label.alias("niederschlagsindikator"),
        p_code.alias("niederschlagsindikator_code"),
        c_label.alias("bedeckungsgrad"),
        c_code.alias("bedeckungsgrad_in_okta"),
        *measures,
    )


def weather_table(observations: DataFrame, missing: str = "zero", optional: tuple[str, ...] = ()) -> DataFrame:
    """W4 → W5 → W6 in one lazy plan."""
    return to_weather(collapse_stations(observations, "mess_datum", missing), optional=optional)


def season(df: DataFrame, ts: str = "zeitstempel") -> DataFrame:
    """Meteorological season label and its ordinal (1 = Frühling … 4 = Winter)."""
    return df.withColumns({"jahreszeit": season_label(ts), "jahreszeit_nr": season_ordinal(ts)})


def enrich(det: DataFrame, weather: DataFrame, ts: str = "zeitstempel") -> DataFrame:
    """E1 + E2: hourly weather of each detection, inner join on the full hour.

    Detections of hours without weather are dropped.  The weather side has one
    row per hour; AQE broadcasts it when its measured size is under the
    broadcast threshold and otherwise keeps a shuffle join (skew-join handling
    splits a hot hour).  No ordering is imposed: sort only where a consumer
    needs it.
    """
    d = det.withColumn("wetterzeit", floor_hour(ts))
    return season(d.join(weather, "wetterzeit", "inner"), ts)
