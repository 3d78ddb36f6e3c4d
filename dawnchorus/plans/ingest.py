"""The import flow: raw detections -> cleaned, complete-day, weather-enriched
detections, plus outages, period and the selected stations.  One lazy graph;
only the station file list is materialised (one path per weather variable)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from dawnchorus.functions.labels import MIN_PER_DAY, PERIOD_FROM, STATION_RADIUS_KM
from dawnchorus.operators.cleaning import complete_days, observation_period, outages
from dawnchorus.operators.weather import (
    best_station, enrich, last_position, nearby_stations, weather_table,
)
from dawnchorus.sources.weather import load_weather


@dataclass
class ImportResult:
    detections: DataFrame
    outages: DataFrame
    period: DataFrame
    stations: DataFrame
    weather: DataFrame
    enriched: DataFrame


def import_detections(detections: DataFrame, weather_observations: DataFrame,
                      stations: DataFrame | None = None, from_ts: str = PERIOD_FROM,
                      min_per_day: int = MIN_PER_DAY, partition: str | None = None,
                      radius_km: float = STATION_RADIUS_KM) -> ImportResult:
    """Cleaning → outages → period → complete days → weather → enrichment."""
    out = outages(detections, partition=partition)
    period = observation_period(detections, from_ts=from_ts, min_per_day=min_per_day)
    complete = complete_days(detections, period, out, partition=partition)
    chosen = (best_station(nearby_stations(stations, last_position(complete), radius_km))
              if stations is not None else None)
    weather = weather_table(weather_observations)
    return ImportResult(complete, out, period, chosen, weather, enrich(complete, weather))


def weather_from_stations(spark: SparkSession, chosen: DataFrame, base_dir: str,
                          optional: tuple[str, ...] = ()) -> DataFrame:
    """Read the staged observation file of every chosen station (W3 → W4–W6).

    The chosen list has one row per weather variable (≤ 7), so collecting the
    links is bounded.  Measurements that no chosen station makes are named in
    ``optional`` and become NULL; any other that is missing raises.
    """
    links = [f"{base_dir.rstrip('/')}/{r.link}" for r in chosen.select("link").collect()]
    return weather_table(load_weather(spark, links), optional=optional)
