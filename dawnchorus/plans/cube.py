"""The detection count cube: detections per (hour, species).

Most report outputs only count detections by day, hour, week and species.
Aggregating the raw detections once to one row per (hour, species) — a table
bounded by hours × species, not by the number of detections — and deriving
every count-based output from it replaces a dozen scans of the raw table by
one.  The cube keeps the detection schema's key columns (``zeitstempel`` is
the full hour) plus the count ``n``; pass ``weight="n"`` to the operators.

The cube is checkpointed to the shared folder (reliable, survives executor
loss) so the outputs built on it do not recompute the raw aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus.functions.calendar import floor_hour
from dawnchorus.operators import grids, models, species, study
from dawnchorus.session import shared_dir

WEIGHT = "n"
#: log2 of a sketch's registers: at most 4 KB each.
SKETCH_BITS = 12
GRAINS = ("day", "week", "month", "quarter", "year")


def detection_cube(df: DataFrame, ts: str = "zeitstempel",
                   keys: tuple[str, ...] = ("deutscher_name", "wissenschaftlicher_name"),
                   checkpoint: bool = True) -> DataFrame:
    """One row per (hour, species keys) with the number of detections ``n``."""
    cube = df.groupBy(floor_hour(ts).alias(ts), *keys).agg(F.count(F.lit(1)).alias(WEIGHT))
    if checkpoint:
        shared_dir(df.sparkSession)
        cube = cube.checkpoint(eager=True)
    return cube


def counted_outputs(cube: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """All count-based species, grid and study outputs from one cube."""
    w = WEIGHT
    return {
        "anzahl_vogelarten": species.species_count(cube, weight=w),
        "erkennungen_am_tag": species.daily(cube, weight=w),
        "top10": species.top_species(cube, weight=w),
        "bottom10": species.bottom_species(cube, weight=w),
        "haeufigkeiten": species.species_frequency(cube, weight=w),
        "neue_vogelarten": species.new_species(cube, weight=w),
        "woechentliche_veraenderungen": species.weekly_change(cube, as_of, weight=w),
        "taegliche_erkennungen": grids.daily_counts_grid(cube, weight=w),
        "heatmap_erkennungen": grids.hour_grid(cube, "count", weight=w),
        "heatmap_vogelarten": grids.hour_grid(cube, "species", weight=w),
        "haeufigste_vogelarten": grids.top_shares(cube, weight=w),
        "top_vogelarten_zeitverlauf": grids.top_daily(cube, weight=w),
        "stunden_matrix": models.hour_matrix(cube, weight=w),
    }


def study_from_cube(cube: DataFrame, species_name: str, start: str, end: str) -> DataFrame:
    return study.weekly_share(cube, species_name, start, end, weight=WEIGHT)


def sketch_bound(bits: int = SKETCH_BITS, sigmas: float = 4.0) -> float:
    """Relative error that an estimate of united sketches keeps within, but for one in some 10,000
    (``sigmas`` standard errors of 1.04 / sqrt(registers))."""
    return sigmas * 1.04 / math.sqrt(2 ** bits)


def distinct_sketches(cube: DataFrame, value: str = "deutscher_name", ts: str = "zeitstempel", bits: int = SKETCH_BITS) -> DataFrame:
    """One HyperLogLog sketch of the values a day: ``tag``, ``skizze``.

    Sums of daily distinct counts say nothing of a week; sketches unite to any
    grain, so no coarser count goes back to the values.  A table of one row a day, to be stored.
    NULL values are not counted.
    """
    return (cube.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("tag"))
            .agg(F.hll_sketch_agg(value, bits).alias("skizze")))


def _begin(grain: str, c: str) -> Column:
    if grain not in GRAINS:
        raise ValueError(f"one of {GRAINS}, not {grain}")
    return F.to_date(F.date_trunc(grain, c))


def distinct_at(sketches: DataFrame, grain: str) -> DataFrame:
    """Estimated distinct values a ``grain`` from stored sketches: ``beginn``, ``geschaetzt``; see ``sketch_bound``."""
    return sketches.groupBy(_begin(grain, "tag").alias("beginn")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("skizze")).alias("geschaetzt"))


def distinct_exactly(cube: DataFrame, grain: str, value: str = "deutscher_name", ts: str = "zeitstempel") -> DataFrame:
    """The exact way: ``beginn``, ``genau``.  Values are first made distinct (partial aggregation), then counted."""
    pairs = cube.where(F.col(ts).isNotNull()).select(_begin(grain, ts).alias("beginn"), value).distinct()
    return pairs.groupBy("beginn").agg(F.count(value).alias("genau"))
