"""Event study of one species: weekly share (U1), extrema (U2), labels (U3),
total (U4), highlighted interval (U5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.functions.calendar import week_start_sunday
from dawnchorus.functions.formatting import de_number
from dawnchorus.functions.labels import STUDY_END, STUDY_MARK_FROM, STUDY_SPECIES, STUDY_START
from dawnchorus.operators.counting import n_rows, n_where
from dawnchorus.operators.species import SPECIES


def weekly_share(df: DataFrame, species_name: str = STUDY_SPECIES, start: str = STUDY_START,
                 end: str = STUDY_END, ts: str = "zeitstempel",
                 species: str = SPECIES, weight: str | None = None) -> DataFrame:
    """Per week (weeks start on Sunday) within [start, end]: all detections,
    detections of ``species_name`` and its share.

    The date range becomes a pushed-down time-stamp predicate; one grouped
    aggregate with a map-side partial step.
    """
    d = F.to_date(F.col(ts))
    return (df.where(d.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
            .groupBy(week_start_sunday(d).alias("woche"))
            .agg(n_rows(weight).alias("erkennungen"),
                 n_where(F.col(species) == species_name, weight).alias("erkennungen_art"))
            .withColumn("anteil_art", F.col("erkennungen_art") / F.col("erkennungen")))


def extrema(df: DataFrame, col: str = "anteil_art") -> DataFrame:
    """Rows at the global minimum or maximum of ``col`` (ties kept)."""
    lo = df.select(F.min(col)).scalar()
    hi = df.select(F.max(col)).scalar()
    return df.where((F.col(col) == lo) | (F.col(col) == hi))


def label(df: DataFrame, suffix: str = " Amseln erkannt",
          col: str = "erkennungen_art") -> DataFrame:
    """Text label ``1.234 Amseln erkannt``."""
    return df.withColumn("label", F.concat(de_number(col), F.lit(suffix)))


def total(df: DataFrame, col: str = "erkennungen") -> DataFrame:
    """U4: total detections of the study (one row, number and German text)."""
    return df.agg(F.sum(col).cast("long").alias("gesamt")).withColumn("gesamt_text", de_number("gesamt"))


def mark_interval(weekly: DataFrame, detections: DataFrame, mark_from: str = STUDY_MARK_FROM,
                  ts: str = "zeitstempel") -> DataFrame:
    """Flag weeks inside the highlighted interval [mark_from, last date]."""
    last = detections.select(F.max(F.to_date(F.col(ts)))).scalar()
    return weekly.withColumns({
        "markiert": F.col("woche") >= F.to_date(F.lit(mark_from)),
        "markierung_beginn": F.to_date(F.lit(mark_from)),
        "markierung_ende": last,
    })
