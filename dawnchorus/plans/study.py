"""The event study: weekly share of one species with extrema labels."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dawnchorus.functions.labels import STUDY_END, STUDY_MARK_FROM, STUDY_SPECIES, STUDY_START
from dawnchorus.operators import study


def event_study(df: DataFrame, species_name: str = STUDY_SPECIES, start: str = STUDY_START,
                end: str = STUDY_END, mark_from: str = STUDY_MARK_FROM) -> dict[str, DataFrame]:
    weekly = study.weekly_share(df, species_name, start, end)
    return {
        "wochen": study.mark_interval(weekly, df, mark_from),
        "extrema": study.label(study.extrema(weekly)),
        "gesamt": study.total(weekly),
    }
