"""The report: every chart dataset and table, and the sink that writes them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dawnchorus.functions.labels import TABLE_LABELS
from dawnchorus.operators import grids, models, species, tables


def chart_daily_detections(df: DataFrame) -> DataFrame:
    """C4: completed daily counts with their Poisson trend."""
    return models.poisson_trend(grids.daily_counts_grid(df), "anzahl_erkennungen")


def chart_daily_species(df: DataFrame) -> DataFrame:
    """Completed daily species counts (ribbon 0..n) with their Poisson trend."""
    return models.poisson_trend(grids.daily_species_grid(df), "anzahl_vogelarten")


def chart_top_daily(df: DataFrame, k: int = 10) -> DataFrame:
    """C7 + M12: daily counts of the top species with one trend per species."""
    return models.grouped_poisson_trend(grids.top_daily(df, k), "anzahl", "deutscher_name")


def report_tables(df: DataFrame, outage_df: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """The named tables of the report with readable column labels, in report order."""
    changes = tables.weekly_change_wide(df, as_of)
    plain = {
        "top_bottom_vogelarten": tables.fmt_number(tables.top_bottom(df),
                                                   ["top10_haeufigkeit", "bottom10_haeufigkeit"]),
        "vogelarten_haeufigkeiten": tables.frequency_table(df),
        "woechentliche_veraenderungen": tables.fmt_number(
            changes, [c for c in changes.columns if c.startswith("KW ")]),
        "neue_vogelarten": tables.new_species_wide(df),
        "unterbrechungen": tables.outage_table(outage_df),
    }
    return {name: tables.labelled(table, TABLE_LABELS[name]) for name, table in plain.items()}


def report_charts(df: DataFrame, period: DataFrame, outage_df: DataFrame) -> dict[str, DataFrame]:
    """The data behind each chart (rendering is not part of the library)."""
    return {
        "taegliche_erkennungen_trend": chart_daily_detections(df),
        "taegliche_vogelarten": chart_daily_species(df),
        "jahreszeiten": grids.season_spans(df),
        "unterbrechungen_anmerkungen": grids.outage_labels(outage_df, period),
        "haeufigste_vogelarten": grids.top_shares(df),
        "top_vogelarten_zeitverlauf": chart_top_daily(df),
        "heatmap_erkennungen": grids.hour_grid(df, "count"),
        "heatmap_vogelarten": grids.hour_grid(df, "species"),
        "heatmap_korrelationen": models.corr_pairs(df),
    }


def write_report(datasets: dict[str, DataFrame], directory: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every dataset as ``{nr}_{name}`` (1-based in dict order).

    Each dataset is written by its own distributed job; nothing is collected.
    Returns name → path.
    """
    paths = {}
    for nr, (name, df) in enumerate(datasets.items(), start=1):
        path = f"{directory.rstrip('/')}/{nr}_{name}"
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(path)
        else:
            w.format(fmt).save(path)
        paths[name] = path
    return paths


_MANIFEST = "nr int, name string, pfad string, format string, zeilen long, pruefsumme decimal(38,0)"


def _totals(df: DataFrame) -> list:
    """Number of rows, and a sum of their hashes that does not depend on their order."""
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("zeilen"), F.coalesce(F.sum(row_hash), F.lit(0)).cast("decimal(38,0)").alias("pruefsumme")]


def write_verified_report(spark: SparkSession, datasets: dict[str, DataFrame], directory: str) -> DataFrame:
    """T8 with a manifest: write every dataset as Parquet ``{nr}_{name}``, and ``manifest`` beside them.

    Row counts and hash totals are observed while the rows are written (no second pass over the plan), so the
    manifest says what the job put out and ``verify_report`` whether that is what can be read.
    """
    rows = []
    for nr, (name, df) in enumerate(datasets.items(), start=1):
        path, seen = f"{directory.rstrip('/')}/{nr}_{name}", Observation(f"report-{nr}-{uuid.uuid4().hex[:8]}")
        df.observe(seen, *_totals(df)).write.mode("overwrite").parquet(path)
        found = seen.get
        rows.append((nr, name, path, "parquet", found["zeilen"], found["pruefsumme"]))
    manifest = spark.createDataFrame(rows, _MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{directory.rstrip('/')}/manifest")
    return manifest


def verify_report(spark: SparkSession, directory: str) -> DataFrame:
    """The manifest of a written report with ``gelesen`` (rows read back) and ``stimmt`` (counts and totals agree).

    A dataset that is missing or cannot be read has a null count and does not agree.
    """
    rows = []
    # one row a dataset of the report
    for m in spark.read.schema(_MANIFEST).parquet(f"{directory.rstrip('/')}/manifest").collect():
        try:
            df = spark.read.format(m["format"]).load(m["pfad"])
            got = df.agg(*_totals(df)).first()
        except Exception as error:  # noqa: BLE001  a missing or damaged dataset is a result here
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error) and "FAILED_READ_FILE" not in str(error):
                raise
            got = {"zeilen": None, "pruefsumme": None}
        same = (got["zeilen"], got["pruefsumme"]) == (m["zeilen"], m["pruefsumme"])
        rows.append((m["nr"], m["name"], m["zeilen"], got["zeilen"], same))
    return spark.createDataFrame(rows, "nr int, name string, zeilen long, gelesen long, stimmt boolean")


def species_overview(df: DataFrame) -> dict[str, DataFrame]:
    """Descriptive statistics printed by the reference before the models."""
    return {
        "anzahl_vogelarten": species.species_count(df),
        "erkennungen_am_tag": species.daily(df),
        "top10": species.top_species(df),
        "bottom10": species.bottom_species(df),
        "haeufigkeiten": species.species_frequency(df),
        "neue_vogelarten": species.new_species(df),
    }


__all__ = ["chart_daily_detections", "chart_daily_species", "chart_top_daily",
           "report_tables", "report_charts", "write_report", "write_verified_report",
           "verify_report", "species_overview"]
