"""Report tables: top/bottom (T1), formatted frequency table (T2), weekly
change wide (T3), new species wide (T4), outages (T5), labels (T6), number
formatting (T7), caption facts (C10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.functions.formatting import de_date, de_number
from dawnchorus.functions.labels import MIN_OBSERVATIONS
from dawnchorus.operators.species import (
    SCIENTIFIC, SPECIES, bottom_species, new_species, species_frequency, top_species, weekly_change,
)
from dawnchorus.session import written


def top_bottom(df: DataFrame, k: int = 10, min_obs: int = MIN_OBSERVATIONS,
               species: str = SPECIES) -> DataFrame:
    """Top-k and bottom-k side by side by rank 1..k.

    Both inputs have at most ``k`` rows, so the numbering windows and the full
    outer join work on ≤ k rows each.  Missing ranks are NULL (the reference
    would fail when there are fewer than k species).
    """
    def ranked(frame, order, prefix):
        w = Window.orderBy(*order)
        return frame.select(F.row_number().over(w).alias("rang"),
                            F.col(species).alias(prefix),
                            F.col("absolute_haeufigkeit").alias(f"{prefix}_haeufigkeit"))

    top = ranked(top_species(df, k, species),
                 [F.desc("absolute_haeufigkeit"), F.asc(species)], "top10")
    bottom = ranked(bottom_species(df, k, min_obs, species),
                    [F.asc("absolute_haeufigkeit"), F.asc(species)], "bottom10")
    return top.join(bottom, "rang", "full")


def fmt_number(df: DataFrame, cols: list[str], decimals: int = 0) -> DataFrame:
    """German-formatted numbers (``.`` thousands, ``,`` decimals)."""
    return df.withColumns({c: de_number(c, decimals) for c in cols})


def frequency_table(df: DataFrame, min_obs: int = MIN_OBSERVATIONS,
                    species: str = SPECIES) -> DataFrame:
    """Ranked frequency table with German-formatted counts and shares."""
    f = species_frequency(df, min_obs, species)
    return fmt_number(f.select("rang", species, "wissenschaftlicher_name", "absolut", "relativ"),
                      ["absolut", "relativ"], 0)


def labelled(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Readable column labels."""
    return df.withColumnsRenamed(labels)


def _week_slots(changes: DataFrame, n_weeks: int) -> list[tuple[int, int]]:
    """The last ``n_weeks`` (ISO year, week) pairs — at most n_weeks rows."""
    rows = (changes.select("jahr", "kalenderwoche").distinct()
            .orderBy(F.desc("jahr"), F.desc("kalenderwoche")).limit(n_weeks).collect())
    return sorted((r.jahr, r.kalenderwoche) for r in rows)


def weekly_change_wide(df: DataFrame, as_of: str, k: int = 10, n_weeks: int = 4,
                       species: str = SPECIES, ts: str = "zeitstempel",
                       slots: list[tuple[int, int]] | None = None) -> DataFrame:
    """rows = top-k species, columns = change % of the last ``n_weeks``
    weeks (``KW <week>``), oldest to newest; rows by the newest week's change,
    descending.

    The change is computed once and written (species × years × weeks rows).
    The weeks are chosen *before* pivoting — the last ones of the data, or the
    given ``slots`` (ISO year, week) — and the pivot runs on an integer
    (year·100 + week) with explicit values, so columns come out in calendar
    order and two years with the same week number cannot collide.
    """
    ch = written(weekly_change(df, as_of, ts, species), "weekly-change")
    slots = sorted(slots) if slots is not None else _week_slots(ch, n_weeks)
    keys = [y * 100 + w for y, w in slots]
    top = top_species(df, k, species, SCIENTIFIC if SCIENTIFIC in df.columns else None).select(species).distinct()
    wide = (ch.join(F.broadcast(top), species, "left_semi")
            .withColumn("_slot", F.col("jahr") * 100 + F.col("kalenderwoche"))
            .where(F.col("_slot").isin(*keys))
            .groupBy(species).pivot("_slot", keys).agg(F.first("prozentuale_veraenderung")))
    names = {str(key): f"KW {w}" if len({w for _, w in slots}) == len(slots) else f"KW {w}/{y}"
             for key, (y, w) in zip(keys, slots)}
    if keys:
        wide = wide.orderBy(F.desc_nulls_last(f"`{keys[-1]}`"), species)
    return wide.withColumnsRenamed(names)


def new_species_wide(df: DataFrame, min_obs: int = MIN_OBSERVATIONS, ts: str = "zeitstempel",
                     species: str = SPECIES, weeks: list[int] | None = None) -> DataFrame:
    """T4: new species per week as columns ``KW <week>``, numbered rows, blanks
    for missing cells.  Like the reference, species are numbered within a week's label
    (week number), across years, and species of different years stand in different
    rows, so that a number can come once for each year; columns stand in the order in
    which the weeks first appear, or as given in ``weeks``."""
    ns = written(new_species(df, min_obs, ts, species), "new-species")  # one row per species
    w = Window.partitionBy("kalenderwoche").orderBy("jahr", "neue_vogelarten")
    numbered = ns.withColumn("nummer", F.row_number().over(w))
    if weeks is None:
        first = ns.groupBy("kalenderwoche").agg(F.min("jahr").alias("jahr")).orderBy("jahr", "kalenderwoche")
        weeks = [r["kalenderwoche"] for r in first.collect()]  # at most 53
    wide = (numbered.groupBy("nummer", "jahr").pivot("kalenderwoche", weeks)
            .agg(F.first("neue_vogelarten")).drop("jahr"))
    wide = wide.withColumnsRenamed({str(x): f"KW {x}" for x in weeks})
    return wide.fillna("", subset=[f"KW {x}" for x in weeks])


def outage_table(outage_df: DataFrame) -> DataFrame:
    """T5: outages with dates as dd.MM.yyyy."""
    keys = [c for c in outage_df.columns if c not in ("beginn", "ende", "dauer")]
    return outage_df.select(*keys, de_date("beginn").alias("beginn"), de_date("ende").alias("ende"),
                            F.col("dauer").alias("dauer_in_tage"))


def caption(df: DataFrame, period: DataFrame, ts: str = "zeitstempel",
            r_squared: float | None = None) -> DataFrame:
    """One row of caption facts.

    N (German format), period bounds as dd.MM.yyyy, and the confidence cutoff ×
    100 of the oldest detection (the reference's "last row" after its
    newest-first sort; ties resolved by the larger cutoff).
    """
    oldest_first = F.struct(F.col(ts), -F.col("schwellenwert"))
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.when(F.col(ts).isNotNull(), F.col("schwellenwert")),
                 F.when(F.col(ts).isNotNull(), oldest_first)).alias("_cut"))
    out = facts.select(
        de_number("n").alias("n_text"),
        de_date(period.select("beginn").scalar()).alias("beginn_text"),
        de_date(period.select("ende").scalar()).alias("ende_text"),
        (F.col("_cut") * 100).alias("konfidenz_prozent"))
    if r_squared is not None:
        out = out.withColumn("r2_text", de_number(F.round(F.lit(r_squared), 2), 2))
    return out
