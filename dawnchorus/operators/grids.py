"""Densified calendar grids and chart data: C1, C2, C3, C6, C7, C8, C9.

Every grid is generated from a one-row aggregate (min / max date) by
``explode(sequence(...))``: its size is the number of calendar days (× 24
hours), independent of the number of detections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.functions.calendar import date_seq, hour24, pick, season_ordinal
from dawnchorus.functions.labels import SEASONS
from dawnchorus.operators.counting import n_rows
from dawnchorus.operators.species import SCIENTIFIC, SPECIES, daily, distinct_species


def _day(ts: str = "zeitstempel"):
    return F.to_date(F.col(ts))


def calendar(df: DataFrame, date_col: str = "datum", measure: str | None = None) -> DataFrame:
    """Every date from the minimum to the maximum of ``date_col`` (one column).

    ``measure`` names a positive column of ``df`` (the count of an aggregate);
    it is summed along with the bounds, so the bounds must be read from ``df``
    itself: when ``df`` is an aggregate its shuffle is then shared with the
    other uses of ``df`` instead of Catalyst re-deriving the dates from the
    raw rows (one scan instead of two).
    """
    aggs = [F.min(date_col).alias("_a"), F.max(date_col).alias("_b")]
    keep = F.col("_a").isNotNull()
    if measure is not None:
        aggs.append(F.sum(measure).alias("_m"))
        keep = keep & (F.col("_m") > 0)   # referenced, so it is not pruned away
    return (df.agg(*aggs).where(keep)
            .select(F.explode(date_seq("_a", "_b")).alias(date_col)))


def complete_days_grid(per_day: DataFrame, date_col: str = "datum",
                       count_col: str | None = None) -> DataFrame:
    """A per-day frame completed with every missing date (values NULL).

    ``count_col`` names a positive per-day count of ``per_day`` (lets the
    calendar share ``per_day``'s shuffle, see ``calendar``).
    """
    # a NULL date never matches the calendar; filtering it up front keeps both
    # uses of ``per_day`` identical (one shared shuffle)
    per_day = per_day.where(F.col(date_col).isNotNull())
    return calendar(per_day, date_col, count_col).join(per_day, date_col, "left")


def daily_counts_grid(df: DataFrame, ts: str = "zeitstempel", weight: str | None = None) -> DataFrame:
    """C1 applied to the daily detection count."""
    per_day = df.groupBy(_day(ts).alias("datum")).agg(n_rows(weight).alias("anzahl_erkennungen"))
    return complete_days_grid(per_day, count_col="anzahl_erkennungen")


def daily_species_grid(df: DataFrame, ts: str = "zeitstempel", species: str = SPECIES,
                       weight: str | None = None) -> DataFrame:
    """C1 applied to the daily number of species (with ``ymin`` = 0 for a ribbon)."""
    per_day = daily(df, ts, species, weight).select("datum", F.col("vogelarten").alias("anzahl_vogelarten"))
    return complete_days_grid(per_day, count_col="anzahl_vogelarten").withColumn("ymin", F.lit(0))


def _reference_season(d):
    """The reference chart's season, kept for ``mode='reference'``: the quarters
    of the year from March on, and as winter only January and February of leap
    years (its test asks for a 29 February and never admits December).
    """
    month = F.month(d)
    leap = F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))) == 366
    return F.when(month.between(3, 11), F.floor(month / 3).cast("int")).when((month <= 2) & leap, F.lit(4))


def season_spans(df: DataFrame, ts: str = "zeitstempel", by_year: bool = False,
                 mode: str = "meteorological") -> DataFrame:
    """Per season the first date, last date and midpoint of the calendar.

    Works on the completed calendar (C1), so outage days count.  ``ende`` is
    moved one day on (closing the gap between bands) unless it is the last
    date overall.  ``by_year`` separates the seasons of different years
    (December belongs to the following winter); without it, like the
    reference, all springs form one span.  ``mode='reference'`` reproduces the
    reference's season test (see ``_reference_season``).
    """
    per_day = (df.where(F.col(ts).isNotNull())
               .groupBy(_day(ts).alias("datum")).agg(F.count(F.lit(1)).alias("_n")))
    days = calendar(per_day, "datum", "_n")
    if mode == "reference":
        nr = _reference_season(F.col("datum"))
    else:
        nr = season_ordinal(F.col("datum"))
    days = days.withColumn("jahreszeit_nr", nr)
    keys = ["jahreszeit_nr"]
    if by_year:
        days = days.withColumn(
            "saisonjahr", F.year("datum") + F.when(F.month("datum") == 12, 1).otherwise(0))
        keys = ["saisonjahr", "jahreszeit_nr"]
    last = per_day.agg(F.struct(F.max("datum").alias("d"), F.count("_n").alias("m"))).scalar().getField("d")
    spans = days.groupBy(*keys).agg(F.min("datum").alias("beginn"), F.max("datum").alias("ende"))
    labels = pick("jahreszeit_nr", SEASONS)
    return spans.select(
        *keys, labels.alias("jahreszeit"), "beginn",
        F.when(F.col("ende") < last, F.date_add("ende", 1)).otherwise(F.col("ende")).alias("ende"),
        F.date_add("beginn", F.floor(F.datediff("ende", "beginn") / 2).cast("int")).alias("mitte"))


def outage_labels(outage_df: DataFrame, period: DataFrame) -> DataFrame:
    """Outages starting within the period, their midpoint and label."""
    lo = period.select("beginn").scalar()
    return (outage_df.where(F.col("beginn") >= lo)
            .select(*outage_df.columns,
                    F.date_add("beginn", F.floor(F.datediff("ende", "beginn") / 2).cast("int"))
                    .alias("mittelwert"),
                    F.concat(F.col("dauer").cast("string"), F.lit(" Tage\nUnterbrechung"))
                    .alias("label")))


def _pair(df: DataFrame, species: str) -> list[str]:
    """The keys of the top list: the name and, where there is one, the scientific name."""
    return [species, *([SCIENTIFIC] if SCIENTIFIC in df.columns else [])]


def _top_of(counts: DataFrame, keys: list[str], n_col: str, k: int) -> DataFrame:
    """The names among the top-``k`` key pairs of an aggregated count frame (ties by name): at most k rows."""
    per = counts.groupBy(*keys).agg(F.sum(n_col).alias("_n"))
    return per.orderBy(F.desc("_n"), *[F.asc_nulls_last(c) for c in keys]).limit(k).select(keys[0]).distinct()


def top_shares(df: DataFrame, k: int = 10, species: str = SPECIES,
               weight: str | None = None) -> DataFrame:
    """Share (%) of all detections for each name in the top-``k`` list (R3:
    ranked by name and scientific name).

    One scan: counts per species, the top-k list and the total all derive from
    the same aggregate (its shuffle is reused).  The top-k list has at most
    ``k`` rows, so broadcasting it is size-safe.
    """
    keys = _pair(df, species)
    pairs = df.groupBy(*keys).agg(n_rows(weight).alias("_pairs"))
    total = pairs.agg(F.sum("_pairs")).scalar()
    counts = pairs.groupBy(species).agg(F.sum("_pairs").alias("absolut"))
    top = _top_of(pairs, keys, "_pairs", k)
    # inner join on the (unique) top names: unlike a semi join it is not pushed
    # below the aggregate, so the raw rows are scanned once
    return (counts.join(F.broadcast(top), species, "inner")
            .withColumn("relativ", F.col("absolut") / total * 100))


def top_daily(df: DataFrame, k: int = 10, ts: str = "zeitstempel", species: str = SPECIES,
              weight: str | None = None) -> DataFrame:
    """Daily detections of each name in the top-``k`` list.

    Counts per (species, scientific name, day) are aggregated once (map-side
    partial counts); the top-k list is derived from them and applied as a
    broadcast join on the aggregate, so the raw rows are read once.
    """
    # NULL species never match the semi join; filtering them up front keeps
    # both uses of the counts identical, so their shuffle is reused.
    keys = _pair(df, species)
    pairs = (df.where(F.col(species).isNotNull())
             .groupBy(*keys, _day(ts).alias("datum"))
             .agg(n_rows(weight).alias("_pairs")))
    per_day = pairs.groupBy(species, "datum").agg(F.sum("_pairs").alias("anzahl"))
    top = _top_of(pairs, keys, "_pairs", k)
    # inner join on the (unique) top names: unlike a semi join it is not pushed
    # below the aggregate, so the raw rows are scanned once
    return per_day.join(F.broadcast(top), species, "inner")


def hour_grid(df: DataFrame, agg: str = "count", ts: str = "zeitstempel",
              species: str = SPECIES, weight: str | None = None,
              approx: bool = False) -> DataFrame:
    """Heat map data over (date, hour 1..24).

    * ``agg='count'``: detections; ``agg='species'``: distinct species.
    * hours of days with any detection and no value → 0;
    * every hour of a day without detections → NULL (shown as a gap).

    The grid is all calendar days × 24 hours; observed days are found with a
    window per date over its 24 grid rows.
    """
    d = _day(ts)
    base = df.where(F.col(ts).isNotNull())
    if agg == "count":
        value = n_rows(weight)
        name = "anzahl_erkennungen"
    else:
        value = distinct_species(species, approx)
        name = "anzahl_vogelarten"
    cells = (base.groupBy(d.alias("datum"), hour24(ts).alias("stunde")).agg(value.alias(name))
             .where(F.col("datum").isNotNull() & F.col("stunde").isNotNull()))
    grid = (calendar(cells, "datum", name)
            .select("datum", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("stunde")))
    joined = grid.join(cells, ["datum", "stunde"], "left")
    observed = F.count(name).over(Window.partitionBy("datum")) > 0
    return joined.select("datum", "stunde",
                         F.when(observed, F.coalesce(F.col(name), F.lit(0))).cast("long").alias(name))
