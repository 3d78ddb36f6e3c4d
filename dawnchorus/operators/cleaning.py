"""Ingest cleaning: frequency ranks (I4), outages (I5), observation period (I6),
complete-day filter (I7), column profile (I8)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.functions.labels import MIN_PER_DAY, PERIOD_FROM
from dawnchorus.operators.ranking import exact_quartiles, global_row_number


def freq_rank(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """I4: categories ordered by frequency (most frequent first, name breaks ties).

    Returns ``(col, n, <col>_rang)``: one row per category.  Join it back where
    an ordinal is needed; the category table is what a factor's level order is.
    """
    name = name or f"{col}_rang"
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return global_row_number(counts, [F.desc("n"), F.asc_nulls_last(col)], name)


def outages(df: DataFrame, ts: str = "zeitstempel", partition: str | None = None,
            min_gap_days: int = 1, strict_na: bool = False) -> DataFrame:
    """Gaps between consecutive observed dates.

    A gap is a step of more than ``min_gap_days`` between two consecutive dates
    with detections: ``beginn`` = last date before the gap, ``ende`` = first
    date after it, ``dauer`` = days counting both ends.

    The rows are first reduced to their distinct dates (partial aggregation),
    so the ordered window runs over at most one row per day and partition, not
    over detections.  ``partition`` computes gaps per station.

    ``strict_na=True`` reproduces the reference's ``drop_na()`` over *all*
    columns: a gap is lost when the first detection of its closing date has a
    NULL in any column.
    """
    keys = ([partition] if partition else [])
    day = F.to_date(F.col(ts)).alias("datum")
    base = df.where(F.col(ts).isNotNull())
    if strict_na:
        any_null = F.greatest(*[F.col(c).isNull() for c in df.columns]) if len(df.columns) > 1 \
            else F.col(df.columns[0]).isNull()
        days = (base.groupBy(*keys, day)
                .agg(F.min_by(any_null, F.struct(F.col(ts), any_null)).alias("_na")))
    else:
        days = base.select(*keys, day).distinct()
    w = Window.orderBy("datum")
    if partition:
        w = Window.partitionBy(partition).orderBy("datum")
    prev = F.lag("datum").over(w)
    gaps = days.select(*keys, prev.alias("beginn"), F.col("datum").alias("ende"),
                       *(["_na"] if strict_na else []))
    gaps = gaps.where(F.datediff("ende", "beginn") > min_gap_days)
    if strict_na:
        gaps = gaps.where(~F.col("_na"))
    return gaps.select(*keys, "beginn", "ende",
                       (F.datediff("ende", "beginn") + 1).alias("dauer"))


def observation_period(df: DataFrame, ts: str = "zeitstempel", from_ts: str = PERIOD_FROM,
                       min_per_day: int = MIN_PER_DAY) -> DataFrame:
    """One row ``(beginn, ende, dauer)``.

    ``beginn`` = first date on or after ``from_ts`` with at least
    ``min_per_day`` detections; ``ende`` = date of the latest detection of the
    *whole* input; ``dauer`` counts both ends.  One grouped pass (per day) and
    a global aggregate over the per-day rows — no join.
    """
    t = F.col(ts)
    per_day = (df.where(t.isNotNull())
               .groupBy(F.to_date(t).alias("datum"))
               .agg(F.count_if(t >= F.to_timestamp_ntz(F.lit(from_ts))).alias("n"),
                    F.max(t).alias("last_ts")))
    out = per_day.agg(
        F.min(F.when(F.col("n") >= min_per_day, F.col("datum"))).alias("beginn"),
        F.to_date(F.max("last_ts")).alias("ende"))
    return out.withColumn("dauer", F.datediff("ende", "beginn") + 1)


def station_periods(df: DataFrame, station: str = "station", ts: str = "zeitstempel",
                    from_ts: str = PERIOD_FROM, min_per_day: int = MIN_PER_DAY) -> DataFrame:
    """I6 for each station: ``(station, beginn, ende, dauer)``.

    As ``observation_period``, over the station's own detections; stations without a day of enough detections
    have no row.  Counts per (station, day) are merged before the shuffle, so a station with a third of
    all detections has a row a day and task there.
    """
    t = F.col(ts)
    per_day = (df.where(t.isNotNull() & F.col(station).isNotNull())
               .groupBy(station, F.to_date(t).alias("datum"))
               .agg(F.count_if(t >= F.to_timestamp_ntz(F.lit(from_ts))).alias("n")))
    out = per_day.groupBy(station).agg(F.min(F.when(F.col("n") >= min_per_day, F.col("datum"))).alias("beginn"),
                                       F.max("datum").alias("ende"))
    return (out.where(F.col("beginn").isNotNull())
            .withColumn("dauer", F.datediff("ende", "beginn") + 1))


def complete_station_days(df: DataFrame, periods: DataFrame, outage_df: DataFrame,
                          ts: str = "zeitstempel", station: str = "station") -> DataFrame:
    """I7 for each station: detections inside their station's period, but for dates that start or end one
    of its outages.

    The interval join has the station as its key: each station has one period, so a detection meets one row
    and no pairs arise; a station with very many detections is split by the adaptive skew join, and a small
    table of periods is broadcast once its size is measured.  Detections without station or time stamp drop.
    """
    d = F.to_date(F.col(ts))
    of = periods.select(F.col(station).alias("_s"), F.col("beginn").alias("_lo"), F.col("ende").alias("_hi"))
    inside = df.join(of, (df[station] == of["_s"]) & d.between(of["_lo"], of["_hi"])).drop("_s", "_lo", "_hi")
    edges = outage_df.select(F.col(station).alias("_s"), F.explode(F.array("beginn", "ende")).alias("_d")).distinct()
    return inside.join(edges, (inside[station] == edges["_s"]) & (F.to_date(inside[ts]) == edges["_d"]), "left_anti")


def complete_days(df: DataFrame, period: DataFrame, outage_df: DataFrame,
                  ts: str = "zeitstempel", partition: str | None = None,
                  eager_bounds: bool = True) -> DataFrame:
    """Keep detections inside the period, drop dates that start or end an outage.

    The period is one row.  By default its two dates are fetched once and
    applied as a time-stamp range on ``ts`` — a literal predicate that reaches
    the parquet scan, where row groups outside the period are skipped by
    their min/max statistics.  ``eager_bounds=False`` keeps the bounds as
    scalar subqueries (fully lazy, no pushdown).  Outage edge dates are
    matched with a left-anti join on the date (and the station when outages
    are per station).  NULL timestamps drop.
    """
    d = F.to_date(F.col(ts))
    if eager_bounds:
        lo, hi = period.select("beginn", "ende").first() or (None, None)
        if lo is None or hi is None:
            inside = df.where(F.lit(False))
        else:
            t = F.col(ts)
            # date literals: casting a date to timestamp_ntz is zone-free
            # (a Python datetime literal would be a session-zone timestamp)
            start = F.lit(lo).cast("timestamp_ntz")
            stop = F.lit(hi + dt.timedelta(days=1)).cast("timestamp_ntz")
            inside = df.where((t >= start) & (t < stop))
    else:
        lo = period.select("beginn").scalar()
        hi = period.select("ende").scalar()
        inside = df.where(d.between(lo, hi))
    keys = [partition] if partition else []
    edges = (outage_df.select(*keys, F.col("beginn").alias("_d"))
             .unionByName(outage_df.select(*keys, F.col("ende").alias("_d")))
             .distinct())
    cond = [d == edges["_d"]] + [inside[k] == edges[k] for k in keys]
    return inside.join(edges, cond, "left_anti")


def profile(df: DataFrame, cols: list[str] | None = None, exact: bool = False) -> DataFrame:
    """I8: per numeric column its type, min, quartiles, mean, max and NULL count.

    One aggregate pass over all columns, then ``stack`` to long form.  Quartiles
    are approximate by default (``percentile_approx``: bounded memory);
    ``exact`` follows R (linear interpolation) and takes them from the
    range-partitioned counts of the values, which are checkpointed when called.
    """
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
               T.DoubleType, T.DecimalType)
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, numeric)]

    def q(c, p):
        x = F.col(c).cast("double")
        return F.lit(None).cast("double") if exact else F.percentile_approx(x, p, 10000).cast("double")

    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"a{i}_min"), q(c, 0.25).alias(f"a{i}_q1"),
                 q(c, 0.5).alias(f"a{i}_med"), F.avg(x).alias(f"a{i}_mean"),
                 q(c, 0.75).alias(f"a{i}_q3"), F.max(x).alias(f"a{i}_max"),
                 F.count_if(F.col(c).isNull()).alias(f"a{i}_na")]
    wide = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = ", ".join(
        f"'{c}', '{types[c]}', a{i}_min, a{i}_q1, a{i}_med, a{i}_mean, a{i}_q3, a{i}_max, a{i}_na"
        for i, c in enumerate(cols))
    long = wide.selectExpr(
        f"stack({len(cols)}, {parts}) as "
        "(spalte, typ, minimum, q1, median, mittelwert, q3, maximum, anzahl_na)")
    if not exact:
        return long
    return (long.drop("q1", "median", "q3").join(exact_quartiles(df, {c: F.col(c) for c in cols}), "spalte", "left")
            .select(*long.columns))


def profile_levels(df: DataFrame, cols: list[str]) -> DataFrame:
    """I8 for text columns: (spalte, wert, anzahl) for each level, NULL included, in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("spalte"), F.col(c).cast("string").alias("wert"))
                                for c in cols]))
    return df.select(cells.alias("z")).groupBy("z.spalte", "z.wert").agg(F.count(F.lit(1)).alias("anzahl"))


def profile_times(df: DataFrame, cols: list[str], exact: bool = False) -> DataFrame:
    """I8 for time columns: min, quartiles, mean, max (whole seconds) and NULL count; ``exact`` as in ``profile``."""
    frames, numbers = [], {}
    stamp = lambda x: F.timestamp_seconds(F.floor(x)).cast("timestamp_ntz")
    for c in cols:
        seconds = F.unix_seconds(F.col(c).cast("timestamp"))
        numbers[c] = seconds
        at = lambda p, x=seconds: (F.lit(None).cast("long") if exact else F.percentile_approx(x, p, 10000))
        frames.append(F.struct(
            F.lit(c).alias("spalte"), stamp(F.min(seconds)).alias("minimum"), stamp(at(0.25)).alias("q1"),
            stamp(at(0.5)).alias("median"), stamp(F.avg(seconds)).alias("mittelwert"), stamp(at(0.75)).alias("q3"),
            stamp(F.max(seconds)).alias("maximum"), F.count_if(F.col(c).isNull()).alias("anzahl_na")))
    long = df.agg(F.array(*frames).alias("z")).select(F.inline("z"))
    if not exact:
        return long
    return (long.drop("q1", "median", "q3").join(exact_quartiles(df, numbers), "spalte", "left")
            .withColumns({q: stamp(F.col(q)) for q in ("q1", "median", "q3")}).select(*long.columns))
