"""Species statistics: counts (R1), per day (R2), top/bottom-k (R3, R4),
frequency table (R5), first-seen species (R6, R6b), weekly change (R7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.functions.calendar import iso_week, iso_year, simple_week
from dawnchorus.functions.labels import MIN_OBSERVATIONS
from dawnchorus.operators.counting import n_rows
from dawnchorus.operators.ranking import global_row_number, global_running_sum
from dawnchorus.session import written

SPECIES = "deutscher_name"
SCIENTIFIC = "wissenschaftlicher_name"


def _day(ts: str = "zeitstempel"):
    return F.to_date(F.col(ts))


def species_count(df: DataFrame, min_obs: int = MIN_OBSERVATIONS,
                  species: str = SPECIES, weight: str | None = None) -> DataFrame:
    """One row, number of species with at least ``min_obs`` detections."""
    per = df.groupBy(species).agg(n_rows(weight).alias("n"))
    return per.agg(F.count_if(F.col("n") >= min_obs).alias("anzahl_vogelarten"))


def distinct_species(species: str = SPECIES, approx: bool = False, rsd: float = 0.01):
    """Distinct species in a group; a NULL species counts as one more (as R's
    ``n_distinct``).  ``approx=True`` uses HyperLogLog++ (bounded memory, one
    aggregation level instead of the expand-based exact distinct)."""
    base = F.approx_count_distinct(species, rsd) if approx else F.countDistinct(species)
    return (base + F.max(F.col(species).isNull()).cast("long")).cast("long")


def daily(df: DataFrame, ts: str = "zeitstempel", species: str = SPECIES,
          weight: str | None = None, approx: bool = False) -> DataFrame:
    """R2: per day the number of detections and of distinct species."""
    return (df.groupBy(_day(ts).alias("datum"))
            .agg(n_rows(weight).alias("erkennungen"),
                 distinct_species(species, approx).alias("vogelarten")))


def _frequencies(df: DataFrame, species: str, scientific: str | None,
                 abs_name: str, rel_name: str, weight: str | None = None) -> DataFrame:
    """Absolute count per species and its share of *all* detections (%).

    The total is the sum of the counts, as a scalar subquery that reuses their
    shuffle: the input is read once, and the share needs no single-partition
    window over the species table.
    """
    keys = [species] + ([scientific] if scientific else [])
    counts = df.groupBy(*keys).agg(n_rows(weight).alias(abs_name))
    total = counts.agg(F.sum(abs_name)).scalar()
    return counts.withColumn(rel_name, F.col(abs_name) / total * 100)


def top_species(df: DataFrame, k: int = 10, species: str = SPECIES,
                scientific: str | None = SCIENTIFIC, weight: str | None = None) -> DataFrame:
    """The ``k`` most frequent species with their share of all detections.

    Exactly ``k`` rows; ties broken by name.  ``orderBy().limit()`` becomes a
    per-partition top-k plus a final merge of k rows per partition.
    """
    f = _frequencies(df, species, scientific, "absolute_haeufigkeit", "relative_haeufigkeit", weight)
    order = [F.desc("absolute_haeufigkeit"), F.asc_nulls_last(species)]
    if scientific:
        order.append(F.asc_nulls_last(scientific))
    return f.orderBy(*order).limit(k)


def bottom_species(df: DataFrame, k: int = 10, min_obs: int = MIN_OBSERVATIONS,
                   species: str = SPECIES, scientific: str | None = SCIENTIFIC,
                   weight: str | None = None) -> DataFrame:
    """The ``k`` least frequent species among those with ``>= min_obs``;
    the share is taken over all detections *before* the threshold."""
    f = _frequencies(df, species, scientific, "absolute_haeufigkeit", "relative_haeufigkeit", weight)
    order = [F.asc("absolute_haeufigkeit"), F.asc_nulls_last(species)]
    if scientific:
        order.append(F.asc_nulls_last(scientific))
    return f.where(F.col("absolute_haeufigkeit") >= min_obs).orderBy(*order).limit(k)


def species_frequency(df: DataFrame, min_obs: int = MIN_OBSERVATIONS,
                      species: str = SPECIES, scientific: str | None = SCIENTIFIC,
                      ranked: bool = True, weight: str | None = None) -> DataFrame:
    """Every species with ``>= min_obs`` detections, absolute and relative
    frequency, ranked 1..n by descending count (name breaks ties).

    The rank is computed with a distributed global numbering, not a
    single-partition window.
    """
    f = _frequencies(df, species, scientific, "absolut", "relativ", weight)
    f = f.where(F.col("absolut") >= min_obs)
    if not ranked:
        return f
    order = [F.desc("absolut"), F.asc_nulls_last(species)]
    if scientific:
        order.append(F.asc_nulls_last(scientific))
    return global_row_number(f, order, "rang")


def _species_weeks(df: DataFrame, ts: str, species: str, weight: str | None) -> DataFrame:
    """Detections per (species, year, non-ISO week); rows without a time stamp
    form the (NULL, NULL) week so that species totals still count them."""
    d = _day(ts)
    return (df.groupBy(species, F.year(d).alias("jahr"), simple_week(d).alias("kalenderwoche"))
            .agg(n_rows(weight).alias("_n")))


def _first_weeks(sw: DataFrame, min_obs: int, species: str) -> DataFrame:
    """Per species with ``>= min_obs`` detections: its first (year, week)."""
    per = sw.groupBy(species).agg(
        F.sum("_n").alias("_tot"),
        F.min(F.when(F.col("jahr").isNotNull(), F.struct("jahr", "kalenderwoche"))).alias("_f"))
    return per.where((F.col("_tot") >= min_obs) & F.col("_f").isNotNull())


def new_species(df: DataFrame, min_obs: int = MIN_OBSERVATIONS, ts: str = "zeitstempel",
                species: str = SPECIES, weight: str | None = None) -> DataFrame:
    """Per (year, non-ISO week) the species seen for the first time.

    The reference folds a running set union over the ordered weeks; the same
    answer is, per species with enough detections, the smallest (year, week)
    in which it occurs.  One scan: counts per (species, week), then per
    species the total (threshold) and the first week — no ordered fold, no
    join.  Weeks without news do not appear.  Week = complete 7-day blocks
    since 1 January, plus one.
    """
    first = _first_weeks(_species_weeks(df, ts, species, weight), min_obs, species)
    return first.select(F.col("_f.jahr").alias("jahr"),
                        F.col("_f.kalenderwoche").alias("kalenderwoche"),
                        F.col(species).alias("neue_vogelarten"))


def running_set(df: DataFrame, order: list[str], col: str) -> DataFrame:
    """R6b/R6c in general: the running union of the values of ``col`` over the groups of ``order``, ascending.

    One row for each value that a group holds: the ``order`` columns, ``col``, ``ist_neu`` (in no earlier group),
    ``anzahl_neu`` (new values of the group) and ``anzahl_alle`` (values of all groups so far).  The union itself is
    never put into a row: at any group it is the new values of the groups up to there.
    A value's first group is a grouped minimum, so no fold is run in order; the sizes are
    running sums of one row a group, dealt out by ranges.  NULL is no value; a group of NULLs comes first, and a group
    that holds no value has no row.
    """
    seen = df.where(F.col(col).isNotNull()).groupBy(*order, col).agg(F.lit(1).alias("_one")).drop("_one")
    group = F.struct(*[F.col(c) for c in order])
    first = seen.groupBy(F.col(col).alias("_value")).agg(F.min(group).alias("_first"))
    # a window of one value's groups could hold them all in one task; the minimum is merged before the shuffle
    rows = (seen.join(first, F.col(col) == F.col("_value"))
            .select(*order, col, group.eqNullSafe(F.col("_first")).alias("ist_neu")))
    rows = written(rows, "running-set")
    sizes = rows.groupBy(*order).agg(F.sum(F.col("ist_neu").cast("long")).alias("anzahl_neu"))
    sizes = global_running_sum(sizes, [F.col(c).asc_nulls_first() for c in order], "anzahl_neu", "anzahl_alle")
    keep = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in order]
    return (rows.alias("r").join(sizes.alias("s"), reduce(lambda a, b: a & b, keep))
            .select(*[F.col(f"r.{c}").alias(c) for c in [*order, col, "ist_neu"]], "s.anzahl_neu", "s.anzahl_alle"))


def running_species_set(df: DataFrame, min_obs: int = MIN_OBSERVATIONS,
                        ts: str = "zeitstempel", species: str = SPECIES,
                        weight: str | None = None) -> DataFrame:
    """Per observed week the running union of species seen so far
    (``alle_vogelarten``, sorted) and the week's new ones (``neue_vogelarten``).

    Built from the same per-(species, week) counts as R6 (one scan), without
    an ordered fold: observed weeks of the qualifying species get a dense
    index (a window over one row per week, bounded by the calendar); every
    species emits the indices from its first week to the last one; the sets
    are collected *per week*, so no task ever holds more than one week's set.
    """
    sw = _species_weeks(df, ts, species, weight)
    first = _first_weeks(sw, min_obs, species)
    weeks = (sw.join(first.select(species), species, "inner")
             .where(F.col("jahr").isNotNull())
             .select("jahr", "kalenderwoche").distinct())
    idx = weeks.withColumn("_i", F.dense_rank().over(Window.orderBy("jahr", "kalenderwoche")))
    last = idx.select(F.max("_i")).scalar()
    firsts = (first.select(F.col(species).alias("_s"), F.col("_f.jahr").alias("jahr"),
                           F.col("_f.kalenderwoche").alias("kalenderwoche"))
              .join(idx, ["jahr", "kalenderwoche"])
              .select("_s", F.col("_i").alias("_first")))
    member = firsts.select("_s", "_first", F.explode(F.sequence("_first", last)).alias("_i"))
    sets = (member.groupBy("_i")
            .agg(F.array_sort(F.collect_list("_s")).alias("alle_vogelarten"),
                 F.array_sort(F.collect_list(F.when(F.col("_first") == F.col("_i"), F.col("_s"))))
                 .alias("neue_vogelarten")))
    empty = F.array().cast("array<string>")
    return (idx.join(sets, "_i", "left")
            .select("jahr", "kalenderwoche",
                    F.coalesce("alle_vogelarten", empty).alias("alle_vogelarten"),
                    F.coalesce("neue_vogelarten", empty).alias("neue_vogelarten")))


def weekly_change(df: DataFrame, as_of: str, ts: str = "zeitstempel",
                  species: str = SPECIES, existing_weeks_only: bool = False,
                  weight: str | None = None) -> DataFrame:
    """Week-over-week change of detections per species (ISO weeks).

    * keeps weeks whose ISO number is below the ISO week of ``as_of`` — in
      every year (the year is not compared, as in the reference);
    * counts per (ISO year, ISO week, species) and completes the grid observed
      years × observed weeks × species with 0 (``existing_weeks_only`` keeps
      only (year, week) pairs that occur in the data);
    * change % = 0 when the previous week has 0, else (n − p) / p · 100;
      the first week of each species, and rows without a species name, are
      dropped.

    The grid is generated per species row by exploding the (calendar-bounded)
    arrays of years and weeks, delivered as scalar subqueries — no cross join
    operator.  The window per species runs over years × weeks rows.
    """
    d = _day(ts)
    base = (df.where(F.col(ts).isNotNull() & F.col(species).isNotNull())
            .select(iso_year(d).alias("jahr"), iso_week(d).alias("kalenderwoche"),
                    F.col(species).alias(species),
                    *([F.col(weight)] if weight else []))
            .where(F.col("kalenderwoche") < iso_week(F.to_date(F.lit(as_of)))))
    counts = (base.groupBy("jahr", "kalenderwoche", species)
              .agg(n_rows(weight).alias("erkennungen")))
    # The side branches below keep an (order-sensitive) sum over the counts so
    # that Catalyst does not re-derive them from the raw rows: all branches then
    # share the one shuffle of ``counts`` (exchange reuse) — one scan in total.
    species_list = (counts.groupBy(species).agg(F.sum("erkennungen").alias("_n"))
                    .where(F.col("_n") > 0).select(species))
    if existing_weeks_only:
        yw = counts.agg(F.struct(
            F.sort_array(F.collect_set(F.struct("jahr", "kalenderwoche"))).alias("yw"),
            F.sum("erkennungen").alias("n"))).scalar()
        grid = (species_list.select(species, F.explode(yw.getField("yw")).alias("_yw"))
                .select(species, "_yw.jahr", "_yw.kalenderwoche"))
    else:
        dims = counts.agg(F.struct(F.sort_array(F.collect_set("jahr")).alias("y"),
                                   F.sort_array(F.collect_set("kalenderwoche")).alias("w"),
                                   F.sum("erkennungen").alias("n"))).scalar()
        grid = (species_list
                .select(species, F.explode(dims.getField("y")).alias("jahr"))
                .select(species, "jahr", F.explode(dims.getField("w")).alias("kalenderwoche")))
    # Densify by union + sum (no join): the grid rows carry 0.  Hash
    # partitioning by species alone satisfies both the aggregate and the window.
    keys = ["jahr", "kalenderwoche", species]
    full = (grid.select(*keys, F.lit(0).cast("long").alias("erkennungen"))
            .unionByName(counts.select(*keys, F.col("erkennungen").cast("long")))
            .repartition(species)
            .groupBy(*keys).agg(F.sum("erkennungen").alias("erkennungen")))
    w = Window.partitionBy(species).orderBy("jahr", "kalenderwoche")
    prev = F.lag("erkennungen").over(w)
    out = full.withColumn("erkennungen_vorwoche", prev)
    change = F.when(F.col("erkennungen_vorwoche") == 0, F.lit(0.0)).otherwise(
        (F.col("erkennungen") - F.col("erkennungen_vorwoche")) / F.col("erkennungen_vorwoche") * 100)
    return (out.where(F.col("erkennungen_vorwoche").isNotNull())
            .withColumn("prozentuale_veraenderung", change)
            .select("jahr", "kalenderwoche", species, "erkennungen",
                    "erkennungen_vorwoche", "prozentuale_veraenderung"))
