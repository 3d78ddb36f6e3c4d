"""Operator 7, mixing sources to target weights: Poisson replication.

A source of n documents that is to give ``share * total`` rows has the mean
repetition rate ``rate = share * total / n``.  Each document draws its number of
copies by inverting the Poisson distribution of that rate at a number that a
hash of its id and the seed gives; it is then repeated so often and all copies
are dealt out at random over all partitions.

Each copy count depends on the row alone: recomputing a lost task gives the same
copies, and no source, however large, is gathered anywhere.

Defined results: null and empty sources form one group; a null id draws as the
id ``null``; rows of one id draw the same count; sources without a weight (or
with weight 0) are left out; an empty table gives an empty result.  The other
columns go through unread, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.llm.common import hash60, materialize, uniform

#: Rows of the rate table that are still broadcast; with more sources it is joined by a shuffle.
MOST_BROADCAST = 10_000


def source_rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5,
                 total: float | None = None, source: str = "source") -> DataFrame:
    """Per source: n documents, target share and mean repetition rate.

    ``weights`` (source, weight) are the target weights; without it they are
    ``n ** alpha`` (alpha 1: as they are, 0: all sources alike).  ``total`` is the
    wanted number of rows, by default that of ``docs``.
    """
    counts = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        weighted = counts.join(weights.select(F.coalesce(F.col("source"), F.lit("")).alias("mix_source"),
                                              F.col("weight").cast("double")), "mix_source")
    weighted = materialize(weighted.filter("weight > 0"), "mix-sources")
    sums = weighted.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    rows = float(total if total is not None else (sums["n"] or 0))
    share = F.col("weight") / F.lit(sums["w"] or 1.0)
    return weighted.withColumn("share", share).withColumn("rate", share * rows / F.col("n"))


def _log_factorial(k: Column) -> Column:
    """Exact to 20, by Stirling's series beyond (error under 1e-13)."""
    x = k.cast("double")
    series = (x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x))
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20))).cast("double"))).otherwise(series)


def poisson_tables(rates: DataFrame) -> DataFrame:
    """Per source: the first count and the cumulative probabilities from there on.

    They span 12 standard deviations on either side of the mean, so a source has
    about ``24 * sqrt(rate)`` entries.
    """
    rate, k = F.col("rate"), F.col("k")
    reach = 12 * F.sqrt(rate) + 12
    grid = rates.select("mix_source", "rate", F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor(rate - reach)).cast("int"), F.ceil(rate + reach).cast("int"))).alias("k"))
    p = F.exp(k * F.log(rate) - rate - _log_factorial(k))
    up_to = Window.partitionBy("mix_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return (grid.select("mix_source", "k", F.sum(p).over(up_to).alias("cumulative"))
            .groupBy("mix_source")
            .agg(F.min("k").alias("first_k"),
                 F.transform(F.array_sort(F.collect_list(F.struct("k", "cumulative"))),
                             lambda x: x["cumulative"]).alias("cumulative")))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5,
                total: float | None = None, seed: str = "mix", source: str = "source",
                doc_id: str = "doc_id", copy_col: str = "mix_copy") -> DataFrame:
    """Repeat and shuffle ``docs``; adds the column ``copy_col`` (0, 1, ... per row)."""
    names = [c for c in docs.columns if c != copy_col]
    rates = source_rates(docs, weights, alpha, total, source)
    tables = poisson_tables(rates)
    few = rates.count() <= MOST_BROADCAST
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                         F.coalesce(F.col(source), F.lit("")).alias("mix_source"),
                         F.col(doc_id).alias("mix_id"))
    joined = packed.join(F.broadcast(tables) if few else tables, "mix_source")
    joined = joined.withColumn("u", uniform(seed, F.col("mix_id")))
    copies = F.col("first_k") + F.aggregate("cumulative", F.lit(0), lambda a, c: a + (c <= F.col("u")).cast("int"))
    repeated = (joined.select("row", "mix_id", copies.alias("n_copies")).filter("n_copies > 0")
                .select("row", "mix_id", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias(copy_col)))
    key = hash60(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col("mix_id").cast("string"), F.lit("null")),
                             F.col(copy_col).cast("string")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = repeated.withColumn("mix_key", key).repartition(n, "mix_key").sortWithinPartitions("mix_key")
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in names], copy_col)
