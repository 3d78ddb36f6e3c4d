"""Distributed global ranking without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task.  Here
the frame is range-partitioned and sorted by Spark (``orderBy``), each row gets
its position inside its partition, and a tiny table of per-partition row counts
(one row per partition, so its size is bounded by the partition count) turns
positions into global ranks.  The sorted frame is checkpointed first so that
both passes see exactly the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.session import shared_dir


def global_row_number(df: DataFrame, order_cols: list, name: str = "rang") -> DataFrame:
    """Dense 1..n numbering in ``order_cols`` order (ties must be broken by the caller)."""
    shared_dir(df.sparkSession)  # make sure a reliable checkpoint folder exists
    sorted_df = (df.orderBy(*order_cols)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id())
                 .checkpoint(eager=True))
    # position inside the partition = id minus the partition's first id
    counts = (sorted_df.groupBy("_pid")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")))
    offsets = counts.select(
        "_pid", "_first",
        (F.sum("_n").over(Window.orderBy("_pid")
                          .rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    ranked = sorted_df.join(F.broadcast(offsets), "_pid")
    rank = F.coalesce(F.col("_off"), F.lit(0)) + (F.col("_mid") - F.col("_first")) + 1
    return ranked.withColumn(name, rank.cast("long")).drop("_pid", "_mid", "_first", "_off")


def global_running_sum(df: DataFrame, order_cols: list, value: str, name: str) -> DataFrame:
    """``value`` summed over all rows up to each one, in ``order_cols`` order (which must be total).

    Range-partitioned and sorted by Spark; sums run inside each range, and a table of one row a range
    (bounded by their number) gives what lies before it.
    """
    shared_dir(df.sparkSession)  # make sure a reliable checkpoint folder exists
    ranges = df.orderBy(*order_cols).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("_pid").agg(F.sum(value).alias("_part")).select("_pid", F.sum("_part").over(before).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.sum(value).over(inside) + F.coalesce(F.col("_off"), F.lit(0))
    return ranges.join(F.broadcast(offsets), "_pid").withColumn(name, run).drop("_pid", "_off")


def exact_quartiles(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(spalte, q1, median, q3) of each named number, NULLs left out, linear interpolation.

    Equal values are counted first; the counts are range-partitioned by name and value, and a
    running sum inside each partition plus the partition's offset gives the ranks of a value.
    A name without a value has no row.
    """
    shared_dir(df.sparkSession)  # make sure a reliable checkpoint folder exists
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("spalte"), x.cast("double").alias("_x"))
                                for c, x in values.items()]))
    counts = (df.select(cells.alias("z")).select("z.*").where(F.col("_x").isNotNull())
              .groupBy("spalte", "_x").agg(F.count(F.lit(1)).alias("_n"))
              .orderBy("spalte", "_x").withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))
    before = Window.partitionBy("spalte").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy("spalte", "_pid").agg(F.sum("_n").alias("_part")).select(
        "spalte", "_pid", F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_off"),
        F.sum("_part").over(Window.partitionBy("spalte")).alias("_all"))
    inside = (Window.partitionBy("spalte", "_pid").orderBy("_x")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (counts.withColumn("_run", F.sum("_n").over(inside)).join(F.broadcast(offsets), ["spalte", "_pid"])
              .withColumn("_end", F.col("_off") + F.col("_run")))  # ranks from 0: _end - _n up to below _end

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")), F.col("_x")))

    def quantile(p: float) -> Column:
        place = F.lit(p) * (F.col("_all") - 1)
        low, part = at(F.floor(place)), F.max(place - F.floor(place))
        return F.when(part == 0, low).otherwise(low * (1 - part) + at(F.ceil(place)) * part)

    return ranked.groupBy("spalte").agg(quantile(0.25).alias("q1"), quantile(0.5).alias("median"),
                                        quantile(0.75).alias("q3"))
