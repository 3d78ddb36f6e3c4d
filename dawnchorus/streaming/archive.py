"""Incremental snapshot archive with Structured Streaming.

The batch form (``sources.archive.merge_snapshots``) re-reads every snapshot
and de-duplicates the whole archive on each run.  Here new snapshots are
picked up exactly once by the file source (its checkpoint records processed
files) and each micro-batch only touches the archive partitions of its own
dates:

1. de-duplicate the batch (full-row ``distinct``);
2. left-anti join, null-safe on every column, against the archive rows of
   the batch's dates — the archive is partitioned by ``datum`` and the date
   list (one value per day, bounded by the calendar) prunes partitions;
3. append the new rows, partitioned by ``datum``.

The union of everything written equals the distinct union of all snapshots,
like the batch merge.  A batch replayed after a failure finds the rows that were
already committed present and appends only the others.  The append is a plain
partitioned Parquet append: a reader at the same moment may see part of a batch.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dawnchorus.session import shared_dir
from dawnchorus.sources.schemas import ENRICHED

PART = "datum"


def _archive_exists(spark: SparkSession, path: str) -> bool:
    """Only a missing or still empty folder means no archive; any other failure is raised."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def read_archive(spark: SparkSession, archive_dir: str, schema: T.StructType = ENRICHED) -> DataFrame:
    """The archive as rows of ``schema`` (the partition column is dropped)."""
    df = spark.read.schema(T.StructType(list(schema.fields) + [T.StructField(PART, T.DateType())])) \
        .parquet(archive_dir)
    return df.select(*[f.name for f in schema.fields])


def _merge_batch(archive_dir: str, schema: T.StructType):
    cols = [f.name for f in schema.fields]

    def merge(batch: DataFrame, batch_id: int) -> None:  # noqa: ARG001
        spark = batch.sparkSession
        row = F.struct(*[F.col(c) for c in cols])
        new = (batch.select(*cols).distinct()
               .withColumn(PART, F.to_date("zeitstempel"))
               .withColumn("_h", F.xxhash64(row))
               .persist(StorageLevel.MEMORY_AND_DISK))  # read for its dates and for the append
        batch_rows = new
        if _archive_exists(spark, archive_dir):
            days = [r[0] for r in new.select(PART).distinct().collect()]
            day_filter = F.col(PART).isin(*[d for d in days if d is not None])
            if None in days:
                day_filter = day_filter | F.col(PART).isNull()
            old = (spark.read.parquet(archive_dir).where(day_filter)
                   .select(PART, F.struct(*[F.col(c) for c in cols]).alias("_row"))
                   .withColumn("_h", F.xxhash64("_row")))
            # equi keys: row hash + date; the full null-safe row comparison
            # guards against hash collisions
            cond = [(new["_h"] == old["_h"]), new[PART].eqNullSafe(old[PART]),
                    F.struct(*[new[c] for c in cols]).eqNullSafe(old["_row"])]
            new = new.join(old, cond, "left_anti")
        # rebalance on the date: AQE coalesces small days and splits a hot one
        (new.drop("_h").hint("rebalance", PART)
         .write.mode("append").partitionBy(PART).parquet(archive_dir))
        batch_rows.unpersist()

    return merge


def archive_stream(spark: SparkSession, incoming_dir: str, archive_dir: str,
                   checkpoint_dir: str | None = None, schema: T.StructType = ENRICHED,
                   fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Start the archive stream over snapshot files arriving in ``incoming_dir``.

    ``fmt='parquet'`` snapshots may lack columns (they read as NULL);
    ``fmt='csv'`` snapshots must carry the full header.  ``available_now``
    processes everything present and stops (scheduled runs); otherwise the
    stream keeps running.  The checkpoint lives in the shared folder.
    """
    checkpoint_dir = checkpoint_dir or f"{shared_dir(spark)}/dawnchorus/archive-stream"
    # snapshots are directories of part files: look into them
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if fmt == "csv":
        from dawnchorus.sources.archive import CSV_OPTIONS
        src = reader.options(**CSV_OPTIONS).option("enforceSchema", False).csv(incoming_dir)
    else:
        src = reader.parquet(incoming_dir)
    w = (src.writeStream.foreachBatch(_merge_batch(archive_dir, schema))
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
