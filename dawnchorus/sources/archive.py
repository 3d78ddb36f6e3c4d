"""Snapshot archive: write a dated snapshot (E3), merge all snapshots.

The weather source keeps only one year, so every run stores its enriched
detections and the next run unions them back.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.sources.schemas import ENRICHED, TS_FORMAT

CSV_OPTIONS = {"header": "true", "timestampNTZFormat": TS_FORMAT,
               "dateFormat": "yyyy-MM-dd", "encoding": "UTF-8"}


def snapshot_path(directory: str, as_of: str, fmt: str = "csv") -> str:
    return f"{directory.rstrip('/')}/erkennungen_{as_of}.{fmt}"


def write_snapshot(df: DataFrame, directory: str, as_of: str, fmt: str = "csv") -> str:
    """Write ``erkennungen_<as_of>.<fmt>`` below ``directory``.

    ``as_of`` is an explicit parameter (never the wall clock).  Spark writes a
    directory of part files; time stamps keep their microseconds.  Parquet is
    the better choice at scale (typed, column pruning); CSV is the reference's
    format.
    """
    path = snapshot_path(directory, as_of, fmt)
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def list_snapshots(spark: SparkSession, directory: str, fmt: str = "csv") -> list[str]:
    """Every snapshot in ``directory``: files ``*.<fmt>`` and directories of part
    files of that name (file listing only).

    Uses the ``binaryFile`` source for the listing; only ``path`` is selected,
    so no file content is read.
    """
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", "true")
             .load(directory.rstrip("/"))
             .select("path"))
    suffix = re.escape(fmt)
    inside = F.regexp_extract("path", rf"^(.*\.{suffix})/[^/]*$", 1)
    snap = F.when(inside != "", inside).when(F.col("path").rlike(rf"\.{suffix}$"), F.col("path"))
    rows = files.select(snap.alias("snap")).where(F.col("snap").isNotNull()).distinct()
    return sorted(r.snap for r in rows.collect())


def _typed(raw: DataFrame, schema: T.StructType, text: bool) -> DataFrame:
    """Columns by *name*, cast to ``schema``; absent columns and unreadable cells become NULL."""
    cols = []
    for f in schema.fields:
        if f.name not in raw.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.TimestampNTZType) and text:
            cols.append(F.try_to_timestamp(F.col(f.name), F.lit(TS_FORMAT)).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def _csv_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    return tuple(spark.read.options(**CSV_OPTIONS).csv(path).columns)


def read_snapshots(spark: SparkSession, paths: list[str], schema: T.StructType = ENRICHED,
                   fmt: str = "csv") -> DataFrame:
    """All given snapshots, by name.

    Parquet snapshots are one read that merges the files' schemas.  CSV
    snapshots are one read for each *distinct header* — text columns by that
    header — so the plan grows with the layouts that were ever in use, not with
    the number of snapshots.
    """
    if not paths:
        return spark.createDataFrame([], schema)
    if fmt == "parquet":
        return _typed(spark.read.option("mergeSchema", "true").parquet(*paths), schema, text=False)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        by_header.setdefault(_csv_header(spark, path), []).append(path)
    frames = []
    for header, group in sorted(by_header.items()):
        layout = T.StructType([T.StructField(c, T.StringType()) for c in header])
        raw = spark.read.options(**CSV_OPTIONS).option("enforceSchema", False).schema(layout).csv(group)
        frames.append(_typed(raw, schema, text=True))
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType = ENRICHED,
                  fmt: str = "csv") -> DataFrame:
    """One snapshot, cast by *name* to ``schema``; absent columns become NULL."""
    return read_snapshots(spark, [path], schema, fmt)


def merge_snapshots(spark: SparkSession, current: DataFrame, directory: str,
                    schema: T.StructType = ENRICHED, fmt: str = "csv") -> DataFrame:
    """Current rows ∪ every snapshot, by name, exact full-row de-duplication.

    ``distinct`` is a hash aggregate with a map-side partial step, so a
    snapshot that repeats the current rows collapses before the shuffle.
    Never overwrite a snapshot that this frame still reads.
    """
    paths = list_snapshots(spark, directory, fmt)
    cur = _conform(current, schema)
    return (cur.unionByName(read_snapshots(spark, paths, schema, fmt)) if paths else cur).distinct()


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema`` (absent ones NULL), by name."""
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
