"""Session construction and shared scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "dawnchorus") -> SparkSession:
    """A session with the settings the library relies on.

    * AQE on: partitions are coalesced after the (usually small) aggregates and
      joins against data-dependent frames become broadcasts only when their
      measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
    * UTC session time zone.  All timestamps are ``timestamp_ntz`` so results do
      not depend on it, but it keeps CSV round trips deterministic.
    * UI off (no server).
    """
    return (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide shared folder (``spark.checkpoint.dir``).

    Read from the session.  When it is unset, a fresh directory is created and
    registered, but only in local mode, where driver and executors are one
    process; on a cluster a machine-local folder would lose data, so it raises.
    """
    d = None
    try:
        d = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001
        d = None
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (no SparkContext, e.g. a remote session)
        sc = None
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d and (sc is None or not (sc.master == "local" or sc.master.startswith("local["))):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    elif sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder for intermediate tables.

    What is written there is deleted when the session's JVM ends.
    """
    path = f"{shared_dir(spark)}/dawnchorus/{name}-{uuid.uuid4().hex[:12]}"
    sc = spark.sparkContext
    file = sc._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(file)
    return path


#: While a table is written: shuffle files go with the query, and the rows that Python workers get come in
#: batches of some MB, of which a task holds several copies at a time.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                  "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: computed once, with no lineage.

    The shuffle files of the writing query go when it has ended: nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for these tables, once their last reader has run."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path:
            sc = table.sparkSession.sparkContext
            file = sc._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(sc._jsc.hadoopConfiguration()).delete(file, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application.

    Functions that run in workers are pickled by name, so the workers import
    them; they find the package in an archive that Spark sends along, whatever
    folder the driver was started from.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / "dawnchorus-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def cluster_conf(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a large cluster, derived from the input size.

    * Scans: 512 MB splits — the heavy stages are scans with map-side partial
      aggregation, so fewer, larger scan tasks cost less scheduling.
    * Shuffles: the large shuffles (an un-broadcast enrichment join, the
      batch archive de-duplication, global sorts) get about 1 GB per initial
      partition and at least 3 waves of the cluster's cores; AQE coalesces the
      many small post-aggregation shuffles to 256 MB partitions and splits
      skewed join partitions.
    * Broadcast: 64 MB covers several years of hourly weather; larger sides
      stay shuffle joins (the size is measured at runtime by AQE).
    """
    gib = 1 << 30
    partitions = max(3 * cores, min(100_000, input_bytes // gib))
    return {
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.shuffle.partitions": str(int(partitions)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }
