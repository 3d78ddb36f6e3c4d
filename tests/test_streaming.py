import datetime as dt
import tempfile

from pyspark.sql import functions as F

from dawnchorus.sources import archive
from dawnchorus.sources.schemas import ENRICHED
from dawnchorus.streaming import archive_stream, read_archive


def _rows(spark, days):
    rows = [(dt.datetime(2024, 3, d, 10), dt.datetime(2024, 3, d, 10, 5, 1, 123456), "Turdus", "Amsel",
             0.81, 0.7, 1.25, 51.8, 6.6, 0.0, None, None, "bedeckt", 8, 5.5, 80.0, 1010.0, 4.0,
             0.2, 0.0, None, "Frühling", 1) for d in days]
    return spark.createDataFrame(rows, ENRICHED)


def test_archive_stream_dedups_across_runs(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    inc, arch, ck = f"{base}/in", f"{base}/arch", f"{base}/ck"
    archive.write_snapshot(_rows(spark, [1, 2]), inc, "a", fmt="parquet")
    archive.write_snapshot(_rows(spark, [2, 3]), inc, "b", fmt="parquet")      # overlaps day 2
    archive_stream(spark, inc, arch, ck).awaitTermination()
    assert read_archive(spark, arch).count() == 3
    # next run: a repeat and a snapshot lacking a column (NULL -> a new distinct row)
    archive.write_snapshot(_rows(spark, [3]), inc, "c", fmt="parquet")
    archive.write_snapshot(_rows(spark, [3]).drop("jahreszeit_nr"), inc, "d", fmt="parquet")
    archive_stream(spark, inc, arch, ck).awaitTermination()
    out = read_archive(spark, arch)
    assert out.count() == 4
    assert out.where(F.col("jahreszeit_nr").isNull()).count() == 1
    # same result as the batch merge over all snapshots
    batch = archive.merge_snapshots(spark, _rows(spark, []), inc, fmt="parquet")
    assert sorted(map(str, batch.collect())) == sorted(map(str, out.collect()))
    # nothing new: a further run appends nothing
    archive_stream(spark, inc, arch, ck).awaitTermination()
    assert read_archive(spark, arch).count() == 4


def test_archive_stream_csv_snapshots(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    inc, arch, ck = f"{base}/in", f"{base}/arch", f"{base}/ck"
    archive.write_snapshot(_rows(spark, [1, 2]), inc, "a", fmt="csv")
    archive.write_snapshot(_rows(spark, [2]), inc, "b", fmt="csv")
    archive_stream(spark, inc, arch, ck, fmt="csv").awaitTermination()
    out = read_archive(spark, arch).collect()
    assert len(out) == 2
    assert {r.zeitstempel.microsecond for r in out} == {123456}
