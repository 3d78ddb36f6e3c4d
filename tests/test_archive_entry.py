import datetime as dt
import tempfile

from pyspark.sql import functions as F

from dawnchorus.sources import archive
from dawnchorus.sources.schemas import ENRICHED
from tests.conftest import SF


def _enriched(spark):
    rows = [(dt.datetime(2024, 3, 1, 10), dt.datetime(2024, 3, 1, 10, 5, 1, 123456), "Turdus", "Amsel",
             0.81, 0.7, 1.25, 51.8, 6.6, 0.0, "Niederschlag", 1, "bedeckt", 8, 5.5, 80.0, 1010.0, 4.0,
             0.2, 0.0, None, "Frühling", 1)]
    return spark.createDataFrame(rows, ENRICHED)


def test_snapshot_roundtrip_is_idempotent(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    cur = _enriched(spark)
    archive.write_snapshot(cur, d, "2024-03-01")
    archive.write_snapshot(cur, d, "2024-03-02")          # duplicate snapshot
    merged = archive.merge_snapshots(spark, cur, d)
    assert merged.count() == 1
    row = merged.first()
    assert row.zeitstempel == dt.datetime(2024, 3, 1, 10, 5, 1, 123456)   # microseconds kept
    again = archive.merge_snapshots(spark, merged, d)
    assert again.count() == 1


def test_snapshot_with_missing_column(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    cur = _enriched(spark)
    archive.write_snapshot(cur.drop("jahreszeit_nr"), d, "2024-03-01")
    merged = archive.merge_snapshots(spark, cur, d)
    assert merged.count() == 2
    assert merged.where(F.col("jahreszeit_nr").isNull()).count() == 1


def test_every_csv_counts_and_plan_does_not_grow(spark):
    """Single files, other names and many snapshots; one scan for each distinct header; bad cells become NULL."""
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    cur = _enriched(spark)
    header = ",".join(cur.columns)
    line = ",".join("" if c == "zeitstempel" else "x" if c == "lufttemperatur" else "" for c in cur.columns)
    for i in range(100):
        with open(f"{d}/erkennungen_2024-{i}.csv", "w") as f:
            f.write(f"{header}\n" + line.replace("x", str(i)) + "\n")
    with open(f"{d}/notes.csv", "w") as f:
        f.write("deutscher_name,lufttemperatur,zeitstempel\nAmsel,warm,never\n")
    merged = archive.merge_snapshots(spark, cur, d)
    assert merged.count() == 1 + 100 + 1
    odd = merged.where("deutscher_name = 'Amsel' and wissenschaftlicher_name is null").collect()
    assert len(odd) == 1 and odd[0].lufttemperatur is None and odd[0].zeitstempel is None
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2


def test_entry_and_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and "absolute_haeufigkeit" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 50


def test_queries_match_oracle_sf0001(spark):
    """A handful of queries against their DuckDB oracle on the smallest tables."""
    import duckdb
    import __spark_entry__ as e
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("daily", "top_species", "weekly_change", "hour_grid_detections", "station_outages",
                 "enriched", "species_kendall"):
        sp = e.queries()[name](spark, SF).toPandas()
        dd = con.sql(e.oracle_sql()[name]).df()
        assert sorted(sp.columns) == sorted(dd.columns), name
        assert len(sp) == len(dd), name
        cols = sorted(sp.columns)
        a = sorted(map(str, sp[cols].astype(str).values.tolist()))
        b = sorted(map(str, dd[cols].astype(str).values.tolist()))
        if name not in ("enriched", "species_kendall", "weekly_change", "hour_grid_detections"):
            assert a == b, name
