import pytest

from dawnchorus.operators import grids, models, species
from dawnchorus.plans.catalog import Tables
from dawnchorus.plans.cube import counted_outputs, detection_cube, distinct_at, distinct_exactly, distinct_sketches, sketch_bound
from tests.conftest import SF


def _same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    ra = sorted(map(str, a.select(*cols).collect()))
    rb = sorted(map(str, b.select(*cols).collect()))
    assert ra == rb


def test_cube_outputs_equal_raw(spark):
    raw = Tables(spark, SF).by_user()
    cube = detection_cube(raw)
    assert cube.count() < raw.count()
    out = counted_outputs(cube, "2024-01-22")
    _same(out["anzahl_vogelarten"], species.species_count(raw))
    _same(out["erkennungen_am_tag"], species.daily(raw))
    _same(out["top10"], species.top_species(raw))
    _same(out["bottom10"], species.bottom_species(raw))
    _same(out["haeufigkeiten"], species.species_frequency(raw))
    _same(out["neue_vogelarten"], species.new_species(raw))
    _same(out["woechentliche_veraenderungen"], species.weekly_change(raw, "2024-01-22"))
    _same(out["taegliche_erkennungen"], grids.daily_counts_grid(raw))
    _same(out["heatmap_erkennungen"], grids.hour_grid(raw, "count"))
    _same(out["heatmap_vogelarten"], grids.hour_grid(raw, "species"))
    _same(out["haeufigste_vogelarten"], grids.top_shares(raw))
    _same(out["top_vogelarten_zeitverlauf"], grids.top_daily(raw))
    _same(out["stunden_matrix"], models.hour_matrix(raw))


def test_sketches_unite_to_any_grain(spark):
    """20,000 values over 40 days, each on several of them, with NULLs."""
    raw = spark.range(0, 60_000).selectExpr(
        "timestamp_ntz'2024-01-30 05:00:00' + make_dt_interval(cast(hash(id) % 20 as int) + 20) as zeitstempel",
        "if(id % 50 = 0, null, concat('a', id % 20000)) as deutscher_name")
    daily = distinct_sketches(raw)
    for grain in ("day", "month", "year"):
        rows = distinct_exactly(raw, grain).join(distinct_at(daily, grain), "beginn").collect()
        assert rows and all(abs(r.geschaetzt - r.genau) <= sketch_bound() * r.genau for r in rows)
    assert distinct_exactly(raw, "year").first().genau == 19_600
    assert distinct_at(distinct_sketches(raw.limit(0)), "week").count() == 0
    with pytest.raises(ValueError):
        distinct_at(daily, "minute")
