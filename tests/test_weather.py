import datetime as dt
import math
import random

import pytest

from dawnchorus.operators import weather
from dawnchorus.plans import catalog


def test_collapse_sums_and_missing_zero(spark):
    t = dt.datetime(2024, 3, 1, 10)
    df = spark.createDataFrame([(t, 1.0, None), (t, 2.0, None)], "mess_datum timestamp_ntz, a double, b double")
    r = weather.collapse_stations(df).first()
    assert (r.a, r.b) == (3.0, 0.0)
    assert weather.collapse_stations(df, missing="null").first().b is None


def test_codes(spark):
    rows = [(dt.datetime(2024, 3, 1, h), c, c) for h, c in enumerate([-1.0, 0.0, 1.0, 8.0, 9.0, None])]
    df = spark.createDataFrame(rows, "mess_datum timestamp_ntz, rs_ind_niederschlagsindikator double, "
                                     "v_n_bedeckungsgrad double")
    got = [(r.niederschlagsindikator, r.niederschlagsindikator_code, r.bedeckungsgrad, r.bedeckungsgrad_in_okta)
           for r in weather.to_weather(df, optional=tuple(weather.WEATHER_RENAMES)).orderBy("wetterzeit").collect()]
    assert got == [(None, None, None, None), ("kein Niederschlag", 0, "wolkenlos", 0),
                   ("Niederschlag", 1, "sonnig", 1), (None, None, "bedeckt", 8),
                   (None, None, None, None), (None, None, None, None)]


def test_station_search_and_best(spark):
    st = spark.createDataFrame([
        (1, "near-old", "wind", "hourly", "recent", 51.80, 6.60, "u1", dt.date(2024, 1, 1)),
        (2, "far-new", "wind", "hourly", "recent", 52.10, 6.60, "u2", dt.date(2024, 6, 1)),
        (3, "near-new", "wind", "hourly", "recent", 51.85, 6.65, "u3", dt.date(2024, 6, 1)),
        (4, "too-far", "wind", "hourly", "recent", 53.50, 6.60, "u4", dt.date(2024, 9, 1)),
        (5, "daily", "sun", "daily", "recent", 51.80, 6.60, "u5", dt.date(2024, 9, 1)),
        (6, "no-end", "sun", "hourly", "recent", 51.80, 6.60, "u6", None),
    ], "stations_id long, stationsname string, var string, res string, per string, "
       "geo_breite double, geo_laenge double, url string, bis_datum date")
    pos = spark.createDataFrame([(51.85, 6.62)], "lat double, lon double")
    near = weather.nearby_stations(st, pos)
    assert sorted(r.stations_id for r in near.collect()) == [1, 2, 3]
    best = weather.best_station(near).collect()
    assert [(r.station, r.wettervariable) for r in best] == [(3, "wind")]
    d = {r.stations_id: r.dist for r in near.collect()}
    assert 27.8 < d[2] < 27.9 and d[3] < 3   # 0.25° latitude ≈ 27.8 km


def test_enrich_inner_join_and_season(spark):
    det = spark.createDataFrame([(dt.datetime(2024, 3, 1, 10, 15),), (dt.datetime(2024, 3, 1, 11, 5),)],
                                "zeitstempel timestamp_ntz")
    wx = spark.createDataFrame([(dt.datetime(2024, 3, 1, 10), 5.0)], "wetterzeit timestamp_ntz, lufttemperatur double")
    out = weather.enrich(det, wx).collect()
    assert len(out) == 1 and out[0].jahreszeit == "Frühling" and out[0].lufttemperatur == 5.0


def test_service_files_as_delivered(spark, tmp_path):
    """Product codes, padded cells and missing markers; an unknown layout raises."""
    import pytest

    from dawnchorus.sources.weather import load_weather, read_observation_file
    one, two = tmp_path / "one.txt", tmp_path / "two.txt"
    one.write_text("STATIONS_ID;MESS_DATUM;QN_9;TT_TU;RF_TU;eor\n"
                   "        44;2024030110;    3;   5.5;  80.0;eor\n        44;2024030111;    3;  -999;  -999.0;eor\n"
                   "        44;bad;    3;   x;   1.0;eor\n")
    two.write_text("STATIONS_ID;MESS_DATUM;  F;  D;eor\n  7;2024030110; 3.1; 250;eor\n")
    rows = load_weather(spark, [str(one), str(two)]).collect()
    by = {(r.stations_id, r.mess_datum): r for r in rows}
    assert by[44.0, dt.datetime(2024, 3, 1, 10)].tt_tu_lufttemperatur == 5.5
    gone = by[44.0, dt.datetime(2024, 3, 1, 11)]
    assert gone.tt_tu_lufttemperatur is None and gone.rf_tu_relative_feuchte is None
    assert by[44.0, None].tt_tu_lufttemperatur is None and by[44.0, None].rf_tu_relative_feuchte == 1.0
    assert by[7.0, dt.datetime(2024, 3, 1, 10)].f_windgeschwindigkeit == 3.1
    other = tmp_path / "other.txt"
    other.write_text("a;b\n1;2\n")
    with pytest.raises(ValueError):
        read_observation_file(spark, str(other))
    with pytest.raises(ValueError):
        weather.to_weather(load_weather(spark, [str(one)]))
    absent = [c for c in weather.WEATHER_RENAMES if c not in rows[0].__fields__]
    optional = ("rs_ind_niederschlagsindikator", "v_n_bedeckungsgrad", *absent)
    assert weather.to_weather(load_weather(spark, [str(one)]), optional=(*optional, "f_windgeschwindigkeit")).count() == 3


@pytest.mark.parametrize("radius", [50.0, 700.0, 9000.0])
def test_stations_near_many_positions(spark, radius):
    """Against every pair: poles, the date line, repeated places, missing coordinates."""
    rng = random.Random(5)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    points += [(90.0, 0.0), (-90.0, 17.0), (89.9, 10.0), (89.9, -170.0), (0.0, 180.0), (0.1, -180.0), (0.0, 179.9), (60.0, -179.99)]
    points += [(a + rng.uniform(-0.4, 0.4) * (abs(a) < 89), b) for a, b in points]
    spots = [(i, a, b) for i, (a, b) in enumerate(points[::2])] + [(900, 0.0, 180.0), (901, 0.0, 180.0), (902, None, 1.0)]
    index = [(i, f"s{i}", "wind", "hourly", "recent", dt.date(2024, 1, 1 + i % 3), a, b, f"u{i}") for i, (a, b) in enumerate(points)]
    stations = spark.createDataFrame(index, "stations_id int, stationsname string, var string, res string, per string, "
                                            "bis_datum date, geo_breite double, geo_laenge double, url string")
    positions = spark.createDataFrame(spots, "station int, lat double, lon double")
    found = weather.stations_near(stations, positions, radius_km=radius, variables=["wind"])
    got = [(r.station, r.stations_id) for r in found.collect()]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    want = [(i, s[0]) for i, a, b in spots if a is not None for s in index if km(a, b, s[6], s[7]) <= radius]
    assert sorted(got) == sorted(want) and want
    best = weather.best_station(found, "station").collect()
    assert len(best) == len({i for i, _ in want})


def test_best_stations_near_pairs_do_not_grow_with_stations_of_a_place(spark, tmp_path, monkeypatch):
    """Four times the suppliers at the same places make the same pairs, and the choice is that among all stations."""
    pairs, best = [], weather.best_station

    def counting(df, by=None):
        pairs.append(df.count())
        return best(df, by)

    monkeypatch.setattr(weather, "best_station", counting)
    span = 7 * 5 * 4 * 17 * 13  # everything that a station's row says of its key repeats after it
    events = [(dt.datetime(2024, 1, 1, i), u, "view", 1.0, "{}") for u in (0, 40, 350) for i in range(2)]
    for times in (1, 4):
        keys = [k + i * span for k in range(0, 300) for i in range(times)]
        d = tmp_path / str(times)
        spark.createDataFrame([(k, f"s{k}", k % 4 + 1) for k in keys], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
        spark.createDataFrame([(k, dt.datetime(1998, 1, 1 + (k * 7) % 11)) for k in keys], "l_suppkey long, l_shipdate timestamp_ntz").write.parquet(f"{d}/lineitem.parquet")
        spark.createDataFrame(events, "ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
        t = catalog._t(spark, str(d))
        everyone = catalog.rounded(best(catalog._stations_by_user(t, t.stations()), "position"))
        assert sorted(catalog.q_best_stations_near(spark, str(d)).collect()) == sorted(everyone.collect()) != []
    assert pairs[0] == pairs[1] > 0
