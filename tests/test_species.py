import datetime as dt

from pyspark.sql import functions as F

from dawnchorus.operators import species


def _df(spark, rows):
    return spark.createDataFrame(
        [(t, s, s.upper()) for t, s in rows],
        "zeitstempel timestamp_ntz, deutscher_name string, wissenschaftlicher_name string")


def test_top_k_ties_and_shares(spark):
    rows = []
    for i in range(12):  # species s00..s11 with counts 12..1, plus a tie at rank 10/11
        n = 12 - i if i < 10 else 3
        rows += [(dt.datetime(2024, 3, 1, 8), f"s{i:02d}")] * n
    df = _df(spark, rows)
    top = species.top_species(df, 10).collect()
    assert len(top) == 10
    assert [r.deutscher_name for r in top][-2:] == ["s08", "s09"]  # tie at 3: s09 < s10 < s11
    shares = species._frequencies(df, "deutscher_name", None, "a", "r").agg(F.sum("r")).first()[0]
    assert abs(shares - 100) < 1e-9
    bottom = species.bottom_species(df, 3, min_obs=4).collect()
    assert [r.deutscher_name for r in bottom] == ["s08", "s07", "s06"]
    assert all(r.absolute_haeufigkeit >= 4 for r in bottom)


def test_daily_counts_null_species(spark):
    t = dt.datetime(2024, 3, 1, 8)
    df = spark.createDataFrame([(t, "a"), (t, None), (t, "a")], "zeitstempel timestamp_ntz, deutscher_name string")
    r = species.daily(df).first()
    assert (r.erkennungen, r.vogelarten) == (3, 2)


def test_new_species_equals_running_union(spark):
    rows = []
    start = dt.datetime(2023, 12, 20, 6)
    for d in range(40):
        for s in ("a", "b", "c", "d"):
            if (s == "b" and d < 10) or (s == "c" and d < 25) or (s == "d" and d % 2):
                continue
            rows += [(start + dt.timedelta(days=d), s)] * 3
    df = _df(spark, rows)
    ns = {(r.jahr, r.kalenderwoche, r.neue_vogelarten) for r in species.new_species(df, 10).collect()}
    # brute force: ordered fold over weeks
    seen, expect = set(), set()
    weeks = {}
    for t, s in rows:
        d = t.date()
        key = (d.year, (d.timetuple().tm_yday - 1) // 7 + 1)
        weeks.setdefault(key, set()).add(s)
    counts = {}
    for _, s in rows:
        counts[s] = counts.get(s, 0) + 1
    for key in sorted(weeks):
        new = {s for s in weeks[key] if counts[s] >= 10} - seen
        expect |= {(key[0], key[1], s) for s in new}
        seen |= new
    assert ns == expect
    run = species.running_species_set(df, 10).orderBy("jahr", "kalenderwoche").collect()
    assert run[-1].alle_vogelarten == sorted(seen)
    assert all(len(set(r.alle_vogelarten)) == len(r.alle_vogelarten) for r in run)


def test_weekly_change(spark):
    # ISO weeks: 2024-01-01 is W1 (Monday).  Species a: W1 2, W2 0, W3 4 ; b: W1 1, W3 1
    # plus 2023 W2 for a (same week number, other year).
    rows = ([(dt.datetime(2024, 1, 1, 8), "a")] * 2 + [(dt.datetime(2024, 1, 15, 8), "a")] * 4
            + [(dt.datetime(2024, 1, 2, 8), "b"), (dt.datetime(2024, 1, 16, 8), "b"),
               (dt.datetime(2023, 1, 10, 8), "a"), (dt.datetime(2024, 2, 20, 8), "a")])
    df = _df(spark, rows)
    out = {(r.jahr, r.kalenderwoche, r.deutscher_name): (r.erkennungen, r.erkennungen_vorwoche,
                                                         r.prozentuale_veraenderung)
           for r in species.weekly_change(df, "2024-01-22").collect()}  # as_of ISO W4 -> weeks < 4
    assert (2024, 8, "a") not in out                     # week 8 filtered out
    assert out[(2024, 2, "a")] == (0, 2, -100.0)
    assert out[(2024, 3, "a")] == (4, 0, 0.0)           # previous 0 -> 0 %
    assert out[(2024, 1, "a")] == (2, 0, 0.0)           # 2023 W3 (completed 0) precedes 2024 W1
    assert (2023, 1, "a") not in out                     # first week of each species dropped
    assert out[(2023, 2, "b")] == (0, 0, 0.0)           # completed grid, zeros
    assert len(out) == 2 * (2 * 3) - 2


def test_species_count(spark):
    rows = [(dt.datetime(2024, 3, 1, 8), "a")] * 10 + [(dt.datetime(2024, 3, 1, 8), "b")] * 9
    assert species.species_count(_df(spark, rows)).first()[0] == 1


def test_species_frequency_rank_is_global(spark):
    rows = []
    for i in range(40):
        rows += [(dt.datetime(2024, 3, 1, 8), f"s{i:02d}")] * (10 + i % 7)
    df = _df(spark, rows).repartition(5)
    got = species.species_frequency(df, 10).orderBy("rang").collect()
    assert [r.rang for r in got] == list(range(1, 41))
    keys = [(-r.absolut, r.deutscher_name) for r in got]
    assert keys == sorted(keys)


def test_daily_approx_distinct_close(spark):
    rows = [(dt.datetime(2024, 3, 1 + d % 3, 8), f"s{i}") for d in range(3) for i in range(200)]
    df = _df(spark, rows)
    exact = {r.datum: r.vogelarten for r in species.daily(df).collect()}
    approx = {r.datum: r.vogelarten for r in species.daily(df, approx=True).collect()}
    assert set(exact) == set(approx)
    for k in exact:
        assert abs(exact[k] - approx[k]) <= 0.05 * exact[k]


def test_weekly_change_existing_weeks_only(spark):
    rows = ([(dt.datetime(2024, 1, 1, 8), "a")] * 2 + [(dt.datetime(2024, 1, 15, 8), "a")] * 4
            + [(dt.datetime(2023, 1, 10, 8), "a")])
    full = species.weekly_change(_df(spark, rows), "2024-01-22").count()
    only = {(r.jahr, r.kalenderwoche) for r in
            species.weekly_change(_df(spark, rows), "2024-01-22", existing_weeks_only=True).collect()}
    assert full == 5                                     # 2 years x 3 weeks, first dropped
    assert only == {(2024, 1), (2024, 3)}                # (2023, 2) is the first -> dropped


def test_running_set(spark):
    rows = [(2, "x"), (1, "b"), (1, "a"), (1, "a"), (3, "a"), (3, "c"), (None, "z"), (4, None), (5, "b"), (5, "z")]
    df = spark.createDataFrame(rows, "g int, v string")
    got = [(r.g, r.v, r.ist_neu, r.anzahl_neu, r.anzahl_alle) for r in species.running_set(df, ["g"], "v").collect()]
    assert sorted(got, key=str) == sorted([(None, "z", True, 1, 1), (1, "a", True, 2, 3), (1, "b", True, 2, 3), (2, "x", True, 1, 4),
                                           (3, "a", False, 1, 5), (3, "c", True, 1, 5), (5, "b", False, 0, 5), (5, "z", False, 0, 5)], key=str)
    assert species.running_set(df.limit(0), ["g"], "v").collect() == []


def test_running_set_against_a_fold(spark):
    import random
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), rng.randint(0, 20), rng.randint(0, 80)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, v int")
    seen, want = set(), set()
    for g in sorted({r[:2] for r in rows}):
        values = {r[2] for r in rows if r[:2] == g}
        new = values - seen
        seen |= values
        want |= {(*g, v, v in new, len(new), len(seen)) for v in values}
    assert {tuple(r) for r in species.running_set(df, ["a", "b"], "v").collect()} == want
