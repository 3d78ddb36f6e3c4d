import datetime as dt

from pyspark.sql import functions as F

from dawnchorus.operators import grids, study, tables


def _df(spark, rows):
    return spark.createDataFrame([(t, s, s.upper(), 0.7) for t, s in rows],
                                 "zeitstempel timestamp_ntz, deutscher_name string, "
                                 "wissenschaftlicher_name string, schwellenwert double")


def test_hour_grid_two_tiers(spark):
    rows = [(dt.datetime(2024, 3, 1, 0, 10), "a"), (dt.datetime(2024, 3, 1, 7), "b"),
            (dt.datetime(2024, 3, 1, 7, 30), "b"), (dt.datetime(2024, 3, 4, 12), "a")]
    g = grids.hour_grid(_df(spark, rows), "count").collect()
    assert len(g) == 4 * 24
    cells = {(r.datum.day, r.stunde): r.anzahl_erkennungen for r in g}
    assert cells[(1, 24)] == 1 and cells[(1, 7)] == 2 and cells[(1, 1)] == 0
    assert cells[(2, 5)] is None and cells[(3, 12)] is None
    assert sum(v is not None for v in cells.values()) == 24 * 2   # observed days only
    s = {(r.datum.day, r.stunde): r.anzahl_vogelarten for r in grids.hour_grid(_df(spark, rows), "species").collect()}
    assert s[(1, 7)] == 1 and s[(4, 12)] == 1


def test_daily_grid_and_season_spans(spark):
    rows = [(dt.datetime(2024, 2, 27, 8), "a"), (dt.datetime(2024, 3, 2, 8), "a")]
    df = _df(spark, rows)
    g = grids.daily_counts_grid(df).orderBy("datum").collect()
    assert [r.anzahl_erkennungen for r in g] == [1, None, None, None, 1]
    spans = {r.jahreszeit: r for r in grids.season_spans(df).collect()}
    assert spans["Winter"].beginn == dt.date(2024, 2, 27)
    assert spans["Winter"].ende == dt.date(2024, 3, 1)          # +1 day closes the gap
    assert spans["Frühling"].ende == dt.date(2024, 3, 2)        # last day stays
    assert spans["Winter"].mitte == dt.date(2024, 2, 28)


def test_reference_season_mode(spark):
    rows = [(dt.datetime(2023, 12, 30, 8), "a"), (dt.datetime(2024, 1, 2, 8), "a"),
            (dt.datetime(2025, 1, 2, 8), "a")]
    spans = {r.jahreszeit_nr: r for r in grids.season_spans(_df(spark, rows), mode="reference").collect()}
    # December never Winter; leap-year January is Winter; 2025 January has no season
    assert spans[4].beginn == dt.date(2024, 1, 1) and spans[4].ende == dt.date(2024, 3, 1)
    assert None in spans


def test_top_bottom_pads_and_formats(spark):
    rows = []
    for i, n in enumerate([1200, 15, 11, 3]):
        rows += [(dt.datetime(2024, 3, 1, 8), f"s{i}")] * n
    df = _df(spark, rows)
    tb = tables.fmt_number(tables.top_bottom(df, k=5, min_obs=10),
                           ["top10_haeufigkeit", "bottom10_haeufigkeit"]).orderBy("rang").collect()
    assert [r.rang for r in tb] == [1, 2, 3, 4]
    assert tb[0].top10_haeufigkeit == "1.200" and tb[0].bottom10 == "s2"
    assert tb[3].bottom10 is None and tb[3].top10 == "s3"


def test_weekly_change_wide_columns(spark):
    rows = []
    for d in range(1, 40):
        rows += [(dt.datetime(2024, 1, d if d <= 31 else d - 31, 8) if d <= 31 else
                  dt.datetime(2024, 2, d - 31, 8), "a")] * (d % 5 + 1)
    wide = tables.weekly_change_wide(_df(spark, rows), "2024-03-01", n_weeks=4)
    assert wide.columns == ["deutscher_name", "KW 5", "KW 6", "KW 7", "KW 8"][:1] + wide.columns[1:]
    assert len(wide.columns) == 5 and wide.columns[1].startswith("KW")
    nums = [int(c.split()[1]) for c in wide.columns[1:]]
    assert nums == sorted(nums)


def test_new_species_wide(spark):
    rows = ([(dt.datetime(2024, 1, 1, 8), "a")] * 10 + [(dt.datetime(2024, 1, 2, 8), "b")] * 10
            + [(dt.datetime(2024, 1, 9, 8), "c")] * 10)
    w = tables.new_species_wide(_df(spark, rows)).orderBy("nummer").collect()
    assert [(r.nummer, r["KW 1"], r["KW 2"]) for r in w] == [(1, "a", "c"), (2, "b", "")]


def test_new_species_wide_over_years(spark):
    """A number comes once for each year that has a species under it."""
    rows = ([(dt.datetime(2023, 1, 3, 8), "a")] * 10 + [(dt.datetime(2023, 1, 4, 8), "b")] * 10
            + [(dt.datetime(2024, 1, 2, 8), "c")] * 10 + [(dt.datetime(2024, 1, 9, 8), "d")] * 10)
    w = tables.new_species_wide(_df(spark, rows))
    assert w.columns == ["nummer", "KW 1", "KW 2"]
    assert sorted(tuple(r) for r in w.collect()) == [(1, "", "d"), (1, "a", ""), (2, "b", ""), (3, "c", "")]


def test_event_study(spark):
    rows = ([(dt.datetime(2024, 3, 3, 8), "Amsel")] * 3 + [(dt.datetime(2024, 3, 4, 8), "x")]
            + [(dt.datetime(2024, 3, 10, 8), "x")] * 4 + [(dt.datetime(2024, 3, 16, 8), "Amsel")])
    df = _df(spark, rows)
    wk = study.weekly_share(df)
    got = {r.woche: (r.erkennungen, r.erkennungen_art, r.anteil_art) for r in wk.collect()}
    assert got == {dt.date(2024, 3, 3): (4, 3, 0.75), dt.date(2024, 3, 10): (5, 1, 0.2)}
    ex = study.label(study.extrema(wk)).collect()
    assert sorted(r.label for r in ex) == ["1 Amseln erkannt", "3 Amseln erkannt"]
    assert study.total(wk).first().gesamt == 9
    marked = {r.woche: r.markiert for r in study.mark_interval(wk, df, "2024-03-05").collect()}
    assert marked == {dt.date(2024, 3, 3): False, dt.date(2024, 3, 10): True}


def test_caption(spark):
    from dawnchorus.operators import cleaning
    rows = [(dt.datetime(2024, 3, 1, 8), "a")] * 1200
    df = _df(spark, rows).withColumn("schwellenwert", F.lit(0.75))
    per = cleaning.observation_period(df, from_ts="2024-03-01", min_per_day=1)
    c = tables.caption(df, per, r_squared=0.456).first()
    assert (c.n_text, c.beginn_text, c.ende_text, c.konfidenz_prozent, c.r2_text) == \
        ("1.200", "01.03.2024", "01.03.2024", 75.0, "0,46")


def test_weekly_change_wide_year_collision(spark):
    rows = []
    for y in (2023, 2024):
        for d in range(1, 15):
            rows += [(dt.datetime(y, 1, d, 8), "a")] * (d % 3 + 1)
    wide = tables.weekly_change_wide(_df(spark, rows), "2024-01-17", n_weeks=4)  # ISO week 3
    # weeks 1 and 2 of both years; the first week overall has no previous week
    assert wide.columns[1:] == ["KW 2/2023", "KW 1/2024", "KW 2/2024"]


def test_top_list_ranks_pairs_of_names(spark):
    """A name with two scientific names enters by each pair's own count, as in the top list."""
    rows = [("A", "a1")] * 3 + [("A", "a2")] * 3 + [("B", "b")] * 5 + [("C", "c")] * 4
    df = spark.createDataFrame([(dt.datetime(2024, 3, 1, 10), *r) for r in rows],
                               "zeitstempel timestamp_ntz, deutscher_name string, wissenschaftlicher_name string")
    assert {r.deutscher_name for r in grids.top_shares(df, 2).collect()} == {"B", "C"}
    assert {r.deutscher_name: r.absolut for r in grids.top_shares(df, 3).collect()} == {"A": 6, "B": 5, "C": 4}
    assert {(r.deutscher_name, r.anzahl) for r in grids.top_daily(df, 2).collect()} == {("B", 5), ("C", 4)}
    from dawnchorus.operators.models import top_names
    assert top_names(df, 2) == ["B", "C"] and top_names(df, 4) == ["B", "C", "A"]
