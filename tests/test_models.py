import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dawnchorus.functions.stats import f_sf, t_sf2, weighted_kendall_tau_b
from dawnchorus.operators import models


def brute_tau_b(x, y):
    s = tx = ty = 0
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            a = np.sign(x[i] - x[j])
            b = np.sign(y[i] - y[j])
            s += a * b
            tx += abs(a)
            ty += abs(b)
    return s / math.sqrt(tx * ty) if tx and ty else float("nan")


@pytest.mark.parametrize("case", ["random", "ties", "perfect", "reversed", "constant"])
def test_weighted_kendall(case):
    rng = random.Random(1)
    n = 60
    if case == "random":
        x = [rng.randint(0, 5) for _ in range(n)]
        y = [rng.randint(0, 5) for _ in range(n)]
    elif case == "ties":
        x = [1] * 30 + [2] * 30
        y = [rng.randint(0, 2) for _ in range(n)]
    elif case == "perfect":
        x = list(range(n)); y = list(range(n))
    elif case == "reversed":
        x = list(range(n)); y = list(range(n, 0, -1))
    else:
        x = [3] * n; y = list(range(n))
    cells = {}
    for a, b in zip(x, y):
        cells[(a, b)] = cells.get((a, b), 0) + 1
    cx = np.array([k[0] for k in cells]); cy = np.array([k[1] for k in cells])
    w = np.array(list(cells.values()))
    got = weighted_kendall_tau_b(cx, cy, w)
    want = brute_tau_b(x, y)
    if math.isnan(want):
        assert math.isnan(got)
    else:
        assert abs(got - want) < 1e-12


def test_kendall_pairwise_complete(spark):
    rows = [(1.0, 1.0, 5.0), (2.0, 2.0, None), (3.0, 3.0, 4.0), (4.0, 4.0, 3.0), (None, 1.0, 1.0)]
    m = spark.createDataFrame(rows, "a double, b double, c double")
    out = {(r.term, r.vogelart): r.korrelation for r in models.kendall(m, ["a", "b", "c"]).collect()}
    assert out[("b", "a")] == pytest.approx(1.0)
    assert out[("c", "a")] == pytest.approx(-1.0)
    assert out[("a", "c")] == pytest.approx(-1.0)
    # b vs c over rows 1,3,4,5 : b = 1,3,4,1 ; c = 5,4,3,1
    assert out[("c", "b")] == pytest.approx(brute_tau_b([1, 3, 4, 1], [5, 4, 3, 1]))


def test_pvalue_helpers():
    # F(3, 20) upper 5 % point is 3.0984; t(10) two-sided 5 % point is 2.2281
    assert f_sf(3.0984, 3, 20) == pytest.approx(0.05, abs=1e-4)
    assert t_sf2(2.2281, 10) == pytest.approx(0.05, abs=1e-4)
    assert t_sf2(0.0, 10) == pytest.approx(1.0)


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(3)
    n = 200
    X = rng.normal(size=(n, 3))
    y = 1.5 * X[:, 0] - 0.5 * X[:, 1] + rng.normal(size=n)
    rows = [tuple(float(v) for v in (y[i], *X[i])) for i in range(n)]
    rows.append((None, 0.0, 0.0, 0.0))
    df = spark.createDataFrame(rows, "y double, a double, b double, c double")
    fit = models.ols(df, "y", ["a", "b", "c"])
    Xall = np.vstack([X, np.zeros((1, 3))])   # the NULL-target row still counts for x statistics
    Z = (X - Xall.mean(0)) / Xall.std(0, ddof=1)
    yz = (y - y.mean()) / y.std(ddof=1)
    A = np.column_stack([np.ones(n), Z])
    beta, *_ = np.linalg.lstsq(A, yz, rcond=None)
    tidy = {r.term: r for r in fit.tidy().collect()}
    assert tidy["(Intercept)"].estimate == pytest.approx(beta[0], abs=1e-9)
    for t, b in zip("abc", beta[1:]):
        assert tidy[t].estimate == pytest.approx(b, rel=1e-9)
    resid = yz - A @ beta
    s2 = resid @ resid / (n - 4)
    se = np.sqrt(np.diag(s2 * np.linalg.inv(A.T @ A)))
    assert tidy["a"].std_error == pytest.approx(se[1], rel=1e-8)
    g = fit.glance().first()
    r2 = 1 - resid @ resid / (yz @ yz)
    assert g.r_squared == pytest.approx(r2, rel=1e-9)
    assert g.nobs == n and g.df_residual == n - 4
    assert g.p_value < 1e-10


def test_ols_scans_once_and_refuses_what_has_no_fit(spark, tmp_path):
    rng = np.random.default_rng(4)
    big = 1e9 + rng.normal(size=500)   # a large mean must not cost digits
    y = 3 + 2 * (big - 1e9) + 0.1 * rng.normal(size=500)
    df = spark.createDataFrame([(float(a), float(b), float(2 * b), 1.0) for a, b in zip(y, big)], "y double, x double, twice double, one double")
    fit = models.ols(df, "y", ["x"], standardize=False)
    slope = np.polyfit(big - 1e9, y, 1)[0]
    assert fit.estimates[1] == pytest.approx(slope, rel=1e-6)
    for xs in (["x", "twice"], ["one"]):
        with pytest.raises(ValueError):
            models.ols(df, "y", xs)
    with pytest.raises(ValueError):
        models.ols(df.limit(2), "y", ["x", "twice"], standardize=False)
    with pytest.raises(ValueError):
        models.ols(df.limit(0), "y", ["x"])
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0


def test_grouped_ols_equals_single_fits(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(g * x + rng.normal()), float(x), float(z)) for g in range(1, 6) for x, z in rng.normal(size=(40, 2))]
    rows += [(9, 1.0, 1.0, 2.0), (9, 2.0, None, 1.0), (8, 1.0, 1.0, 1.0), (8, 2.0, 1.0, 3.0), (8, 2.5, 1.0, 4.0), (8, 0.0, 1.0, 0.0), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, y double, x double, z double")
    got = models.grouped_ols(df, "g", "y", ["x", "z"], standardize=True).collect()
    for g in range(1, 6):
        fit = models.ols(df.where(f"g = {g}"), "y", ["x", "z"])
        mine = {r.term: r for r in got if r.g == g}
        for t, e, s in zip(fit.terms, fit.estimates, fit.std_errors):
            assert mine[t].estimate == pytest.approx(e, abs=1e-9) and mine[t].std_error == pytest.approx(s, rel=1e-9)
            assert mine[t].r_squared == pytest.approx(fit.r2) and mine[t].n == 40
    assert [(r.g, r.term, r.n) for r in got if r.g in (None, 8, 9)] and all(r.term is None for r in got if r.g in (None, 8, 9))


def test_principal_order(spark):
    names = list("abcd")
    corr = {("b", "a"): 0.9, ("c", "a"): -0.7, ("c", "b"): -0.6, ("d", "a"): 0.1, ("d", "b"): None, ("d", "c"): 0.2}
    pairs = spark.createDataFrame([(t, v, k) for (t, v), k in corr.items()], "term string, vogelart string, korrelation double")
    m = np.eye(4)
    for (t, v), k in corr.items():
        m[names.index(t), names.index(v)] = m[names.index(v), names.index(t)] = k or 0.0
    centred = m - m.mean(0)
    u, s, vt = np.linalg.svd(centred)
    load = vt[0] * np.sign(vt[0][np.argmax(np.abs(vt[0]))])
    assert models.principal_order(pairs, names) == [names[i] for i in np.argsort(centred @ load)]
    assert models.principal_order(pairs, names)[0] in "ac" and models.principal_order(pairs, []) == []
    assert models.principal_order(pairs.limit(0), ["q"]) == ["q"]


@pytest.mark.parametrize("blocks", [2, 5, 16])
def test_kendall_in_blocks(spark, blocks):
    """Cut into blocks against the kernel on the whole pair; a value of x and one of y hold a third each."""
    rng = np.random.default_rng(3)
    n = 6000
    x = np.where(rng.random(n) < 0.34, 7.0, rng.integers(0, 900, n))
    y = np.where(rng.random(n) < 0.34, 3.0, x // 2 + rng.integers(0, 400, n))
    m = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(x, y)], "p double, q double, same double")
    got = {(r.term, r.vogelart): (r.korrelation, r.n) for r in
           models.kendall(m, ["p", "q", "same"], triangle=True, blocks=blocks, whole=0).collect()}
    want = weighted_kendall_tau_b(x, y, np.ones(n))
    assert got[("q", "p")][0] == pytest.approx(want, abs=1e-12) and got[("q", "p")][1] == n
    assert got[("same", "p")] == (None, n)
    small = [(a, b) for a, b in zip(x[:80], y[:80])]
    assert weighted_kendall_tau_b(x[:80], y[:80], np.ones(80)) == pytest.approx(brute_tau_b(*zip(*small)), abs=1e-12)


def test_incomplete_beta_raises_without_convergence():
    with pytest.raises(ArithmeticError):
        f_sf(1.0, 1e14, 1e14)


def test_kendall_is_planned_once(spark):
    m = spark.createDataFrame([(1, 2, 3), (2, 1, 3), (3, 3, 1), (4, None, 0)], "a int, b int, c int")
    k = models.kendall(m, ["a", "b", "c"])
    assert k._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    rows = {(r.term, r.vogelart): (r.korrelation, r.n) for r in k.collect()}
    assert len(rows) == 6 and all(rows[a, b] == rows[b, a] for a, b in rows)


def test_poisson_trend_matches_irls(spark):
    base = dt.date(2024, 3, 1)
    counts = [5, 7, None, 9, 12, 11, 15, 18, None, 22]
    df = spark.createDataFrame([(base + dt.timedelta(days=i), c) for i, c in enumerate(counts)],
                               "datum date, n long")
    out = models.poisson_trend(df, "n").orderBy("datum").collect()
    x = np.array([i for i, c in enumerate(counts) if c is not None], dtype=float) - 4.5
    yv = np.array([c for c in counts if c is not None], dtype=float)
    a, b = models.irls_poisson(x, yv)
    for i, r in enumerate(out):
        assert r.trend == pytest.approx(math.exp(a + b * (i - 4.5)), rel=1e-6)


def test_grouped_poisson_equals_separate(spark):
    base = dt.date(2024, 3, 1)
    rows = [(g, base + dt.timedelta(days=i), int(c)) for g, k in (("a", 0.1), ("b", -0.05))
            for i, c in enumerate(np.round(20 * np.exp(k * np.arange(12))))]
    df = spark.createDataFrame(rows, "g string, datum date, n long")
    joint = {(r.g, r.datum): r.trend for r in models.grouped_poisson_trend(df, "n", "g").collect()}
    per = {(r.g, r.datum): r.trend
           for r in models.grouped_poisson_trend(df, "n", "g").collect()}
    assert set(per) == set(joint)
    for key, v in joint.items():
        assert per[key] == pytest.approx(v, rel=1e-6)
    for g in ("a", "b"):
        xs = np.arange(12, dtype=float) - 5.5
        ys = np.array([c for gg, _, c in rows if gg == g], dtype=float)
        a, b = models.irls_poisson(xs, ys)
        for i in range(12):
            assert joint[(g, base + dt.timedelta(days=i))] == pytest.approx(math.exp(a + b * xs[i]), rel=1e-6)


def test_hour_matrix_fill(spark):
    t = dt.datetime(2024, 3, 1, 0, 30)
    df = spark.createDataFrame([(t, "a"), (t, "a"), (dt.datetime(2024, 3, 1, 5), "b")],
                               "zeitstempel timestamp_ntz, deutscher_name string")
    m = {(r.stunde): (r.a, r.b) for r in models.hour_matrix(df, 10).collect()}
    assert m == {24: (2, None), 5: (None, 1)}
    m0 = {(r.stunde): (r.a, r.b) for r in models.hour_matrix(df, 10, fill=0).collect()}
    assert m0 == {24: (2, 0), 5: (0, 1)}


def test_forest_labels(spark):
    tidy = spark.createDataFrame(
        [("(Intercept)", 0.0, 0.1, 1.0), ("luftdruck_in_hpa", 0.3, 0.1, 0.003),
         ("bedeckungsgrad_in_okta", -0.1, 0.1, 0.3)],
        "term string, estimate double, std_error double, p_value double")
    out = models.forest(tidy).collect()
    assert [r.term for r in out] == ["Bewölkung", "Luftdruck"]
    assert out[0].p_label == "p = 0.30" and out[1].p_label == "p < 0.01"
    assert out[1].signifikant and not out[0].signifikant
    assert out[1].ci_unten == pytest.approx(0.3 - 0.196)


def test_normalize_eager_equals_lazy(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, None, 2.0), (4.0, 7.0, 2.0)], "a double, b double, c double")
    lazy = sorted(map(tuple, models.normalize(df, ["a", "b", "c"]).collect()), key=str)
    eager = sorted(map(tuple, models.normalize(df, ["a", "b", "c"], eager=True).collect()), key=str)
    assert lazy == eager
    assert all(r[2] is None for r in eager)            # sd 0 -> NULL


def test_grouped_poisson_number_of_groups_does_not_matter(spark):
    """One group, a NULL group, a one-day group, an all-zero group and many groups: each as fitted alone."""
    base = dt.date(2024, 3, 1)
    rows = [(g, base + dt.timedelta(days=i), 5 + i + j) for j, g in enumerate(["a", None, *map(str, range(60))]) for i in range(6)]
    rows += [("one", base, 7)] + [("zero", base + dt.timedelta(days=i), 0) for i in range(4)]
    schema = "g string, datum date, n long"
    every = {(r.g, r.datum): r.trend for r in models.grouped_poisson_trend(spark.createDataFrame(rows, schema), "n", "g").collect()}
    alone = models.grouped_poisson_trend(spark.createDataFrame([r for r in rows if r[0] == "a"], schema), "n", "g").collect()
    assert len(every) == len(rows)
    for r in alone:
        assert r.trend == pytest.approx(every[r.g, r.datum], rel=1e-9)
        assert r.trend == pytest.approx(5 + (r.datum - base).days, rel=0.05)
    assert every[None, base] == pytest.approx(6, rel=0.05)
    assert every["one", base] == pytest.approx(7) and every["zero", base] == 0


def test_poisson_fit_that_does_not_converge_raises():
    with pytest.raises(ArithmeticError):
        models.irls_poisson(np.arange(5.0), np.array([1.0, 2, 4, 8, 16]), iters=2)
