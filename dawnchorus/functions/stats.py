"""Small numeric helpers for model summaries (driver-side, scalar inputs only)
and the per-group Kendall kernel used inside ``applyInPandas``."""

from __future__ import annotations

import math

import numpy as np


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"the incomplete beta function of a={a}, b={b}, x={x} did not converge")


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail P(F > f) of the F distribution."""
    if f is None or not math.isfinite(f):
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    if t is None or not math.isfinite(t):
        return float("nan")
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


def weighted_concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """S = Σ over pairs of cells of sgn(dx)·sgn(dy)·w·w', without enumerating pairs.

    In the order of (x, y), pairs are told by the highest bit in which the ranks of
    their y differ: within equal higher bits, one running sum a bit counts them all.
    Pairs of equal x, which that order counts as concordant, are taken off again.
    Cells may repeat; O(cells log² cells) in vectorized steps.
    """
    if len(w) == 0:
        return 0.0
    w = np.asarray(w, np.float64)
    _, xi = np.unique(x, return_inverse=True)
    _, yi = np.unique(y, return_inverse=True)
    order = np.lexsort((yi, xi))
    xi, yi, w = xi[order], yi[order], w[order]
    wx = np.bincount(xi, weights=w)
    first = np.concatenate(([True], (xi[1:] != xi[:-1]) | (yi[1:] != yi[:-1])))
    cells = np.add.reduceat(w, np.flatnonzero(first))  # equal cells are one
    total = -(float((wx * wx).sum()) - float((cells * cells).sum())) / 2
    for bit in range(int(yi.max()).bit_length()):
        prefix = yi >> (bit + 1)
        by = np.argsort(prefix, kind="stable")
        group, one, v = prefix[by], (yi[by] >> bit) & 1 == 1, w[by]
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(group)])))
        zeros = np.cumsum(np.where(one, 0.0, v))
        before = zeros - np.repeat((zeros - np.where(one, 0.0, v))[starts], sizes)
        weight = np.add.reduceat(np.where(one, 0.0, v), starts)
        # Of the group's zeros those before a one are smaller and stand earlier, the rest later.
        total += float((v * (2 * before - np.repeat(weight, sizes)))[one].sum())
    return total


def kendall_tau_b(s: float, n: float, x_ties: float, y_ties: float) -> float:
    """tau-b of S, the number of observations and the pairs tied in x and in y."""
    pairs = n * (n - 1) / 2
    scale = math.sqrt(max((pairs - x_ties) * (pairs - y_ties), 0.0))
    return s / scale if n >= 2 and scale > 0 else float("nan")


def weighted_kendall_tau_b(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Kendall's tau-b of observations given as (x, y) cells with multiplicities ``w``."""
    def ties(values):
        sums = np.bincount(np.unique(values, return_inverse=True)[1], weights=w) if len(values) else np.zeros(0)
        return float((sums * (sums - 1) / 2).sum())

    return kendall_tau_b(weighted_concordance(x, y, w), float(np.sum(w)), ties(x), ties(y))
