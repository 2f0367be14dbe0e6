"""Window kernels against plain restatements of the documented formulas, one window at a time."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.special import beta_inc, binomial_interval, t_two_sided
from tidemark.operators import kernels as K
from tidemark.panel import Panel

rng = np.random.default_rng(11)
WALK = 100 * np.cumprod(1 + rng.normal(0, 0.02, 400))


def windows(n, count=25):
    starts = rng.integers(0, len(WALK) - n, count)
    return np.stack([WALK[s : s + n] for s in starts])


def fit(x, y):
    return np.polyfit(x, y, 1)[0]


def rs_one(p, max_lag):
    r = np.diff(np.log(p))
    lags = range(2, min(max_lag, len(r) // 2))
    vals = []
    for lag in lags:
        blocks = [r[i * lag : (i + 1) * lag] for i in range(len(r) // lag)]
        got = []
        for b in blocks:
            cs = np.cumsum(b - b.mean())
            got.append((cs.max() - cs.min()) / b.std(ddof=1))
        vals.append(np.mean(got))
    return np.clip(fit(np.log(list(lags)), np.log(vals)), 0, 1)


def dfa_one(p, max_window):
    r = np.diff(np.log(p))
    y = np.cumsum(r - r.mean())
    sizes = np.unique(np.logspace(np.log10(4), np.log10(min(max_window, len(y) // 2)), 50).astype(int))
    pts = []
    for s in sizes:
        if s < 4 or s > len(y) // 2:
            continue
        f = []
        for i in range(len(y) // s):
            b = y[i * s : (i + 1) * s]
            x = np.arange(s)
            f.append(np.sqrt(np.mean((b - np.polyval(np.polyfit(x, b, 1), x)) ** 2)))
        pts.append((s, np.mean(f)))
    return fit(np.log([a for a, _ in pts]), np.log([b for _, b in pts]))


def higuchi_one(p):
    r = np.diff(np.log(p))
    n = len(r)
    out = []
    for k in range(1, min(8, n // 4) + 1):
        parts = []
        for m in range(k):
            x = r[m::k]
            if len(x) > 1:
                parts.append(np.abs(np.diff(x)).sum() * (n - 1) / (((n - 1) // k) * k * k))
        out.append(np.mean(parts))
    return np.clip(-fit(np.log(np.arange(1, len(out) + 1)), np.log(np.array(out) + 1e-10)), 1, 2)


def adf_one(p):
    """Dickey-Fuller by explicit regressions, one lag length at a time."""
    x = np.log(p)
    n = len(x)
    top = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))
    d = np.diff(x)

    def regress(lag, start):
        y = d[start:]
        cols = [np.ones(len(y)), x[start:-1]] + [d[start - j : len(d) - j] for j in range(1, lag + 1)]
        a = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        res = y - a @ beta
        ssr = res @ res
        s2 = ssr / (len(y) - a.shape[1])
        se = np.sqrt(s2 * np.linalg.inv(a.T @ a)[1, 1])
        aic = len(y) * np.log(ssr / len(y)) + 2 * a.shape[1]
        return aic, beta[1] / se

    best = min(range(top + 1), key=lambda k: regress(k, top)[0])
    return regress(best, best)[1]


def kpss_one(p):
    e = np.log(p) - np.log(p).mean()
    n = len(e)
    s0, s1 = (e @ e) / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        g = (e[i:] @ e[:-i]) / (n / 2)
        s0 += g
        s1 += i * g
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    var = e @ e + sum(2 * (e[i:] @ e[:-i]) * (1 - i / (lags + 1)) for i in range(1, lags + 1))
    return (np.cumsum(e) ** 2).sum() / n**2 / (var / n)


@pytest.mark.parametrize(
    "fn,one,n",
    [
        (K.hurst_rs(25), lambda p: rs_one(p, 25), 50),
        (K.hurst_dfa(15), lambda p: dfa_one(p, 15), 30),
        (K.hurst_dfa(30), lambda p: dfa_one(p, 30), 60),
        (K.higuchi, higuchi_one, 30),
        (K.adf_stat, adf_one, 50),
        (K.adf_stat, adf_one, 33),
        (K.kpss_stat, kpss_one, 50),
    ],
)
def test_against_formula(fn, one, n):
    w = windows(n)
    np.testing.assert_allclose(fn(w), [one(p) for p in w], rtol=1e-7, atol=1e-9)


def test_ks_small_sizes_by_enumeration():
    from itertools import combinations

    n = 5
    counts = np.zeros(n + 1)
    for pick in combinations(range(2 * n), n):
        step = np.cumsum([1 if i in pick else -1 for i in range(2 * n)])
        counts[np.abs(step).max()] += 1
    tail = counts[::-1].cumsum()[::-1] / counts.sum()
    np.testing.assert_allclose(K.ks_table(n), tail, rtol=1e-12)


def test_ks_steps_counts_ties_together():
    a, b = np.array([[1.0, 2, 2, 3]]), np.array([[2.0, 2, 4, 5]])
    values = np.unique(np.concatenate([a, b], axis=1))
    want = max(abs((a <= v).sum() - (b <= v).sum()) for v in values)
    assert K.ks_steps(a, b)[0] == want


def test_structural_break_uses_two_parts_at_twice_the_inner_window():
    w = windows(100, 10)
    got = K.structural_break(50)(w)
    r = w[:, 1:] / w[:, :-1] - 1
    for i in range(len(w)):
        rec, bef = r[i, -50:], r[i, -100:-50]
        ac = abs(np.corrcoef(rec[1:], rec[:-1])[0, 1] - np.corrcoef(bef[1:], bef[:-1])[0, 1])
        h = K.ks_steps(w[i : i + 1, :50], w[i : i + 1, 50:])[0]
        want = (min(100, ac * 100) * 0.2 + (1 - K.ks_table(50)[h]) * 100 * 0.2) / 0.4
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_percent_rank_averages_ties():
    assert K.percent_rank(np.array([[1.0, 2, 2, 2]]))[0] == pytest.approx((1 + 2 + 3 + 4 - 1) / 3 / 4)


def test_tail_mean():
    w = rng.normal(size=(5, 40))
    want = [x[x <= np.quantile(x, 0.05)].mean() for x in w]
    np.testing.assert_allclose(K.tail_mean(0.05)(w), want)


def test_higher_highs():
    w = np.array([[1, 2, 1, 3, 1, 2, 1, 0.5, 0.4]], float)
    assert K.higher_extremes(1)(w)[0] == 0.0  # last two peaks 3 then 2
    assert K.higher_extremes(1)(w[:, :5])[0] == 1.0  # peaks 2 then 3


def test_adf_pvalue_published_points():
    # 1 / 5 / 10 percent critical values for a constant, large samples
    np.testing.assert_allclose(K.adf_pvalue_of(np.array([-3.43, -2.86, -2.57])), [0.01, 0.05, 0.10], atol=2e-3)


def test_special_functions():
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)
    lo, hi = binomial_interval(np.array([0, 5, 10]), np.array([10, 10, 10]))
    assert lo[0] == 0 and hi[2] == 1
    assert lo[1] == pytest.approx(0.187086, abs=1e-6) and hi[1] == pytest.approx(0.812914, abs=1e-6)


def test_gaps_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(9)
    x = 100 * np.cumprod(1 + rng.normal(0, 0.02, 400))
    x[[0, 1, 90, 91, 92, 250]] = np.nan
    days = pd.date_range("2001-01-01", periods=400, freq="D").date
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "ts": days, "x": x})).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    kernel = [K.Kernel("rank", "x", K.percent_rank, 60, 20)]
    want = pd.Series(x).rolling(60, min_periods=20).apply(lambda w: ((w < w[-1]).sum() + (w <= w[-1]).sum() + 1) / 2 / (~np.isnan(w)).sum(), raw=True)
    for size in (64, 100, 4096):
        got = K.apply_kernels(df, Panel(chunk_rows=size), kernel).orderBy("ts").toPandas()["rank"]
        known = ~np.isnan(x)
        np.testing.assert_allclose(got[known], want[known])
