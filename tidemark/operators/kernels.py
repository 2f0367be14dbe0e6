"""Rolling statistics with no window-expression form, over Arrow batches of one chunk each.

A chunk arrives with the history rows its windows need, so one very long series is worked on in
parallel and a task never holds more than ``chunk_rows`` plus the window.  Each kernel takes a
matrix with one window per row (oldest value first) and returns one number per row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.functions.special import norm_cdf, t_two_sided
from tidemark.panel import CHUNK, OWN, Panel


@dataclass(frozen=True)
class Kernel:
    """``name`` = fn over windows of ``n`` values of ``column``; windows of ``m``..``n`` - 1 values
    are used at the start of a series.  ``offset`` windows end that many rows before the row."""

    name: str
    column: str
    fn: Callable[[np.ndarray], np.ndarray]
    n: int
    m: int | None = None
    offset: int = 0


def apply_kernels(df: DataFrame, panel: Panel, kernels: Sequence[Kernel]) -> DataFrame:
    """Add one column per kernel, in one shuffle."""
    back = max(k.n + k.offset for k in kernels)
    cols = sorted({k.column for k in kernels})
    frame = panel.halo(df, back)
    ts = panel.ts
    schema = T.StructType([f for f in frame.schema.fields if f.name not in (CHUNK, OWN)])
    for k in kernels:
        schema = schema.add(k.name, T.DoubleType())
    names = [f.name for f in schema.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        own = pdf[OWN].to_numpy()
        values = {x: pdf[x].to_numpy(dtype=float, na_value=np.nan) for x in cols}
        rows = np.flatnonzero(own)
        out = pdf.loc[own, [c for c in pdf.columns if c not in (CHUNK, OWN)]].copy()
        for k in kernels:
            out[k.name] = _roll(values[k.column], rows, k)[own]
        return out[names]

    return frame.groupBy(*panel.keys, CHUNK).applyInPandas(run, schema)


def _roll(x: np.ndarray, rows: np.ndarray, k: Kernel) -> np.ndarray:
    """The kernel over the known values of each row's last ``n`` rows, where there are ``m`` or more.

    One rule for the first rows of a series and for gaps, so a result never depends on where a chunk
    begins.  Windows without a gap are done together."""
    res = np.full(len(x), np.nan)
    n, m = k.n, k.n if k.m is None else k.m
    known = ~np.isnan(x)
    total = np.concatenate(([0], np.cumsum(known)))
    end = rows - k.offset
    rows, end = rows[end >= 0], end[end >= 0]
    low = np.maximum(end - n + 1, 0)
    count = total[end + 1] - total[low]
    full = count == n
    with np.errstate(all="ignore"):
        if full.any():
            view = np.lib.stride_tricks.sliding_window_view(x, n)
            res[rows[full]] = k.fn(view[low[full]])
        for i in np.flatnonzero(~full & (count >= max(m, 1))):
            w = x[low[i] : end[i] + 1]
            res[rows[i]] = k.fn(w[~np.isnan(w)][None, :])[0]
    return res


# -- helpers -----------------------------------------------------------------------------------


def _slope(x: np.ndarray, y: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Row-wise least-squares slope over the entries marked ok; NaN with fewer than two."""
    cnt = ok.sum(axis=1)
    xs, ys = np.where(ok, x, 0.0), np.where(ok, y, 0.0)
    safe = np.maximum(cnt, 1)
    xm, ym = xs.sum(axis=1) / safe, ys.sum(axis=1) / safe
    dx = np.where(ok, x - xm[:, None], 0.0)
    dy = np.where(ok, y - ym[:, None], 0.0)
    return np.where(cnt >= 2, (dx * dy).sum(axis=1) / (dx * dx).sum(axis=1), np.nan)


def _log_returns(w: np.ndarray) -> np.ndarray:
    return np.diff(np.log(w), axis=1)


# -- order statistics --------------------------------------------------------------------------


def percent_rank(w: np.ndarray) -> np.ndarray:
    """Rank of the last value among the window, ties averaged, as a share."""
    last = w[:, -1:]
    return ((w < last).sum(axis=1) + ((w == last).sum(axis=1) + 1) / 2) / w.shape[1]


def tail_mean(q: float) -> Callable[[np.ndarray], np.ndarray]:
    """Mean of the values at or below the q quantile."""

    def fn(w):
        cut = np.quantile(w, q, axis=1, keepdims=True)
        low = w <= cut
        return np.where(low, w, 0.0).sum(axis=1) / low.sum(axis=1)

    return fn


# -- memory of a series ------------------------------------------------------------------------


def hurst_rs(max_lag: int, min_points: int = 2, check_length: bool = True):
    """Rescaled range on log returns: slope of log mean(R/S) on log block size, in [0, 1]."""

    def fn(w):
        r = _log_returns(w)
        n = r.shape[1]
        if n < 10 or (check_length and w.shape[1] < max_lag):
            return np.full(len(w), np.nan)
        lags = np.arange(2, min(max_lag, n // 2))
        rs = np.full((len(w), len(lags)), np.nan)
        for j, lag in enumerate(lags):
            nb = n // lag
            b = r[:, : nb * lag].reshape(len(w), nb, lag)
            dev = np.cumsum(b - b.mean(axis=2, keepdims=True), axis=2)
            span = dev.max(axis=2) - dev.min(axis=2)
            s = b.std(axis=2, ddof=1)
            ok = s > 0
            k = ok.sum(axis=1)
            rs[:, j] = np.where(k > 0, np.where(ok, span / np.where(ok, s, 1), 0).sum(axis=1) / np.maximum(k, 1), np.nan)
        # a block size without any usable block is left out, and the sizes close up
        order = np.argsort(np.isnan(rs), axis=1, kind="stable")
        rs = np.take_along_axis(rs, order, axis=1)
        ok = np.isfinite(np.log(rs))
        h = _slope(np.broadcast_to(np.log(lags), rs.shape), np.log(rs), ok)
        enough = (~np.isnan(rs)).sum(axis=1) >= min_points
        return np.where(enough, np.clip(h, 0, 1), np.nan)

    return fn


def hurst_dfa(max_window: int, min_window: int = 4):
    """Detrended fluctuation analysis of log returns; not bounded."""

    def fn(w):
        r = _log_returns(w)
        n = r.shape[1]
        if w.shape[1] < max_window or n < max_window:
            return np.full(len(w), np.nan)
        y = np.cumsum(r - r.mean(axis=1, keepdims=True), axis=1)
        sizes = np.unique(np.logspace(np.log10(min_window), np.log10(min(max_window, n // 2)), 50).astype(int))
        sizes = [s for s in sizes if 4 <= s <= n // 2]
        if len(sizes) < 2:
            return np.full(len(w), np.nan)
        fl = np.empty((len(w), len(sizes)))
        for j, s in enumerate(sizes):
            nb = n // s
            b = y[:, : nb * s].reshape(len(w), nb, s)
            x = np.arange(s) - (s - 1) / 2
            b = b - b.mean(axis=2, keepdims=True)
            beta = (b * x).sum(axis=2) / (x * x).sum()
            fl[:, j] = np.sqrt(((b - beta[:, :, None] * x) ** 2).mean(axis=2)).mean(axis=1)
        return _slope(np.broadcast_to(np.log(sizes), fl.shape), np.log(fl), fl > 0)

    return fn


def higuchi(w: np.ndarray) -> np.ndarray:
    """Higuchi fractal dimension of log returns, in [1, 2]."""
    r = _log_returns(w)
    n = r.shape[1]
    k_max = min(8, n // 4)
    if n < 10 or k_max < 2:
        return np.full(len(w), np.nan)
    lengths = []
    for k in range(1, k_max + 1):
        parts = [
            np.abs(np.diff(r[:, m::k], axis=1)).sum(axis=1) * (n - 1) / (((n - 1) // k) * k * k)
            for m in range(k) if len(range(m, n, k)) >= 2
        ]
        lengths.append(np.mean(parts, axis=0))
    y = np.log(np.array(lengths).T + 1e-10)
    x = np.broadcast_to(np.log(np.arange(1, k_max + 1)), y.shape)
    return np.clip(-_slope(x, y, np.isfinite(y)), 1.0, 2.0)


# -- stationarity ------------------------------------------------------------------------------


def _lagged(d: np.ndarray, lags: int) -> np.ndarray:
    """Differences and their first ``lags`` lags, trimmed: (rows, obs, lags)."""
    n = d.shape[1]
    return np.stack([d[:, lags - j : n - j] for j in range(1, lags + 1)], axis=2) if lags else d[:, :, None][:, :, :0]


def adf_stat(w: np.ndarray) -> np.ndarray:
    """Augmented Dickey-Fuller t statistic on log prices, constant, lag length by AIC.

    The models compared are nested, so one QR factorisation per window gives the residual sum of
    squares of all of them.
    """
    out = np.full(len(w), np.nan)
    length = w.shape[1]
    if length < 30:
        return out
    good = np.ptp(w, axis=1) > 0
    x = np.log(w[good])
    if not len(x):
        return out
    d = np.diff(x, axis=1)
    top = min(length // 2 - 2, math.ceil(12 * (length / 100) ** 0.25))
    y = d[:, top:]
    obs = y.shape[1]
    design = np.concatenate([np.ones((len(x), obs, 1)), x[:, top:-1, None], _lagged(d, top)], axis=2)
    q, _ = np.linalg.qr(design)
    proj = np.einsum("rok,ro->rk", q, y) ** 2
    ssr = (y * y).sum(axis=1, keepdims=True) - np.cumsum(proj, axis=1)
    params = np.arange(1, design.shape[2] + 1)
    aic = obs * np.log(ssr[:, 1:] / obs) + 2 * params[1:]
    best = np.argmin(aic, axis=1)
    t = np.full(len(x), np.nan)
    for lag in np.unique(best):
        sel = best == lag
        yy = d[sel, lag:]
        m = yy.shape[1]
        full = np.concatenate([np.ones((sel.sum(), m, 1)), _lagged(d[sel], lag), x[sel, lag:-1, None]], axis=2)
        qq, rr = np.linalg.qr(full)
        c = np.einsum("rok,ro->rk", qq, yy)
        res = (yy * yy).sum(axis=1) - (c * c).sum(axis=1)
        sigma = np.sqrt(res / (m - full.shape[2]))
        t[sel] = c[:, -1] * np.sign(rr[:, -1, -1]) / sigma
    out[good] = t
    return out


def adf_pvalue_of(t: np.ndarray) -> np.ndarray:
    """MacKinnon (1994) response surface for one variable with a constant."""
    # fixed values: published coefficients and the range they hold on
    small, large = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
    star, low, high = -1.61, -18.83, 2.74
    ps = norm_cdf(small[0] + small[1] * t + small[2] * t**2)
    pl = norm_cdf(large[0] + large[1] * t + large[2] * t**2 + large[3] * t**3)
    p = np.where(t <= star, ps, pl)
    p = np.where(t > high, 1.0, np.where(t < low, 0.0, p))
    return np.where(np.isnan(t), np.nan, p)


def adf_pvalue(w: np.ndarray) -> np.ndarray:
    return adf_pvalue_of(adf_stat(w))


def kpss_stat(w: np.ndarray) -> np.ndarray:
    """KPSS level statistic on log prices with the Hobijn et al. (1998) bandwidth."""
    n = w.shape[1]
    if n < 30:
        return np.full(len(w), np.nan)
    e = np.log(w)
    e = e - e.mean(axis=1, keepdims=True)
    auto = [(e[:, i:] * e[:, : n - i]).sum(axis=1) for i in range(n)]
    s0, s1 = auto[0] / n, np.zeros(len(w))
    for i in range(1, int(n ** (2 / 9)) + 1):
        s0 = s0 + auto[i] / (n / 2)
        s1 = s1 + i * auto[i] / (n / 2)
    gamma = 1.1447 * ((s1 / s0) ** 2) ** (1 / 3)
    lags = np.minimum(np.nan_to_num(gamma * n ** (1 / 3)).astype(int), n - 1)
    var = auto[0].copy()
    for i in range(1, int(lags.max(initial=0)) + 1):
        var = var + np.where(i <= lags, 2 * auto[i] * (1 - i / (lags + 1)), 0.0)
    eta = (np.cumsum(e, axis=1) ** 2).sum(axis=1) / n**2
    return np.where(var > 0, eta / (var / n), np.nan)


def _half_life(w: np.ndarray) -> np.ndarray:
    if w.shape[1] < 20:
        return np.full(len(w), np.nan)
    x = np.log(w)
    a, b = x[:, :-1], x[:, 1:]
    da = a - a.mean(axis=1, keepdims=True)
    beta = (da * (b - b.mean(axis=1, keepdims=True))).sum(axis=1) / (da * da).sum(axis=1)
    hl = -math.log(2) / np.log(beta)
    return np.where((beta > 0) & (beta < 1), np.clip(hl, 1, 252), np.nan)


def mean_reversion_score(w: np.ndarray) -> np.ndarray:
    """0-100: half-life, ADF p-value, distance from the half-window mean and band position, with
    the weights shared out over the parts that exist."""
    n = w.shape[1]
    half, band = n // 2, min(20, n // 2)
    hl = np.clip((1 - _half_life(w) / n) * 100, 0, 100)
    adf = np.clip((1 - adf_pvalue(w)) * 100, 0, 100)
    ma = w[:, -half:].mean(axis=1)
    dist = np.minimum(100, np.abs((w[:, -1] - ma) / ma) * 500)
    b = w[:, -band:]
    sd = b.std(axis=1, ddof=1)
    pos = np.where(sd > 0, (w[:, -1] - (b.mean(axis=1) - 2 * sd)) / (4 * sd), np.nan)
    parts = np.stack([hl, adf, dist, np.abs(pos - 0.5) * 200], axis=1)
    weight = np.array([0.3, 0.25, 0.25, 0.2])
    ok = ~np.isnan(parts)
    return np.where(ok, parts * weight, 0).sum(axis=1) / np.where(ok, weight, 0).sum(axis=1)


# -- structural change -------------------------------------------------------------------------


def ks_table(n: int) -> np.ndarray:
    """Exact two-sided p-value of the two-sample Kolmogorov-Smirnov statistic h/n for equal sizes
    (Gnedenko and Korolyuk 1951), indexed by h."""
    total = math.comb(2 * n, n)
    p = [1.0]
    for h in range(1, n + 1):
        s = sum((-1) ** (k + 1) * math.comb(2 * n, n - k * h) for k in range(1, n // h + 1))
        p.append(min(1.0, 2 * s / total))
    return np.array(p)


def ks_steps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest difference of the two empirical counts, per row, for equal sizes."""
    both = np.concatenate([a, b], axis=1)
    order = np.argsort(both, axis=1, kind="stable")
    v = np.take_along_axis(both, order, axis=1)
    step = np.where(order < a.shape[1], 1, -1).cumsum(axis=1)
    closes = np.ones(v.shape, bool)
    closes[:, :-1] = v[:, 1:] != v[:, :-1]  # count ties together
    return np.abs(np.where(closes, step, 0)).max(axis=1)


def _autocorr(r: np.ndarray) -> np.ndarray:
    a, b = r[:, 1:], r[:, :-1]
    da, db = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    den = np.sqrt((da * da).sum(axis=1) * (db * db).sum(axis=1))
    return np.where(den > 0, (da * db).sum(axis=1) / np.where(den > 0, den, 1), np.nan)


def structural_break(inner: int):
    """0-100: shift of mean, volatility, autocorrelation and distribution between two halves."""
    table = ks_table(inner)

    def fn(w):
        n = w.shape[1]
        if n < 2 * inner:
            return np.full(len(w), np.nan)
        r = w[:, 1:] / w[:, :-1] - 1
        recent, before = r[:, -inner:], r[:, -2 * inner : -inner]
        parts, weights = [], []
        if r.shape[1] >= 2 * inner:
            sd = r.std(axis=1, ddof=1)
            shift = np.abs(recent.mean(axis=1) - before.mean(axis=1)) / sd
            parts.append(np.where(sd > 0, np.minimum(100, shift * 50), np.nan))
            vol = before.std(axis=1, ddof=1)
            parts.append(np.where(vol > 0, np.minimum(100, np.abs(recent.std(axis=1, ddof=1) - vol) / vol * 100), np.nan))
            weights += [0.3, 0.3]
        parts.append(np.minimum(100, np.abs(_autocorr(recent) - _autocorr(before)) * 100))
        parts.append((1 - table[ks_steps(w[:, -2 * inner : -inner], w[:, -inner:])]) * 100)
        weights += [0.2, 0.2]
        mat, wt = np.stack(parts, axis=1), np.array(weights)
        ok = ~np.isnan(mat)
        return np.where(ok, mat * wt, 0).sum(axis=1) / np.where(ok, wt, 0).sum(axis=1)

    return fn


def trend_pvalue(w: np.ndarray) -> np.ndarray:
    """Two-sided p-value of the linear trend."""
    n = w.shape[1]
    if n < 5:
        return np.full(len(w), np.nan)
    x = np.arange(n) - (n - 1) / 2
    d = w - w.mean(axis=1, keepdims=True)
    sxx, syy = (x * x).sum(), (d * d).sum(axis=1)
    rho = (d * x).sum(axis=1) / np.sqrt(sxx * syy)
    t = rho * np.sqrt((n - 2) / np.maximum((1 - rho) * (1 + rho), 1e-20))
    return np.where(syy > 0, t_two_sided(t, n - 2), np.nan)


def higher_extremes(half: int, highs: bool = True):
    """1 if the last two local extremes (equal to the extreme of +-half rows) rise, else 0."""

    def fn(w):
        n = w.shape[1]
        out = np.zeros(len(w))
        if n < 2 * half:
            return out
        s = w if highs else -w
        last = np.full(len(w), np.nan)
        prev = np.full(len(w), np.nan)
        for i in range(max(1, half), min(n - 1, n - half)):
            peak = (s[:, i] > s[:, i - 1]) & (s[:, i] > s[:, i + 1])
            peak &= s[:, i] == s[:, max(0, i - half) : i + half + 1].max(axis=1)
            prev = np.where(peak, last, prev)
            last = np.where(peak, w[:, i], last)
        return (last > prev).astype(float)

    return fn


def cusum(part: str):
    """Two-sided CUSUM of a window of returns: slack half a deviation, alarm at four, both sides reset
    together.  ``pos`` / ``neg`` are the running maxima, ``changes`` the number of alarms."""

    def fn(w):
        if w.shape[1] < 10:
            return np.full(len(w), np.nan)
        sd = w.std(axis=1, ddof=1)
        p = q = mp = mq = changes = np.zeros(len(w))
        for j in range(w.shape[1]):
            p = np.maximum(0, p + w[:, j] - sd / 2)
            q = np.maximum(0, q - w[:, j] - sd / 2)
            mp, mq = np.maximum(mp, p), np.maximum(mq, q)
            alarm = (p > 4 * sd) | (q > 4 * sd)
            changes = changes + alarm
            p, q = np.where(alarm, 0, p), np.where(alarm, 0, q)
        return np.where(sd > 0, {"pos": mp, "neg": mq, "changes": changes}[part], 0.0)

    return fn


# fixed values: the windows the feature builders use
MODEL_KERNELS = (
    Kernel("hurst_30d", "close", hurst_dfa(15), 30, 10),
    Kernel("hurst_60d", "close", hurst_dfa(30), 60, 20),
    Kernel("fractal_dimension_30d", "close", higuchi, 30, 10),
    Kernel("adf_stat_30d", "close", adf_stat, 50, 30),
    Kernel("kpss_stat_30d", "close", kpss_stat, 50, 30),
    Kernel("mr_score_30d", "close", mean_reversion_score, 50, 30),
    Kernel("structural_break_score", "close", structural_break(50), 100, 50),
)
CUSUM_KERNELS = tuple(Kernel(f"cusum_{s}", "simple_return_1d", cusum(s), 30, 10) for s in ("pos", "neg"))


def window_family(windows: Sequence[int], column: str = "close") -> list[Kernel]:
    """Every kernel for every window, named <kernel>_<window>."""
    out = []
    for n in windows:
        out += [
            Kernel(f"hurst_rs_{n}", column, hurst_rs(n // 2), n),
            Kernel(f"hurst_dfa_{n}", column, hurst_dfa(n // 2), n),
            Kernel(f"fractal_dim_{n}", column, higuchi, n),
            Kernel(f"adf_stat_{n}", column, adf_stat, n),
            Kernel(f"kpss_stat_{n}", column, kpss_stat, n),
            Kernel(f"mean_reversion_score_{n}", column, mean_reversion_score, n),
            Kernel(f"structural_break_score_{n}", column, structural_break(n), 2 * n),
            Kernel(f"trend_p_value_{n}", column, trend_pvalue, n),
            Kernel(f"higher_highs_{n}", column, higher_extremes(n // 2), n),
        ]
    return out


