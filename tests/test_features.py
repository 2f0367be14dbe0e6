"""Every registered feature: causal, chunk-invariant, and reported when its inputs are absent."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels as K
from tidemark.operators.features import FEATURES
from tidemark.operators.model_features import MODEL_FEATURES, model_features
from tidemark.panel import DAILY, Panel

rng = np.random.default_rng(7)
N = 420
EXOG = sorted(
    {i for f in FEATURES.items.values() for i in f.inputs if i not in FEATURES.items}
    - {"open", "high", "low", "close", "volume", "n_obs", "ts", "series_start", "hurst_30d", "half_life_60d", "regime_duration"}
)
PUBLIC = [n for n in FEATURES.items if not n.startswith("_") and n not in ("hurst_x_halflife", "vol_x_regime_duration", "trend_strength", "mean_reversion_score", "mvrv_hurst_signal")]


def make(seed=3):
    r = np.random.default_rng(seed)
    out = []
    for s in ("a", "b"):
        close = 100 * np.cumprod(1 + r.normal(0, 0.02, N))
        pdf = pd.DataFrame({"series_id": s, "ts": pd.date_range("1999-01-01", periods=N).date, "close": close})
        pdf["open"] = close * (1 + r.normal(0, 0.01, N))
        pdf["high"] = np.maximum(pdf.open, close) * 1.01
        pdf["low"] = np.minimum(pdf.open, close) * 0.99
        pdf["volume"] = r.uniform(1, 2, N) * 1e4
        pdf["n_obs"] = r.integers(1, 50, N)
        pdf["series_start"] = pdf.ts.iloc[0]
        for x in EXOG:
            pdf[x] = 50 + np.cumsum(r.normal(0, 0.5, N))
        out.append(pdf)
    return pd.concat(out, ignore_index=True)


def table(df, cols):
    return df.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)[cols]


def numeric(pdf):
    return pdf.apply(lambda s: pd.to_numeric(s, errors="coerce") if s.dtype == object else s.astype(float))


@pytest.fixture(scope="module")
def base(spark):
    pdf = make()
    return pdf, spark.createDataFrame(pdf).cache()


def test_all_features_causal_and_chunk_invariant(spark, base):
    pdf, df = base
    names = [n for n in PUBLIC]
    got, skipped = FEATURES.build(df, DAILY, names)
    assert not skipped
    plain = table(got, names)
    shocked = pdf.copy()
    last = shocked.groupby("series_id").tail(1).index
    prices = ["open", "high", "low", "close"] + EXOG
    shocked.loc[last, prices] *= 1.5
    other = table(FEATURES.build(spark.createDataFrame(shocked), Panel(chunk_rows=150), names)[0], names)
    keep = plain.index.difference(last)
    labels = [n for n in names if plain[n].dtype == object and isinstance(plain[n].dropna().iloc[0], str)]
    a, b = numeric(plain.drop(columns=labels)), numeric(other.drop(columns=labels))
    for n in a.columns:
        np.testing.assert_allclose(a.loc[keep, n], b.loc[keep, n], rtol=1e-7, atol=1e-7, err_msg=n)
    for n in labels:
        assert plain.loc[keep, n].fillna("").tolist() == other.loc[keep, n].fillna("").tolist(), n
    moved = [n for n in a.columns if not np.allclose(a.loc[last, n], b.loc[last, n], equal_nan=True)]
    assert len(moved) > 60  # the shock is visible where it should be


def test_recursive_averages_match_pandas(base):
    pdf, df = base
    names = ["ema_12", "macd_histogram", "rsi_14d", "adx", "atr_14d", "adx_14"]
    got = table(FEATURES.build(df, Panel(chunk_rows=50), names)[0], names)
    for s, g in pdf.groupby("series_id"):
        i = g.index
        p, h, lo = g["close"], g["high"], g["low"]
        ew = lambda x, a: x.ewm(alpha=a, adjust=False).mean()
        e12, e26 = ew(p, 2 / 13), ew(p, 2 / 27)
        macd = e12 - e26
        d = p.diff()
        rs = ew(d.where(d > 0, 0), 1 / 14) / (ew((-d).where(d < 0, 0), 1 / 14) + 1e-10)
        tr = pd.concat([h - lo, (h - p.shift()).abs(), (lo - p.shift()).abs()], axis=1).max(axis=1)
        up, dn = h.diff(), -lo.diff()
        pdm = up.where((up > dn) & (up > 0), 0)
        mdm = dn.where((dn > pdm) & (dn > 0), 0)
        atr = ew(tr, 1 / 14)
        pdi, mdi = 100 * ew(pdm, 1 / 14) / atr, 100 * ew(mdm, 1 / 14) / atr
        adx = ew(100 * (pdi - mdi).abs() / (pdi + mdi + 1e-10), 1 / 14)
        for n, want in {"ema_12": e12, "macd_histogram": macd - ew(macd, 0.2), "rsi_14d": 100 - 100 / (1 + rs), "adx": adx, "atr_14d": atr}.items():
            np.testing.assert_allclose(got.loc[i, n], want, rtol=1e-9, atol=1e-9, err_msg=n)


def test_absent_inputs_are_reported(base):
    _, df = base
    got, skipped = FEATURES.build(df.drop("vix", "sp500"), DAILY, ["return_7d", "vix_zscore", "btc_sp500_corr_30d", "no_such"])
    assert set(skipped) == {"vix_zscore", "btc_sp500_corr_30d", "no_such"}
    assert skipped["vix_zscore"] == ["vix"]
    assert got.columns == ["series_id", "ts", "return_7d"]


def test_kernels_chunk_invariant_and_match_cusum_fold(spark, base):
    _, df = base
    ks = list(K.MODEL_KERNELS) + [K.Kernel("rank", "close", K.percent_rank, 60)]
    small = df.select("series_id", "ts", "close")
    names = [k.name for k in ks]
    a = table(K.apply_kernels(small, DAILY, ks), names)
    b = table(K.apply_kernels(small.repartition(7), Panel(chunk_rows=40), ks), names)
    for n in names:
        np.testing.assert_allclose(a[n], b[n], rtol=1e-9, equal_nan=True, err_msg=n)
    built, _ = FEATURES.build(df, DAILY, ["simple_return_1d", "cusum_pos", "cusum_neg"])
    fold = table(built, ["cusum_pos", "cusum_neg"])
    kern = table(K.apply_kernels(built.select("series_id", "ts", "simple_return_1d"), Panel(chunk_rows=40), K.CUSUM_KERNELS), ["cusum_pos", "cusum_neg"])
    np.testing.assert_allclose(fold.astype(float), kern, rtol=1e-9)


def test_model_features(spark, base):
    _, df = base
    out, skipped = model_features(df.withColumns({"reserve_risk": F.col("vix"), "puell_raw": F.col("vix")}), DAILY)
    assert not skipped
    pdf = out.toPandas()
    assert len(set(MODEL_FEATURES)) == 32 and set(MODEL_FEATURES) <= set(pdf.columns)
    assert len(pdf) == 2 * N and not pdf[MODEL_FEATURES].isna().any().any()


def test_recursive_averages_keep_their_digits_on_flat_runs(spark):
    """Bars that move for 100 rows and then stand still: directional movement by the plain recursion."""
    n = 1500
    r = np.random.default_rng(2)
    close = np.concatenate([100 * np.cumprod(1 + r.normal(0, 0.02, 100)), np.zeros(n - 100)])
    close[100:] = close[99]
    high, low = close.copy(), close.copy()
    high[:100] *= 1.01
    low[:100] *= 0.99
    days = pd.date_range("2000-01-01", periods=n, freq="D").date
    pdf = pd.DataFrame({"series_id": "s", "ts": days, "open": close, "high": high, "low": low, "close": close, "volume": 1.0})
    df = spark.createDataFrame(pdf).withColumn("series_start", F.lit(days[0]))
    tables = [FEATURES.build(df, Panel(chunk_rows=k), ["plus_di", "minus_di", "adx", "ema_12"])[0].orderBy("ts").toPandas() for k in (64, 4096)]
    ema = pd.Series(close).ewm(alpha=2 / 13, adjust=False).mean()
    for t in tables:
        np.testing.assert_allclose(t.ema_12, ema, rtol=1e-12)
        last = t.iloc[-1]
        assert last.plus_di > 1 and last.minus_di > 1 and last.adx > 1
        np.testing.assert_allclose(t[["plus_di", "minus_di", "adx"]].iloc[200:], np.tile(t[["plus_di", "minus_di", "adx"]].iloc[[-1]].to_numpy() * [1, 1, 0], (1300, 1)) + np.outer(t.adx.iloc[200:], [0, 0, 1]), rtol=1e-6)
    np.testing.assert_allclose(tables[0].iloc[:, 2:].astype(float), tables[1].iloc[:, 2:].astype(float), rtol=1e-9)


@pytest.mark.parametrize("chunk_rows", [16, 4096])
def test_recursive_averages_over_gaps(spark, chunk_rows):
    """As ``ewm(adjust=False)``: leading, single and long gaps, a series without a value, NaN, no ``series_start``."""
    n, r = 400, np.random.default_rng(8)
    days = pd.date_range("2001-03-01", periods=n, freq="D").date
    made = {"none": np.full(n, np.nan), "full": r.normal(100, 5, n), "holes": r.normal(100, 5, n), "long": r.normal(-3, 1, n), "late": r.normal(5, 1, n)}
    made["holes"][r.random(n) < 0.4] = np.nan
    made["long"][30:290] = np.nan
    made["late"][:77] = np.nan
    pdf = pd.concat([pd.DataFrame({"series_id": k, "ts": days, "close": v}) for k, v in made.items()])
    df = spark.createDataFrame(pdf).withColumn("close", F.when((F.col("series_id") == "late") | ~F.isnan("close"), F.col("close")))
    got = FEATURES.build(df, Panel(chunk_rows=chunk_rows), ["ema_12", "ema_26", "rsi_14d"])[0].toPandas().sort_values(["series_id", "ts"])
    for k, v in made.items():
        g, p = got[got.series_id == k], pd.Series(v)
        for name, span in (("ema_12", 12), ("ema_26", 26)):
            np.testing.assert_allclose(g[name].astype(float), p.ewm(span=span, adjust=False).mean(), rtol=1e-11, err_msg=k)
        if k == "late":
            continue  # a NaN price has no sign
        d = p.diff()
        rs = d.where(d > 0, 0).ewm(alpha=1 / 14, adjust=False).mean() / ((-d).where(d < 0, 0).ewm(alpha=1 / 14, adjust=False).mean() + 1e-10)
        np.testing.assert_allclose(g["rsi_14d"].astype(float), 100 - 100 / (1 + rs), rtol=1e-9)
