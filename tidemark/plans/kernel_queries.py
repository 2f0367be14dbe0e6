"""Window kernels and the full model feature set (checked against plain formulas in the tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import kernels as K
from tidemark.operators.features import FEATURES
from tidemark.operators.model_features import MODEL_FEATURES, model_features
from tidemark.panel import DAILY
from tidemark.plans import tables as t
from tidemark.plans.catalog import query
from tidemark.plans.feature_queries import chg, win

c = F.col


def _close(spark, sf_dir):
    return t.panel(spark, sf_dir).select("series_id", "ts", "close")


@query("model_kernels", "series_id ts " + " ".join(f"{k.name}:8" for k in K.MODEL_KERNELS))
def model_kernels(spark, sf_dir):
    return K.apply_kernels(_close(spark, sf_dir), DAILY, K.MODEL_KERNELS)


@query("hurst_of_prior_rows", "series_id ts hurst_30d_rs:8 hurst_60d_rs:8")
def hurst_of_prior_rows(spark, sf_dir):
    """Rescaled range over the rows before each row."""
    fn = K.hurst_rs(20, min_points=3, check_length=False)
    ks = [K.Kernel(f"hurst_{n}d_rs", "close", fn, n, offset=1) for n in (30, 60)]
    return K.apply_kernels(_close(spark, sf_dir), DAILY, ks)


_FAMILY = K.window_family([30, 50])


@query("kernel_windows", "series_id ts " + " ".join(f"{k.name}:8" for k in _FAMILY))
def kernel_windows(spark, sf_dir):
    return K.apply_kernels(_close(spark, sf_dir), DAILY, _FAMILY)


@query(
    "volatility_percentile", "series_id ts vol_percentile:6 vol_label",
    f"""WITH {t.SQL_PANEL}, r AS (SELECT *, {chg('close', 1)} AS x FROM panel),
        v AS (SELECT *, CASE WHEN count(x) OVER {win(10)} = 10 THEN round(stddev_samp(x) OVER {win(10)}, 9) END AS s FROM r),
        l AS (SELECT series_id, ts, s, list(s) OVER {win(51)} AS a, count(x) OVER {win(60)} AS n FROM v),
        p AS (SELECT series_id, ts, CASE WHEN n = 60 THEN (len(list_filter(a, lambda q: q < s)) + len(list_filter(a, lambda q: q <= s)) + 1) * 50.0 / len(a) END AS vol_percentile FROM l)
        SELECT *, CASE WHEN vol_percentile IS NULL THEN 'unknown' WHEN vol_percentile > 80 THEN 'high_volatility' WHEN vol_percentile > 60 THEN 'elevated_volatility' WHEN vol_percentile < 20 THEN 'low_volatility' ELSE 'normal_volatility' END AS vol_label FROM p""",
)
def volatility_percentile(spark, sf_dir):
    """Where the current 10-row volatility stands within 60 returns: a short deviation first, then its rank
    in the window."""
    base, _ = FEATURES.build(t.panel(spark, sf_dir), DAILY, ["simple_return_1d"])
    from tidemark.functions import rolling as R

    f = DAILY.halo(base, 61)
    w = DAILY.window()
    f = f.withColumns({"s": F.round(R.std("simple_return_1d", w, 10), 9), "_n": F.count("simple_return_1d").over(R.frame(w, 60))})
    # 10 returns of the 60 make the first deviation, 51 deviations stand in the window
    out = DAILY.owned(f.withColumn("_rank", R.percent_rank("s", w, 51)))
    # the averaged rank counts (strict + weak + 1) / 2
    pct = F.when(c("_n") == 60, c("_rank") * 100)
    label = (
        F.when(c("vol_percentile").isNull(), "unknown").when(c("vol_percentile") > 80, "high_volatility")
        .when(c("vol_percentile") > 60, "elevated_volatility").when(c("vol_percentile") < 20, "low_volatility").otherwise("normal_volatility")
    )
    return out.withColumn("vol_percentile", pct).withColumn("vol_label", label)


_INPUTS = ["eth", "gold", "copper", "m2_supply", "fed_balance_sheet", "futures_close", "nupl", "stablecoin_supply", "funding_rate", "reserve_risk", "puell_raw"]


@query("model_features", "series_id ts " + " ".join(f"{n}:8" for n in MODEL_FEATURES) + " trend_strength:8 regime_v3 vol_x_regime_duration:8")
def model_feature_table(spark, sf_dir):
    df, skipped = model_features(t.metric_panel(spark, sf_dir, _INPUTS), DAILY)
    if skipped:
        raise ValueError(f"absent inputs: {skipped}")
    return df


