"""The feature set a model is trained and served on, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import clean, kernels, regimes
from tidemark.operators.features import FEATURES
from tidemark.panel import Panel
from tidemark.stage import stage

c = F.col

# fixed values: the model features, in the groups they come from
WINDOWED = [
    "adx", "eth_btc_ratio", "m2_yoy_growth", "volatility_7d", "basis_pct", "basis_ma7",
    "nupl_ma30", "bb_position", "eth_pctchg_30d", "stablecoin_zscore", "stablecoin_supply_change_30d",
    "btc_gold_corr_30d_simple", "copper_return_30d", "half_life_60d", "sortino_30d", "volume_sma20_ratio",
    "aroon_down_30", "velocity", "price_fracdiff_05", "fed_fracdiff_05", "funding_rate_ma7",
]
KERNELS = ["cusum_pos", "cusum_neg", "mr_score_30d", "structural_break_score", "hurst_60d", "fractal_dimension_30d", "kpss_stat_30d"]
RAW = ["eth", "fed_balance_sheet"]
MEDIAN_FILLED = ["reserve_risk", "puell_raw"]
MODEL_FEATURES = WINDOWED + KERNELS + RAW + MEDIAN_FILLED


def model_features(df: DataFrame, panel: Panel, with_regime: bool = True, fill: bool = True) -> tuple[DataFrame, dict[str, list[str]]]:
    """All model features of a dense panel; absent inputs are reported per feature.

    Expression features and window kernels share nothing but the panel, so each takes one shuffle.
    The intermediate result is staged: the regime run lengths read it more than once.
    """
    have = [x for x in RAW + MEDIAN_FILLED if x in df.columns]
    extra = ["volatility_30d", "return_30d"] if with_regime else []
    built, skipped = FEATURES.build(df, panel, WINDOWED + ["simple_return_1d"] + extra, keep=["close", *have])
    wanted = [k for k in kernels.MODEL_KERNELS + kernels.CUSUM_KERNELS if k.name in KERNELS or k.name == "hurst_30d"]
    out = kernels.apply_kernels(built, panel, wanted)
    if have_fill := [x for x in MEDIAN_FILLED if x in have]:
        out = clean.fill_first_median(out, panel, have_fill, causal=not fill)
    if with_regime:
        h = F.coalesce("hurst_30d", F.lit(0.5))
        out = out.withColumns(
            {
                "trend_strength": c("adx") * h,
                "_code": regimes.regime_code_serving(c("volatility_30d"), c("return_30d"), c("adx"), c("hurst_30d")),
            }
        )
        out = stage(out, "model_features")
        out = regimes.smooth_code(out, panel, "_code", "regime_v3")
        out = regimes.run_length(out, panel, "regime_v3", "regime_duration")
        out = out.withColumn("vol_x_regime_duration", c("volatility_30d") * c("regime_duration")).drop("_code")
    names = [x for x in MODEL_FEATURES if x in out.columns]
    if fill:
        out = clean.fill_forward(out, panel, names, then_zero=True)
    tail = ["trend_strength", "regime_v3", "vol_x_regime_duration"] if with_regime else []
    return out.select(*panel.keys, panel.ts, *names, *tail), skipped
