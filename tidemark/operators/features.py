"""Price, volume, candle, risk, macro, on-chain and interaction features.

Inputs are the panel columns ``open high low close volume`` and, where a feature needs them, named
exogenous columns.  All windows count rows of a dense calendar panel.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions.scalars import clip, div, flag
from tidemark.operators.registry import FEATURES

reg = FEATURES

YEAR = math.sqrt(365)
c = F.col


# -- returns, lags, momentum -------------------------------------------------------------------

for p in (1, 7, 14, 30, 60, 90, 180, 365):
    reg.add(f"return_{p}d", "close", lambda s, p=p: R.log_change("close", s.w, p), back=p)
reg.add("simple_return_1d", "close", lambda s: R.pct_change("close", s.w, 1), back=1)
for k in (1, 2, 3, 5, 7):
    reg.add(f"return_lag_{k}", "return_1d", lambda s, k=k: F.lag("return_1d", k).over(s.w), back=k)
reg.add("momentum_10d", "close", lambda s: R.pct_change("close", s.w, 10), back=10)
reg.add(
    "momentum_consensus",
    "return_7d return_30d return_90d",
    lambda s: F.signum("return_7d") + F.signum("return_30d") + F.signum("return_90d"),
)
for p in (7, 30):
    reg.add(
        f"momentum_accel_{p}d", f"return_{p}d",
        lambda s, p=p: c(f"return_{p}d") - F.lag(f"return_{p}d", p).over(s.w), back=p,
    )

# -- volatility --------------------------------------------------------------------------------

for p in (7, 30, 60, 90):
    reg.add(f"volatility_{p}d", "return_1d", lambda s, p=p: R.std("return_1d", s.w, p) * YEAR, back=p)
reg.add("volatility_lag_7", "volatility_30d", lambda s: F.lag("volatility_30d", 7).over(s.w), back=7)
reg.add("_hl2", "high low", lambda s: F.pow(F.ln(div("high", "low")), 2))
reg.add(
    "parkinson_vol_14d", "_hl2",
    lambda s: F.sqrt(R.total("_hl2", s.w, 14) / (4 * 14 * math.log(2))) * YEAR, back=14,
)
reg.add("_pk1", "_hl2", lambda s: F.sqrt(c("_hl2") / (4 * math.log(2))))
reg.add("parkinson_vol_14d_mean", "_pk1", lambda s: R.mean("_pk1", s.w, 14), back=14)
reg.add("intraday_range", "high low close", lambda s: div(c("high") - c("low"), "close"))

# -- trend and oscillators ---------------------------------------------------------------------

for p in (20, 50, 200):
    reg.add(f"sma_{p}d", "close", lambda s, p=p: R.mean("close", s.w, p), back=p)
    reg.add(f"price_to_sma{p}", f"close sma_{p}d", lambda s, p=p: div("close", f"sma_{p}d") - 1)
reg.add("_d1", "close", lambda s: c("close") - F.lag("close", 1).over(s.w), back=1)
reg.add("_gain", "_d1", lambda s: F.when(c("_d1") > 0, c("_d1")).otherwise(0.0))
reg.add("_loss", "_d1", lambda s: F.when(c("_d1") < 0, -c("_d1")).otherwise(0.0))
reg.ewm("_avg_gain", "_gain", 1 / 14)
reg.ewm("_avg_loss", "_loss", 1 / 14)
reg.add(
    "rsi_14d", "_avg_gain _avg_loss",
    lambda s: 100 - 100 / (1 + c("_avg_gain") / (c("_avg_loss") + 1e-10)),
)
reg.ewm("ema_12", "close", 2 / 13)
reg.ewm("ema_26", "close", 2 / 27)
reg.add("macd", "ema_12 ema_26", lambda s: c("ema_12") - c("ema_26"))
reg.ewm("macd_signal", "macd", 2 / 10)
reg.add("macd_histogram", "macd macd_signal", lambda s: c("macd") - c("macd_signal"))
reg.add("price_oscillator", "ema_12 ema_26", lambda s: div(c("ema_12") - c("ema_26"), "ema_26") * 100)
for n in (20, 30):
    reg.add(f"_bbm_{n}", "close", lambda s, n=n: R.mean("close", s.w, n), back=n)
    reg.add(f"_bbs_{n}", "close", lambda s, n=n: R.std("close", s.w, n), back=n)
    reg.add(
        f"bb_position_{n}", f"close _bbm_{n} _bbs_{n}",
        lambda s, n=n: div(c("close") - (c(f"_bbm_{n}") - 2 * c(f"_bbs_{n}")), 4 * c(f"_bbs_{n}")),
    )
    reg.add(f"bb_width_{n}", f"_bbm_{n} _bbs_{n}", lambda s, n=n: div(4 * c(f"_bbs_{n}"), f"_bbm_{n}") * 100)
    reg.add(f"bb_distance_{n}", f"close _bbm_{n} _bbs_{n}", lambda s, n=n: div(c("close") - c(f"_bbm_{n}"), f"_bbs_{n}"))
reg.add("bb_width", "_bbm_20 _bbs_20", lambda s: div(4 * c("_bbs_20"), "_bbm_20"))
reg.add(
    "bb_position", "close _bbm_20 _bbs_20",
    lambda s: (c("close") - (c("_bbm_20") - 2 * c("_bbs_20"))) / (4 * c("_bbs_20") + 1e-10),
    doc="position in the 20-row band, denominator guarded by 1e-10",
)
reg.add("_lo14", "close", lambda s: R.low("close", s.w, 14), back=14)
reg.add("_hi14", "close", lambda s: R.high("close", s.w, 14), back=14)
reg.add("stochastic_k", "close _lo14 _hi14", lambda s: 100 * div(c("close") - c("_lo14"), c("_hi14") - c("_lo14")))
reg.add("stochastic_d", "stochastic_k", lambda s: R.mean("stochastic_k", s.w, 3), back=3)

# directional movement; the minus side is compared with the already zeroed plus side
reg.add("_pc", "close", lambda s: F.lag("close", 1).over(s.w), back=1)
reg.add(
    "true_range", "high low _pc",
    lambda s: F.greatest(c("high") - c("low"), F.abs(c("high") - c("_pc")), F.abs(c("low") - c("_pc"))),
)
reg.add("_up", "high", lambda s: c("high") - F.lag("high", 1).over(s.w), back=1)
reg.add("_dn", "low", lambda s: F.lag("low", 1).over(s.w) - c("low"), back=1)
reg.add("_pdm", "_up _dn", lambda s: F.when((c("_up") > c("_dn")) & (c("_up") > 0), c("_up")).otherwise(0.0))
reg.add("_mdm", "_pdm _dn", lambda s: F.when((c("_dn") > c("_pdm")) & (c("_dn") > 0), c("_dn")).otherwise(0.0))
reg.add("_mdm_raw", "_up _dn", lambda s: F.when((c("_dn") > c("_up")) & (c("_dn") > 0), c("_dn")).otherwise(0.0))
reg.ewm("atr_14d", "true_range", 1 / 14)
reg.ewm("_spdm", "_pdm", 1 / 14)
reg.ewm("_smdm", "_mdm", 1 / 14)
reg.add("plus_di", "_spdm atr_14d", lambda s: 100 * div("_spdm", "atr_14d"))
reg.add("minus_di", "_smdm atr_14d", lambda s: 100 * div("_smdm", "atr_14d"))
reg.add(
    "_dx", "plus_di minus_di",
    lambda s: F.coalesce(100 * F.abs(c("plus_di") - c("minus_di")) / (c("plus_di") + c("minus_di") + 1e-10), F.lit(0.0)),
)
reg.ewm("adx", "_dx", 1 / 14)
for p in (14, 20):
    reg.ewm(f"_latr_{p}", "true_range", 1 / p)
    reg.ewm(f"_lp_{p}", "_pdm", 1 / p)
    reg.ewm(f"_lm_{p}", "_mdm_raw", 1 / p)
    reg.add(
        f"_ldx_{p}", f"_latr_{p} _lp_{p} _lm_{p}",
        lambda s, p=p: F.coalesce(
            100 * F.abs(div(100 * c(f"_lp_{p}"), f"_latr_{p}") - div(100 * c(f"_lm_{p}"), f"_latr_{p}"))
            / (div(100 * c(f"_lp_{p}"), f"_latr_{p}") + div(100 * c(f"_lm_{p}"), f"_latr_{p}") + 1e-10),
            F.lit(0.0),
        ),
    )
    reg.ewm(f"adx_{p}", f"_ldx_{p}", 1 / p)

reg.add("atr_14_simple", "_tr_strict", lambda s: R.mean("_tr_strict", s.w, 14), back=14)
reg.add("_tr_strict", "true_range _pc", lambda s: F.when(c("_pc").isNotNull(), c("true_range")))
reg.add("atr_pct", "atr_14_simple close", lambda s: div("atr_14_simple", "close") * 100)
reg.add("zscore_50d", "close", lambda s: R.zscore("close", s.w, 50), back=50)


def _first_extreme(s, n, pick):
    vals = R.values("close", s.w, n)
    return F.array_position(vals, pick(vals)) - 1


for p in (14, 25, 30):
    for side, pick in (("up", F.array_max), ("down", F.array_min)):
        reg.add(
            f"aroon_{side}_{p}", "close",
            lambda s, p=p, pick=pick: F.when(
                R.over(F.count("close"), s.w, p + 1) == p + 1, _first_extreme(s, p + 1, pick) / p * 100
            ),
            back=p + 1,
        )
    reg.add(f"aroon_oscillator_{p}", f"aroon_up_{p} aroon_down_{p}", lambda s, p=p: c(f"aroon_up_{p}") - c(f"aroon_down_{p}"))

for p in (5, 10, 20, 50, 100, 200):
    reg.add(f"_ma_{p}", "close", lambda s, p=p: R.mean("close", s.w, p), back=p)
    reg.add(f"distance_ma_{p}", f"close _ma_{p}", lambda s, p=p: div(c("close") - c(f"_ma_{p}"), f"_ma_{p}") * 100)
    reg.add(f"distance_percentile_{p}", f"distance_ma_{p}", lambda s, p=p: R.percent_rank(f"distance_ma_{p}", s.w, 2 * p) * 100, back=2 * p)
    reg.add(f"zscore_ma_{p}", "close", lambda s, p=p: R.zscore("close", s.w, p), back=p)

# -- volume ------------------------------------------------------------------------------------

reg.add("_obv_step", "close _pc volume", lambda s: F.coalesce(F.signum(c("close") - c("_pc")) * c("volume"), F.lit(0.0)))
reg.add(
    "_obv_change", "_obv_step",
    lambda s: F.when(
        R.over(F.count(F.lit(1)), s.w, 21) == 21, R.over(F.sum("_obv_step"), s.w, 20)
    ),
    back=21,
    doc="a 20-row difference of a running sum is the sum of the last 20 steps",
)
reg.add(
    "obv_trend", "_obv_change",
    lambda s: F.coalesce(clip(c("_obv_change") / (R.std("_obv_change", s.w, 60) + 1e-10), F.lit(-5.0), F.lit(5.0)), F.lit(0.0)),
    back=60,
)
for p in (20, 50):
    reg.add(f"volume_sma{p}_ratio", "volume", lambda s, p=p: div("volume", R.mean("volume", s.w, p)), back=p)
for n in (20, 30, 50, 100):
    reg.add(f"volume_zscore_{n}", "volume", lambda s, n=n: R.zscore("volume", s.w, n), back=n)
    reg.add(f"price_volume_corr_{n}", "close volume", lambda s, n=n: R.corr("close", "volume", s.w, n), back=n)

# -- candles and exchange microstructure -------------------------------------------------------

reg.add("gap_pct", "open _pc", lambda s: div(c("open") - c("_pc"), "_pc") * 100)
reg.add("intraday_range_pct", "high low close", lambda s: div(c("high") - c("low"), "close") * 100)
reg.add("candle_body_ratio", "open high low close", lambda s: div(F.abs(c("close") - c("open")), c("high") - c("low")))
reg.add("upper_shadow_ratio", "open high low close", lambda s: div(c("high") - F.greatest("open", "close"), c("high") - c("low")))
reg.add("lower_shadow_ratio", "open high low close", lambda s: div(F.least("open", "close") - c("low"), c("high") - c("low")))
reg.add("candle_direction", "open close", lambda s: F.signum(c("close") - c("open")))
reg.add("spot_taker_buy_ratio", "taker_buy volume", lambda s: div("taker_buy", "volume"))
reg.add("spot_taker_sell_ratio", "spot_taker_buy_ratio", lambda s: 1 - c("spot_taker_buy_ratio"))
reg.add("taker_pressure", "spot_taker_buy_ratio spot_taker_sell_ratio", lambda s: c("spot_taker_buy_ratio") - c("spot_taker_sell_ratio"))
reg.add("volume_per_trade", "volume n_obs", lambda s: div("volume", "n_obs"))
reg.add("trade_count_zscore", "n_obs", lambda s: R.zscore("n_obs", s.w, 30), back=30)
reg.add("basis_pct", "futures_close close", lambda s: div(c("futures_close") - c("close"), "close") * 100)
reg.add("basis_annualized", "basis_pct", lambda s: c("basis_pct") * 4)
for p in (7, 30):
    reg.add(f"basis_ma{p}", "basis_pct", lambda s, p=p: R.mean("basis_pct", s.w, p), back=p)
reg.add("basis_zscore", "basis_pct", lambda s: R.zscore("basis_pct", s.w, 90), back=90)
reg.add("ls_ratio_change", "global_ls_ratio", lambda s: R.pct_change("global_ls_ratio", s.w, 1), back=1)
reg.add("ls_ratio_ma7", "global_ls_ratio", lambda s: R.mean("global_ls_ratio", s.w, 7), back=7)
reg.add("extreme_long", "global_long_pct", lambda s: flag(c("global_long_pct") > 0.70))
reg.add("extreme_short", "global_long_pct", lambda s: flag(1 - c("global_long_pct") > 0.45))
reg.add("smart_retail_divergence", "top_traders_ls_ratio global_ls_ratio", lambda s: c("top_traders_ls_ratio") - c("global_ls_ratio"))
reg.add("taker_ratio_ma7", "futures_taker_ratio", lambda s: R.mean("futures_taker_ratio", s.w, 7), back=7)
reg.add("aggressive_buying", "futures_taker_ratio", lambda s: flag(c("futures_taker_ratio") > 1.1))
reg.add("aggressive_selling", "futures_taker_ratio", lambda s: flag(c("futures_taker_ratio") < 0.9))
for p in (1, 7, 30):
    reg.add(f"_oi_change_{p}", "open_interest", lambda s, p=p: R.pct_change("open_interest", s.w, p), back=p)


def clipped_by_quantiles(x, s, lo=0.01, hi=0.99, n=365, m=30):
    """Bound by rolling quantiles; no bound where there is too little history."""
    b = R.quantiles(x, [lo, hi], s.w, n, m)
    return clip(x, b[0], b[1])


reg.add("oi_change_1d", "_oi_change_1", lambda s: c("_oi_change_1"))
for p in (7, 30):
    reg.add(f"oi_change_{p}d", f"_oi_change_{p}", lambda s, p=p: clipped_by_quantiles(f"_oi_change_{p}", s), back=365)
reg.add("oi_ma7", "open_interest", lambda s: R.mean("open_interest", s.w, 7), back=7)

# -- fractional differencing: static weights, so a plain sum of lags ---------------------------


def fracdiff_weights(d: float, threshold: float) -> list[float]:
    """Weights until one falls to the threshold, that one included."""
    if threshold <= 0 or d <= -1:
        raise ValueError("the weights never fall to the threshold")
    w = [1.0]
    while abs(w[-1]) > threshold:
        k = len(w)
        w.append(-w[-1] * (d - k + 1) / k)
    return w


def fracdiff(x: str, w, d: float = 0.3, threshold: float = 0.01):
    ws = fracdiff_weights(d, threshold)
    total = None
    for k, wk in enumerate(ws):
        v = F.lit(wk) * (c(x) if k == 0 else F.lag(x, k).over(w))
        total = v if total is None else total + v
    return total


_FD = len(fracdiff_weights(0.3, 0.01))
reg.add("_log_close", "close", lambda s: F.ln("close"))
reg.add("price_fracdiff_05", "_log_close", lambda s: fracdiff("_log_close", s.w), back=_FD)
reg.add("_log_fed", "fed_balance_sheet", lambda s: F.ln(F.nullif("fed_balance_sheet", F.lit(0.0))))
reg.add("fed_fracdiff_05", "_log_fed", lambda s: fracdiff("_log_fed", s.w), back=_FD)

# -- risk --------------------------------------------------------------------------------------

for p in (30, 60, 90):
    reg.add(
        f"sharpe_{p}d", f"return_{p}d volatility_{p}d",
        lambda s, p=p: F.when(c(f"volatility_{p}d") > 0, c(f"return_{p}d") * (365 / p) / c(f"volatility_{p}d")).otherwise(0.0),
    )
reg.add("_down2", "return_1d", lambda s: F.when(c("return_1d") < 0, F.pow("return_1d", F.lit(2))).otherwise(0.0))
reg.add("_ddev", "_down2", lambda s: F.sqrt(R.mean("_down2", s.w, 30)) * YEAR, back=30)
reg.add("sortino_30d", "return_30d _ddev", lambda s: F.when(c("_ddev") > 0, c("return_30d") * (365 / 30) / c("_ddev")).otherwise(0.0))
for p in (30, 90, 180, 365):
    reg.add(f"_dd_{p}", "close", lambda s, p=p: div(c("close") - R.high("close", s.w, p), R.high("close", s.w, p)), back=p)
    reg.add(f"max_drawdown_{p}d", f"_dd_{p}", lambda s, p=p: R.low(f"_dd_{p}", s.w, p), back=p)
reg.add("cvar_95", "return_1d", lambda s: R.tail_mean("return_1d", 0.05, s.w, 252), back=252)
for n, y in ((365, 1), (730, 2)):
    reg.add(f"price_percentile_{y}y", "close", lambda s, n=n: R.percent_rank("close", s.w, n), back=n)
reg.add("vol_percentile_1y", "volatility_30d", lambda s: R.percent_rank("volatility_30d", s.w, 365), back=365)
reg.add("var_95", "return_1d", lambda s: R.quantile("return_1d", 0.05, s.w, 252), back=252)

# -- macro, sentiment, cross-asset -------------------------------------------------------------

reg.add("vix_ma20", "vix", lambda s: R.mean("vix", s.w, 20), back=20)
reg.add("vix_zscore", "vix", lambda s: R.zscore("vix", s.w, 90), back=90)
for a in ("gold", "oil", "copper"):
    reg.add(f"{a}_return_30d", a, lambda s, a=a: R.pct_change(a, s.w, 30), back=30)
for a in ("sp500", "dxy", "eth", "m2_supply", "hash_rate", "addresses_with_balance"):
    for p in (30, 90):
        reg.add(f"{a}_pctchg_{p}d", a, lambda s, a=a, p=p: R.pct_change(a, s.w, p), back=p)
reg.add("m2_yoy_growth", "m2_supply_pctchg_90d", lambda s: F.pow(1 + c("m2_supply_pctchg_90d"), F.lit(365.0 / 90.0)) - 1)
reg.add("fed_bs_yoy_change", "fed_balance_sheet", lambda s: R.pct_change("fed_balance_sheet", s.w, 252), back=252)
reg.add("eth_btc_ratio", "eth close", lambda s: c("eth") / (c("close") + 1e-10))
reg.add("yield_curve_inverted", "yield_curve_2s10s", lambda s: flag(c("yield_curve_2s10s") < 0))
reg.add("real_yield_10y", "us10y breakeven_10y", lambda s: c("us10y") - c("breakeven_10y"))
for a in ("sp500", "gold", "dxy", "eth", "vix"):
    reg.add(f"_chg_{a}", a, lambda s, a=a: R.pct_change(a, s.w, 1), back=1)
    reg.add(f"btc_{a}_corr_30d", f"return_1d _chg_{a}", lambda s, a=a: R.corr("return_1d", f"_chg_{a}", s.w, 30), back=30)
reg.add("btc_gold_corr_30d_simple", "simple_return_1d _chg_gold", lambda s: R.corr("simple_return_1d", "_chg_gold", s.w, 30), back=30)
reg.add("btc_sp500_corr_90d", "return_1d _chg_sp500", lambda s: R.corr("return_1d", "_chg_sp500", s.w, 90), back=90)
for p in (7, 30):
    reg.add(f"fear_greed_ma{p}", "fear_greed", lambda s, p=p: R.mean("fear_greed", s.w, p), back=p)
reg.add("fear_greed_zscore", "fear_greed", lambda s: R.zscore("fear_greed", s.w, 90), back=90)
reg.add("extreme_fear", "fear_greed", lambda s: flag(c("fear_greed") < 25))
reg.add("extreme_greed", "fear_greed", lambda s: flag(c("fear_greed") > 75))
reg.add("fg_extreme_signal", "fear_greed_ma7", lambda s: F.when(c("fear_greed_ma7") < 25, -1).when(c("fear_greed_ma7") > 75, 1).otherwise(0))

# -- on-chain ----------------------------------------------------------------------------------

for u in ("btc", "usd"):
    reg.add(f"exchange_netflow_{u}", f"exchange_inflow_{u} exchange_outflow_{u}", lambda s, u=u: c(f"exchange_inflow_{u}") - c(f"exchange_outflow_{u}"))
reg.add("exchange_netflow_ma7", "exchange_netflow_btc", lambda s: R.mean("exchange_netflow_btc", s.w, 7), back=7)
for k in (1, 7):
    reg.add(f"exchange_netflow_lag_{k}", "exchange_netflow_btc", lambda s, k=k: F.lag("exchange_netflow_btc", k).over(s.w), back=k)
reg.add("supply_on_exchanges_pct", "supply_on_exchanges circulating_supply", lambda s: div("supply_on_exchanges", "circulating_supply") * 100)
reg.add("supply_change_30d", "supply_on_exchanges", lambda s: R.pct_change("supply_on_exchanges", s.w, 30), back=30)
reg.add("mvrv_zscore", "mvrv_ratio", lambda s: R.zscore("mvrv_ratio", s.w, 365), back=365)
reg.add("btc_dom_zscore", "btc_dominance", lambda s: R.zscore("btc_dominance", s.w, 90), back=90)


def guarded_z(x, s, n=365, m=30):
    return clip((c(x) - R.mean(x, s.w, n, m)) / (R.std(x, s.w, n, m) + 1e-10), F.lit(-5.0), F.lit(5.0))


reg.add("mcap_zscore", "market_cap", lambda s: guarded_z("market_cap", s), back=365)
for a in ("active_addresses", "tx_count", "ecosystem_commits"):
    reg.add(f"{a}_ma7", a, lambda s, a=a: R.mean(a, s.w, 7), back=7)
reg.add("tx_growth_30d", "tx_count", lambda s: R.pct_change("tx_count", s.w, 30), back=30)
reg.add("commits_ma7", "core_commits", lambda s: R.mean("core_commits", s.w, 7), back=7)
reg.add("_commits_ma30", "core_commits", lambda s: R.mean("core_commits", s.w, 30), back=30)
reg.add("commits_trend_30d", "_commits_ma30", lambda s: R.pct_change("_commits_ma30", s.w, 30), back=30)
reg.add("_bsr", "futures_buy_volume futures_sell_volume", lambda s: c("futures_buy_volume") / (c("futures_sell_volume") + 1))
reg.add("buy_sell_ratio", "_bsr", lambda s: clipped_by_quantiles("_bsr", s), back=365)
reg.add("net_buy_pressure", "futures_buy_volume futures_sell_volume", lambda s: c("futures_buy_volume") - c("futures_sell_volume"))
reg.add("futures_dominance", "futures_volume volume", lambda s: c("futures_volume") / (c("volume") + c("futures_volume") + 1) * 100)
reg.add("nvt_ratio", "market_cap transfer_count close", lambda s: clip(c("market_cap") / (c("transfer_count") * c("close") + 1e-10), F.lit(0.0), F.lit(1000.0)))
reg.add("mcap_to_fdv", "market_cap fdv", lambda s: clip(c("market_cap") / (c("fdv") + 1e-10), F.lit(0.0), F.lit(1.5)))
reg.add("stock_to_flow", "circulating_supply btc_issued_daily", lambda s: clip(div("circulating_supply", c("btc_issued_daily") * 365), F.lit(0.0), F.lit(1000.0)))
reg.add("s2f_multiple", "close stock_to_flow", lambda s: clip(div("close", F.pow("stock_to_flow", F.lit(3))), F.lit(0.0), F.lit(100.0)))
reg.add("s2f_zscore", "s2f_multiple", lambda s: guarded_z("s2f_multiple", s), back=365)
reg.add("issuance_usd", "btc_issued_daily close", lambda s: c("btc_issued_daily") * c("close"))
reg.add("puell_multiple", "issuance_usd", lambda s: clip(div("issuance_usd", R.mean("issuance_usd", s.w, 365, 30)), F.lit(0.0), F.lit(10.0)), back=365)
reg.add("puell_extreme_low", "puell_multiple", lambda s: flag(c("puell_multiple") < 0.5))
reg.add("puell_extreme_high", "puell_multiple", lambda s: flag(c("puell_multiple") > 4))
reg.add("_hash9", "hash_rate", lambda s: R.mean("hash_rate", s.w, 9, 4), back=9)
reg.add("_hash200", "hash_rate", lambda s: R.mean("hash_rate", s.w, 200, 100), back=200)
reg.add("difficulty_ribbon", "_hash9 _hash200", lambda s: clip(div("_hash9", "_hash200") - 1, F.lit(-1.0), F.lit(1.0)))
reg.add("ribbon_compression", "_hash9 _hash200", lambda s: clip(div(F.abs(c("_hash9") - c("_hash200")), "_hash200"), F.lit(0.0), F.lit(2.0)))
reg.add("miner_capitulation", "difficulty_ribbon ribbon_compression", lambda s: flag((c("difficulty_ribbon") < -0.05) & (c("ribbon_compression") < 0.1)))
reg.add("_txusd", "transfer_count close", lambda s: c("transfer_count") * c("close"))
reg.add("nvt_signal", "market_cap _txusd", lambda s: clip(div("market_cap", R.mean("_txusd", s.w, 90, 7)), F.lit(0.0), F.lit(500.0)), back=90)
reg.add("nvt_golden_cross", "nvt_signal", lambda s: flag(c("nvt_signal") < R.mean("nvt_signal", s.w, 30)), back=30)
for p in (7, 30):
    reg.add(f"stablecoin_supply_change_{p}d", "stablecoin_supply", lambda s, p=p: R.pct_change("stablecoin_supply", s.w, p), back=p)
reg.add("stablecoin_btc_ratio", "stablecoin_supply market_cap", lambda s: clip(div("stablecoin_supply", "market_cap"), F.lit(0.0), F.lit(10.0)))
reg.add(
    "stablecoin_zscore", "stablecoin_supply",
    lambda s: clip(
        (c("stablecoin_supply") - R.mean("stablecoin_supply", s.w, 30)) / (R.std("stablecoin_supply", s.w, 90, 30) + 1e-10),
        F.lit(-5.0), F.lit(5.0),
    ),
    back=90,
)
reg.add(
    "stablecoin_zscore_full", "stablecoin_supply",
    lambda s: clip(
        div(c("stablecoin_supply") - R.mean("stablecoin_supply", s.w, 30), R.std("stablecoin_supply", s.w, 90)),
        F.lit(-5.0), F.lit(5.0),
    ),
    back=90,
)
for a, ps in (("sopr", (7, 30)), ("nupl", (30,)), ("sth_sopr", (7,))):
    for p in ps:
        reg.add(f"{a}_ma{p}_min1", a, lambda s, a=a, p=p: R.mean(a, s.w, p, 1), back=p)
reg.add("sopr_below_1", "sopr", lambda s: flag(c("sopr") < 1))
reg.add("nupl_capitulation", "nupl", lambda s: flag(c("nupl") < 0))
reg.add("nupl_euphoria", "nupl", lambda s: flag(c("nupl") > 0.75))
reg.add("sth_capitulation", "sth_sopr", lambda s: flag(c("sth_sopr") < 1))
reg.add("mempool_congestion", "mempool_tx_count", lambda s: div("mempool_tx_count", R.mean("mempool_tx_count", s.w, 7, 1)), back=7)
reg.add("miners_revenue_ratio_min1", "miners_revenue_usd", lambda s: div("miners_revenue_usd", R.mean("miners_revenue_usd", s.w, 30, 1)), back=30)
reg.add("google_trend_ma4w", "google_trend", lambda s: R.mean("google_trend", s.w, 28, 1), back=28)
reg.add("google_trend_fomo", "google_trend", lambda s: flag(c("google_trend") > 80))
reg.add("nupl_ma30", "nupl", lambda s: R.mean("nupl", s.w, 30), back=30)
reg.add("miners_revenue_ratio", "miners_revenue_usd", lambda s: div("miners_revenue_usd", R.mean("miners_revenue_usd", s.w, 30)), back=30)
reg.add("funding_rate_ma7", "funding_rate", lambda s: R.mean("funding_rate", s.w, 7, 1), back=7)

# -- calendar, interactions, regimes of volatility ---------------------------------------------

reg.add("day_of_week", "ts", lambda s: F.weekday("ts"))
reg.add("is_month_end", "ts", lambda s: flag(F.last_day("ts") == c("ts").cast("date")))
reg.add("is_q4", "ts", lambda s: flag(F.quarter("ts") == 4))
reg.add("rsi_regime_normalized", "rsi_14d", lambda s: div("rsi_14d", R.mean("rsi_14d", s.w, 90)), back=90)
reg.add("trend_strength", "adx hurst_30d", lambda s: c("adx") * F.coalesce("hurst_30d", F.lit(0.5)))
reg.add("mean_reversion_score", "adx hurst_30d", lambda s: (1 - c("hurst_30d")) * (50 - clip("adx", F.lit(0.0), F.lit(50.0))) / 50)
reg.add("mvrv_hurst_signal", "mvrv_zscore hurst_30d", lambda s: c("mvrv_zscore") * c("hurst_30d"))
reg.add("_vol_terciles", "volatility_30d", lambda s: R.quantiles("volatility_30d", [0.33, 0.66], s.w, 365, 60), back=365)
reg.add(
    "vol_regime", "volatility_30d _vol_terciles",
    lambda s: F.when(c("volatility_30d") > c("_vol_terciles")[1], 2).when(c("volatility_30d") < c("_vol_terciles")[0], 0).otherwise(1),
)
reg.add("funding_x_oi", "funding_rate oi_change_7d", lambda s: c("funding_rate") * c("oi_change_7d"))
reg.add("funding_basis_spread", "funding_rate basis_pct", lambda s: c("funding_rate") - c("basis_pct"))
reg.add("mvrv_x_nupl", "mvrv_zscore nupl", lambda s: c("mvrv_zscore") * c("nupl"))
reg.add("sopr_x_nupl", "sopr nupl", lambda s: c("sopr") * c("nupl"))
reg.add("vol_x_regime_duration", "volatility_30d regime_duration", lambda s: c("volatility_30d") * c("regime_duration"))
reg.add("hurst_x_halflife", "hurst_30d half_life_60d", lambda s: c("hurst_30d") * c("half_life_60d"))
reg.add("rsi_x_bb", "rsi_14d bb_position", lambda s: (c("rsi_14d") - 50) * c("bb_position"))
reg.add("fg_x_vix", "fear_greed_ma7 vix_zscore", lambda s: c("fear_greed_ma7") * c("vix_zscore"))
reg.add("funding_extreme", "funding_rate", lambda s: flag(F.abs("funding_rate") > 2 * R.std("funding_rate", s.w, 90, 30)), back=90)

# -- closed-form statistical kernels -----------------------------------------------------------


def half_life(s, n, m):
    """From the slope b of log price on its own lag inside the window: -ln 2 / ln b in [1, 252]."""
    b = F.when(R.over(F.count("_log_close"), s.w, n) >= m, R.over(F.regr_slope("_log_close", "_lag_log"), s.w, n - 1))
    hl = F.when((b > 0) & (b < 1), -math.log(2) / F.ln(b))
    return clip(hl, F.lit(1.0), F.lit(252.0))


reg.add("_lag_log", "_log_close", lambda s: F.lag("_log_close", 1).over(s.w), back=1)
reg.add("_dlog", "_log_close _lag_log", lambda s: c("_log_close") - c("_lag_log"))
for n, m in ((30, 20), (60, 30), (20, 20), (50, 50), (100, 100)):
    reg.add(f"half_life_{n}d", "_log_close _lag_log", lambda s, n=n, m=m: half_life(s, n, m), back=n)
for n in (30, 60):
    pair = n - 1
    reg.add(f"_mu_{n}", "_log_close", lambda s, n=n: R.mean("_log_close", s.w, n, 30), back=n)
    reg.add(f"_ou_n_{n}", "_dlog", lambda s, n=n: R.over(F.count("_dlog"), s.w, n - 1), back=n)
    # co-moments over the n-1 pairs; subtracting the pair means first avoids cancellation
    reg.add(f"_ou_sxx_{n}", "_lag_log", lambda s, n=n: R.over(F.var_pop("_lag_log"), s.w, n - 1), back=n)
    reg.add(f"_ou_sxd_{n}", "_lag_log _dlog", lambda s, n=n: R.over(F.covar_pop("_lag_log", "_dlog"), s.w, n - 1), back=n)
    reg.add(f"_ou_sdd_{n}", "_dlog", lambda s, n=n: R.over(F.var_pop("_dlog"), s.w, n - 1), back=n)
    reg.add(f"_ou_mx_{n}", "_lag_log _dlog", lambda s, n=n: R.over(F.avg("_lag_log"), s.w, n - 1), back=n)
    reg.add(f"_ou_md_{n}", "_dlog", lambda s, n=n: R.over(F.avg("_dlog"), s.w, n - 1), back=n)
    ou = f"_mu_{n} _ou_sxx_{n} _ou_sxd_{n} _ou_sdd_{n} _ou_mx_{n} _ou_md_{n}"

    def _theta(n=n):
        gap = c(f"_ou_mx_{n}") - c(f"_mu_{n}")
        num = c(f"_ou_sxd_{n}") + gap * c(f"_ou_md_{n}")
        den = c(f"_ou_sxx_{n}") + gap * gap
        return F.abs(div(-num, den))

    reg.add(f"_theta_{n}", ou, lambda s, f=_theta: f())
    reg.add(f"ou_theta_{n}d", f"_theta_{n}", lambda s, n=n: clip(f"_theta_{n}", F.lit(0.0), F.lit(10.0)))
    reg.add(f"ou_mu_{n}d", f"_mu_{n} _theta_{n}", lambda s, n=n: F.when(c(f"_theta_{n}").isNotNull(), c(f"_mu_{n}")))
    # the spread of d + theta (x - mu) does not depend on mu
    reg.add(
        f"ou_sigma_{n}d", f"_theta_{n} {ou}",
        lambda s, n=n: F.when(c(f"_theta_{n}").isNotNull(), F.sqrt(F.greatest(
            c(f"_ou_sdd_{n}") + 2 * c(f"_theta_{n}") * c(f"_ou_sxd_{n}") + c(f"_theta_{n}") * c(f"_theta_{n}") * c(f"_ou_sxx_{n}"),
            F.lit(0.0),
        ))),
    )
reg.add("_pct_8", "close", lambda s: R.pct_change("close", s.w, 8), back=8)
reg.add(
    "variance_ratio_30d", "simple_return_1d _pct_8",
    lambda s: F.when(
        R.over(F.count("simple_return_1d"), s.w, 29) >= 16,
        div(R.over(F.var_samp("_pct_8"), s.w, 22) / 8, R.over(F.var_samp("simple_return_1d"), s.w, 29)),
    ),
    back=30,
    doc="lag 8 inside 30 prices: 29 one-step and 22 eight-step changes",
)
reg.add("_row", "ts", lambda s: s.panel.pos().cast("double"))
for n, m in ((10, 10), (20, 20), (30, 10), (50, 50), (100, 100)):
    reg.add(
        f"trend_slope_{n}", "close _row",
        lambda s, n=n, m=m: F.when(R.over(F.count("close"), s.w, n) >= m,
                                   div(R.over(F.regr_slope("close", "_row"), s.w, n), R.over(F.avg("close"), s.w, n)) * 100),
        back=n,
    )
    reg.add(
        f"linear_r2_{n}", "close _row",
        lambda s, n=n, m=m: F.when(R.over(F.count("close"), s.w, n) >= m, R.over(F.regr_r2("close", "_row"), s.w, n)),
        back=n,
    )
    reg.add(f"trend_angle_{n}", f"trend_slope_{n}", lambda s, n=n: F.degrees(F.atan(c(f"trend_slope_{n}") / 100)))
# longest look-back of the same-direction streak is the window itself
reg.add("_same_dir", "simple_return_1d", lambda s: flag(c("simple_return_1d") * F.lag("simple_return_1d", 1).over(s.w) > 0), back=1)
for n, m in ((10, 10), (20, 20), (30, 10), (50, 50), (100, 100)):
    reg.add(
        f"_streak_{n}", "_same_dir _row",
        lambda s, n=n: F.least(
            c("_row") - F.coalesce(
                R.over(F.max(F.when(c("_same_dir") == 0, c("_row"))), s.w, n), R.over(F.min("_row"), s.w, n) 
            ),
            R.over(F.count("close"), s.w, n) - 1,
        ),
        back=n,
    )
    reg.add(
        f"trend_strength_{n}d", f"linear_r2_{n} trend_slope_{n} _streak_{n} close",
        lambda s, n=n: 0.4 * c(f"linear_r2_{n}") * 100
        + 0.3 * F.least(F.lit(100.0), F.abs(f"trend_slope_{n}") * 10)
        + 0.3 * c(f"_streak_{n}") / R.over(F.count("close"), s.w, n) * 100,
        back=n,
    )
for n in (20, 50, 100):
    reg.add(
        f"price_position_{n}", "close",
        lambda s, n=n: F.when(R.high("close", s.w, n) == R.low("close", s.w, n), 50.0).otherwise(
            div(c("close") - R.low("close", s.w, n), R.high("close", s.w, n) - R.low("close", s.w, n)) * 100
        ),
        back=n,
    )
for n in (10, 20, 30, 50, 100):
    fit = [p for p in (5, 10, 20, 50) if p <= n]

    def _momentum(s, n=n, fit=tuple(fit)):
        top = sum((div("close", F.lag("close", p - 1).over(s.w)) - 1) * 100 * (1 / p) for p in fit)
        return F.when(R.over(F.count("close"), s.w, n) >= n, top / sum(1 / p for p in fit))

    reg.add(f"momentum_score_{n}", "close", _momentum, back=n)
    reg.add(
        f"trend_consistency_{n}", "simple_return_1d",
        lambda s, n=n: F.abs(R.mean(F.when(c("simple_return_1d").isNotNull(), (c("simple_return_1d") > 0).cast("double")), s.w, n) - 0.5) * 200,
        back=n,
    )
    reg.add(
        f"trend_regime_{n}", f"trend_strength_{n}d momentum_score_{n}",
        lambda s, n=n: F.when(c(f"trend_strength_{n}d").isNull() | c(f"momentum_score_{n}").isNull(), None)
        .when(c(f"trend_strength_{n}d") > 70, F.when(c(f"momentum_score_{n}") > 20, "strong_uptrend").when(c(f"momentum_score_{n}") < -20, "strong_downtrend").otherwise("strong_sideways"))
        .when(c(f"trend_strength_{n}d") > 40, F.when(c(f"momentum_score_{n}") > 10, "moderate_uptrend").when(c(f"momentum_score_{n}") < -10, "moderate_downtrend").otherwise("moderate_sideways"))
        .otherwise("no_trend"),
    )
# velocity: 10-row mean of simple returns, in percent; needs 20 prices
reg.add("_v10", "simple_return_1d", lambda s: R.mean("simple_return_1d", s.w, 10), back=10)
reg.add("_has20", "close", lambda s: R.over(F.count("close"), s.w, 20) >= 20, back=20)
reg.add("velocity", "_v10 _has20", lambda s: F.when(c("_has20"), c("_v10") * 100))
reg.add("acceleration", "_v10 _has20", lambda s: F.when(c("_has20"), (c("_v10") - F.lag("_v10", 1).over(s.w)) * 10000), back=1)
reg.add(
    "momentum_regime", "velocity acceleration",
    lambda s: F.when(c("velocity").isNull() | c("acceleration").isNull(), "unknown")
    .when((c("velocity") > 0) & (c("acceleration") > 0), "accelerating_up")
    .when((c("velocity") > 0) & (c("acceleration") < 0), "decelerating_up")
    .when((c("velocity") < 0) & (c("acceleration") < 0), "accelerating_down")
    .when((c("velocity") < 0) & (c("acceleration") > 0), "decelerating_down")
    .otherwise("neutral"),
)
reg.add("_corr30", "simple_return_1d _chg_sp500", lambda s: R.corr("simple_return_1d", "_chg_sp500", s.w, 30), back=30)
reg.add("_corr30_recent", "_corr30", lambda s: R.mean("_corr30", s.w, 30), back=30)
reg.add(
    "correlation_change_30d", "_corr30_recent",
    lambda s: div(c("_corr30_recent") - F.lag("_corr30_recent", 30).over(s.w), F.abs(F.lag("_corr30_recent", 30).over(s.w)) + 0.01),
    back=30,
)
for n in (20, 30, 50, 100):
    short = n // 3
    reg.add(f"_vs_{n}", "simple_return_1d", lambda s, k=short: R.std("simple_return_1d", s.w, k), back=short)
    reg.add(
        f"vol_regime_ratio_{n}", f"_vs_{n} simple_return_1d",
        lambda s, n=n: F.when(R.over(F.count("simple_return_1d"), s.w, 2 * n) >= 2 * n, div(f"_vs_{n}", R.std("simple_return_1d", s.w, n))),
        back=2 * n,
    )
    k = max(1, n // 6)
    reg.add(f"_pct_{n}_{k}", "close", lambda s, k=k: R.pct_change("close", s.w, k), back=k)


def noise_ratio(s, short, long, n):
    """Return variance at two horizons inside n prices, scaled twice by the horizon ratio."""
    vs = R.over(F.var_samp(f"_ns_{short}"), s.w, n - short)
    vl = R.over(F.var_samp(f"_ns_{long}"), s.w, n - long)
    full = R.over(F.count("close"), s.w, n) >= n
    return F.when(full, div(vs, vl) * (long / short) / (short / long))


for k in (5, 30):
    reg.add(f"_ns_{k}", "close", lambda s, k=k: R.pct_change("close", s.w, k), back=k)
reg.add("noise_ratio_100", "close _ns_5 _ns_30", lambda s: noise_ratio(s, 5, 30, 100), back=100)

# -- CUSUM with joint reset: a fold over a short frame -----------------------------------------


def cusum(x: str, w, n: int, m: int):
    """Two-sided CUSUM over the frame; slack std/2, alarm at 4 std, both sides reset together.

    Returns a struct of the running maxima, the alarm flag and the number of alarms.
    """
    sd = F.when(R.over(F.count(x), w, n) >= m, R.over(F.stddev_samp(x), w, n))
    zero = F.struct(
        F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0.0).alias("mp"), F.lit(0.0).alias("mq"), F.lit(0).alias("k")
    )

    def step(a, v):
        p = F.greatest(F.lit(0.0), a["p"] + v["x"] - v["sd"] / 2)
        q = F.greatest(F.lit(0.0), a["q"] - v["x"] - v["sd"] / 2)
        alarm = (p > 4 * v["sd"]) | (q > 4 * v["sd"])
        return F.struct(
            F.when(alarm, 0.0).otherwise(p).alias("p"),
            F.when(alarm, 0.0).otherwise(q).alias("q"),
            F.greatest(a["mp"], p).alias("mp"),
            F.greatest(a["mq"], q).alias("mq"),
            (a["k"] + F.when(alarm, 1).otherwise(0)).alias("k"),
        )

    arr = F.transform(R.values(x, w, n), lambda v: F.struct(v.alias("x"), sd.alias("sd")))
    out = F.aggregate(arr, zero, step)
    return F.when(sd == 0, zero).when(sd.isNotNull(), out)


reg.add("_cusum_30", "simple_return_1d", lambda s: cusum("simple_return_1d", s.w, 30, 10), back=30)
reg.add("cusum_pos", "_cusum_30", lambda s: c("_cusum_30.mp"))
reg.add("cusum_neg", "_cusum_30", lambda s: c("_cusum_30.mq"))
reg.add("cusum_score", "cusum_pos cusum_neg", lambda s: F.abs("cusum_pos") + F.abs("cusum_neg"))
reg.add("cusum_changes", "_cusum_30", lambda s: c("_cusum_30.k"))
reg.add("cusum_change_detected", "_cusum_30", lambda s: F.when(c("_cusum_30").isNotNull(), flag(c("_cusum_30.k") > 0)))
