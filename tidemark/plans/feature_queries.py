"""Registered feature families, each against window SQL over the same panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.features import FEATURES, fracdiff_weights
from tidemark.panel import DAILY, Panel
from tidemark.plans import tables as t
from tidemark.plans.catalog import query

c = F.col
ORD = "(PARTITION BY series_id ORDER BY ts)"


def win(n: int) -> str:
    return f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def agg(fn: str, x: str, n: int, m: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {win(n)} >= {m or n} THEN {fn} OVER {win(n)} END"


def mean(x, n, m=None):
    return agg(f"avg({x})", x, n, m)


def std(x, n, m=None):
    return agg(f"stddev_samp({x})", x, n, m)


def q(x, p, n, m=None):
    return agg(f"quantile_cont({x}, {p})", x, n, m)


def lag(x, k=1):
    return f"lag({x}, {k}) OVER {ORD}"


def zs(x, n, m=None):
    return f"(({x}) - ({mean(x, n, m)})) / nullif({std(x, n, m)}, 0)"


def chg(x, k):
    return f"{x} / nullif({lag(x, k)}, 0) - 1"


def corr(x, y, n):
    pair = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END"
    px, py = (f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {v} END" for v in (x, y))
    vary = f"stddev_pop({px}) OVER {win(n)} * stddev_pop({py}) OVER {win(n)}"
    return f"CASE WHEN count({pair}) OVER {win(n)} >= {n} THEN covar_pop({x}, {y}) OVER {win(n)} / nullif({vary}, 0) END"


def clip(x, lo, hi):
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(least(({x}), {hi}), {lo}) END"


def flag(cond):
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


RET = {"return_1d": f"ln(close / {lag('close')})"}


def family(name: str, out: dict[str, tuple[int | None, str]], stages: list[dict[str, str]] = (), metrics=(), derived=None):
    """Register features under one name.  ``out`` maps feature -> (digits, SQL); ``stages`` are SQL
    columns computed before them, in order."""
    columns = "series_id ts " + " ".join(n if d is None else f"{n}:{d}" for n, (d, _) in out.items())
    head, src = (t.sql_metric_panel(metrics), "mp") if metrics else (t.SQL_PANEL, "panel")
    ctes = ""
    for i, st in enumerate(stages):
        ctes += f", s{i} AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in st.items())} FROM {src})"
        src = f"s{i}"
    sql = f"WITH {head}{ctes} SELECT series_id, ts, {', '.join(f'{x} AS {k}' for k, (_, x) in out.items())} FROM {src}"

    @query(name, columns, sql)
    def run(spark, sf_dir):
        base = t.metric_panel(spark, sf_dir, metrics) if metrics else t.panel(spark, sf_dir)
        df, skipped = FEATURES.build(base, DAILY, list(out))
        if skipped:
            raise ValueError(f"absent inputs: {skipped}")
        return df

    return run


# -- returns and volatility --------------------------------------------------------------------

family(
    "log_returns",
    {f"return_{p}d": (8, f"ln(close / {lag('close', p)})") for p in (1, 7, 14, 30, 60, 90, 180, 365)}
    | {"momentum_10d": (8, chg("close", 10))},
)
family("return_lags", {f"return_lag_{k}": (8, lag("return_1d", k)) for k in (1, 2, 3, 5, 7)}, [RET])
family(
    "momentum",
    {
        "momentum_consensus": (0, "sign(r7) + sign(r30) + sign(r90)"),
        "momentum_accel_7d": (8, f"r7 - {lag('r7', 7)}"),
        "momentum_accel_30d": (8, f"r30 - {lag('r30', 30)}"),
    },
    [{f"r{p}": f"ln(close / {lag('close', p)})" for p in (7, 30, 90)}],
)
VOL = {f"volatility_{p}d": f"{std('return_1d', p)} * sqrt(365.0)" for p in (7, 30, 60, 90)}
family("volatility", {k: (8, f"({v.split(' * sqrt')[0]}) * sqrt(365.0)") for k, v in VOL.items()}, [RET])
VOL = {k: f"({v.split(' * sqrt')[0]}) * sqrt(365.0)" for k, v in VOL.items()}
family(
    "volatility_regime",
    {
        "volatility_lag_7": (8, lag("volatility_30d", 7)),
        "vol_regime": (None, f"CASE WHEN volatility_30d > ({q('volatility_30d', 0.66, 365, 60)}) THEN 2 WHEN volatility_30d < ({q('volatility_30d', 0.33, 365, 60)}) THEN 0 ELSE 1 END"),
    },
    [RET, VOL],
)
family(
    "range_volatility",
    {
        "parkinson_vol_14d": (7, f"sqrt(({agg('sum(hl2)', 'hl2', 14)}) / (4 * 14 * ln(2))) * sqrt(365.0)"),
        "parkinson_vol_14d_mean": (7, f"{mean('pk1', 14)}"),
        "intraday_range": (7, "(high - low) / close"),
    },
    [{"hl2": "pow(ln(high / low), 2)", "pk1": "sqrt(pow(ln(high / low), 2) / (4 * ln(2)))"}],
)

# -- trend -------------------------------------------------------------------------------------

family(
    "moving_averages",
    {
        "sma_50d": (4, mean("close", 50)),
        "sma_200d": (6, mean("close", 200)),
        **{f"price_to_sma{p}": (8, f"close / ({mean('close', p)}) - 1") for p in (20, 50, 200)},
        "zscore_50d": (7, zs("close", 50)),
    },
)
BB = {"m": mean("close", 20), "sd": std("close", 20), "m30": mean("close", 30), "sd30": std("close", 30)}
family(
    "bollinger",
    {
        "bb_position": (7, "(close - (m - 2 * sd)) / (4 * sd + 1e-10)"),
        "bb_width": (7, "4 * sd / m"),
        "bb_position_30": (7, "(close - (m30 - 2 * sd30)) / (4 * sd30)"),
        "bb_width_30": (6, "4 * sd30 / m30 * 100"),
        "bb_distance_20": (7, "(close - m) / sd"),
    },
    [BB],
)
family(
    "stochastic",
    {"stochastic_k": (6, "k"), "stochastic_d": (6, mean("k", 3))},
    [{"lo": agg("min(close)", "close", 14), "hi": agg("max(close)", "close", 14)}, {"k": "100 * (close - lo) / nullif(hi - lo, 0)"}],
)
family(
    "distance_from_average",
    {f"distance_ma_{p}": (6, f"(close - ({mean('close', p)})) / ({mean('close', p)}) * 100") for p in (5, 10, 20, 50, 100, 200)}
    | {f"zscore_ma_{p}": (6, zs("close", p)) for p in (5, 10, 20, 100, 200)},
)
family(
    "simple_true_range",
    {
        "true_range": (2, "tr"),
        "atr_14_simple": (6, mean("trs", 14)),
        "atr_pct": (6, f"({mean('trs', 14)}) / close * 100"),
    },
    [
        {"pc": lag("close")},
        {"tr": "greatest(high - low, abs(high - pc), abs(low - pc))",
         "trs": "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END"},
    ],
)
ARO = {}
for _p in (14, 25, 30):
    for _side, _fn in (("up", "list_max"), ("down", "list_min")):
        ARO[f"aroon_{_side}_{_p}"] = (
            6,
            f"CASE WHEN count(close) OVER {win(_p + 1)} = {_p + 1} THEN "
            f"(list_position(list(close) OVER {win(_p + 1)}, {_fn}(list(close) OVER {win(_p + 1)})) - 1) / {_p}.0 * 100 END",
        )
family("aroon", ARO)
family(
    "on_balance_volume",
    {"obv_trend": (7, f"coalesce({clip(f'ch / (({std(chr(99) + chr(104), 60)}) + 1e-10)', '-5.0', '5.0')}, 0)")},
    [
        {"stp": f"coalesce(sign(close - {lag('close')}) * volume, 0)"},
        {"obv": f"sum(stp) OVER {ORD}"},
        {"ch": f"obv - {lag('obv', 20)}"},
    ],
)
family(
    "volume_ratios",
    {
        "volume_sma20_ratio": (7, f"volume / nullif({mean('volume', 20)}, 0)"),
        "volume_sma50_ratio": (7, f"volume / nullif({mean('volume', 50)}, 0)"),
        "volume_zscore_30": (6, zs("volume", 30)),
        "price_volume_corr_30": (6, corr("close", "volume", 30)),
        "volume_per_trade": (4, "volume / nullif(n_obs, 0)"),
        "trade_count_zscore": (6, zs("n_obs", 30)),
    },
)
family(
    "candles",
    {
        "gap_pct": (6, "(open - pc) / pc * 100"),
        "intraday_range_pct": (6, "(high - low) / close * 100"),
        "candle_body_ratio": (7, "abs(close - open) / nullif(high - low, 0)"),
        "upper_shadow_ratio": (7, "(high - greatest(open, close)) / nullif(high - low, 0)"),
        "lower_shadow_ratio": (7, "(least(open, close) - low) / nullif(high - low, 0)"),
        "candle_direction": (0, "sign(close - open)"),
    },
    [{"pc": lag("close")}],
)
_W = fracdiff_weights(0.3, 0.01)
family(
    "fractional_difference",
    {
        "price_fracdiff_05": (7, " + ".join(f"{w!r} * {'lp' if k == 0 else lag('lp', k)}" for k, w in enumerate(_W))),
        "fed_fracdiff_05": (7, " + ".join(f"{w!r} * {'lf' if k == 0 else lag('lf', k)}" for k, w in enumerate(_W))),
    },
    [{"lp": "ln(close)", "lf": "ln(nullif(fed_balance_sheet, 0))"}],
    metrics=["fed_balance_sheet"],
)

# -- recursive averages: a recursive SQL statement walks the rows one by one ---------------------


def recursive(x_cols: dict[str, float], src: str, out: str) -> str:
    """y = x on the first row, then (1-a) y + a x."""
    first = ", ".join(f"{x} AS {x}_e" for x in x_cols)
    step = ", ".join(f"{1 - a!r} * e.{x}_e + {a!r} * n.{x}" for x, a in x_cols.items())
    return f"""{out}_n AS (SELECT *, row_number() OVER {ORD} AS rn FROM {src}),
{out}_e AS (
  SELECT series_id, rn, {first} FROM {out}_n WHERE rn = 1
  UNION ALL
  SELECT n.series_id, n.rn, {step} FROM {out}_e e JOIN {out}_n n ON n.series_id = e.series_id AND n.rn = e.rn + 1),
{out} AS (SELECT n.*, {", ".join(f"e.{x}_e" for x in x_cols)} FROM {out}_n n JOIN {out}_e e USING (series_id, rn))"""


@query(
    "wilder_rsi", "series_id ts rsi_14d:6",
    f"""WITH RECURSIVE {t.SQL_PANEL}, d AS (SELECT *, close - {lag('close')} AS dl FROM panel),
gl AS (SELECT *, CASE WHEN dl > 0 THEN dl ELSE 0 END AS gain, CASE WHEN dl < 0 THEN -dl ELSE 0 END AS loss FROM d),
{recursive({'gain': 1 / 14, 'loss': 1 / 14}, 'gl', 'r')}
SELECT series_id, ts, 100 - 100 / (1 + gain_e / (loss_e + 1e-10)) AS rsi_14d FROM r""",
)
def wilder_rsi(spark, sf_dir):
    return FEATURES.build(t.panel(spark, sf_dir), DAILY, ["rsi_14d"])[0]


SQL_GAPS = f"""{t.SQL_PANEL}, gaps AS (SELECT series_id, ts, CASE WHEN n_obs > 0 AND day(ts) NOT BETWEEN 5 AND 12 AND ts >= series_start + INTERVAL 10 DAY THEN close END AS close FROM panel)"""


def panel_with_gaps(spark, sf_dir):
    """The panel without the carried closes, without most of the second week of each month and without its first days."""
    p = t.panel(spark, sf_dir)
    known = (c("n_obs") > 0) & ~F.dayofmonth("ts").between(5, 12) & (c("ts") >= F.date_add("series_start", 10))
    return p.select("series_id", "ts", F.when(known, c("close")).alias("close"))


def recursive_over_gaps(cols: dict[str, float], src: str, dst: str) -> str:
    """``x_e``: what was averaged fades with every row, a known value weighs alpha."""
    y = {x: f"CASE WHEN n.{x} IS NULL THEN r.{x}_e WHEN r.{x}_e IS NULL THEN n.{x} ELSE (r.{x}_w * {1 - a!r}::DOUBLE * r.{x}_e + {a!r}::DOUBLE * n.{x}) / (r.{x}_w * {1 - a!r}::DOUBLE + {a!r}::DOUBLE) END" for x, a in cols.items()}
    w = {x: f"CASE WHEN n.{x} IS NULL AND r.{x}_e IS NOT NULL THEN r.{x}_w * {1 - a!r}::DOUBLE ELSE 1.0::DOUBLE END" for x, a in cols.items()}
    first = ", ".join(f"CAST({x} AS DOUBLE) AS {x}_e, 1.0::DOUBLE AS {x}_w" for x in cols)
    step = ", ".join(f"{y[x]}, {w[x]}" for x in cols)
    return f"""{dst}_n AS (SELECT *, row_number() OVER {ORD} AS i FROM {src}),
{dst} AS (SELECT series_id, ts, i, {first} FROM {dst}_n WHERE i = 1 UNION ALL
  SELECT n.series_id, n.ts, n.i, {step} FROM {dst} r JOIN {dst}_n n ON n.series_id = r.series_id AND n.i = r.i + 1)"""


@query(
    "ema_with_gaps", "series_id ts ema_12:4 ema_26:4",
    f"""WITH RECURSIVE {SQL_GAPS}, two AS (SELECT *, close AS a, close AS b FROM gaps), {recursive_over_gaps({'a': 2 / 13, 'b': 2 / 27}, 'two', 'e')}
SELECT series_id, ts, a_e AS ema_12, b_e AS ema_26 FROM e""",
)
def ema_with_gaps(spark, sf_dir):
    return FEATURES.build(panel_with_gaps(spark, sf_dir), Panel(chunk_rows=64), ["ema_12", "ema_26"])[0]


@query(
    "rsi_with_gaps", "series_id ts rsi_14d:6",
    f"""WITH RECURSIVE {SQL_GAPS}, d AS (SELECT *, close - {lag('close')} AS dl FROM gaps),
gl AS (SELECT *, CASE WHEN dl > 0 THEN dl ELSE 0 END AS gain, CASE WHEN dl < 0 THEN -dl ELSE 0 END AS loss FROM d),
{recursive_over_gaps({'gain': 1 / 14, 'loss': 1 / 14}, 'gl', 'r')}
SELECT series_id, ts, 100 - 100 / (1 + gain_e / (loss_e + 1e-10)) AS rsi_14d FROM r""",
)
def rsi_with_gaps(spark, sf_dir):
    return FEATURES.build(panel_with_gaps(spark, sf_dir), Panel(chunk_rows=64), ["rsi_14d"])[0]


@query(
    "macd", "series_id ts macd:3 macd_histogram:3 price_oscillator:7",
    f"""WITH RECURSIVE {t.SQL_PANEL}, c2 AS (SELECT *, close AS c12, close AS c26 FROM panel),
{recursive({'c12': 2 / 13, 'c26': 2 / 27}, 'c2', 'a')},
mm AS (SELECT series_id, ts, close, c12_e - c26_e AS macd, (c12_e - c26_e) / c26_e * 100 AS price_oscillator FROM a),
{recursive({'macd': 2 / 10}, 'mm', 'b')}
SELECT series_id, ts, macd, macd - macd_e AS macd_histogram, price_oscillator FROM b""",
)
def macd(spark, sf_dir):
    return FEATURES.build(t.panel(spark, sf_dir), DAILY, ["macd", "macd_histogram", "price_oscillator"])[0]


def _adx_sql(minus: str, period: int) -> str:
    a = 1 / period
    return f"""WITH RECURSIVE {t.SQL_PANEL}, u AS (
  SELECT *, {lag('close')} AS pc, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM panel),
v AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
   CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm FROM u),
x AS (SELECT *, {minus} AS mdm FROM v),
{recursive({'tr': a, 'pdm': a, 'mdm': a}, 'x', 'y')},
z AS (SELECT series_id, ts, tr_e AS atr, 100 * pdm_e / nullif(tr_e, 0) AS pdi, 100 * mdm_e / nullif(tr_e, 0) AS mdi FROM y),
zz AS (SELECT *, coalesce(100 * abs(pdi - mdi) / (pdi + mdi + 1e-10), 0) AS dx FROM z),
{recursive({'dx': a}, 'zz', 'o')}
SELECT series_id, ts, atr AS atr_14d, pdi AS plus_di, mdi AS minus_di, dx_e AS adx, dx_e AS adx_14 FROM o"""


@query(
    "directional_movement", "series_id ts atr_14d:4 plus_di:6 minus_di:6 adx:6",
    _adx_sql("CASE WHEN dn > pdm AND dn > 0 THEN dn ELSE 0 END", 14),
)
def directional_movement(spark, sf_dir):
    return FEATURES.build(t.panel(spark, sf_dir), DAILY, ["atr_14d", "plus_di", "minus_di", "adx"])[0]


@query("directional_movement_raw", "series_id ts adx_14:6", _adx_sql("CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END", 14))
def directional_movement_raw(spark, sf_dir):
    return FEATURES.build(t.panel(spark, sf_dir), DAILY, ["adx_14"])[0]


# -- risk --------------------------------------------------------------------------------------

family(
    "sharpe_sortino",
    {f"sharpe_{p}d": (7, f"CASE WHEN volatility_{p}d > 0 THEN ln(close / {lag('close', p)}) * (365 / {p}.0) / volatility_{p}d ELSE 0 END") for p in (30, 60, 90)}
    | {"sortino_30d": (7, f"CASE WHEN ({mean('dn2', 30)}) > 0 THEN ln(close / {lag('close', 30)}) * (365 / 30.0) / (sqrt({mean('dn2', 30)}) * sqrt(365.0)) ELSE 0 END")},
    [RET, VOL | {"dn2": "CASE WHEN return_1d < 0 THEN return_1d * return_1d ELSE 0 END"}],
)
family(
    "rolling_drawdown",
    {f"max_drawdown_{p}d": (8, agg(f"min(dd{p})", f"dd{p}", p)) for p in (30, 90, 180, 365)},
    [{f"dd{p}": f"close / ({agg('max(close)', 'close', p)}) - 1" for p in (30, 90, 180, 365)}],
)
family("value_at_risk", {"var_95": (8, q("return_1d", 0.05, 252))}, [RET])

# -- outside series ----------------------------------------------------------------------------

family(
    "macro_changes",
    {
        "vix_ma20": (6, mean("vix", 20)),
        "vix_zscore": (6, zs("vix", 90)),
        **{f"{a}_return_30d": (7, chg(a, 30)) for a in ("gold", "oil", "copper")},
        **{f"{a}_pctchg_{p}d": (7, chg(a, p)) for a in ("sp500", "dxy", "eth") for p in (30, 90)},
        "m2_yoy_growth": (6, f"pow({chg('m2_supply', 90)} + 1, 365.0 / 90.0) - 1"),
        "fed_bs_yoy_change": (7, chg("fed_balance_sheet", 252)),
        "eth_btc_ratio": (8, "eth / (close + 1e-10)"),
        "yield_curve_inverted": (None, flag("yield_curve_2s10s < 0")),
        "real_yield_10y": (7, "us10y - breakeven_10y"),
    },
    metrics=["vix", "gold", "oil", "copper", "sp500", "dxy", "eth", "m2_supply", "fed_balance_sheet", "yield_curve_2s10s", "us10y", "breakeven_10y"],
)
family(
    "cross_correlations",
    {f"btc_{a}_corr_30d": (6, corr("return_1d", f"c_{a}", 30)) for a in ("sp500", "gold", "dxy", "eth", "vix")}
    | {"btc_sp500_corr_90d": (6, corr("return_1d", "c_sp500", 90))},
    [RET, {f"c_{a}": chg(a, 1) for a in ("sp500", "gold", "dxy", "eth", "vix")}],
    metrics=["sp500", "gold", "dxy", "eth", "vix"],
)
family(
    "sentiment",
    {
        "fear_greed_ma7": (6, "m7"),
        "fear_greed_ma30": (6, mean("fear_greed", 30)),
        "fear_greed_zscore": (6, zs("fear_greed", 90)),
        "extreme_fear": (None, flag("fear_greed < 25")),
        "extreme_greed": (None, flag("fear_greed > 75")),
        "fg_extreme_signal": (None, "CASE WHEN m7 < 25 THEN -1 WHEN m7 > 75 THEN 1 ELSE 0 END"),
    },
    [{"m7": mean("fear_greed", 7)}],
    metrics=["fear_greed"],
)
family(
    "exchange_flows",
    {
        "exchange_netflow_btc": (4, "nf"),
        "exchange_netflow_usd": (2, "exchange_inflow_usd - exchange_outflow_usd"),
        "exchange_netflow_ma7": (5, mean("nf", 7)),
        "exchange_netflow_lag_1": (4, lag("nf", 1)),
        "exchange_netflow_lag_7": (4, lag("nf", 7)),
        "supply_on_exchanges_pct": (6, "supply_on_exchanges / circulating_supply * 100"),
        "supply_change_30d": (7, chg("supply_on_exchanges", 30)),
    },
    [{"nf": "exchange_inflow_btc - exchange_outflow_btc"}],
    metrics=["exchange_inflow_btc", "exchange_outflow_btc", "exchange_inflow_usd", "exchange_outflow_usd", "supply_on_exchanges", "circulating_supply"],
)
family(
    "valuation_scores",
    {
        "mvrv_zscore": (6, zs("mvrv_ratio", 365)),
        "btc_dom_zscore": (6, zs("btc_dominance", 90)),
        "mcap_zscore": (6, clip(f"(market_cap - ({mean('market_cap', 365, 30)})) / (({std('market_cap', 365, 30)}) + 1e-10)", "-5.0", "5.0")),
        "nvt_ratio": (6, clip("market_cap / (transfer_count * close + 1e-10)", "0.0", "1000.0")),
        "mcap_to_fdv": (6, clip("market_cap / (fdv + 1e-10)", "0.0", "1.5")),
    },
    metrics=["mvrv_ratio", "btc_dominance", "market_cap", "transfer_count", "fdv"],
)
family(
    "activity",
    {
        "active_addresses_ma7": (6, mean("active_addresses", 7)),
        "tx_count_ma7": (6, mean("tx_count", 7)),
        "tx_growth_30d": (7, chg("tx_count", 30)),
        "commits_ma7": (6, mean("core_commits", 7)),
        "commits_trend_30d": (7, chg("c30", 30)),
        "ecosystem_commits_ma7": (6, mean("ecosystem_commits", 7)),
        "addresses_with_balance_pctchg_30d": (7, chg("addresses_with_balance", 30)),
        "hash_rate_pctchg_30d": (7, chg("hash_rate", 30)),
    },
    [{"c30": mean("core_commits", 30)}],
    metrics=["active_addresses", "tx_count", "core_commits", "ecosystem_commits", "addresses_with_balance", "hash_rate"],
)
family(
    "futures_positioning",
    {
        "buy_sell_ratio": (7, f"greatest(least(bsr, {q('bsr', 0.99, 365, 30)}), {q('bsr', 0.01, 365, 30)})"),
        "net_buy_pressure": (2, "futures_buy_volume - futures_sell_volume"),
        "futures_dominance": (6, "futures_volume / (volume + futures_volume + 1) * 100"),
        "oi_change_1d": (7, chg("open_interest", 1)),
        "oi_change_7d": (7, f"CASE WHEN oi7 IS NOT NULL THEN greatest(least(oi7, {q('oi7', 0.99, 365, 30)}), {q('oi7', 0.01, 365, 30)}) END"),
        "oi_change_30d": (7, f"CASE WHEN oi30 IS NOT NULL THEN greatest(least(oi30, {q('oi30', 0.99, 365, 30)}), {q('oi30', 0.01, 365, 30)}) END"),
        "oi_ma7": (5, mean("open_interest", 7)),
        "funding_rate_ma7": (8, mean("funding_rate", 7, 1)),
    },
    [{"bsr": "futures_buy_volume / (futures_sell_volume + 1)", "oi7": chg("open_interest", 7), "oi30": chg("open_interest", 30)}],
    metrics=["futures_buy_volume", "futures_sell_volume", "futures_volume", "open_interest", "funding_rate"],
)
family(
    "futures_basis",
    {
        "basis_pct": (5, "b"),
        "basis_annualized": (5, "b * 4"),
        "basis_ma7": (5, mean("b", 7)),
        "basis_ma30": (5, mean("b", 30)),
        "basis_zscore": (6, zs("b", 90)),
    },
    [{"b": "(futures_close - close) / close * 100"}],
    metrics=["futures_close"],
)
family(
    "positioning_ratios",
    {
        "ls_ratio_change": (7, chg("global_ls_ratio", 1)),
        "ls_ratio_ma7": (7, mean("global_ls_ratio", 7)),
        "extreme_long": (None, flag("global_long_pct > 0.70")),
        "extreme_short": (None, flag("1 - global_long_pct > 0.45")),
        "smart_retail_divergence": (10, "top_traders_ls_ratio - global_ls_ratio"),
        "taker_ratio_ma7": (7, mean("futures_taker_ratio", 7)),
        "aggressive_buying": (None, flag("futures_taker_ratio > 1.1")),
        "aggressive_selling": (None, flag("futures_taker_ratio < 0.9")),
        "spot_taker_buy_ratio": (7, "taker_buy / nullif(volume, 0)"),
        "spot_taker_sell_ratio": (7, "1 - taker_buy / nullif(volume, 0)"),
        "taker_pressure": (6, "taker_buy / nullif(volume, 0) - (1 - taker_buy / nullif(volume, 0))"),
    },
    metrics=["global_ls_ratio", "global_long_pct", "top_traders_ls_ratio", "futures_taker_ratio", "taker_buy"],
)
family(
    "supply_models",
    {
        "stock_to_flow": (7, "s2f"),
        "s2f_multiple": (5, "s2m"),
        "s2f_zscore": (6, clip(f"(s2m - ({mean('s2m', 365, 30)})) / (({std('s2m', 365, 30)}) + 1e-10)", "-5.0", "5.0")),
        "puell_multiple": (6, "pu"),
        "puell_extreme_low": (None, flag("pu < 0.5")),
        "puell_extreme_high": (None, flag("pu > 4")),
    },
    [
        {"s2f": clip("circulating_supply / nullif(btc_issued_daily * 365, 0)", "0.0", "1000.0"), "iss": "btc_issued_daily * close"},
        {"s2m": clip("close / nullif(pow(s2f, 3), 0)", "0.0", "100.0"), "pu": clip(f"iss / nullif({mean('iss', 365, 30)}, 0)", "0.0", "10.0")},
    ],
    metrics=["circulating_supply", "btc_issued_daily"],
)
family(
    "miner_stress",
    {
        "difficulty_ribbon": (7, "dr"),
        "ribbon_compression": (7, "rc"),
        "miner_capitulation": (None, flag("dr < -0.05 AND rc < 0.1")),
        "nvt_signal": (6, "nv"),
        "nvt_golden_cross": (None, flag(f"nv < ({mean('nv', 30)})")),
    },
    [
        {"h9": mean("hash_rate", 9, 4), "h200": mean("hash_rate", 200, 100), "txu": "transfer_count * close"},
        {"dr": clip("h9 / nullif(h200, 0) - 1", "-1.0", "1.0"), "rc": clip("abs(h9 - h200) / nullif(h200, 0)", "0.0", "2.0"),
         "nv": clip(f"market_cap / nullif({mean('txu', 90, 7)}, 0)", "0.0", "500.0")},
    ],
    metrics=["hash_rate", "transfer_count", "market_cap"],
)
family(
    "stablecoins",
    {
        "stablecoin_supply_change_7d": (7, chg("stablecoin_supply", 7)),
        "stablecoin_supply_change_30d": (7, chg("stablecoin_supply", 30)),
        "stablecoin_btc_ratio": (7, clip("stablecoin_supply / nullif(market_cap, 0)", "0.0", "10.0")),
        "stablecoin_zscore": (6, clip(f"(stablecoin_supply - ({mean('stablecoin_supply', 30)})) / (({std('stablecoin_supply', 90, 30)}) + 1e-10)", "-5.0", "5.0")),
        "stablecoin_zscore_full": (6, clip(f"(stablecoin_supply - ({mean('stablecoin_supply', 30)})) / nullif({std('stablecoin_supply', 90)}, 0)", "-5.0", "5.0")),
    },
    metrics=["stablecoin_supply", "market_cap"],
)
family(
    "on_chain",
    {
        "sopr_ma7_min1": (7, mean("sopr", 7, 1)),
        "sopr_ma30_min1": (7, mean("sopr", 30, 1)),
        "sopr_below_1": (None, flag("sopr < 1")),
        "nupl_ma30_min1": (7, mean("nupl", 30, 1)),
        "nupl_capitulation": (None, flag("nupl < 0")),
        "nupl_euphoria": (None, flag("nupl > 0.75")),
        "sth_sopr_ma7_min1": (7, mean("sth_sopr", 7, 1)),
        "sth_capitulation": (None, flag("sth_sopr < 1")),
        "mempool_congestion": (7, f"mempool_tx_count / ({mean('mempool_tx_count', 7, 1)})"),
        "miners_revenue_ratio_min1": (7, f"miners_revenue_usd / ({mean('miners_revenue_usd', 30, 1)})"),
        "google_trend_ma4w": (6, mean("google_trend", 28, 1)),
        "google_trend_fomo": (None, flag("google_trend > 80")),
        "nupl_ma30": (7, mean("nupl", 30)),
        "miners_revenue_ratio": (7, f"miners_revenue_usd / ({mean('miners_revenue_usd', 30)})"),
    },
    metrics=["sopr", "nupl", "sth_sopr", "mempool_tx_count", "miners_revenue_usd", "google_trend"],
)
family(
    "calendar_fields",
    {
        "day_of_week": (None, "CAST(isodow(ts) - 1 AS INTEGER)"),
        "is_month_end": (None, flag("last_day(ts) = ts")),
        "is_q4": (None, flag("quarter(ts) = 4")),
    },
)
family(
    "interactions",
    {
        "funding_basis_spread": (5, "funding_rate - (futures_close - close) / close * 100"),
        "sopr_x_nupl": (7, "sopr * nupl"),
        "fg_x_vix": (5, "fg7 * vz"),
        "funding_extreme": (None, flag(f"abs(funding_rate) > 2 * ({std('funding_rate', 90, 30)})")),
        "mvrv_x_nupl": (6, "mz * nupl"),
    },
    [{"fg7": mean("fear_greed", 7), "vz": zs("vix", 90), "mz": zs("mvrv_ratio", 365)}],
    metrics=["funding_rate", "futures_close", "sopr", "nupl", "fear_greed", "vix", "mvrv_ratio"],
)

# -- closed-form kernels -----------------------------------------------------------------------

_LOG = [{"lp": "ln(close)"}, {"lx": lag("lp")}, {"dx": "lp - lx"}]


def _half_life(n, m):
    b = f"CASE WHEN count(lp) OVER {win(n)} >= {m} THEN regr_slope(lp, lx) OVER {win(n - 1)} END"
    return f"greatest(least(CASE WHEN ({b}) > 0 AND ({b}) < 1 THEN -ln(2) / ln(greatest({b}, 1e-300)) END, 252.0), 1.0)"


family(
    "half_life",
    {f"half_life_{n}d": (6, f"CASE WHEN (CASE WHEN count(lp) OVER {win(n)} >= {m} THEN regr_slope(lp, lx) OVER {win(n - 1)} END) BETWEEN 1e-300 AND 1 THEN {_half_life(n, m)} END") for n, m in ((30, 20), (60, 30))},
    _LOG,
)
_OU = {}
for _n in (30, 60):
    _OU[f"mu{_n}"] = mean("lp", _n, 30)
    for _k, _e in (("sxx", "lx*lx"), ("sx", "lx"), ("sxd", "lx*dx"), ("sd", "dx"), ("sdd", "dx*dx")):
        _OU[f"{_k}{_n}"] = f"sum({_e}) OVER {win(_n - 1)}"
    _OU[f"n{_n}"] = f"count(dx) OVER {win(_n - 1)}"
family(
    "ou_parameters",
    {f"ou_theta_{n}d": (6, f"CASE WHEN th{n} IS NOT NULL THEN least(th{n}, 10.0) END") for n in (30, 60)}
    | {f"ou_mu_{n}d": (7, f"CASE WHEN th{n} IS NOT NULL THEN mu{n} END") for n in (30, 60)}
    | {f"ou_sigma_{n}d": (6, f"CASE WHEN th{n} IS NOT NULL THEN sqrt(greatest((sdd{n} - sd{n}*sd{n}/n{n})/n{n} + 2*th{n}*(sxd{n} - sx{n}*sd{n}/n{n})/n{n} + th{n}*th{n}*(sxx{n} - sx{n}*sx{n}/n{n})/n{n}, 0)) END") for n in (30, 60)},
    [*_LOG, _OU, {f"th{n}": f"abs(-(sxd{n} - mu{n}*sd{n}) / nullif(sxx{n} - 2*mu{n}*sx{n} + n{n}*mu{n}*mu{n}, 0))" for n in (30, 60)}],
)
family(
    "variance_ratio",
    {"variance_ratio_30d": (6, f"CASE WHEN count(r1) OVER {win(29)} >= 16 THEN (var_samp(r8) OVER {win(22)} / 8) / nullif(var_samp(r1) OVER {win(29)}, 0) END")},
    [{"r1": chg("close", 1), "r8": chg("close", 8)}],
)
_TS = {}
for _n, _m in ((10, 10), (20, 20), (30, 10)):
    _TS[f"sl{_n}"] = f"CASE WHEN count(close) OVER {win(_n)} >= {_m} THEN regr_slope(close, x) OVER {win(_n)} / avg(close) OVER {win(_n)} * 100 END"
    _TS[f"r2{_n}"] = f"CASE WHEN count(close) OVER {win(_n)} >= {_m} THEN regr_r2(close, x) OVER {win(_n)} END"
family(
    "linear_trend",
    {f"trend_slope_{n}": (6, f"sl{n}") for n in (10, 20, 30)} | {f"linear_r2_{n}": (7, f"r2{n}") for n in (10, 20, 30)}
    | {"trend_angle_20": (6, "degrees(atan(sl20 / 100))")},
    [{"x": "CAST(date_diff('day', DATE '1995-01-01', ts) AS DOUBLE)"}, _TS],
)


def _streak(n):
    brk = f"max(CASE WHEN same = 0 THEN x END) OVER {win(n)}"
    return f"least(x - coalesce({brk}, min(x) OVER {win(n)}), count(close) OVER {win(n)} - 1)"


family(
    "trend_strength_score",
    {f"trend_strength_{n}d": (6, f"0.4 * r2{n} * 100 + 0.3 * least(100.0, abs(sl{n}) * 10) + 0.3 * ({_streak(n)}) / (count(close) OVER {win(n)}) * 100") for n in (10, 20, 30)},
    [
        {"x": "CAST(date_diff('day', DATE '1995-01-01', ts) AS DOUBLE)", "r1": chg("close", 1)},
        {"same": f"CASE WHEN r1 * {lag('r1')} > 0 THEN 1 ELSE 0 END"},
        _TS,
    ],
)


def _mom(n):
    fit = [p for p in (5, 10, 20, 50) if p <= n]
    top = " + ".join(f"(close / {lag('close', p - 1)} - 1) * 100 * (1.0 / {p})" for p in fit)
    return f"CASE WHEN count(close) OVER {win(n)} >= {n} THEN ({top}) / {sum(1 / p for p in fit)!r} END"


family(
    "momentum_and_consistency",
    {f"momentum_score_{n}": (5, _mom(n)) for n in (10, 20, 50)}
    | {f"trend_consistency_{n}": (6, f"abs(CASE WHEN count(r1) OVER {win(n)} >= {n} THEN avg(CASE WHEN r1 > 0 THEN 1.0 WHEN r1 IS NOT NULL THEN 0.0 END) OVER {win(n)} END - 0.5) * 200") for n in (10, 20, 50)}
    | {f"price_position_{n}": (6, f"CASE WHEN count(close) OVER {win(n)} >= {n} THEN CASE WHEN max(close) OVER {win(n)} = min(close) OVER {win(n)} THEN 50.0 ELSE (close - min(close) OVER {win(n)}) / (max(close) OVER {win(n)} - min(close) OVER {win(n)}) * 100 END END") for n in (20, 50, 100)},
    [{"r1": chg("close", 1)}],
)
family(
    "velocity_acceleration",
    {
        "velocity": (6, "v"),
        "acceleration": (4, "a"),
        "momentum_regime": (None, "CASE WHEN v IS NULL OR a IS NULL THEN 'unknown' WHEN v > 0 AND a > 0 THEN 'accelerating_up' WHEN v > 0 AND a < 0 THEN 'decelerating_up' WHEN v < 0 AND a < 0 THEN 'accelerating_down' WHEN v < 0 AND a > 0 THEN 'decelerating_down' ELSE 'neutral' END"),
    },
    [
        {"r1": chg("close", 1)},
        {"v10": mean("r1", 10), "h20": f"count(close) OVER {win(20)} >= 20"},
        {"v": "CASE WHEN h20 THEN v10 * 100 END", "a": f"CASE WHEN h20 THEN (v10 - {lag('v10')}) * 10000 END"},
    ],
)
family(
    "correlation_change",
    {"correlation_change_30d": (5, f"(cm - {lag('cm', 30)}) / (abs({lag('cm', 30)}) + 0.01)")},
    [{"r1": chg("close", 1), "s1": chg("sp500", 1)}, {"cr": corr("r1", "s1", 30)}, {"cm": mean("cr", 30)}],
    metrics=["sp500"],
)
family(
    "volatility_shift",
    {f"vol_regime_ratio_{n}": (6, f"CASE WHEN count(r1) OVER {win(2 * n)} >= {2 * n} THEN ({std('r1', n // 3)}) / nullif({std('r1', n)}, 0) END") for n in (20, 30, 50)}
    | {"noise_ratio_100": (4, f"CASE WHEN count(close) OVER {win(100)} >= 100 THEN (var_samp(r5) OVER {win(95)}) / nullif(var_samp(r30) OVER {win(70)}, 0) * 36 END")},
    [{"r1": chg("close", 1), "r5": chg("close", 5), "r30": chg("close", 30)}],
)


_CUSUM_SQL = f"""WITH {t.SQL_PANEL}, r AS (SELECT *, {chg('close', 1)} AS r1 FROM panel),
f AS (SELECT series_id, ts, list(r1) FILTER (r1 IS NOT NULL) OVER {win(30)} AS a, stddev_samp(r1) OVER {win(30)} AS sd, count(r1) OVER {win(30)} AS n FROM r),
g AS (SELECT series_id, ts, sd, n, CASE WHEN n >= 10 AND sd > 0 THEN list_reduce(
    list_transform(a, lambda v: {{'v': v, 'p': 0.0, 'q': 0.0, 'mp': 0.0, 'mq': 0.0, 'k': 0}}),
    lambda s, e: {{
      'v': 0.0,
      'p': CASE WHEN greatest(0, s.p + e.v - sd / 2) > 4 * sd OR greatest(0, s.q - e.v - sd / 2) > 4 * sd THEN 0.0 ELSE greatest(0, s.p + e.v - sd / 2) END,
      'q': CASE WHEN greatest(0, s.p + e.v - sd / 2) > 4 * sd OR greatest(0, s.q - e.v - sd / 2) > 4 * sd THEN 0.0 ELSE greatest(0, s.q - e.v - sd / 2) END,
      'mp': greatest(s.mp, greatest(0, s.p + e.v - sd / 2)),
      'mq': greatest(s.mq, greatest(0, s.q - e.v - sd / 2)),
      'k': s.k + CASE WHEN greatest(0, s.p + e.v - sd / 2) > 4 * sd OR greatest(0, s.q - e.v - sd / 2) > 4 * sd THEN 1 ELSE 0 END}},
    {{'v': 0.0, 'p': 0.0, 'q': 0.0, 'mp': 0.0, 'mq': 0.0, 'k': 0}}) END AS c FROM f)
SELECT series_id, ts, CASE WHEN n >= 10 AND sd = 0 THEN 0 ELSE c.mp END AS cusum_pos, CASE WHEN n >= 10 AND sd = 0 THEN 0 ELSE c.mq END AS cusum_neg,
  CASE WHEN n >= 10 AND sd = 0 THEN 0 ELSE c.k END AS cusum_changes FROM g"""


@query("cusum", "series_id ts cusum_pos:6 cusum_neg:6 cusum_changes", _CUSUM_SQL)
def cusum(spark, sf_dir):
    return FEATURES.build(t.panel(spark, sf_dir), DAILY, ["cusum_pos", "cusum_neg", "cusum_changes"])[0]
