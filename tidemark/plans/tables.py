"""The driver tables as panel inputs, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators.registry import Registry
from tidemark.panel import DAILY, HOURLY
from tidemark.sources.bars import attach_sources, bars
from tidemark.stage import staged_once

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- bars --------------------------------------------------------------------------------------


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return bars(o, c("o_orderpriority"), F.to_date("o_orderdate"), c("o_totalprice"), c("o_orderkey"), c("o_totalprice"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense daily bars of orders by priority, staged."""
    return staged_once(
        spark, "panel", (sf_dir,),
        lambda: DAILY.fill_grid(
            order_bars(spark, sf_dir), carry=["open", "high", "low", "close"], zero=["volume", "n_obs"]
        ),
    )


SQL_BARS = """bars AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, sum(o_totalprice) AS volume, count(*) AS n_obs
  FROM orders GROUP BY 1, 2)"""

SQL_PANEL = (
    SQL_BARS
    + """, spine AS (
  SELECT series_id, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts, min(ts) AS series_start
  FROM bars GROUP BY series_id),
panel AS (
  SELECT series_id, ts, series_start,
         last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high,
         last_value(low IGNORE NULLS) OVER w AS low, last_value(close IGNORE NULLS) OVER w AS close,
         coalesce(volume, 0) AS volume, coalesce(n_obs, 0) AS n_obs
  FROM spine LEFT JOIN bars USING (series_id, ts)
  WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""
)

# daily metrics of lineitem standing in for the outside series; the text is valid on both engines
METRICS = {
    "eth": "avg(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END)",
    "gold": "avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END)",
    "oil": "avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END)",
    "copper": "max(l_extendedprice)",
    "sp500": "avg(l_extendedprice)",
    "dxy": "50 + 1000 * avg(l_discount)",
    "vix": "avg(l_quantity)",
    "us10y": "100 * avg(l_tax)",
    "yield_curve_2s10s": "100 * avg(l_discount) - 5",
    "breakeven_10y": "50 * avg(l_tax)",
    "m2_supply": "1000 + sum(l_quantity)",
    "fed_balance_sheet": "sum(l_extendedprice)",
    "fear_greed": "2 * avg(l_quantity)",
    "exchange_inflow_btc": "sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END)",
    "exchange_outflow_btc": "sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END)",
    "exchange_inflow_usd": "sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END)",
    "exchange_outflow_usd": "sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END)",
    "supply_on_exchanges": "500 + sum(l_linenumber)",
    "circulating_supply": "5000 + count(*)",
    "market_cap": "sum(l_extendedprice * l_quantity)",
    "fdv": "1.2 * sum(l_extendedprice * l_quantity)",
    "mvrv_ratio": "avg(l_extendedprice) / 40000",
    "btc_dominance": "avg(l_discount) * 1000",
    "active_addresses": "CAST(count(*) AS DOUBLE)",
    "tx_count": "CAST(10 + count(*) AS DOUBLE)",
    "transfer_count": "CAST(5 + count(*) AS DOUBLE)",
    "core_commits": "CAST(1 + max(l_linenumber) AS DOUBLE)",
    "ecosystem_commits": "CAST(sum(l_linenumber) AS DOUBLE)",
    "addresses_with_balance": "CAST(1000 + sum(l_linenumber) AS DOUBLE)",
    "futures_buy_volume": "sum(CASE WHEN l_linenumber <= 3 THEN l_quantity ELSE 0 END)",
    "futures_sell_volume": "sum(CASE WHEN l_linenumber > 3 THEN l_quantity ELSE 0 END)",
    "futures_volume": "sum(l_extendedprice) / 10",
    "futures_close": "avg(l_extendedprice) * 6",
    "open_interest": "100 + sum(l_quantity)",
    "funding_rate": "avg(l_discount) - 0.05",
    "btc_issued_daily": "CAST(count(*) AS DOUBLE)",
    "hash_rate": "avg(l_extendedprice) / 1000",
    "stablecoin_supply": "10000 + sum(l_quantity)",
    "sopr": "avg(l_quantity) / 25.5",
    "sth_sopr": "avg(l_quantity) / 26",
    "nupl": "avg(l_discount) * 10 - 0.2",
    "mempool_tx_count": "CAST(count(*) AS DOUBLE)",
    "miners_revenue_usd": "sum(l_extendedprice) / 100",
    "google_trend": "max(l_quantity) * 2",
    "global_ls_ratio": "avg(l_quantity) / 25",
    "global_long_pct": "avg(l_quantity) / 45",
    "top_traders_ls_ratio": "avg(l_extendedprice) / 41000",
    "futures_taker_ratio": "avg(l_quantity) / 25",
    "reserve_risk": "CASE WHEN CAST(l_shipdate AS DATE) >= DATE '1996-04-19' THEN avg(l_tax) END",
    "puell_raw": "CASE WHEN CAST(l_shipdate AS DATE) >= DATE '1996-04-19' THEN avg(l_discount) * 20 END",
    "taker_buy": "sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END)",
}


def daily_metrics(spark: SparkSession, sf_dir: str, names=None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pick = list(METRICS) if names is None else list(names)
    return li.groupBy(F.to_date("l_shipdate").alias("ts")).agg(*[F.expr(METRICS[n]).alias(n) for n in pick])


def metric_panel(spark: SparkSession, sf_dir: str, names) -> DataFrame:
    """The price panel with outside metrics joined on the day and carried forward, staged."""
    from tidemark.panel import Running

    def make():
        wide, _ = attach_sources(panel(spark, sf_dir), ["ts"], {"metrics": daily_metrics(spark, sf_dir)})
        out = DAILY.running(wide, {f"_f_{n}": Running(c(n), "last") for n in METRICS})
        return out.withColumns({n: c(f"_f_{n}") for n in METRICS}).drop(*[f"_f_{n}" for n in METRICS])

    return staged_once(spark, "metric_panel", (sf_dir,), make).select(*panel(spark, sf_dir).columns, *names)


def sql_metric_panel(names) -> str:
    names = list(names)
    aggs = ", ".join(f"{METRICS[n]} AS {n}" for n in names)
    fill = ", ".join(f"last_value({n} IGNORE NULLS) OVER w AS {n}" for n in names)
    return f"""{SQL_PANEL}, metrics AS (
  SELECT CAST(l_shipdate AS DATE) AS ts, {aggs} FROM lineitem GROUP BY 1),
mp AS (
  SELECT panel.*, {fill} FROM panel LEFT JOIN metrics USING (ts)
  WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return bars(e, c("event_type"), F.date_trunc("hour", "ts").cast("timestamp"), c("value"), c("event_id"), F.lit(1.0))


# -- a decision-layer input that SQL can restate -----------------------------------------------

# fixed values: a short step history of annual cash rates
RATE_STEPS = [
    ("1995-06-01", 0.12), ("1996-03-15", 0.105), ("1997-01-10", 0.095), ("1998-02-01", 0.11),
    ("1999-05-20", 0.13), ("2000-04-05", 0.1175), ("2001-01-15", 0.1375),
]


def rate_steps(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(d).cast("date").alias("effective"), F.lit(r).alias("annual")) for d, r in RATE_STEPS])
    return spark.range(1).select(F.explode(rows).alias("s")).select("s.*")


def rate_expr(ts):
    """The step history as one literal CASE: no join at all for a constant table."""
    out = F.lit(RATE_STEPS[0][1])
    for d, r in RATE_STEPS[1:]:
        out = F.when(ts >= F.lit(d).cast("date"), F.lit(r)).otherwise(out)
    return out


SQL_RATE = "CASE " + " ".join(
    f"WHEN ts >= DATE '{d}' THEN {r}" for d, r in reversed(RATE_STEPS)
) + f" ELSE {RATE_STEPS[0][1]} END"
SQL_CASH = f"CASE WHEN isodow(ts) <= 5 THEN pow(1 + ({SQL_RATE}), 1.0 / 252) - 1 ELSE 0 END"

_SIG = Registry()
# rounded, so that two days with the same average are equal on every engine
_SIG.add("price", "close", lambda s: F.round(R.mean("close", s.w, 30), 4), back=30)
_SIG.add("_lp", "price", lambda s: F.ln("price"))
_SIG.add("_x", "ts", lambda s: s.panel.pos().cast("double"))
_SIG.add("sma_short", "price", lambda s: R.mean("price", s.w, 50), back=50)
_SIG.add("sma_long", "price", lambda s: R.mean("price", s.w, 200), back=200)
_SIG.add("day_ret", "price", lambda s: R.pct_change("price", s.w, 1), back=1)
_SIG.add("vol30", "day_ret", lambda s: F.round(R.std("day_ret", s.w, 30) * F.sqrt(F.lit(365.0)), 10), back=30)
_SIG.add(
    "pred", "_lp _x",
    lambda s: F.when(R.over(F.count("_lp"), s.w, 20) >= 20, F.round(3 * R.over(F.regr_slope("_lp", "_x"), s.w, 20), 10)),
    back=20,
)
_SIG.add("p_up", "pred", lambda s: 1 / (1 + F.exp(-10 * c("pred"))))

SIGNAL_COLUMNS = ["price", "sma_short", "sma_long", "day_ret", "vol30", "pred", "p_up"]
START = "1996-01-01"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed price with a slope-based forecast, and the daily cash rate; staged."""
    from tidemark.operators.accounting import accrual

    def make():
        s, _ = _SIG.build(panel(spark, sf_dir), DAILY, SIGNAL_COLUMNS)
        return s.filter(c("pred").isNotNull()).withColumn("cash_rate", accrual(rate_expr(c("ts")), c("ts")))

    return staged_once(spark, "signals", (sf_dir,), make)


SQL_SIGNALS = SQL_PANEL + f""", px AS (
  SELECT series_id, ts, CASE WHEN count(close) OVER w >= 30 THEN round(avg(close) OVER w, 4) END AS price,
         CAST(date_diff('day', DATE '1970-01-01', ts) AS DOUBLE) AS x
  FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS 29 PRECEDING)),
sg0 AS (
  SELECT *,
    CASE WHEN count(price) OVER w50 >= 50 THEN avg(price) OVER w50 END AS sma_short,
    CASE WHEN count(price) OVER w200 >= 200 THEN avg(price) OVER w200 END AS sma_long,
    price / lag(price) OVER o - 1 AS day_ret,
    CASE WHEN count(price) OVER w20 >= 20 THEN round(3 * regr_slope(ln(price), x) OVER w20, 10) END AS pred
  FROM px
  WINDOW o AS (PARTITION BY series_id ORDER BY ts),
    w20 AS (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING),
    w50 AS (PARTITION BY series_id ORDER BY ts ROWS 49 PRECEDING),
    w200 AS (PARTITION BY series_id ORDER BY ts ROWS 199 PRECEDING)),
sg AS (
  SELECT series_id, ts, price, sma_short, sma_long, day_ret,
    CASE WHEN count(day_ret) OVER w30 >= 30 THEN round(stddev_samp(day_ret) OVER w30 * sqrt(365.0), 10) END AS vol30,
    pred, 1 / (1 + exp(-10 * pred)) AS p_up, {SQL_CASH} AS cash_rate
  FROM sg0
  WINDOW w30 AS (PARTITION BY series_id ORDER BY ts ROWS 29 PRECEDING)),
signals AS (SELECT * FROM sg WHERE pred IS NOT NULL)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision log of the signals, staged."""
    from tidemark.operators.decisions import decide

    return staged_once(
        spark, "decisions", (sf_dir,), lambda: decide(signals(spark, sf_dir), DAILY, start=START, carry=["vol30"])
    )


SQL_DECISIONS = SQL_SIGNALS + f""", rng AS (SELECT * FROM signals WHERE ts >= DATE '{START}'),
mv AS (SELECT *, lag(price) OVER (PARTITION BY series_id ORDER BY ts) AS in_prev FROM rng),
reb AS (
  SELECT *, coalesce(abs(price / in_prev - 1) > 0.08, false) AS is_large_move, isodow(ts) <> 5 AS is_off_calendar
  FROM mv),
dec0 AS (
  SELECT *, lead(ts) OVER (PARTITION BY series_id ORDER BY ts) AS nt
  FROM reb WHERE is_large_move OR NOT is_off_calendar),
ends AS (SELECT series_id, max(ts) AS end_ts FROM signals GROUP BY 1),
cashidx AS (SELECT series_id, ts, exp(sum(ln(1 + cash_rate)) OVER (PARTITION BY series_id ORDER BY ts)) AS g, price FROM signals),
dec1 AS (
  SELECT d.*, coalesce(nt, end_ts) AS next_ts FROM dec0 d JOIN ends USING (series_id)),
dec2 AS (
  SELECT d.series_id, d.ts, d.price, s.day_ret AS daily_ret, d.pred, d.p_up, d.vol30,
    CASE WHEN d.sma_short IS NULL OR d.sma_long IS NULL THEN 'MILD'
         WHEN d.price > d.sma_short AND d.sma_short > d.sma_long THEN 'BULL'
         WHEN d.price > d.sma_long THEN 'MILD' ELSE 'BEAR' END AS regime,
    1 / (1 + exp(-abs(d.p_up - 0.5) * 5)) AS conf,
    d.is_large_move, d.is_off_calendar, d.next_ts,
    b.price / a.price - 1 AS asset_ret, b.g / a.g - 1 AS cash_ret
  FROM dec1 d JOIN cashidx a ON a.series_id = d.series_id AND a.ts = d.ts
    JOIN cashidx b ON b.series_id = d.series_id AND b.ts = d.next_ts
    JOIN signals s ON s.series_id = d.series_id AND s.ts = d.ts),
dec3 AS (
  SELECT *, CASE regime WHEN 'BULL' THEN 60.0 WHEN 'MILD' THEN 30.0 ELSE 15.0 END AS k FROM dec2),
decisions AS (
  SELECT *, alloc * asset_ret + (1 - alloc) * cash_ret AS strat_ret
  FROM (SELECT *, greatest(least(pred * k * conf, 1.0), 0.0) AS alloc FROM dec3))"""


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily asset and cash returns of the signal panel."""
    return signals(spark, sf_dir).select("series_id", "ts", "price", c("day_ret").alias("asset_ret"), c("cash_rate").alias("cash_ret"))


