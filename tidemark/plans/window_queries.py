"""Joins, run lengths, ranks, labels and regimes over the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins, labels, regimes
from tidemark.operators.features import FEATURES
from tidemark.operators.decisions import scenarios
from tidemark.operators.order_stats import expanding_median
from tidemark.panel import DAILY, Running
from tidemark.plans import tables as t
from tidemark.plans.catalog import query
from tidemark.plans.feature_queries import ORD, mean, std, win

c = F.col

# -- joins -------------------------------------------------------------------------------------


@query(
    "left_join_metrics", "series_id ts close vix:7",
    f"WITH {t.SQL_BARS}, m AS (SELECT CAST(l_shipdate AS DATE) AS ts, {t.METRICS['vix']} AS vix FROM lineitem GROUP BY 1) SELECT series_id, ts, close, vix FROM bars LEFT JOIN m USING (ts)",
)
def left_join_metrics(spark, sf_dir):
    return t.order_bars(spark, sf_dir).join(t.daily_metrics(spark, sf_dir, ["vix"]), "ts", "left")


@query(
    "outer_join_days", "ts orders_n lines_n",
    """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS ts, count(*) AS orders_n FROM orders GROUP BY 1),
       b AS (SELECT CAST(l_shipdate AS DATE) AS ts, count(*) AS lines_n FROM lineitem GROUP BY 1) SELECT ts, orders_n, lines_n FROM a FULL JOIN b USING (ts)""",
)
def outer_join_days(spark, sf_dir):
    a = t.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.count(F.lit(1)).alias("orders_n"))
    b = t.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("ts")).agg(F.count(F.lit(1)).alias("lines_n"))
    return a.join(b, "ts", "outer")


@query(
    "collision_safe_join", "series_id ts close volume:2 vix:7",
    f"WITH {t.SQL_BARS}, m AS (SELECT CAST(l_shipdate AS DATE) AS ts, {t.METRICS['vix']} AS vix FROM lineitem GROUP BY 1) SELECT series_id, ts, close, volume, vix FROM bars LEFT JOIN m USING (ts)",
)
def collision_safe_join(spark, sf_dir):
    right = t.daily_metrics(spark, sf_dir, ["vix"]).withColumn("close", F.lit(-1.0))
    return joins.fresh_columns(t.order_bars(spark, sf_dir), right, ["ts"])


for _name, _op, _strict in (("asof_at_or_before", ">=", False), ("asof_strictly_before", ">", True)):

    @query(
        _name, "series_id ts price:4 alloc:7 regime",
        f"WITH {t.SQL_DECISIONS} SELECT s.series_id, s.ts, s.price, d.alloc, d.regime FROM signals s ASOF LEFT JOIN decisions d ON s.series_id = d.series_id AND s.ts {_op} d.ts",
    )
    def asof(spark, sf_dir, strict=_strict):
        left = t.signals(spark, sf_dir).select("series_id", "ts", "price")
        return joins.asof(left, t.decisions(spark, sf_dir), DAILY, ["alloc", "regime"], strict=strict)


@query(
    "asof_first_fallback", "series_id ts price:4 alloc:7",
    f"""WITH {t.SQL_DECISIONS}, f AS (SELECT series_id, arg_min(alloc, ts) AS a0 FROM decisions GROUP BY 1)
        SELECT s.series_id, s.ts, s.price, coalesce(d.alloc, a0) AS alloc FROM signals s JOIN f USING (series_id) ASOF LEFT JOIN decisions d ON s.series_id = d.series_id AND s.ts >= d.ts""",
)
def asof_first_fallback(spark, sf_dir):
    left = t.signals(spark, sf_dir).select("series_id", "ts", "price")
    return joins.asof(left, t.decisions(spark, sf_dir), DAILY, ["alloc"], fallback_first=True)


@query(
    "rate_as_of", "o_orderkey ts annual",
    f"SELECT o_orderkey, ts, {t.SQL_RATE} AS annual FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ts FROM orders)",
)
def rate_as_of(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ts"))
    return joins.asof_global(o, t.rate_steps(spark), "ts", "effective", ["annual"], fallback_first=True)


@query(
    "rows_inside_periods", "series_id period_start n first_day last_day sum_ret:7",
    f"""WITH {t.SQL_DECISIONS} SELECT d.series_id, d.ts AS period_start, count(*) AS n, min(s.ts) AS first_day, max(s.ts) AS last_day, sum(s.day_ret) AS sum_ret
        FROM decisions d JOIN signals s ON s.series_id = d.series_id AND s.ts > d.ts AND s.ts <= d.next_ts GROUP BY 1, 2""",
)
def rows_inside_periods(spark, sf_dir):
    daily = t.signals(spark, sf_dir).select("series_id", "ts", "day_ret")
    rows = joins.period_of(daily, t.decisions(spark, sf_dir).select("series_id", "ts", "next_ts"), DAILY, [])
    return rows.groupBy("series_id", "period_start").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_day"), F.max("ts").alias("last_day"), F.sum("day_ret").alias("sum_ret")
    )


@query(
    "next_decision", "series_id ts next_ts",
    f"WITH {t.SQL_DECISIONS}, e AS (SELECT series_id, max(ts) AS e FROM decisions GROUP BY 1) SELECT series_id, ts, coalesce(lead(ts) OVER {ORD}, e + INTERVAL 7 DAY)::DATE AS next_ts FROM decisions JOIN e USING (series_id)",
)
def next_decision(spark, sf_dir):
    """The study that ends at the last decision plus seven days."""
    d = t.decisions(spark, sf_dir).select("series_id", "ts")
    d = DAILY.running(d, {"_n": Running(c("ts"), "prev")}, reverse=True)
    return d.select("series_id", "ts", F.coalesce("_n", F.date_add("ts", 7)).alias("next_ts"))


@query(
    "unlogged_days", "series_id ts",
    f"WITH {t.SQL_DECISIONS} SELECT series_id, ts FROM signals ANTI JOIN decisions USING (series_id, ts)",
)
def unlogged_days(spark, sf_dir):
    return t.signals(spark, sf_dir).select("series_id", "ts").join(t.decisions(spark, sf_dir), ["series_id", "ts"], "left_anti")


@query(
    "logged_days", "series_id ts price:4",
    f"WITH {t.SQL_DECISIONS} SELECT series_id, ts, price FROM signals SEMI JOIN decisions USING (series_id, ts)",
)
def logged_days(spark, sf_dir):
    return t.signals(spark, sf_dir).select("series_id", "ts", "price").join(t.decisions(spark, sf_dir), ["series_id", "ts"], "left_semi")


@query(
    "regime_multiplier", "series_id ts regime k_wide",
    f"WITH {t.SQL_DECISIONS} SELECT series_id, ts, regime, CASE regime WHEN 'BULL' THEN 100 WHEN 'MILD' THEN 50 ELSE 20 END AS k_wide FROM decisions",
)
def regime_multiplier(spark, sf_dir):
    d = t.decisions(spark, sf_dir)
    return d.withColumn("k_wide", joins.lookup(c("regime"), {"BULL": 100, "MILD": 50, "BEAR": 20}))


@query(
    "fx_on_price_calendar", "series_id ts fx:4",
    f"""WITH {t.SQL_PANEL}, fx AS (SELECT series_id, ts, close AS v FROM bars WHERE isodow(ts) < 6 AND ts > DATE '1995-01-20'),
        f AS (SELECT p.series_id, p.ts, last_value(v IGNORE NULLS) OVER (PARTITION BY p.series_id ORDER BY p.ts) AS v1 FROM panel p LEFT JOIN fx USING (series_id, ts))
        SELECT series_id, ts, coalesce(v1, first_value(v1 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fx FROM f""",
)
def fx_on_price_calendar(spark, sf_dir):
    fx = t.order_bars(spark, sf_dir).filter((F.weekday("ts") < 5) & (c("ts") > "1995-01-20")).select("series_id", "ts", c("close").alias("fx"))
    cal = t.panel(spark, sf_dir).select("series_id", "ts").join(fx, ["series_id", "ts"], "left")
    return joins.on_calendar(cal, DAILY, ["fx"], both_ways=True)


@query(
    "scenario_grid", "series_id scenario n mean_alloc:7",
    f"""WITH {t.SQL_DECISIONS}, g AS (SELECT * FROM (VALUES ('5/1', 5.0, 1.0), ('15/1', 15.0, 1.0), ('5/half', 5.0, 0.5), ('15/half', 15.0, 0.5)) AS v(scenario, scale, mult))
        SELECT series_id, scenario, count(*) AS n, avg(greatest(least(pred * k * mult / (1 + exp(-abs(p_up - 0.5) * scale)), 1.0), 0.0)) AS mean_alloc
        FROM decisions CROSS JOIN g GROUP BY 1, 2""",
)
def scenario_grid(spark, sf_dir):
    from tidemark.operators.decisions import allocation, confidence

    grid = [{"scenario": f"{s}/{n}", "scale": float(s), "mult": m} for s in (5, 15) for n, m in (("1", 1.0), ("half", 0.5))]
    d = scenarios(t.decisions(spark, sf_dir), grid)
    a = allocation(c("pred"), c("k") * c("mult"), confidence(c("p_up"), c("scale")))
    return d.groupBy("series_id", "scenario").agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_alloc"))


# -- ranks and tails of long windows -----------------------------------------------------------


def _rank_sql(x: str, n: int) -> str:
    lst = f"list({x}) OVER {win(n)}"
    return (
        f"CASE WHEN count({x}) OVER {win(n)} >= {n} THEN (len(list_filter({lst}, lambda v: v < {x})) + "
        f"(len(list_filter({lst}, lambda v: v = {x})) + 1) / 2.0) / {n} END"
    )


@query(
    "percent_ranks", "series_id ts price_percentile_1y:8 price_percentile_2y:8 vol_percentile_1y:8",
    f"""WITH {t.SQL_PANEL}, r AS (SELECT *, ln(close / lag(close) OVER {ORD}) AS return_1d FROM panel),
        v AS (SELECT *, round(({std('return_1d', 30)}) * sqrt(365.0), 9) AS vol FROM r),
        l AS (SELECT *, list(close) OVER {win(365)} AS l1, list(close) OVER {win(730)} AS l2, list(vol) OVER {win(365)} AS l3,
              count(close) OVER {win(365)} AS n1, count(close) OVER {win(730)} AS n2, count(vol) OVER {win(365)} AS n3 FROM v)
        SELECT series_id, ts,
          CASE WHEN n1 = 365 THEN (len(list_filter(l1, lambda q: q < close)) + (len(list_filter(l1, lambda q: q = close)) + 1) / 2.0) / 365 END AS price_percentile_1y,
          CASE WHEN n2 = 730 THEN (len(list_filter(l2, lambda q: q < close)) + (len(list_filter(l2, lambda q: q = close)) + 1) / 2.0) / 730 END AS price_percentile_2y,
          NULL::DOUBLE AS vol_percentile_1y FROM l""".replace("NULL::DOUBLE AS vol_percentile_1y", "CASE WHEN n3 = 365 THEN (len(list_filter(l3, lambda q: q < vol)) + (len(list_filter(l3, lambda q: q = vol)) + 1) / 2.0) / 365 END AS vol_percentile_1y"),
)
def percent_ranks(spark, sf_dir):
    base, _ = FEATURES.build(t.panel(spark, sf_dir), DAILY, ["volatility_30d"], keep=["close"])
    # deviations that differ only in the last bits would break ties differently on each engine
    base = base.withColumn("volatility_30d", F.round("volatility_30d", 9))
    return FEATURES.build(base, DAILY, ["price_percentile_1y", "price_percentile_2y", "vol_percentile_1y"])[0]


@query(
    "tail_loss", "series_id ts cvar_95:8",
    f"""WITH {t.SQL_PANEL}, r AS (SELECT *, ln(close / lag(close) OVER {ORD}) AS x FROM panel),
        l AS (SELECT *, list(x) OVER {win(252)} AS a, count(x) OVER {win(252)} AS n, quantile_cont(x, 0.05) OVER {win(252)} AS q FROM r)
        SELECT series_id, ts, CASE WHEN n = 252 THEN list_avg(list_filter(a, lambda v: v <= q)) END AS cvar_95 FROM l""",
)
def tail_loss(spark, sf_dir):
    return FEATURES.build(t.panel(spark, sf_dir), DAILY, ["cvar_95"])[0]


@query(
    "distance_percentiles", "series_id ts distance_percentile_10:6 distance_percentile_50:6",
    f"""WITH {t.SQL_PANEL}, d AS (SELECT *, (close - ({mean('close', 10)})) / ({mean('close', 10)}) * 100 AS d10, (close - ({mean('close', 50)})) / ({mean('close', 50)}) * 100 AS d50 FROM panel),
        l AS (SELECT *, list(d10) OVER {win(20)} AS l1, list(d50) OVER {win(100)} AS l2, count(d10) OVER {win(20)} AS n1, count(d50) OVER {win(100)} AS n2 FROM d)
        SELECT series_id, ts,
          CASE WHEN n1 = 20 THEN (len(list_filter(l1, lambda q: q < d10)) + (len(list_filter(l1, lambda q: q = d10)) + 1) / 2.0) / 20 * 100 END AS distance_percentile_10,
          CASE WHEN n2 = 100 THEN (len(list_filter(l2, lambda q: q < d50)) + (len(list_filter(l2, lambda q: q = d50)) + 1) / 2.0) / 100 * 100 END AS distance_percentile_50 FROM l""",
)
def distance_percentiles(spark, sf_dir):
    return FEATURES.build(t.panel(spark, sf_dir), DAILY, ["distance_percentile_10", "distance_percentile_50"])[0]


# -- cumulative and run-length operators -------------------------------------------------------


@query(
    "cumulative", "series_id ts cum_max cum_sum:2 cum_growth:6",
    f"WITH {t.SQL_PANEL}, r AS (SELECT *, coalesce(close / lag(close) OVER {ORD} - 1, 0) / 10000 AS x FROM panel) SELECT series_id, ts, max(close) OVER {ORD} AS cum_max, sum(volume) OVER {ORD} AS cum_sum, product(1 + x) OVER {ORD} AS cum_growth FROM r",
)
def cumulative(spark, sf_dir):
    base, _ = FEATURES.build(t.panel(spark, sf_dir), DAILY, ["simple_return_1d"], keep=["close", "volume"])
    x = 1 + F.coalesce("simple_return_1d", F.lit(0.0)) / 10000
    return DAILY.running(base, {"cum_max": Running(c("close"), "max"), "cum_sum": Running(c("volume"), "sum"), "cum_growth": Running(x, "product")})


@query(
    "all_time_high", "series_id ts distance_from_ath:8 days_since_ath",
    f"""WITH {t.SQL_PANEL}, a AS (SELECT *, max(close) OVER {ORD} AS ath FROM panel)
        SELECT series_id, ts, close / ath - 1 AS distance_from_ath, date_diff('day', max(CASE WHEN close = ath THEN ts END) OVER {ORD}, ts)::INTEGER AS days_since_ath FROM a""",
)
def all_time_high(spark, sf_dir):
    df = DAILY.running(t.panel(spark, sf_dir).select("series_id", "ts", "close"), {"ath": Running(c("close"), "max")})
    df = df.withColumn("_at", F.when(c("close") == c("ath"), c("ts")))
    df = DAILY.running(df, {"_last": Running(c("_at"), "last")})
    return df.withColumns({"distance_from_ath": c("close") / c("ath") - 1, "days_since_ath": F.datediff("ts", "_last")})


_ANCHORS = ["1995-11-28", "1997-07-09", "1999-05-11"]


@query(
    "days_since_anchor", "series_id ts days_since_anchor",
    f"WITH {t.SQL_PANEL} SELECT series_id, ts, CASE " + " ".join(f"WHEN ts >= DATE '{d}' THEN date_diff('day', DATE '{d}', ts)" for d in reversed(_ANCHORS)) + " ELSE 0 END::INTEGER AS days_since_anchor FROM panel",
)
def days_since_anchor(spark, sf_dir):
    dates = F.array(*[F.lit(d).cast("date") for d in _ANCHORS])
    past = F.array_max(F.filter(dates, lambda d: d <= c("ts")))
    return t.panel(spark, sf_dir).select("series_id", "ts", F.coalesce(F.datediff("ts", past), F.lit(0)).alias("days_since_anchor"))


_STATE = "CASE WHEN volume = 0 THEN 'idle' WHEN close > open THEN 'up' ELSE 'down' END"


def _state():
    return F.when(c("volume") == 0, "idle").when(c("close") > c("open"), "up").otherwise("down")


_ISLANDS = f"""WITH {t.SQL_PANEL}, s AS (SELECT series_id, ts, {_STATE} AS state FROM panel),
  ch AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER {ORD} THEN 1 ELSE 0 END AS ch FROM s),
  g AS (SELECT *, sum(ch) OVER {ORD} AS grp FROM ch)"""


@query(
    "run_lengths", "series_id ts state run_length",
    f"{_ISLANDS} SELECT series_id, ts, state, row_number() OVER (PARTITION BY series_id, grp ORDER BY ts) AS run_length FROM g",
)
def run_lengths(spark, sf_dir):
    df = t.panel(spark, sf_dir).select("series_id", "ts", _state().alias("state"))
    return regimes.run_length(df, DAILY, "state")


@query(
    "run_spans", "series_id state run_start run_end n_rows",
    f"{_ISLANDS}, r AS (SELECT series_id, state, grp, min(ts) AS run_start, max(ts) AS l, count(*) AS n_rows FROM g GROUP BY 1, 2, 3) SELECT series_id, state, run_start, coalesce(lead(run_start) OVER (PARTITION BY series_id ORDER BY grp), l) AS run_end, n_rows FROM r",
)
def run_spans(spark, sf_dir):
    df = t.panel(spark, sf_dir).select("series_id", "ts", _state().alias("state"))
    return regimes.runs(df, DAILY, "state")


@query(
    "rows_since_large_move", "series_id ts since",
    f"""WITH {t.SQL_PANEL}, r AS (SELECT *, close / lag(close) OVER {ORD} - 1 AS x, row_number() OVER {ORD} AS n FROM panel),
        e AS (SELECT *, coalesce(abs(x) > 2 * ({std('x', 30)}), false) AS hit FROM r)
        SELECT series_id, ts, n - coalesce(max(CASE WHEN hit THEN n END) OVER {ORD}, 0) AS since FROM e""",
)
def rows_since_large_move(spark, sf_dir):
    from tidemark.functions import rolling as R

    base, _ = FEATURES.build(t.panel(spark, sf_dir), DAILY, ["simple_return_1d"])
    f = DAILY.halo(base, 30)
    f = DAILY.owned(f.withColumn("_hit", F.abs("simple_return_1d") > 2 * R.std("simple_return_1d", DAILY.window(), 30)))
    return regimes.rows_since(f, DAILY, c("_hit"), "since")


@query(
    "days_in_regime", "series_id ts regime days_in_state",
    f"""WITH {t.SQL_DECISIONS}, p AS (SELECT series_id, ts, regime, lag(regime) OVER {ORD} AS pr, coalesce(date_diff('day', lag(ts) OVER {ORD}, ts), 1) AS step FROM decisions),
        g AS (SELECT *, sum(CASE WHEN pr IS DISTINCT FROM regime THEN 1 ELSE 0 END) OVER {ORD} AS grp FROM p)
        SELECT series_id, ts, regime, CAST(sum(step) OVER (PARTITION BY series_id, grp ORDER BY ts) AS BIGINT) AS days_in_state FROM g""",
)
def days_in_regime(spark, sf_dir):
    return regimes.days_in_state(t.decisions(spark, sf_dir).select("series_id", "ts", "regime"), DAILY, "regime")


@query(
    "last_rows", "series_id ts close",
    f"WITH {t.SQL_BARS} SELECT series_id, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS r FROM bars) WHERE r <= 60",
)
def last_rows(spark, sf_dir):
    df = DAILY.running(t.order_bars(spark, sf_dir), {"_r": Running(F.lit(1), "count")}, reverse=True)
    return df.filter(c("_r") <= 60)


@query(
    "history_percentile", "series_id ts close share_below:8",
    f"""WITH {t.SQL_PANEL}, l AS (SELECT series_id, max(ts) AS ts, arg_max(close, ts) AS cur FROM panel WHERE ts <= DATE '2000-06-30' GROUP BY 1)
        SELECT l.series_id, l.ts, cur AS close, avg(CASE WHEN p.close <= cur THEN 1.0 ELSE 0.0 END) AS share_below FROM l JOIN panel p ON p.series_id = l.series_id AND p.ts <= l.ts GROUP BY 1, 2, 3""",
)
def history_percentile(spark, sf_dir):
    """Share of the history at or below the value of a chosen day: two aggregations."""
    p = t.panel(spark, sf_dir).select("series_id", "ts", "close").filter(c("ts") <= "2000-06-30")
    cur = p.groupBy("series_id").agg(F.max("ts").alias("_ts"), F.max_by("close", "ts").alias("_cur"))
    j = p.join(cur, "series_id")
    return j.groupBy("series_id", c("_ts").alias("ts"), c("_cur").alias("close")).agg(F.avg((c("close") <= c("_cur")).cast("double")).alias("share_below"))


@query(
    "expanding_stats", "series_id ts expanding_mean:8 expanding_std:4",
    f"WITH {t.SQL_PANEL} SELECT series_id, ts, CASE WHEN count(close) OVER {ORD} >= 30 THEN ln(avg(close) OVER {ORD}) END AS expanding_mean, CASE WHEN count(close) OVER {ORD} >= 30 THEN stddev_samp(close) OVER {ORD} END AS expanding_std FROM panel",
)
def expanding_stats(spark, sf_dir):
    p = DAILY.with_origin(t.panel(spark, sf_dir).select("series_id", "ts", "close"), ["close"])
    y = c("close") - c("_o_close")
    df = DAILY.running(p, {"_n": Running(c("close"), "count"), "_s": Running(y, "sum"), "_ss": Running(y * y, "sum")})
    ok = c("_n") >= 30
    var = F.greatest(c("_ss") - c("_s") * c("_s") / c("_n"), F.lit(0.0)) / F.greatest(c("_n") - 1, F.lit(1))
    return df.withColumns({"expanding_mean": F.when(ok, F.ln(c("_o_close") + c("_s") / c("_n"))), "expanding_std": F.when(ok, F.sqrt(var))})


@query(
    "expanding_median", "series_id ts median_close:6 median_volume:6",
    f"WITH {t.SQL_PANEL} SELECT series_id, ts, quantile_cont(CASE WHEN n_obs > 0 THEN close END, 0.5) OVER {ORD} AS median_close, quantile_cont(volume, 0.5) OVER {ORD} AS median_volume FROM panel",
)
def expanding_medians(spark, sf_dir):
    """Of the observed closes, with gaps, and of the volume, which is 0 on many days."""
    p = t.panel(spark, sf_dir).select("series_id", "ts", F.when(c("n_obs") > 0, c("close")).alias("close"), "volume")
    return expanding_median(expanding_median(p, DAILY, "close", "median_close"), DAILY, "volume", "median_volume")


# -- regimes -----------------------------------------------------------------------------------

_CODES = {
    "research": """CASE WHEN v > 35 OR vol > 0.9 OR r30 < -0.20 THEN 4 WHEN a > 30 AND r30 > 0.05 THEN 2 WHEN a > 30 AND r30 < -0.05 THEN -2
      WHEN a > 20 AND r30 > 0.02 THEN 1 WHEN a > 20 AND r30 < -0.02 THEN -1 WHEN a < 20 AND h < 0.45 THEN -3 ELSE 0 END""",
    "serving": """CASE WHEN coalesce(vol, 0.5) > 0.9 OR coalesce(r30, 0) < -0.20 THEN 4
      WHEN a > 30 THEN CASE WHEN r30 > 0.05 THEN 2 WHEN r30 < -0.05 THEN -2 ELSE 0 END
      WHEN a > 20 THEN CASE WHEN r30 > 0.02 THEN 1 WHEN r30 < -0.02 THEN -1 ELSE 0 END
      WHEN a < 20 AND h < 0.45 THEN -3 ELSE 0 END""",
}
# stand-ins with the ranges of the real inputs, so that every class occurs
_IN_SQL = t.SQL_SIGNALS + f""", i AS (SELECT series_id, ts, vol30 * 0.8 AS vol, price / lag(price, 10) OVER {ORD} - 1 AS r30,
  10 + 30 * abs(price / sma_short - 1) * 10 AS a, p_up AS h, 20 + 20 * abs(day_ret) * 10 AS v FROM signals)"""


def _regime_inputs(spark, sf_dir):
    f = DAILY.halo(t.signals(spark, sf_dir), 10)
    f = f.withColumns(
        {
            "vol": c("vol30") * 0.8,
            "r30": c("price") / F.lag("price", 10).over(DAILY.window()) - 1,
            "a": 10 + 30 * F.abs(c("price") / c("sma_short") - 1) * 10,
            "h": c("p_up"),
            "v": 20 + 20 * F.abs("day_ret") * 10,
        }
    )
    return DAILY.owned(f)


for _kind, _code in _CODES.items():

    @query(
        f"regime_code_{_kind}", "series_id ts code smoothed",
        f"""WITH {_IN_SQL}, k AS (SELECT series_id, ts, {_code} AS code FROM i),
            m AS (SELECT *, median(code) OVER {win(5)} AS md FROM k)
            SELECT series_id, ts, code, CAST(round_even(md, 0) AS INTEGER) AS smoothed FROM m""",
    )
    def regime_code(spark, sf_dir, kind=_kind):
        i = _regime_inputs(spark, sf_dir)
        if kind == "research":
            code = regimes.regime_code(c("v"), c("vol"), c("r30"), c("a"), c("h"))
        else:
            code = regimes.regime_code_serving(c("vol"), c("r30"), c("a"), c("h"))
        return regimes.smooth_code(i.select("series_id", "ts", code.alias("code")), DAILY, "code", "smoothed")


@query(
    "sma_regimes", "series_id ts regime",
    f"WITH {t.SQL_SIGNALS} SELECT series_id, ts, CASE WHEN sma_short IS NULL OR sma_long IS NULL THEN 'MILD' WHEN price > sma_short AND sma_short > sma_long THEN 'BULL' WHEN price > sma_long THEN 'MILD' ELSE 'BEAR' END AS regime FROM signals",
)
def sma_regimes(spark, sf_dir):
    return t.signals(spark, sf_dir).withColumn("regime", regimes.sma_regime(c("price"), c("sma_short"), c("sma_long")))


@query(
    "interpretive_labels", "series_id ts hurst_label strength score_label status",
    f"""WITH {_IN_SQL} SELECT series_id, ts, CASE WHEN h > 0.55 THEN 'trending' WHEN h < 0.45 THEN 'mean_reverting' ELSE 'random_walk' END AS hurst_label,
        round(abs(h - 0.5) * 2, 7) AS strength, CASE WHEN a * 2 > 70 THEN 'high' WHEN a * 2 > 40 THEN 'medium' WHEN a IS NOT NULL THEN 'low' END AS score_label,
        CASE WHEN a IS NULL THEN 'unknown' WHEN a * 2 > 70 THEN 'regime_changing' WHEN a * 2 > 40 THEN CASE WHEN vol * 2 > 1.5 THEN 'volatility_expanding' WHEN vol * 2 < 0.7 THEN 'volatility_contracting' ELSE 'transition_period' END ELSE 'stable_regime' END AS status FROM i""",
)
def interpretive_labels(spark, sf_dir):
    i = _regime_inputs(spark, sf_dir)
    return i.withColumns(
        {
            "hurst_label": regimes.hurst_label(c("h")),
            "strength": F.round(F.abs(c("h") - 0.5) * 2, 7),
            "score_label": regimes.level_label(c("a") * 2, "high", "medium", "low"),
            "status": regimes.status_label(c("a") * 2, c("vol") * 2),
        }
    )


# -- labels ------------------------------------------------------------------------------------


@query(
    "forward_labels", "series_id ts target_return_1d:8 target_direction_1d target_return_5d:8 target_direction_5d target_return_3d:8 target_up_3d",
    f"""WITH {t.SQL_PANEL}, l AS (SELECT *, lead(close, 1) OVER {ORD} AS n1, lead(close, 3) OVER {ORD} AS n3, lead(close, 5) OVER {ORD} AS n5 FROM panel)
        SELECT series_id, ts, ln(n1 / close) AS target_return_1d, CAST(ln(n1 / close) > 0 AS DOUBLE) AS target_direction_1d, n5 / close - 1 AS target_return_5d,
        CAST(coalesce(n5 > close, false) AS DOUBLE) AS target_direction_5d, n3 / close - 1 AS target_return_3d, CAST(n3 > close AS DOUBLE) AS target_up_3d FROM l""",
)
def forward_labels(spark, sf_dir):
    return labels.forward_returns(t.panel(spark, sf_dir).select("series_id", "ts", "close"), DAILY, 3)


def _barrier_sql(name, h, pt, sl):
    path = f"list(price) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"{path} AS p_{name}"


@query(
    "triple_barrier", "series_id ts " + " ".join(f"{n} {n}_bin" for n in labels.BARRIERS),
    f"""WITH {t.SQL_SIGNALS}, l AS (SELECT series_id, ts, price, vol30 / sqrt(365.0) AS dv, {", ".join(_barrier_sql(n, *v) for n, v in labels.BARRIERS.items())} FROM signals),
        b AS (SELECT series_id, ts, """
    + ", ".join(
        f"""CASE WHEN len(p_{n}) = {h} AND dv > 0 THEN coalesce(list_filter(list_transform(p_{n}, lambda x: CASE WHEN x >= price * (1 + {pt} * dv) THEN 1 WHEN x <= price * (1 - {sl} * dv) THEN -1 ELSE 0 END), lambda x: x <> 0)[1], 0) END AS {n}"""
        for n, (h, pt, sl) in labels.BARRIERS.items()
    )
    + " FROM l) SELECT *, "
    + ", ".join(f"CAST({n} = 1 AS INTEGER) AS {n}_bin" for n in labels.BARRIERS)
    + " FROM b",
)
def triple_barrier(spark, sf_dir):
    s = t.signals(spark, sf_dir).select("series_id", "ts", "price", "vol30")
    return labels.triple_barrier(s, DAILY, "vol30", price="price")


_FV = f"""WITH {t.SQL_SIGNALS}, z AS (SELECT series_id, ts, price, coalesce(day_ret, 0) AS r FROM signals),
  v AS (SELECT *, CASE WHEN count(*) OVER {win(5)} = 5 THEN stddev_samp(r) OVER {win(5)} END AS current_vol,
    CASE WHEN count(*) OVER nx = 5 THEN stddev_samp(r) OVER nx END AS future_vol, lead(price, 5) OVER {ORD} / price - 1 AS fr
    FROM z WINDOW nx AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
  m AS (SELECT *, median(current_vol) OVER {ORD} AS md FROM v),
  q AS (SELECT series_id, quantile_cont(current_vol, 0.33) AS a, quantile_cont(current_vol, 0.66) AS b FROM v GROUP BY 1),
  lb AS (SELECT m.*, CASE WHEN future_vol IS NOT NULL AND current_vol IS NOT NULL THEN CAST(future_vol > current_vol AS INTEGER) END AS vol_up,
    CASE WHEN future_vol IS NOT NULL THEN CAST(coalesce(future_vol > md, false) AS INTEGER) END AS vol_high,
    CASE WHEN future_vol IS NULL THEN NULL WHEN future_vol < a THEN 0 WHEN future_vol < b THEN 1 ELSE 2 END AS vol_tercile FROM m JOIN q USING (series_id))"""


@query("volatility_labels", "series_id ts vol_up vol_high vol_tercile", f"{_FV} SELECT * FROM lb")
def volatility_labels(spark, sf_dir):
    s = t.signals(spark, sf_dir).select("series_id", "ts", "price", "day_ret")
    return labels.volatility_labels(s, DAILY, "day_ret")


@query(
    "combined_labels", "series_id ts vol_direction bullish_regime risk_adjusted sharpe_high",
    f"""{_FV} SELECT lb.series_id, lb.ts, CASE WHEN future_vol IS NOT NULL AND current_vol IS NOT NULL AND fr IS NOT NULL THEN CAST(vol_up = 1 AND fr > 0 AS INTEGER) END AS vol_direction,
      CASE WHEN future_vol IS NOT NULL AND current_vol IS NOT NULL AND fr IS NOT NULL THEN CAST(p_up > 0.55 AND fr > 0 AS INTEGER) END AS bullish_regime,
      CAST(fr / (future_vol + 1e-8) > 0 AS INTEGER) AS risk_adjusted, CAST(fr / (future_vol + 1e-8) > 0.1 AS INTEGER) AS sharpe_high
      FROM lb JOIN signals s ON s.series_id = lb.series_id AND s.ts = lb.ts""",
)
def combined_labels(spark, sf_dir):
    s = t.signals(spark, sf_dir).select("series_id", "ts", "price", "day_ret", "p_up")
    return labels.combined_labels(labels.volatility_labels(s, DAILY, "day_ret"), DAILY, "price", hurst="p_up")


@query(
    "price_from_returns", "series_id ts price_index:5",
    f"WITH {t.SQL_SIGNALS} SELECT series_id, ts, 100 * product(1 + coalesce(day_ret, 0)) OVER {ORD} AS price_index FROM signals",
)
def price_from_returns(spark, sf_dir):
    return labels.price_index(t.signals(spark, sf_dir).select("series_id", "ts", "day_ret"), DAILY, "day_ret")


