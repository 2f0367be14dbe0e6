"""Cash accrual, period and daily returns, curves and performance metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip, div
from tidemark.operators.joins import asof, asof_global
from tidemark.panel import ROW_DAY, Panel, Running, numbered

c = F.col


# -- cash --------------------------------------------------------------------------------------


def accrual(annual: Column, ts: Column) -> Column:
    """Business-day accrual of an annual rate; weekends earn nothing."""
    return F.when(F.weekday(ts) < 5, F.pow(1 + annual, F.lit(1 / 252)) - 1).otherwise(0.0)


def cash_from_steps(calendar: DataFrame, steps: DataFrame, ts: str = "ts") -> DataFrame:
    """Daily cash rate from a step history; days before the first step use the first."""
    out = asof_global(calendar, steps, ts, "effective", ["annual"], fallback_first=True)
    return out.withColumn("cash_rate", accrual(c("annual"), c(ts))).drop("annual")


def cash_from_observed(calendar: DataFrame, observed: DataFrame, ts: str = "ts") -> DataFrame:
    """Daily cash rate from observations; days without one earn nothing."""
    rates = observed.select(ts, c("rate").alias("cash_rate"))
    return calendar.join(rates, ts, "left").withColumn("cash_rate", F.coalesce("cash_rate", F.lit(0.0)))


def constant_cash(annual: float) -> Column:
    return F.lit((1 + annual) ** (1 / 365) - 1)


def cash_summary(observed: DataFrame, rate: str = "rate", ts: str = "ts") -> DataFrame:
    """Observed rates by year: count, mean, annualised mean and compounded total."""
    return observed.groupBy(F.year(ts).alias("year")).agg(
        F.count(rate).alias("n_days"),
        F.avg(rate).alias("mean_rate"),
        (F.pow(1 + F.avg(rate), F.lit(252)) - 1).alias("annualised"),
        compounded(c(rate)).alias("total"),
    )


# -- returns -----------------------------------------------------------------------------------


def compounded(r: Column) -> Column:
    """prod(1+r)-1; exact for a total loss, unlike a sum of logs."""
    return F.product(1 + r) - 1


def implied_cash(strat: Column, alloc: Column, asset: Column, fallback: float = 0.0021, gap: float = 1e-3) -> Column:
    """The cash leg that explains a stored period return."""
    return F.when((1 - alloc) > gap, (strat - alloc * asset) / (1 - alloc)).otherwise(F.lit(fallback))


def repaired_cash(df: DataFrame, panel: Panel, strat: str, alloc: str, asset: str, out: str = "cash_repaired") -> DataFrame:
    """Implied cash bounded to [0, .008]; gaps take the median of the last 8 rows, then the series
    median; open periods stay null."""
    a, s = c(alloc), c(strat)
    raw = F.when(a <= 0.001, s).when(a < 0.9, (s - a * c(asset)) / (1 - a))
    df = df.withColumn("_raw", clip(raw, F.lit(0.0), F.lit(0.008)))
    df, rows = numbered(df, panel)
    f = rows.halo(df, 8)
    med8 = F.percentile("_raw", F.lit(0.5)).over(rows.window().rowsBetween(-7, 0))
    f = rows.owned(f.withColumn("_m8", med8)).drop(ROW_DAY)
    med = f.groupBy(*panel.keys).agg(F.percentile("_raw", F.lit(0.5)).alias("_m"))
    f = f.join(med, list(panel.keys), "left")
    fixed = F.when(s.isNotNull(), F.coalesce("_raw", "_m8", "_m"))
    return f.withColumn(out, fixed).drop("_raw", "_m8", "_m")


def geometric_daily(period: Column, n_days: Column) -> Column:
    return F.pow(1 + period, 1 / F.greatest(n_days, F.lit(1))) - 1


def transaction_cost(df: DataFrame, panel: Panel, alloc: str, bps: Column | float, ret: str, out: str = "net_ret") -> DataFrame:
    """Return less bps of the allocation change; the first change is the allocation itself."""
    df = panel.running(df, {"_pa": Running(c(alloc), "prev")})
    delta = F.abs(c(alloc) - F.coalesce("_pa", F.lit(0.0)))
    rate = bps if isinstance(bps, Column) else F.lit(float(bps))
    return df.withColumns({"turnover": delta, out: c(ret) - delta * rate / 10000}).drop("_pa")


def daily_mark_to_market(daily: DataFrame, decisions: DataFrame, panel: Panel, same_day: bool = False, alloc: str = "alloc") -> DataFrame:
    """Daily strategy return from sparse decisions.

    A decision made at the close of its day earns from the next one.  ``same_day`` applies it on the
    day itself, which looks ahead, and exists for comparison only.  ``daily`` has asset_ret and
    cash_ret; a missing asset return counts as 0.
    """
    got = asof(daily, decisions.select(*panel.keys, panel.ts, alloc), panel, [alloc], strict=not same_day)
    a, r = c(alloc), F.coalesce("asset_ret", F.lit(0.0))
    return got.filter(a.isNotNull()).withColumn("strat_ret", a * r + (1 - a) * c("cash_ret"))


def equity(df: DataFrame, panel: Panel, ret: str, leading_one: bool = True, base: float = 1.0, out: str = "equity") -> DataFrame:
    """Growth of ``base`` and the drawdown from its peak.

    ``leading_one``: the peak starts at the stake; otherwise at the first value.
    """
    df = panel.running(df, {"_g": Running(1 + c(ret), "product")})
    df = panel.running(df, {"_peak": Running(c("_g"), "max")})
    peak = F.greatest(c("_peak"), F.lit(1.0)) if leading_one else c("_peak")
    return df.withColumns({out: base * c("_g"), "drawdown": c("_g") / peak - 1}).drop("_g", "_peak")


def rebased(df: DataFrame, panel: Panel, ret: str, since: str, out: str = "curve") -> DataFrame:
    """Base-100 curve restarted at the first row on or after ``since``, which is itself 100."""
    part = df.filter(c(panel.ts) >= F.lit(since).cast("date"))
    g = panel.running(part, {"_g": Running(1 + c(ret), "product"), "_first": Running(c(ret), "count")})
    first = part.groupBy(*panel.keys).agg(F.min_by(1 + c(ret), c(panel.ts)).alias("_g0"))
    return g.join(first, list(panel.keys)).withColumn(out, 100 * c("_g") / c("_g0")).drop("_g", "_g0", "_first")


# -- metrics -----------------------------------------------------------------------------------


def metrics(df: DataFrame, by: Sequence[str], ret: str, cash: str, ppy: float, drawdown: str = "drawdown", ts: str = "ts") -> DataFrame:
    """Performance of each (series, scenario, ...), one partial aggregation over the periods.

    Sortino here divides by the root mean square of the negative periods only; ``sortino_excess``
    by that of min(excess, 0) over all periods.  Sharpe uses the population deviation.
    """
    r, x = c(ret), c(ret) - c(cash)
    root = math.sqrt(ppy)
    neg = F.sqrt(F.avg(F.when(r < 0, r * r)))
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2))))
    years = F.datediff(F.max(ts), F.min(ts)) / 365.25
    return df.groupBy(*by).agg(
        F.count(r).alias("n"),
        compounded(r).alias("cum"),
        F.avg(r).alias("mean_ret"),
        (F.stddev_pop(r) * root).alias("vol"),
        (div(F.avg(r), neg) * root).alias("sortino"),
        (div(F.avg(x), down) * root).alias("sortino_excess"),
        (div(F.avg(r), F.nullif(F.stddev_pop(r), F.lit(0.0))) * root).alias("sharpe"),
        (div(F.avg(x), F.nullif(F.stddev_pop(x), F.lit(0.0))) * root).alias("sharpe_excess"),
        F.min(drawdown).alias("max_dd"),
        (F.pow(F.product(1 + r), div(F.lit(1.0), years)) - 1).alias("cagr"),
    ).withColumn("calmar", div("cagr", F.nullif(F.abs("max_dd"), F.lit(0.0))))


def summary(ret: Column, ppy: float = 52) -> dict[str, Column]:
    """Aggregates shared by sweeps and permutations: compounded return, Sortino, Sharpe."""
    root = math.sqrt(ppy)
    neg = F.sqrt(F.avg(F.when(ret < 0, ret * ret)))
    return {
        "cum": compounded(ret),
        "sortino": div(F.avg(ret), F.nullif(neg, F.lit(0.0))) * root,
        "sharpe": div(F.avg(ret), F.nullif(F.stddev_pop(ret), F.lit(0.0))) * root,
    }


def per_year(df: DataFrame, by: Sequence[str], cols: Sequence[str], ts: str = "ts", alloc: str | None = None) -> DataFrame:
    aggs = [compounded(c(x)).alias(x) for x in cols]
    if alloc:
        aggs.append(F.avg(alloc).alias("avg_alloc"))
    return df.groupBy(*by, F.year(ts).alias("year")).agg(*aggs)


def direction_stats(df: DataFrame, by: Sequence[str], pred: str = "pred", fwd: str = "asset_ret") -> DataFrame:
    """Hit rates under both conventions (strict same sign; both-not-positive counts too) and the
    correlation of forecast and outcome."""
    p, f = c(pred), c(fwd)
    strict = ((p > 0) & (f > 0)) | ((p < 0) & (f < 0))
    return df.filter(f.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(strict.cast("double")).alias("hit_rate"),
        F.avg(((p > 0) == (f > 0)).cast("double")).alias("sign_agreement"),
        F.corr(p, f).alias("pred_corr"),
    )


def exposure(df: DataFrame, by: Sequence[str], alloc: str = "alloc", fwd: str = "asset_ret", cap: float = 0.99, zero: float = 0.01) -> DataFrame:
    a = c(alloc)
    return df.groupBy(*by).agg(
        F.avg(a).alias("mean_alloc"),
        F.max(a).alias("max_alloc"),
        F.avg((a >= cap).cast("double")).alias("share_at_cap"),
        F.avg((a >= 0.70).cast("double")).alias("share_above_70"),
        F.avg((a <= zero).cast("double")).alias("share_near_zero"),
        F.avg((a == 0).cast("double")).alias("share_zero"),
        F.corr(a, c(fwd)).alias("alloc_corr"),
    )


def turnover(df: DataFrame, panel: Panel, alloc: str = "alloc") -> DataFrame:
    df = panel.running(df, {"_pa": Running(c(alloc), "prev")})
    d = F.abs(c(alloc) - F.coalesce("_pa", F.lit(0.0)))
    return df.groupBy(*panel.keys).agg(F.avg(d).alias("mean_turnover"), F.sum(d).alias("total_turnover"))


def captures(df: DataFrame, by: Sequence[str], strat: str = "strat_ret", asset: str = "asset_ret") -> DataFrame:
    """Mean strategy over mean asset return in up and in down periods."""
    s, a = c(strat), c(asset)
    side = lambda cond: div(F.avg(F.when(cond, s)), F.nullif(F.avg(F.when(cond, a)), F.lit(0.0)))
    return df.groupBy(*by).agg(side(a > 0).alias("up_capture"), side(a < 0).alias("down_capture"))


def factsheet(daily: DataFrame, decisions: DataFrame, panel: Panel) -> DataFrame:
    """Per series: growth against cash, share of months at or above cash, captures, best and worst
    decision with its date, exposure and share of zero positions."""
    keys = list(panel.keys)
    acc = daily.groupBy(*keys).agg(compounded(c("strat_ret")).alias("_s"), compounded(c("cash_ret")).alias("_c"))
    months = daily.groupBy(*keys, F.trunc(panel.ts, "month").alias("_m")).agg(
        compounded(c("strat_ret")).alias("_ms"), compounded(c("cash_ret")).alias("_mc")
    )
    months = months.groupBy(*keys).agg(
        F.avg((c("_ms") >= c("_mc")).cast("double")).alias("months_at_or_above_cash"), F.count(F.lit(1)).alias("n_months")
    )
    s = c("strat_ret")
    best = decisions.groupBy(*keys).agg(
        F.max(s).alias("best"),
        F.max_by(panel.ts, F.struct(s, -F.datediff(c(panel.ts), F.lit("1970-01-01").cast("date")))).alias("best_ts"),
        F.min(s).alias("worst"),
        F.min_by(panel.ts, F.struct(s, c(panel.ts))).alias("worst_ts"),
        F.avg("alloc").alias("exposure"),
        F.avg((c("alloc") == 0).cast("double")).alias("share_zero"),
    )
    acc = acc.select(*keys, F.when(c("_c") > 0.001, c("_s") / c("_c")).alias("share_of_cash"))
    return acc.join(months, keys).join(captures(decisions, keys), keys).join(best, keys)


def two_frequencies(decisions: DataFrame, daily: DataFrame, by: Sequence[str]) -> DataFrame:
    """Decision-level and daily metrics side by side, for reconciliation."""
    a = decisions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in summary(c("strat_ret"), 52).items()])
    b = daily.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in summary(c("strat_ret"), 365).items()])
    return a.withColumn("frequency", F.lit("decision")).unionByName(b.withColumn("frequency", F.lit("daily")))


# -- execution conventions ---------------------------------------------------------------------


def execution_point(conv: Column, ts: Column, price: Column, prev_price: Column, next_ts: Column, next_price: Column,
                    emergency: Column, ret: Column, threshold: float = 0.08) -> Column:
    """When and at what price a decision is executed: at the close; at the threshold price on an
    emergency day; at the next close; or (no-emergency) at the close."""
    at_threshold = prev_price * (1 + F.signum(ret) * threshold)
    close = F.struct(ts.alias("ts"), price.alias("price"))
    return (
        F.when((conv == "thresh") & emergency, F.struct(ts.alias("ts"), at_threshold.alias("price")))
        .when((conv == "nextclose") & emergency & next_ts.isNotNull(), F.struct(next_ts.alias("ts"), next_price.alias("price")))
        .otherwise(close)
    )


def split_day(a_before: Column, a_after: Column, day_ret: Column, first_leg: Column, cash: Column) -> Column:
    """A day traded at a threshold: the old position earns up to it, the new one from it."""
    rest = (1 + day_ret) / (1 + first_leg) - 1
    return (1 + a_before * first_leg) * (1 + a_after * rest) - 1 + (1 - a_after) * cash
