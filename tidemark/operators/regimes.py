"""Regime codes and run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.panel import Panel, Running

c = F.col


def sma_regime(price: Column, sma_short: Column, sma_long: Column) -> Column:
    """BULL / MILD / BEAR; MILD while an average is missing."""
    return (
        F.when(sma_short.isNull() | sma_long.isNull() | price.isNull(), "MILD")
        .when((price > sma_short) & (sma_short > sma_long), "BULL")
        .when(price > sma_long, "MILD")
        .otherwise("BEAR")
    )


def _or_default(x: Column, default: float) -> Column:
    """0 counts as absent; a missing value is kept and makes comparisons false."""
    return F.when(x == 0, F.lit(default)).otherwise(x)


def regime_code(vix: Column, vol: Column, ret: Column, adx: Column, hurst: Column) -> Column:
    """4 crisis, +-2 strong trend, +-1 mild trend, -3 mean reverting, 0 neutral.

    A strong trend with a small return falls through to the mild test.
    """
    vix, vol, adx, hurst = _or_default(vix, 20.0), _or_default(vol, 0.5), _or_default(adx, 20.0), _or_default(hurst, 0.5)
    return (
        F.when((vix > 35) | (vol > 0.9) | (ret < -0.20), 4)
        .when((adx > 30) & (ret > 0.05), 2)
        .when((adx > 30) & (ret < -0.05), -2)
        .when((adx > 20) & (ret > 0.02), 1)
        .when((adx > 20) & (ret < -0.02), -1)
        .when((adx < 20) & (hurst < 0.45), -3)
        .otherwise(0)
    )


def regime_code_serving(vol: Column, ret: Column, adx: Column, hurst: Column) -> Column:
    """Serving form: no volatility index, defaults for missing inputs, and each trend band is
    exclusive (a strong trend with a small return is neutral)."""
    vol, ret = F.coalesce(vol, F.lit(0.5)), F.coalesce(ret, F.lit(0.0))
    adx, hurst = F.coalesce(adx, F.lit(20.0)), F.coalesce(hurst, F.lit(0.5))
    return (
        F.when((vol > 0.9) | (ret < -0.20), 4)
        .when(adx > 30, F.when(ret > 0.05, 2).when(ret < -0.05, -2).otherwise(0))
        .when(adx > 20, F.when(ret > 0.02, 1).when(ret < -0.02, -1).otherwise(0))
        .when((adx < 20) & (hurst < 0.45), -3)
        .otherwise(0)
    )


def smooth_code(df: DataFrame, panel: Panel, code: str, out: str, n: int = 5) -> DataFrame:
    """Rolling median of the code, halves to even."""
    f = panel.halo(df, n)
    med = F.percentile(code, F.lit(0.5)).over(R.frame(panel.window(), n))
    return panel.owned(f.withColumn(out, F.bround(med).cast("int")))


def run_length(df: DataFrame, panel: Panel, state: str, out: str = "run_length", start: str | None = None) -> DataFrame:
    """Rows since the state last changed, counting from 1; works for runs of any length.

    The change flag needs one row of history; the start of the run is a running 'last', so a run
    that spans many chunks is carried by the chunk summaries.
    """
    prev = "_prev_state"
    df = panel.running(df, {prev: Running(c(state), "prev"), "_n": Running(F.lit(1), "count")})
    change = (c("_n") == 1) | ~c(prev).eqNullSafe(c(state))
    df = df.withColumn("_mark", F.when(change, F.struct(c("_n").alias("n"), c(panel.ts).alias("ts"))))
    df = panel.running(df, {"_run": Running(c("_mark"), "last")})
    df = df.withColumn(out, c("_n") - c("_run.n") + 1)
    if start:
        df = df.withColumn(start, c("_run.ts"))
    return df.drop(prev, "_n", "_mark", "_run")


def runs(df: DataFrame, panel: Panel, state: str) -> DataFrame:
    """Start, end (start of the next run, or the last row) and state of every run."""
    marked = run_length(df, panel, state, "_len", "run_start")
    per = marked.groupBy(*panel.keys, state, "run_start").agg(
        F.max(panel.ts).alias("_last"), F.count(F.lit(1)).alias("n_rows")
    )
    nxt = panel.running(
        per.withColumnRenamed("run_start", panel.ts), {"_next": Running(c(panel.ts), "prev")}, reverse=True
    )
    return nxt.select(
        *panel.keys, state, c(panel.ts).alias("run_start"), F.coalesce(c("_next"), c("_last")).alias("run_end"), "n_rows"
    )


def rows_since(df: DataFrame, panel: Panel, event: Column, out: str) -> DataFrame:
    """Counter that is 0 on an event and counts rows since; before the first event it counts from
    1 at the first row."""
    df = panel.running(df, {"_n": Running(F.lit(1), "count")})
    df = df.withColumn("_hit", F.when(F.coalesce(event, F.lit(False)), c("_n")))
    df = panel.running(df, {"_last": Running(c("_hit"), "last")})
    return df.withColumn(out, c("_n") - F.coalesce(c("_last"), F.lit(0))).drop("_n", "_hit", "_last")


def days_in_state(df: DataFrame, panel: Panel, state: str, out: str = "days_in_state") -> DataFrame:
    """For irregular rows: 1 on the first row; on a change the gap in days to the row before; then
    the days add up until the next change."""
    prev = {"_ps": Running(F.struct(c(state).alias("s"), c(panel.ts).alias("t")), "prev")}
    df = panel.running(df, prev)
    gap = F.datediff(c(panel.ts), c("_ps.t"))
    step = F.when(c("_ps").isNull(), F.lit(1)).otherwise(gap)
    change = c("_ps").isNull() | (c("_ps.s") != c(state))
    df = df.withColumn("_step", step.cast("long"))
    df = panel.running(df, {"_cum": Running(c("_step"), "sum")})
    df = df.withColumn("_base", F.when(change, c("_cum") - c("_step")))
    df = panel.running(df, {"_off": Running(c("_base"), "last")})
    return df.withColumn(out, c("_cum") - c("_off")).drop("_ps", "_step", "_cum", "_base", "_off")


def hurst_label(h: Column) -> Column:
    return F.when(h > 0.55, "trending").when(h < 0.45, "mean_reverting").when(h.isNotNull(), "random_walk")


def level_label(x: Column, high: str, mid: str, low: str) -> Column:
    """Above 70 / above 40 / otherwise."""
    return F.when(x > 70, high).when(x > 40, mid).when(x.isNotNull(), low)


def status_label(break_score: Column, vol_ratio: Column) -> Column:
    return (
        F.when(break_score.isNull(), "unknown")
        .when(break_score > 70, "regime_changing")
        .when(
            break_score > 40,
            F.when(vol_ratio > 1.5, "volatility_expanding")
            .when(vol_ratio < 0.7, "volatility_contracting")
            .otherwise("transition_period"),
        )
        .otherwise("stable_regime")
    )
