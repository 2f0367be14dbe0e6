"""Predictions to allocations: calendar, confidence, sizing, overlays and execution conventions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip, flag
from tidemark.operators.regimes import sma_regime
from tidemark.panel import CHUNK, Panel, Running

c = F.col

# fixed values: default decision parameters
K_DEFAULT = {"BULL": 60.0, "MILD": 30.0, "BEAR": 15.0}
SIGMOID_SCALE = 5.0
LARGE_MOVE = 0.08
FRIDAY = 4


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def confidence(p_up: Column, scale: Column | float = SIGMOID_SCALE) -> Column:
    """Between .5 (undecided) and 1."""
    return sigmoid(F.abs(p_up - 0.5) * scale)


def confidence_variant(name: Column, pred: Column, p_up: Column) -> Column:
    """Named confidence rules, for scenario grids."""
    side = F.when(pred >= 0, 1.0).otherwise(-1.0)
    return (
        F.when(name == "sig15", confidence(p_up, 15.0))
        .when(name == "sig5", confidence(p_up, 5.0))
        .when(name == "conf1", F.lit(1.0))
        .when(name == "signed15", sigmoid((p_up - 0.5) * side * 15))
    )


def multiplier(regime: Column, k: Mapping[str, float] = K_DEFAULT) -> Column:
    return F.create_map(*[F.lit(v) for kv in k.items() for v in (kv[0], float(kv[1]))])[regime]


def allocation(pred: Column, k: Column, conf: Column, lo: Column | float = 0.0, hi: Column | float = 1.0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return clip(pred * k * conf, as_col(lo), as_col(hi))


def horizon_scaled(k: Column, horizon: Column | int) -> Column:
    """A longer-horizon prediction is larger; K shrinks with it so the bound does not saturate."""
    return k * 3 / horizon


def on_calendar(ts: Column, weekdays: Sequence[int] = (FRIDAY,)) -> Column:
    return F.weekday(ts).isin(list(weekdays))


def large_move(ret: Column, threshold: Column | float = LARGE_MOVE) -> Column:
    """Strictly above the threshold; a missing return is not a move."""
    return F.coalesce(F.abs(ret) > threshold, F.lit(False))


def decide(
    signals: DataFrame,
    panel: Panel,
    start: str | None = None,
    weekdays: Sequence[int] = (FRIDAY,),
    threshold: float = LARGE_MOVE,
    k: Mapping[str, float] = K_DEFAULT,
    scale: float = SIGMOID_SCALE,
    rate: str = "cash_rate",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Decision rows with what they earn until the next decision.

    ``signals`` has price, sma_short, sma_long, pred, p_up and a daily cash rate.  The next decision may
    be any number of rows ahead: it is a running value from the end of the series over chunk
    summaries, no self-join and no look-ahead limit.  A cash index that grows from the start of the
    series gives the cash return of (d0, d1] as a ratio of two of its values.  The last decision ends
    at the last row of its series.
    """
    f = panel.halo(signals, back=1)
    w = panel.window()
    in_range = F.lit(True) if start is None else (c(panel.ts) >= F.lit(start).cast("date"))
    prev_in_range = F.lag(in_range, 1).over(w)
    ret = F.try_divide("price", F.lag("price", 1).over(w)) - 1
    # the move is measured inside the range, so its first row never fires
    f = f.withColumns({"daily_ret": ret, "_move": large_move(F.when(prev_in_range, ret), threshold)})
    f = panel.owned(f).withColumn("_dec", in_range & (on_calendar(c(panel.ts), weekdays) | c("_move")))
    f = panel.running(f, {"_cash": Running(1 + c(rate), "product")})
    here = F.struct(c(panel.ts).alias("ts"), c("price"), c("_cash"))
    f = panel.running(
        f.withColumn("_here", here),
        {"_next": Running(F.when(c("_dec"), c("_here")), "last", exclusive=True), "_end": Running(c("_here"), "first")},
        reverse=True,
    )
    d = f.filter(c("_dec")).withColumn("_to", F.coalesce("_next", "_end"))
    regime = sma_regime(c("price"), c("sma_short"), c("sma_long"))
    conf = confidence(c("p_up"), scale)
    d = d.withColumn("regime", regime).withColumns({"k": multiplier(c("regime"), k), "conf": conf})
    d = d.withColumns(
        {
            "alloc": allocation(c("pred"), c("k"), c("conf")),
            "is_large_move": c("_move"),
            "is_off_calendar": ~on_calendar(c(panel.ts), weekdays),
            "next_ts": c("_to.ts"),
            "asset_ret": F.try_divide(c("_to.price"), c("price")) - 1,
            "cash_ret": F.try_divide(c("_to._cash"), c("_cash")) - 1,
        }
    )
    d = d.withColumn("strat_ret", period_return(c("alloc"), c("asset_ret"), c("cash_ret")))
    return d.select(
        *panel.keys, panel.ts, "price", "daily_ret", "pred", "p_up", "regime", "k", "conf", "alloc",
        "is_large_move", "is_off_calendar", "next_ts", "asset_ret", "cash_ret", "strat_ret", *carry,
    )


def period_return(alloc: Column, asset: Column, cash: Column) -> Column:
    return alloc * asset + (1 - alloc) * cash


def scenarios(df: DataFrame, grid: Sequence[Mapping[str, object]], name: str = "scenario") -> DataFrame:
    """Every row once per scenario.

    The grid is a short literal the caller wrote, unrolled row by row: a narrow operation, no join.
    """
    keys = list(grid[0])
    rows = F.array(*[F.struct(*[F.lit(g[k]).alias(k) for k in keys]) for g in grid])
    out = df.withColumn("_s", F.explode(rows))
    return out.select("*", *[c(f"_s.{k}").alias(k) for k in keys]).drop("_s")


# -- holding and suppressing -------------------------------------------------------------------


def hold(daily: DataFrame, panel: Panel, decided: Column, out: str = "alloc_held") -> DataFrame:
    """Days without a decision keep the last one."""
    return panel.running(daily, {out: Running(decided, "last")})


def suppress(decisions: DataFrame, panel: Panel, skip: Column, alloc: str, out: str) -> DataFrame:
    """Decisions that must not trade keep the previous traded allocation, 0 before the first."""
    kept = F.when(~F.coalesce(skip, F.lit(False)), c(alloc))
    df = panel.running(decisions.withColumn("_kept", kept), {out: Running(c("_kept"), "last")})
    return df.withColumn(out, F.coalesce(c(out), F.lit(0.0))).drop("_kept")


# -- sizing overlays ---------------------------------------------------------------------------


def vol_target(alloc: Column, vol: Column, ref: Column | float, lo: float, hi: float) -> Column:
    """Scale by reference over realised volatility; unchanged where volatility is unknown."""
    mult = F.coalesce(clip(F.try_divide(F.lit(ref) if not isinstance(ref, Column) else ref, vol), F.lit(lo), F.lit(hi)), F.lit(1.0))
    return clip(alloc * mult, F.lit(0.0), F.lit(1.0))


def vol_scaled_k(k: Column, realised: Column, target: float = 0.70, lo: float | None = None, hi: float | None = None,
                 default: float = 0.70, floor: float = 0.10) -> Column:
    """K times target over realised volatility (default while there is too little history)."""
    mult = target / F.greatest(F.coalesce(realised, F.lit(default)), F.lit(floor))
    return k * clip(mult, None if lo is None else F.lit(lo), None if hi is None else F.lit(hi))


def vol_cut(alloc: Column, vol: Column, limit: float, mult: float) -> Column:
    return alloc * F.when(vol > limit, mult).otherwise(1.0)


def persistence_boost(k: Column, regime: Column, days: Column, min_days: Column | int, boost: Column | float) -> Column:
    return F.when((regime == "BULL") & (days >= min_days), k * boost).otherwise(k)


def attribution_policy(policy: Column, pred: Column, regime: Column, conf: Column,
                       k: Mapping[str, float] = K_DEFAULT, flat: float = 50.0) -> Column:
    """Which part of the rule earns the result: the same data sized by partial rules."""
    km = multiplier(regime, k)
    model = allocation(pred, km, conf)
    return (
        F.when(policy == "model", model)
        .when(policy == "hybrid", F.when(regime == "BULL", 1.0).otherwise(model))
        .when(policy == "regime_only", multiplier(regime, {"BULL": 1.0, "MILD": 0.5, "BEAR": 0.0}))
        .when(policy == "hold", F.lit(1.0))
        .when(policy == "flat_k", allocation(pred, F.lit(flat), conf))
        .when(policy == "no_confidence", allocation(pred, km, F.lit(1.0)))
        .when(policy == "sign_only", F.when(pred > 0, 0.5).otherwise(0.0))
        .when(policy == "model_in_bear", F.when(regime == "BEAR", model).otherwise(1.0))
    )


def quantile_sizing(variant: Column, pred: Column, q10: Column, q50: Column, q90: Column, k: Column,
                    conf: Column, spread_ref: Column, fraction: float = 0.10, eps: float = 1e-4) -> Column:
    """Sizing from predicted quantiles next to the point forecast."""
    base = allocation(pred, k, conf)
    kelly = clip(q50 / F.greatest(F.abs(q10), F.lit(eps)) * fraction * conf, F.lit(0.0), F.lit(1.0))
    narrow = clip(spread_ref / F.greatest(q90 - q10, F.lit(eps)), F.lit(0.3), F.lit(1.0))
    return (
        F.when(variant == "mean", base)
        .when(variant == "median", allocation(q50, k, conf))
        .when(variant == "kelly", F.when(q50 > 0, kelly).otherwise(0.0))
        .when(variant == "positive_floor", F.when(q10 > 0, base).otherwise(0.0))
        .when(variant == "spread", allocation(pred, k * narrow, conf))
        .when(variant == "hybrid", F.when(q10 > 0, allocation(q50, k, conf)).otherwise(0.0))
    )


def action_label(alloc: Column, emergency: Column, ret: Column, backfilled: Column) -> Column:
    """'ALLOC 45.0%', with tags for an emergency and a backfilled row."""
    text = F.format_string("ALLOC %.1f%%", alloc * 100)
    text = F.when(emergency, F.concat(text, F.format_string(" EMERGENCY (ret %+.1f%%)", ret * 100))).otherwise(text)
    return F.when(backfilled, F.concat(text, F.lit(" [BACKFILLED]"))).otherwise(text)


def missed(expected: DataFrame, logged: DataFrame, keys: Sequence[str], models: DataFrame) -> DataFrame:
    """Decision dates after the last logged one that were never written, each with the newest model
    trained strictly before it."""
    last = logged.groupBy(*[k for k in keys if k != "ts"]).agg(F.max("ts").alias("_last"))
    todo = expected.join(last, [k for k in keys if k != "ts"], "left").filter(c("_last").isNull() | (c("ts") > c("_last")))
    todo = todo.join(logged.select(*keys), list(keys), "left_anti").drop("_last")
    from tidemark.operators.joins import asof_global

    return asof_global(todo, models, "ts", "cutoff_ts", ["cutoff_ts"], strict=True)


