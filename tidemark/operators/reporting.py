"""Report queries over a decision log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip
from tidemark.operators.aggregates import pick_mode
from tidemark.panel import Panel, Running

c = F.col


def preset(df: DataFrame, panel: Panel, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a named period, counted back from the last row of each series: all, 24m, 12m, 6m, ytd,
    custom."""
    ts = c(panel.ts)
    if name == "all":
        return df
    if name == "custom":
        return df.filter((ts >= F.lit(start).cast("date")) & (ts <= F.lit(end).cast("date")))
    last = df.groupBy(*panel.keys).agg(F.max(panel.ts).alias("_last"))
    since = F.trunc("_last", "year") if name == "ytd" else F.add_months("_last", -int(name.rstrip("m")))
    return df.join(last, list(panel.keys)).filter(ts >= since).drop("_last")


def monthly(df: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*by, F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("alloc").alias("mean_alloc"), F.avg("p_up").alias("mean_p_up"),
        pick_mode("regime").alias("regime"), F.count_if("is_large_move").alias("emergencies"),
    )


def size_class(alloc_pct: Column) -> Column:
    return (
        F.when(alloc_pct <= 0.01, "none").when(alloc_pct < 10, "minimal").when(alloc_pct < 30, "small")
        .when(alloc_pct < 60, "moderate").when(alloc_pct < 85, "large").otherwise("near maximum")
    )


def bounded(x: Column) -> Column:
    return clip(x, F.lit(0.0), F.lit(1.0))


def counterfactuals(pred: Column, k: Column, conf: Column, k_bull: float = 60.0) -> dict[str, Column]:
    return {
        "actual": bounded(pred * k * conf),
        "without_confidence": bounded(pred * k),
        "if_bull": bounded(pred * k_bull * conf),
        "potential": bounded(pred * k_bull),
    }


def main_brake(pred: Column, k: Column, conf: Column) -> Column:
    """Which factor cut the position most."""
    f = counterfactuals(pred, k, conf)
    return (
        F.when(pred <= 0, "negative forecast")
        .when(f["potential"] < 0.30, "weak forecast")
        .when(f["actual"] >= 0.85, "none")
        .when(f["if_bull"] - f["actual"] >= f["without_confidence"] - f["actual"], "regime")
        .otherwise("uncertain classifier")
    )


def forecast_band(pred: Column) -> Column:
    return F.when(pred <= 0, "negative").when(pred < 0.005, "very weak").when(pred < 0.015, "moderate").otherwise("strong")


def confidence_band(conf: Column) -> Column:
    return F.when(conf < 0.6, "undecided").when(conf < 0.85, "medium").otherwise("confident")


def verdict(alloc: Column, asset: Column, cash: Column) -> Column:
    """What a closed period says about the position."""
    return F.when(asset.isNull(), None).when(
        asset > cash, F.when(alloc >= 0.5, "conviction rewarded").otherwise("cost of caution")
    ).otherwise(F.when(alloc < 0.5, "caution protected").otherwise("large in a bad period"))


def neighbours(df: DataFrame, panel: Panel, at: str, before: int = 12, after: int = 7) -> DataFrame:
    """Rows around one day, by row distance within the series."""
    ts = c(panel.ts)
    n = panel.running(df, {"_n": Running(F.lit(1), "count")})
    here = n.filter(ts == F.lit(at).cast("date")).select(*panel.keys, c("_n").alias("_at"))
    j = n.join(here, list(panel.keys)).withColumn("distance", c("_n") - c("_at"))
    return j.filter(c("distance").between(-before, after)).drop("_n", "_at")


def explain_month(df: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    """Level against the mean of the log and the reasons, as flags and one sentence list."""
    overall = df.groupBy(*by).agg((F.avg("alloc") * 100).alias("_all"))
    m = df.groupBy(*by, F.date_format(ts, "yyyy-MM").alias("month")).agg(
        (F.avg("alloc") * 100).alias("alloc_pct"),
        F.avg((c("regime") == "BEAR").cast("double")).alias("bear"),
        F.avg((c("regime") == "BULL").cast("double")).alias("bull"),
        pick_mode("regime").alias("dominant"),
        (F.avg("pred") * 100).alias("pred_pct"),
        F.avg(F.abs(c("p_up") - 0.5)).alias("edge"),
        F.count_if("is_large_move").alias("emergencies"),
        F.avg((c("alloc") == 0).cast("double")).alias("zeroed"),
    )
    j = m.join(overall, list(by))
    d = c("alloc_pct") - c("_all")
    level = F.when(d < -10, "well below").when(d < -3, "below").when(d > 10, "well above").when(d > 3, "above").otherwise("in line")
    reasons = F.concat_ws(
        "; ",
        F.when(c("bear") >= 0.5, "mostly BEAR").when(c("bull") >= 0.5, "mostly BULL").otherwise(F.concat(F.lit("dominant "), c("dominant"))),
        F.when(c("pred_pct") <= 0.3, "weak forecasts").otherwise("positive forecasts"),
        F.when(c("edge") < 0.1, "uncertain"),
        F.when(c("emergencies") > 0, F.concat(c("emergencies").cast("string"), F.lit(" emergencies"))),
        F.when(c("zeroed") >= 0.5, "mostly zeroed"),
    )
    return j.select(*by, "month", "alloc_pct", level.alias("level"), reasons.alias("reasons"))


def extreme_features(df: DataFrame, panel: Panel, features: Sequence[str], at: str, gap: float = 35.0, top: int = 4) -> DataFrame:
    """Features whose value on a day is far from the middle of their history, per series."""
    from tidemark.operators.controls import unpivot

    keys = list(panel.keys)
    upto = df.filter(c(panel.ts) <= F.lit(at).cast("date"))
    long = unpivot(upto.select(*keys, panel.ts, *features), [*keys, panel.ts], features).filter(c("x").isNotNull())
    day = upto.groupBy(*keys).agg(F.max(panel.ts).alias("_day"))
    now = long.join(day, keys).filter(c(panel.ts) == c("_day")).select(*keys, "feature", c("x").alias("value"))
    share = F.avg((c("x") <= c("value")).cast("double")) * 100
    pct = long.join(now, [*keys, "feature"]).groupBy(*keys, "feature", "value").agg(share.alias("percentile"))
    far = pct.filter(F.abs(c("percentile") - 50) >= gap)
    # the few extreme features of a series: keep the top by distance, no global sort
    best = far.groupBy(*keys).agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.abs(c("percentile") - 50)).alias("o"), "feature", "value", "percentile"))), 1, top).alias("_t")
    )
    return best.select(*keys, F.explode("_t").alias("_x")).select(*keys, "_x.feature", "_x.value", "_x.percentile")


def action_fields(action: Column) -> dict[str, Column]:
    """Numbers and tags pulled back out of the action text."""
    ret = F.regexp_extract(action, r"EMERGENCY \(ret ([+-]?[\d.]+)%\)", 1)
    return {"emergency_ret": F.when(ret != "", ret.cast("double")), "backfilled": action.contains("[BACKFILLED")}


def change_from_previous(df: DataFrame, panel: Panel, x: str, out: str = "delta") -> DataFrame:
    df = panel.running(df, {"_p": Running(c(x), "prev")})
    return df.withColumn(out, c(x) - c("_p")).drop("_p")


def top_k(df: DataFrame, metric: str, k: int, tie: Sequence[str]) -> DataFrame:
    return df.orderBy(c(metric).desc_nulls_last(), *tie).limit(k)
