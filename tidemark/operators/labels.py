"""Forward-looking labels.  All of them look ahead; none may be used as a feature."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order_stats import expanding_median
from tidemark.operators.quantiles import exact_quantiles
from tidemark.panel import Panel, Running
from tidemark.stage import stage

c = F.col


def forward_returns(df: DataFrame, panel: Panel, horizon: int = 3, price: str = "close") -> DataFrame:
    """Log return to the next row, simple returns 5 and ``horizon`` rows ahead, and directions.

    The last rows have no outcome and stay null, except the 5-row direction, where an unknown
    comparison counts as 0.
    """
    f = panel.halo(df, 1, max(horizon, 5))
    w = panel.window()
    p = c(price)
    ahead = lambda k: F.lead(p, k).over(w)
    log_next = F.ln(ahead(1) / p)
    f = f.withColumns(
        {
            "target_return_1d": log_next,
            "target_direction_1d": (log_next > 0).cast("double"),
            "target_return_5d": ahead(5) / p - 1,
            "target_direction_5d": F.coalesce(ahead(5) > p, F.lit(False)).cast("double"),
            f"target_return_{horizon}d": ahead(horizon) / p - 1,
            f"target_up_{horizon}d": (ahead(horizon) > p).cast("double"),
        }
    )
    return panel.owned(f)


# fixed values: the four barrier settings
BARRIERS = {
    "tb_2_1_10": (10, 2.0, 1.0), "tb_15_1_5": (5, 1.5, 1.0), "tb_2_15_10": (10, 2.0, 1.5), "tb_15_075_7": (7, 1.5, 0.75),
}


def triple_barrier(df: DataFrame, panel: Panel, vol: str, configs: Mapping[str, tuple[int, float, float]] = BARRIERS, price: str = "close") -> DataFrame:
    """1 if the upper barrier is touched first within h rows, -1 for the lower, 0 for neither.

    Barriers are pt / sl times the daily volatility (annual over sqrt 365).  Null where volatility is
    missing or not positive and in the last h rows.  ``<name>_bin`` is 1 for an upper touch.
    """
    reach = max(h for h, _, _ in configs.values())
    f = panel.halo(df, 0, reach)
    w = panel.window()
    p = c(price)
    daily = c(vol) / math.sqrt(365)
    out = {}
    for name, (h, pt, sl) in configs.items():
        path = F.collect_list(p).over(w.rowsBetween(1, h))
        # the path is at most h values: an aggregate that stops changing at the first touch
        hit = F.aggregate(
            F.transform(path, lambda x: F.when(x >= p * (1 + pt * daily), 1).when(x <= p * (1 - sl * daily), -1).otherwise(0)),
            F.lit(0),
            lambda acc, x: F.when(acc == 0, x).otherwise(acc),
        )
        ok = (F.size(path) == h) & (c(vol) > 0)
        out[name] = F.when(ok, hit)
    f = f.withColumns(out)
    f = f.withColumns({f"{n}_bin": F.when(c(n).isNotNull(), (c(n) == 1).cast("int")) for n in configs})
    return panel.owned(f)


def volatility_labels(df: DataFrame, panel: Panel, ret: str, n: int = 5) -> DataFrame:
    """Realised volatility of the next n returns against the last n (missing returns count 0):
    does it rise, is it above the expanding median of the past, and its tercile.

    The tercile edges use the whole sample of each series.
    """
    f = panel.halo(df, n, n)
    w = panel.window()
    f = f.withColumn("_r", F.coalesce(c(ret), F.lit(0.0)))
    std = lambda lo, hi: F.when(F.count("_r").over(w.rowsBetween(lo, hi)) == n, F.stddev_samp("_r").over(w.rowsBetween(lo, hi)))
    f = panel.owned(f.withColumns({"current_vol": std(1 - n, 0), "future_vol": std(1, n)}).drop("_r"))
    f = stage(f, "volatility")  # several passes follow
    f = expanding_median(f, panel, "current_vol", "_med")
    f = f.join(exact_quantiles(f, panel.keys, "current_vol", [0.33, 0.66], "_cuts"), list(panel.keys), "left")
    v, now = c("future_vol"), c("current_vol")
    return f.withColumns(
        {
            "vol_up": F.when(v.isNotNull() & now.isNotNull(), (v > now).cast("int")),
            "vol_high": F.when(v.isNotNull(), F.coalesce(v > c("_med"), F.lit(False)).cast("int")),
            "vol_tercile": F.when(v.isNull(), None).when(v < c("_cuts")[0], 0).when(v < c("_cuts")[1], 1).otherwise(2),
        }
    ).drop("_med", "_cuts")


def combined_labels(df: DataFrame, panel: Panel, price: str = "close", n: int = 5, hurst: str | None = None) -> DataFrame:
    """On top of ``volatility_labels``: rising volatility with a rising price, a trending regime with a
    rising price, and a forward return per unit of future volatility above 0 and above 0.1."""
    f = panel.halo(df, 0, n)
    f = panel.owned(f.withColumn("_fr", F.lead(price, n).over(panel.window()) / c(price) - 1))
    up = c("_fr") > 0
    valid = c("future_vol").isNotNull() & c("current_vol").isNotNull() & c("_fr").isNotNull()
    h = F.coalesce(c(hurst), F.lit(0.0)) if hurst else F.lit(0.5)
    sharpe = c("_fr") / (c("future_vol") + 1e-8)
    return f.withColumns(
        {
            "vol_direction": F.when(valid, ((c("vol_up") == 1) & up).cast("int")),
            "bullish_regime": F.when(valid, ((h > 0.55) & up).cast("int")),
            "risk_adjusted": F.when(sharpe.isNotNull(), (sharpe > 0).cast("int")),
            "sharpe_high": F.when(sharpe.isNotNull(), (sharpe > 0.1).cast("int")),
        }
    ).drop("_fr")


def price_index(df: DataFrame, panel: Panel, ret: str, base: float = 100.0, out: str = "price_index") -> DataFrame:
    """A price level from returns when only returns are known (a missing return counts as 0)."""
    g = panel.running(df, {"_g": Running(1 + F.coalesce(c(ret), F.lit(0.0)), "product")})
    return g.withColumn(out, base * c("_g")).drop("_g")


