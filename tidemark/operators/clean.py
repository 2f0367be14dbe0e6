"""Cleaning and imputation over panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import rolling as R
from tidemark.functions.scalars import clip, flag
from tidemark.panel import Panel, Running

c = F.col


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def between(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Both ends included."""
    return df.filter((c(ts) >= F.lit(start).cast("date")) & (c(ts) <= F.lit(end).cast("date")))


def first_or_last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: str = "last") -> DataFrame:
    """One row per key by a total order; ``max_by`` combines on the map side, so a key with very many
    rows costs no sort."""
    rest = [x for x in df.columns if x not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, *[c(f"_r.{x}").alias(x) for x in rest])


def fill_forward(df: DataFrame, panel: Panel, cols: Sequence[str], then_zero: bool = False) -> DataFrame:
    df = panel.running(df, {f"_f_{x}": Running(c(x), "last") for x in cols})
    fill = {x: F.coalesce(c(f"_f_{x}"), F.lit(0.0)) if then_zero else c(f"_f_{x}") for x in cols}
    return df.withColumns(fill).drop(*[f"_f_{x}" for x in cols])


def fill_backward(df: DataFrame, panel: Panel, cols: Sequence[str]) -> DataFrame:
    """Warm-up rows take the first known value.  Looks ahead."""
    df = panel.running(df, {f"_b_{x}": Running(c(x), "last") for x in cols}, reverse=True)
    return df.withColumns({x: c(f"_b_{x}") for x in cols}).drop(*[f"_b_{x}" for x in cols])


def fill_rolling_median(df: DataFrame, panel: Panel, cols: Sequence[str], n: int = 365, m: int = 30) -> DataFrame:
    f = panel.halo(df, n)
    w = panel.window()
    f = f.withColumns({f"_m_{x}": R.median(x, w, n, m) for x in cols})
    f = f.withColumns({x: F.coalesce(c(x), c(f"_m_{x}")) for x in cols}).drop(*[f"_m_{x}" for x in cols])
    return panel.owned(f)


def impute_median_first(df: DataFrame, panel: Panel, cols: Sequence[str]) -> DataFrame:
    """Rolling median, then forward fill, then zero."""
    return fill_forward(fill_rolling_median(df, panel, cols), panel, cols, then_zero=True)


def impute_forward_first(df: DataFrame, panel: Panel, cols: Sequence[str]) -> DataFrame:
    """Forward fill, then rolling median, then zero: for every numeric column."""
    out = fill_rolling_median(fill_forward(df, panel, cols), panel, cols)
    return out.withColumns({x: F.coalesce(c(x), F.lit(0.0)) for x in cols})


def fill_first_median(df: DataFrame, panel: Panel, cols: Sequence[str], first_n: int = 30, causal: bool = False) -> DataFrame:
    """Nulls take the median of the first ``first_n`` known values of the series.

    This uses later values for rows before the first known one; ``causal`` leaves those null.
    """
    # the first n known values per series are few: rank inside the first chunks only
    out = df
    for x in cols:
        known = panel.running(df.select(*panel.keys, panel.ts, x), {"_n": Running(c(x), "count")})
        head = known.filter(c(x).isNotNull() & (c("_n") <= first_n))
        med = head.groupBy(*panel.keys).agg(F.percentile(x, F.lit(0.5)).alias("_med"), F.max(panel.ts).alias("_until"))
        out = out.join(med, list(panel.keys), "left")
        fill = F.when(c(panel.ts) > c("_until"), c("_med")) if causal else F.coalesce("_med", F.lit(0.0))
        out = out.withColumn(x, F.coalesce(c(x), fill)).drop("_med", "_until")
    return out


# fixed values: neutral fill by column-name fragment
NEUTRAL = {"basis": 0.0, "funding": 0.0, "futures_volume": 0.0, "shadow": 0.5, "trade_count_zscore": 0.0, "gap_pct": 0.0}


def fill_neutral(df: DataFrame, table: Mapping[str, float] = NEUTRAL) -> DataFrame:
    """Neutral constants chosen by column name."""
    fills = {}
    for x in numeric_columns(df):
        for part, v in table.items():
            if part in x.lower():
                fills[x] = v
                break
    return df.na.fill(fills) if fills else df


def fill_from(df: DataFrame, pairs: Mapping[str, Column]) -> DataFrame:
    """Nulls of one column from another expression."""
    return df.withColumns({x: F.coalesce(c(x), e) for x, e in pairs.items()})


def prefer(first: Column, second: Column) -> Column:
    return F.coalesce(first, second)


def repair_ohlc(df: DataFrame, o: str = "open", h: str = "high", l: str = "low", x: str = "close") -> DataFrame:
    return df.withColumns({h: F.greatest(o, h, x), l: F.least(o, l, x)})


def clip_rolling_quantiles(df: DataFrame, panel: Panel, cols: Sequence[str], lo=0.01, hi=0.99, n=365, m=30) -> DataFrame:
    f = panel.halo(df, n)
    f = f.withColumns({f"_q_{x}": R.quantiles(x, [lo, hi], panel.window(), n, m) for x in cols})
    f = f.withColumns({x: clip(x, c(f"_q_{x}")[0], c(f"_q_{x}")[1]) for x in cols}).drop(*[f"_q_{x}" for x in cols])
    return panel.owned(f)


def winsorise(df: DataFrame, panel: Panel, cols: Sequence[str], sigma: float = 5.0, n: int = 365, m: int = 30) -> DataFrame:
    """Bound by rolling mean +- sigma deviations; by the expanding ones where the window is thin."""
    run = {}
    df = panel.with_origin(df, cols)
    for x in cols:
        y = c(x) - c(f"_o_{x}")
        run |= {f"_n_{x}": Running(c(x), "count"), f"_s_{x}": Running(y, "sum"), f"_ss_{x}": Running(y * y, "sum")}
    df = panel.running(df, run)
    f = panel.halo(df, n)
    w = panel.window()
    bounds = {}
    for x in cols:
        k, s, ss = c(f"_n_{x}"), c(f"_s_{x}"), c(f"_ss_{x}")
        e_mean = F.when(k >= m, c(f"_o_{x}") + s / k)
        e_std = F.when((k >= m) & (k > 1), F.sqrt(F.greatest(ss - s * s / k, F.lit(0.0)) / F.greatest(k - 1, F.lit(1))))
        bounds[f"_mu_{x}"] = F.coalesce(R.mean(x, w, n, m), e_mean)
        bounds[f"_sd_{x}"] = F.coalesce(R.std(x, w, n, m), e_std)
    f = f.withColumns(bounds)
    f = f.withColumns({x: clip(x, c(f"_mu_{x}") - sigma * c(f"_sd_{x}"), c(f"_mu_{x}") + sigma * c(f"_sd_{x}")) for x in cols})
    return panel.owned(f).drop(*bounds, *run, *[f"_o_{x}" for x in cols])


def availability(df: DataFrame, starts: Mapping[str, tuple[str, str]]) -> DataFrame:
    """0/1 flags from a start date per flag: {flag: (ts column, date)}."""
    return df.withColumns({k: flag(c(ts) >= F.lit(d).cast("date")) for k, (ts, d) in starts.items()})


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: nulls, usable values (known and not zero), deviation.  One aggregation pass."""
    stats = []
    for x in cols:
        stats.append(
            F.struct(
                F.lit(x).alias("name"),
                F.count_if(c(x).isNull()).alias("n_null"),
                F.count_if(c(x).isNotNull() & (c(x) != 0)).alias("n_usable"),
                F.stddev_samp(x).alias("deviation"),
            )
        )
    row = df.agg(*[s.alias(f"_{i}") for i, s in enumerate(stats)])
    return row.select(F.explode(F.array(*row.columns)).alias("_p")).select("_p.*")


def null_audit(df: DataFrame, cols: Sequence[str], top: int = 15) -> DataFrame:
    prof = column_profile(df, cols).filter(c("n_null") > 0)
    return prof.select("name", "n_null").orderBy(c("n_null").desc(), "name").limit(top)


def drop_thin(df: DataFrame, cols: Sequence[str], min_usable: int) -> tuple[DataFrame, list[str]]:
    """Without the columns that have too few usable values; the decision needs one row per column."""
    thin = [r["name"] for r in column_profile(df, cols).filter(c("n_usable") < min_usable).collect()]
    return df.drop(*thin), thin


def drop_constant(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    flat = [r["name"] for r in column_profile(df, cols).filter(c("deviation") == 0).collect()]
    return df.drop(*flat), flat


def select_available(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    have = [x for x in wanted if x in df.columns]
    return df.select(*have), [x for x in wanted if x not in df.columns]


def finite_rows(df: DataFrame, cols: Sequence[str], null_to_zero: bool = False) -> DataFrame:
    if null_to_zero:
        return df.na.fill(0.0, list(cols))
    ok = F.lit(True)
    for x in cols:
        ok = ok & c(x).isNotNull() & ~F.isnan(c(x))
    return df.filter(ok)
