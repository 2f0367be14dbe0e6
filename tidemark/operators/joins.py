"""As-of, interval and lookup joins without range cross products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.panel import Panel, Running

c = F.col
_SALTS, _DAYS = 16, 64


def asof(
    left: DataFrame,
    right: DataFrame,
    panel: Panel,
    values: Sequence[str],
    strict: bool = False,
    fallback_first: bool = False,
) -> DataFrame:
    """Latest right row at or before (``strict``: before) each left row, per key.

    Both sides are stacked and the last right value runs along time: one shuffle on
    (keys, chunk), whatever the density of either side, and no row pairs are made.
    """
    lcols = [x for x in left.columns if x not in panel.keys and x != panel.ts]
    pack = F.struct(*values)
    l = left.select(*panel.keys, panel.ts, F.struct(*lcols).alias("_l") if lcols else F.struct(F.lit(1).alias("_one")).alias("_l"))
    r = right.select(*panel.keys, panel.ts, pack.alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    # several rows share a time step: right rows sort before left rows unless strict; of right rows with
    # one time the largest values win, so the pick never depends on the order of arrival
    side = F.when(c("_r").isNotNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    ordered = _OrderedPanel(panel, side, c("_r"))
    out = ordered.running(both, {"_m": Running(c("_r"), "last")})
    out = out.filter(c("_l").isNotNull())
    picked = out.select(
        *panel.keys, panel.ts, *[c(f"_l.{x}").alias(x) for x in lcols], *[c(f"_m.{v}").alias(v) for v in values]
    )
    if not fallback_first:
        return picked
    first = right.groupBy(*panel.keys).agg(F.min_by(pack, F.struct(c(panel.ts), pack)).alias("_f"))
    out = picked.join(first, list(panel.keys), "left")
    return out.select(
        *[x for x in picked.columns if x not in values],
        *[F.coalesce(c(v), c(f"_f.{v}")).alias(v) for v in values],
    )


class _OrderedPanel:
    """``Panel.running`` with a side flag that breaks ties within a time step."""

    def __init__(self, panel: Panel, side: Column, tie: Column):
        self.panel, self.side, self.tie = panel, side, tie

    def running(self, df: DataFrame, specs: Mapping[str, Running]) -> DataFrame:
        # time and side as one sortable value; chunk arithmetic stays on the time alone
        key = "_tk"
        df = df.withColumn(key, F.struct(c(self.panel.ts).alias("t"), self.side.alias("s"), self.tie.alias("o")))
        wrapped = _StructPanel(self.panel.keys, key, self.panel.step, self.panel.chunk_rows)
        return wrapped.running(df, specs).drop(key)


class _StructPanel(Panel):
    def pos(self, ts: Column | None = None) -> Column:
        return super().pos(c(self.ts).getField("t") if ts is None else ts)


def asof_global(
    left: DataFrame, right: DataFrame, ts: str, effective: str, values: Sequence[str],
    strict: bool = False, fallback_first: bool = False,
) -> DataFrame:
    """As-of against a keyless history (rates, model cutoffs) of any length.

    Left rows are dealt over ``_SALTS`` salts and the history is copied to each, so the salts are keys of
    ``asof``: its chunks of time spread the rows further, and no side is held whole anywhere.
    """
    panel = Panel(("_salt",), ts, "day", _DAYS)
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(_SALTS)).cast("int"))
    r = right.select(c(effective).alias(ts), *[c(v).alias(f"_h_{v}") for v in values]).where(c(ts).isNotNull())
    r = r.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    out = asof(l, r, panel, [f"_h_{v}" for v in values], strict, fallback_first)
    return out.select(*left.columns, *[c(f"_h_{v}").alias(v) for v in values])


def fresh_columns(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that only adds columns the left side does not have."""
    add = [x for x in right.columns if x not in left.columns]
    return left.join(right.select(*on, *add), list(on), "left")


def lookup(key: Column, table: Mapping[object, object]) -> Column:
    """A small literal dimension as a map expression."""
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[key]


def period_of(daily: DataFrame, periods: DataFrame, panel: Panel, values: Sequence[str]) -> DataFrame:
    """Which holding period (d0, d1] each daily row falls in: the strict as-of of the period starts,
    kept while the period lasts.  ``periods`` has ts (d0), next_ts (d1)."""
    got = asof(daily, periods.withColumn("period_start", c(panel.ts)), panel, ["period_start", "next_ts", *values], strict=True)
    inside = c(panel.ts) <= c("next_ts")
    return got.filter(inside)


def on_calendar(df: DataFrame, panel: Panel, values: Sequence[str], both_ways: bool = False) -> DataFrame:
    """Sparse values on the dense calendar rows of ``df``: carried forward, and optionally backward
    over the head."""
    df = panel.running(df, {f"_f_{v}": Running(c(v), "last") for v in values})
    if both_ways:
        df = panel.running(df, {f"_b_{v}": Running(c(v), "last") for v in values}, reverse=True)
    picks = {v: F.coalesce(c(f"_f_{v}"), *([c(f"_b_{v}")] if both_ways else [])) for v in values}
    return df.withColumns(picks).drop(*[f"_f_{v}" for v in values], *[f"_b_{v}" for v in values])
