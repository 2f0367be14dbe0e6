"""Raw events and vendor tables to bars and daily metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bars(
    df: DataFrame,
    key: Column,
    ts: Column,
    price: Column,
    order: Column,
    volume: Column,
    alias: str = "series_id",
) -> DataFrame:
    """Open / high / low / close / volume / n_obs per (series, ts bucket).

    Every aggregate has a partial form, so a series holding a third of all events is reduced on the
    map side to at most one row per bucket and task before anything is shuffled.
    """
    return (
        df.select(
            key.alias(alias), ts.alias("ts"), price.alias("_p"), order.alias("_o"), volume.alias("_v")
        )
        .groupBy(alias, "ts")
        .agg(
            F.min_by("_p", "_o").alias("open"),
            F.max("_p").alias("high"),
            F.min("_p").alias("low"),
            F.max_by("_p", "_o").alias("close"),
            F.sum("_v").alias("volume"),
            F.count(F.lit(1)).alias("n_obs"),
        )
    )


def bucket_stats(df: DataFrame, keys: Sequence[str], bucket: Column, value: Column) -> DataFrame:
    """Several events per bucket rolled up: sum, mean, max, min, count."""
    return (
        df.withColumns({"ts": bucket, "_x": value})
        .groupBy(*keys, "ts")
        .agg(
            F.sum("_x").alias("value_sum"),
            F.avg("_x").alias("value_mean"),
            F.max("_x").alias("value_max"),
            F.min("_x").alias("value_min"),
            F.count("_x").alias("value_count"),
        )
    )


def last_per_bucket(df: DataFrame, keys: Sequence[str], bucket: Column, order: Column, cols: Sequence[str]) -> DataFrame:
    """Last non-null value of every column per key and bucket (not the last row)."""
    df = df.withColumns({"_b": bucket, "_o": order})
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in cols]
    return df.groupBy(*keys, F.col("_b").alias("ts")).agg(*aggs)


def rename_present(df: DataFrame, mapping: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Vendor columns to canonical names; absent ones are reported, not invented."""
    have = [(old, new) for old, new in mapping.items() if old in df.columns]
    missing = [old for old in mapping if old not in df.columns]
    return df.select(*[F.col(old).alias(new) for old, new in have]), missing


# fixed values: positional layout of an exchange kline record
KLINE_FIELDS = (
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume",
    "n_trades", "taker_buy_base", "taker_buy_quote", "ignored",
)


def klines(df: DataFrame, payload: str, prefix: str = "") -> DataFrame:
    """A JSON array of positional candle arrays to typed bars.

    Values that are not numbers become null instead of failing the job.
    """
    row = F.explode(F.from_json(payload, "array<array<string>>"))
    other = [c for c in df.columns if c != payload]
    out = df.select(*other, row.alias("_k"))
    ms = {"open_time", "close_time"}
    fields = []
    for i, name in enumerate(KLINE_FIELDS[:-1]):
        raw = F.get(F.col("_k"), F.lit(i))
        if name in ms:
            fields.append(F.timestamp_millis(raw.try_cast("long")).alias(name))
        elif name == "n_trades":
            fields.append(raw.try_cast("long").alias(prefix + name))
        else:
            fields.append(raw.try_cast("double").alias(prefix + name))
    return out.select(*other, *fields)


def closed_only(df: DataFrame, close_time: str, now: Column) -> DataFrame:
    """Drop the candle that has not finished yet."""
    return df.filter(F.col(close_time) < now)


def circulating_supply(df: DataFrame, primary: Column, fallback: Column, epoch_seconds: Column) -> DataFrame:
    """Nested supply figure with a fallback field, zero supplies dropped, epoch to UTC day."""
    return df.select(
        F.to_date(F.timestamp_seconds(epoch_seconds)).alias("ts"),
        F.coalesce(primary, fallback).cast("double").alias("stablecoin_supply"),
    ).filter(F.col("stablecoin_supply") > 0)


def metrics_wide(long: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Many single-metric series side by side: the N-way outer merge as one pivot, one shuffle."""
    return long.groupBy(*keys).pivot(name, list(names)).agg(F.max(value))


def to_utc_day(epoch: Column, unit: str = "ms") -> Column:
    make = F.timestamp_millis if unit == "ms" else F.timestamp_seconds
    return F.to_date(make(epoch.cast("long")))


def day_to_ms(day: Column) -> Column:
    return F.unix_date(day.cast("date")).cast("long") * 86400000


def day_first_rate(text_day: Column, percent: Column) -> tuple[Column, Column]:
    """'dd/MM/yyyy' text and a percentage to a date and a decimal."""
    return F.to_date(text_day, "dd/MM/yyyy"), percent.try_cast("double") / 100


def by_priority(parts: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Several sources for the same key: the first one in the list that has a value wins.

    ``min_by`` keeps one candidate per key and task, so no sort of the full union is needed.
    """
    tagged = None
    for i, part in enumerate(parts):
        p = part.select(*keys, F.col(value), F.lit(i).alias("_prio")).filter(F.col(value).isNotNull())
        tagged = p if tagged is None else tagged.unionByName(p)
    best = F.min_by(F.struct(value, "_prio"), F.col("_prio")).alias("_b")
    return tagged.groupBy(*keys).agg(best).select(
        *keys, F.col(f"_b.{value}").alias(value), F.col("_b._prio").alias("source")
    )


def attach_sources(spine: DataFrame, on: Sequence[str], sources: Mapping[str, DataFrame | None]) -> tuple[DataFrame, list[str]]:
    """Left-join each named source on the spine; a source that is absent is skipped and reported.

    Columns a source shares with what is already there are not taken twice.
    """
    skipped = []
    out = spine
    for name, src in sources.items():
        if src is None or not set(on) <= set(src.columns):
            skipped.append(name)
            continue
        fresh = [c for c in src.columns if c not in out.columns]
        out = out.join(src.select(*on, *fresh), list(on), "left")
    return out, skipped


def constant_series(spine: DataFrame, **values: float) -> DataFrame:
    """Default source: constants over the calendar."""
    return spine.withColumns({k: F.lit(float(v)) for k, v in values.items()})
