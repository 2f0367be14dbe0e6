"""Exact quantiles of groups of any size, and the bucketings built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, by: Sequence[str], x: str, qs: Sequence[float], out: str = "quantiles") -> DataFrame:
    """Linearly interpolated quantiles per group as an array in the order of ``qs``.

    ``percentile`` keeps every distinct value of a group in one task.  Here a mergeable sketch gives two
    edges around each quantile; exact counts between the edges tell in which interval each rank lies,
    and only these intervals are ranked, each by itself and with duplicates collapsed to counts.  The
    result is exact whatever the edges are: a poor sketch only makes an interval longer.
    """
    rows = df.filter(c(x).isNotNull()).select(*by, c(x).cast("double").alias("_v"))
    pad = 2 / _ACCURACY
    near = sorted({min(max(q + s, 0.0), 1.0) for q in qs for s in (-pad, pad)})
    sketch = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", F.array(*map(F.lit, near)), F.lit(_ACCURACY))).alias("_edges"))
    # one sketch row per group; without keys it is a scalar
    j = rows.join(sketch, list(by)) if by else rows.withColumn("_edges", sketch.scalar())
    j = j.select(*by, "_v", F.size(F.filter("_edges", lambda e: e < c("_v"))).alias("_k"))
    inner = j.groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("_c"))
    # a group has two intervals per quantile and one more
    w = Window.partitionBy(*by)
    inner = inner.withColumns(
        {
            "_n": F.sum("_c").over(w),
            "_before": F.coalesce(F.sum("_c").over(w.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (c("_n") - 1)).alias("rank")) for i, q in enumerate(qs)])
    wanted = F.filter(ranks, lambda m: (F.floor(m["rank"]) < c("_before") + c("_c")) & (F.ceil(m["rank"]) >= c("_before")))
    inner = inner.select(*by, "_k", "_before", wanted.alias("_wanted")).where(F.size("_wanted") > 0)
    values = j.groupBy(*by, "_k", "_v").agg(F.count(F.lit(1)).alias("_m")).join(inner, [*by, "_k"])
    # the running count comes before rows are multiplied by the ranks they answer for
    values = values.withColumn("_cum", c("_before") + F.sum("_m").over(Window.partitionBy(*by, "_k").orderBy("_v")))
    ranked = values.select(*by, "_v", "_cum", F.explode("_wanted").alias("_w")).select(*by, "_v", "_cum", "_w.*")
    # first value whose running count passes the 0-based rank
    floor = F.floor("rank")
    per = ranked.groupBy(*by, "i", "rank").agg(
        F.min(F.when(c("_cum") > floor, c("_v"))).alias("_a"), F.min(F.when(c("_cum") > F.ceil("rank"), c("_v"))).alias("_b")
    )
    per = per.withColumn("_q", c("_a") + (c("rank") - floor) * (c("_b") - c("_a")))
    packed = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "_q"))).alias("_qs"))
    return packed.select(*by, F.transform("_qs", lambda s: s["_q"]).alias(out))


def fixed_bucket(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed buckets (a, b]; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, name in zip(edges[:-1], edges[1:], labels):
        out = F.when((x > lo) & (x <= hi), name).otherwise(out)
    return out


def quantile_bucket(df: DataFrame, by: Sequence[str], x: str, n: int, out: str = "bucket") -> DataFrame:
    """1..n by exact quantile edges; equal edges collapse, ties stay together, right-closed with the
    lowest value included."""
    edges = exact_quantiles(df, by, x, [i / n for i in range(n + 1)], "_edges")
    edges = edges.withColumn("_edges", F.array_distinct("_edges"))
    j = df.join(edges, list(by)) if by else df.withColumn("_edges", edges.scalar())
    below = F.size(F.filter("_edges", lambda e: e < c(x)))
    return j.withColumn(out, F.when(c(x).isNotNull(), F.greatest(below, F.lit(1)))).drop("_edges")
