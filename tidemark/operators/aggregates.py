"""Group aggregations over decisions and panels."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import pearson
from tidemark.operators.accounting import compounded
from tidemark.operators.quantiles import exact_quantiles

c = F.col


def accuracy(df: DataFrame, by: Sequence[str], pred: str = "pred", fwd: str = "asset_ret") -> DataFrame:
    """Rows, hits, hit rate, mean outcome and forecast correlation per group."""
    p, f = c(pred), c(fwd)
    hit = (((p > 0) & (f > 0)) | ((p < 0) & (f < 0))).cast("long")
    return df.filter(f.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hit).alias("hits"),
        F.avg(hit).alias("hit_rate"),
        F.avg(f).alias("mean_ret"),
        pearson(pred, fwd).alias("pred_corr"),
    )


def shares(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Share of each value within its group: two aggregations, no window over the raw rows."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    j = counts.join(totals, list(by)) if by else counts.withColumn("_t", totals.scalar())
    return j.select(*by, value, "n", (c("n") / c("_t")).alias("share"))


def year_month_table(df: DataFrame, by: Sequence[str], ts: str, ret: str) -> DataFrame:
    """Compounded return per month and per year, laid out as twelve month columns and a total."""
    monthly = df.select(*by, F.year(ts).alias("year"), F.month(ts).alias("month"), c(ret).alias("_r"))
    keys = [*by, "year"]
    sets = monthly.groupingSets([[*map(c, keys), c("month")], [*map(c, keys)]], *map(c, keys), c("month")).agg(
        compounded(c("_r")).alias("ret"), F.grouping("month").alias("_total")
    )
    cell = lambda cond: F.max(F.when(cond, c("ret")))
    return sets.groupBy(*keys).agg(
        *[cell((c("_total") == 0) & (c("month") == m)).alias(f"m{m:02d}") for m in range(1, 13)],
        cell(c("_total") == 1).alias("total"),
    )


def over_seeds(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over seeds; 0 for a single seed."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_std")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seeds"), *aggs)


def labelled_summary(df: DataFrame, by: Sequence[str], label: str, order: str, values: Sequence[str]) -> DataFrame:
    """First label of the group (by ``order``) with mean and deviation of the values."""
    aggs = [F.min_by(label, order).alias(label)]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std")]
    return df.groupBy(*by).agg(*aggs)


def quantile_summary(df: DataFrame, by: Sequence[str], x: str, at: str) -> DataFrame:
    """min, p10, p25, p50, p75, p90, max and where the extremes are."""
    qs = [0.10, 0.25, 0.50, 0.75, 0.90]
    ext = df.groupBy(*by).agg(
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.min_by(at, F.struct(c(x), c(at))).alias("argmin"), F.max_by(at, F.struct(c(x), c(at))).alias("argmax"),
    )
    q = exact_quantiles(df, by, x, qs, "_q")
    j = ext.join(q, list(by)) if by else ext.withColumn("_q", q.scalar())
    return j.select(*by, "min", *[F.get("_q", F.lit(i)).alias(f"p{int(v * 100)}") for i, v in enumerate(qs)], "max", "argmin", "argmax")


_PAIRS_PER_PASS = 300


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """corr of every listed column pair, long form; a bounded number of pairs per aggregation."""
    out = None
    for i in range(0, len(pairs), _PAIRS_PER_PASS):
        part = pairs[i : i + _PAIRS_PER_PASS]
        row = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(a, b).alias("corr")).alias(f"_{k}") for k, (a, b) in enumerate(part)])
        rows = row.select(F.explode(F.array(*row.columns)).alias("_p")).select("_p.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def redundant_pairs(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    pairs = list(itertools.combinations(cols, 2))
    found = pair_correlations(df, pairs).filter(F.abs("corr") > threshold)
    return found.orderBy(F.abs("corr").desc(), "a", "b")


def leakage(df: DataFrame, features: Sequence[str], targets: Sequence[str], threshold: float = 0.3) -> DataFrame:
    """Feature and target pairs with a suspiciously high correlation."""
    return pair_correlations(df, [(f, t) for t in targets for f in features]).filter(F.abs("corr") > threshold)


def share_where(df: DataFrame, by: Sequence[str], conds: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(F.coalesce(cond, F.lit(False)).cast("double")).alias(n) for n, cond in conds.items()])


def pick_mode(x: str) -> Column:
    """Most frequent value, the smallest on ties."""
    return F.mode(x, deterministic=True)
