"""Is the result luck?  Permutations, null signals, overfitting estimates and paired comparisons."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import div, norm_cdf, normal_hash, unit_hash
from tidemark.operators.accounting import summary
from tidemark.operators.decisions import allocation, confidence, period_return
from tidemark.operators.quantiles import exact_quantiles
from tidemark.panel import Panel, Running

c = F.col


# -- permutation test --------------------------------------------------------------------------


def permutations(decisions: DataFrame, panel: Panel, n: int, scale: float = 15.0, first: int = 0) -> DataFrame:
    """Metrics of each of n shuffles of (pred, p_up) together against (k, asset_ret, cash_ret).

    Shuffle number and row hash to a random order, so the result does not depend on partitioning;
    the row ranked r takes the place of row r.  The unit of sorting is one shuffle of one series.
    Only aggregates of a shuffle leave it, ``max_dd`` (the worst fall of the shuffled curve from its
    peak, the start included) among them, and ``first`` lets a million shuffles run in blocks (``permuted_blocks``).
    """
    keys = list(panel.keys)
    rows = panel.running(decisions, {"_i": Running(F.lit(1), "count")})
    ident = c(panel.ts).cast("string")
    signal = rows.select(*keys, "pred", "p_up", ident.alias("_id"))
    signal = signal.withColumn("perm", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))
    order = F.md5(F.concat_ws(":", c("perm").cast("string"), *[c(k) for k in keys], c("_id")))
    w = Window.partitionBy(*keys, "perm").orderBy("_h", "_id")
    signal = signal.withColumn("_h", order).withColumn("_i", F.row_number().over(w).cast("long")).drop("_h", "_id")
    place = rows.select(*keys, "_i", "k", "asset_ret", "cash_ret")
    j = signal.join(place, [*keys, "_i"])
    a = allocation(c("pred"), c("k"), confidence(c("p_up"), scale))
    r = period_return(a, c("asset_ret"), c("cash_ret"))
    return _with_drawdown(j.withColumn("_r", r), [*keys, "perm"], "_i")


def _with_drawdown(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The metrics of the returns ``_r`` of each group and ``max_dd``; a group is one log or one shuffle of it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("_g", F.product(1 + F.coalesce("_r", F.lit(0.0))).over(w))
    d = d.withColumn("_f", c("_g") / F.greatest(F.max("_g").over(w), F.lit(1.0)) - 1)
    return d.groupBy(*by).agg(*[v.alias(k) for k, v in summary(c("_r")).items()], F.min("_f").alias("max_dd"))


def unshuffled(decisions: DataFrame, panel: Panel, scale: float = 15.0) -> DataFrame:
    """The metrics of the decisions as they are, to hold ``permutations`` against."""
    a = allocation(c("pred"), c("k"), confidence(c("p_up"), scale))
    return _with_drawdown(decisions.withColumn("_r", period_return(a, c("asset_ret"), c("cash_ret"))), list(panel.keys), panel.ts)


def permuted_blocks(decisions: DataFrame, panel: Panel, n: int, path: str, block: int = 20_000, scale: float = 15.0) -> DataFrame:
    """``n`` shuffles in blocks of ``block``, each written to its own folder under ``path``; folders that are complete are not
    made again, so a run that ended early goes on where it stopped.  Returns all of them."""
    spark = decisions.sparkSession
    folders = []
    for first in range(0, n, block):
        folder = f"{path}/first={first}-n={min(block, n - first)}"
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            permutations(decisions, panel, min(block, n - first), scale, first).write.mode("overwrite").parquet(folder)
        folders.append(folder)
    return spark.read.parquet(*folders)


METRICS = ("cum", "sortino", "sharpe", "max_dd")


def permutation_summary(perms: DataFrame, baseline: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Distribution of each metric over the shuffles and the share strictly above the baseline.

    A Sortino ratio without a losing period is null here and stands for infinity: it is above any
    other, and nothing is above it."""
    base = baseline.select(*by, *[c(m).alias(f"_b_{m}") for m in metrics])
    j = perms.join(base, list(by))
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        aggs += [
            F.avg(m).alias(f"{m}_mean"), F.max(m).alias(f"{m}_max"),
            F.avg(F.coalesce(c(m) > c(f"_b_{m}"), c(m).isNull() & c(f"_b_{m}").isNotNull() & F.lit(m == "sortino")).cast("double")).alias(f"{m}_p_value"),
        ]
    # a million shuffles are too many values for one percentile() buffer
    long = perms.unpivot(list(by), list(metrics), "_metric", "_x")
    tails = exact_quantiles(long, [*by, "_metric"], "_x", [0.95, 0.99], "_q")
    tails = tails.groupBy(*by).agg(
        *[F.max(F.when(c("_metric") == m, F.get("_q", F.lit(i)))).alias(f"{m}_{p}") for m in metrics for i, p in enumerate(("p95", "p99"))]
    )
    return j.groupBy(*by).agg(*aggs).join(tails, list(by))


# -- null signals ------------------------------------------------------------------------------


def random_signal(decisions: DataFrame, by: Sequence[str], seeds: int, ident: Column) -> DataFrame:
    """pred ~ N(mean, std) of the real one and p_up ~ U(0,1), per seed, from hashes."""
    stats = decisions.groupBy(*by).agg(F.avg("pred").alias("_m"), F.stddev_pop("pred").alias("_s"))
    d = decisions.join(stats, list(by)).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    key = F.concat_ws(":", *[c(k) for k in by], ident)
    return d.withColumns({"pred": c("_m") + c("_s") * normal_hash(c("seed"), key), "p_up": unit_hash(c("seed"), key, F.lit("p"))}).drop("_m", "_s")


def probe(decisions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Degenerate signals as scenarios: sign only, constant +1 %, and no regime (K = 50)."""
    mean_abs = decisions.groupBy(*by).agg(F.avg(F.abs("pred")).alias("_ma"))
    d = decisions.join(mean_abs, list(by))
    kinds = F.array(*[F.lit(x) for x in ("actual", "sign_only", "constant", "no_regime")])
    d = d.withColumn("probe", F.explode(kinds))
    sign = F.signum("pred") * c("_ma")
    return d.withColumns(
        {
            "pred": F.when(c("probe") == "sign_only", sign).when(c("probe") == "constant", 0.01).otherwise(c("pred")),
            "p_up": F.when(c("probe") == "constant", 0.65).otherwise(c("p_up")),
            "k": F.when(c("probe") == "no_regime", 50.0).otherwise(c("k")),
        }
    ).drop("_ma")


def simulate(d: DataFrame, by: Sequence[str], scale: float | Column = 15.0) -> DataFrame:
    a = allocation(c("pred"), c("k"), confidence(c("p_up"), scale))
    r = period_return(a, c("asset_ret"), c("cash_ret"))
    return d.withColumn("_r", r).groupBy(*by).agg(F.avg(a).alias("mean_alloc"), *[v.alias(k) for k, v in summary(c("_r")).items()])


# -- Sharpe under non-normal returns and many trials -------------------------------------------


def expected_max_z(n_trials: int) -> float:
    if n_trials <= 1:
        return 0.0
    root = math.sqrt(2 * math.log(n_trials))
    return root - (0.5772156649 + math.log(math.log(n_trials))) / (2 * root)


def probabilistic_sharpe(df: DataFrame, by: Sequence[str], ret: str, benchmarks: Mapping[str, float], ppy: float = 52,
                         rf: float = 0.0021, published: bool = False) -> DataFrame:
    """Probability that the true Sharpe exceeds each (annual) benchmark.

    The reproduced form uses excess kurtosis with (k - 1)/4; ``published`` uses the one of the paper,
    (k_full - 1)/4 = (k + 2)/4.  .5 for fewer than three returns or no variation.
    """
    r = c(ret)
    row = df.groupBy(*by).agg(
        F.count(r).alias("n"), F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s"),
        F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"),
    )
    sr = F.when(c("_s") == 0, 0.0).otherwise(div(c("_m") - rf, "_s"))
    k = (c("kurt") + 2) / 4 if published else (c("kurt") - 1) / 4
    row = row.withColumn("sr", sr)
    den = F.sqrt((1 - c("skew") * c("sr") + k * c("sr") * c("sr")) / (c("n") - 1))
    row = row.withColumn("_den", den)
    z = {f"z_{n}": div(c("sr") - b / math.sqrt(ppy), F.nullif("_den", F.lit(0.0))) for n, b in benchmarks.items()}
    psr = {f"psr_{n}": F.when((c("n") < 3) | (c("_den") == 0), 0.5).otherwise(norm_cdf(c(f"z_{n}"))) for n in benchmarks}
    return row.withColumns(z).withColumns(psr).drop("_m", "_s", "_den")


def deflated_sharpe(df: DataFrame, by: Sequence[str], ret: str, trials: Sequence[int], trial_variance: float = 1.0) -> DataFrame:
    bench = {f"n{n}": expected_max_z(n) * math.sqrt(trial_variance) for n in trials}
    return probabilistic_sharpe(df, by, ret, bench)


# -- combinatorially symmetric cross-validation -------------------------------------------------


def backtest_overfitting(df: DataFrame, by: Sequence[str], variant: str, order: str, ret: str, splits: int = 16,
                         ppy: float = 52, rf: float = 0.0021) -> DataFrame:
    """Probability that the best variant in one half ranks below the median in the other half.

    Rows are reduced to (n, sum, sum of squares) per split and variant first.  All C(splits,
    splits/2) halves are bit masks over those; the work per mask is splits x variants, whatever the
    length of the series.
    """
    by = list(by)
    # periods are numbered once per group from the distinct times, then put in equal splits
    times = df.select(*by, order).distinct()
    wt = Window.partitionBy(*by).orderBy(order)
    times = times.withColumn("_t", F.row_number().over(wt) - 1)
    size = times.groupBy(*by).agg(F.floor(F.count(F.lit(1)) / splits).alias("_size"), F.count(F.lit(1)).alias("_len"))
    times = times.join(size.filter(c("_len") >= 2 * splits), by)
    times = times.withColumn("_split", F.floor(c("_t") / c("_size")).cast("int")).filter(c("_split") < splits).drop("_t", "_size", "_len")
    r = c(ret)
    stats = df.join(times, [*by, order]).groupBy(*by, variant, "_split").agg(
        F.count(r).alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("ss")
    )
    per = stats.groupBy(*by, variant).agg(F.array_sort(F.collect_list(F.struct("_split", "n", "s", "ss"))).alias("_p"))
    masks = F.filter(F.sequence(F.lit(0), F.lit(2**splits - 1)), lambda m: F.bit_count(m) == splits // 2)
    per = per.withColumn("mask", F.explode(masks))

    def sharpe(inside: bool) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"))
        pick = lambda p: (F.call_function("shiftright", c("mask"), p["_split"]).bitwiseAND(F.lit(1)) == (1 if inside else 0))
        tot = F.aggregate(
            "_p", zero,
            lambda a, p: F.struct(
                (a["n"] + F.when(pick(p), p["n"]).otherwise(0)).alias("n"),
                (a["s"] + F.when(pick(p), p["s"]).otherwise(0.0)).alias("s"),
                (a["ss"] + F.when(pick(p), p["ss"]).otherwise(0.0)).alias("ss"),
            ),
            lambda a: F.struct((a["s"] / a["n"]).alias("m"), F.sqrt(F.greatest(a["ss"] / a["n"] - a["s"] * a["s"] / a["n"] / a["n"], F.lit(0.0))).alias("sd")),
        )
        return F.transform(F.array(tot), lambda x: F.when(x["sd"] == 0, 0.0).otherwise(F.try_divide(x["m"] - rf, x["sd"]) * math.sqrt(ppy)))[0]

    halves = per.select(*by, variant, "mask", sharpe(True).alias("_in"), sharpe(False).alias("_out"))
    w = Window.partitionBy(*by, "mask")
    ranked = halves.withColumn("_best", F.max_by("_out", F.struct(c("_in"), c(variant))).over(w))
    rank = ranked.groupBy(*by, "mask").agg(F.avg((c("_out") < c("_best")).cast("double")).alias("_rank"), F.count(F.lit(1)).alias("_k"))
    rank = rank.filter(c("_k") >= 2)
    return rank.groupBy(*by).agg(F.count(F.lit(1)).alias("n_halves"), F.avg((c("_rank") < 0.5).cast("double")).alias("pbo"))


# -- paired comparisons ------------------------------------------------------------------------


def paired_delta(df: DataFrame, by: Sequence[str], seed: str, variant: str, a: str, b: str, metric: str) -> DataFrame:
    """a minus b per seed: mean, deviation, t statistic, win rate.  A conditional aggregation pairs the
    two without a join."""
    pair = df.filter(c(variant).isin(a, b)).groupBy(*by, seed).agg(
        F.max(F.when(c(variant) == a, c(metric))).alias("_a"), F.max(F.when(c(variant) == b, c(metric))).alias("_b")
    ).filter(c("_a").isNotNull() & c("_b").isNotNull())
    d = c("_a") - c("_b")
    sd = F.coalesce(F.stddev_samp(d), F.lit(0.0))
    return pair.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), sd.alias("std_delta"),
        div(F.avg(d), F.nullif(sd, F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("t_stat"),
        F.avg((d > 0).cast("double")).alias("win_rate"),
    )


def against_baseline(df: DataFrame, by: Sequence[str], seed: str, variant: str, baseline: str, metric: str) -> DataFrame:
    """Every variant against one: mean over seeds of the difference, wins and n."""
    base = df.filter(c(variant) == baseline).select(*by, seed, c(metric).alias("_b"))
    j = df.filter(c(variant) != baseline).join(base, [*by, seed])
    d = c(metric) - c("_b")
    return j.groupBy(*by, variant).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), F.count_if(d > 0).alias("wins"))


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided, for aggregated rows."""
    from tidemark.functions.special import t_two_sided

    return pd.Series(t_two_sided(t.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def binomial_ci(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Exact 95 % interval of a hit rate, for aggregated rows."""
    from tidemark.functions.special import binomial_interval

    lo, hi = binomial_interval(k.to_numpy(float), n.to_numpy(float))
    return pd.DataFrame({"low": lo, "high": hi})


def proportion_shift(df: DataFrame, by: Sequence[str], hit: Column, current: Column) -> DataFrame:
    """Hit rate of the current rows against the history: z and two-sided p."""
    k = lambda cond: F.count_if(cond & hit)
    row = df.groupBy(*by).agg(
        F.count_if(current).alias("n_cur"), k(current).alias("k_cur"), F.count_if(~current).alias("n_hist"), k(~current).alias("k_hist")
    )
    pc, ph = div("k_cur", "n_cur"), div("k_hist", "n_hist")
    z = div(pc - ph, F.nullif(F.sqrt(div(ph * (1 - ph), "n_cur")), F.lit(0.0)))
    row = row.withColumn("z", z).withColumn("_az", F.abs("z"))
    return row.withColumn("p_value", 2 * (1 - norm_cdf(c("_az")))).drop("_az")


def verdict(df: DataFrame, by: Sequence[str], config: str, metric: str) -> DataFrame:
    """Spread of a metric over a sweep and the configuration that reaches the maximum."""
    m = c(metric)
    return df.groupBy(*by).agg(
        F.max(m).alias("best"), F.max_by(config, F.struct(m, c(config))).alias("best_config"),
        F.min(m).alias("worst"), F.avg(m).alias("mean"), (F.max(m) - F.min(m)).alias("range"),
    )


def attribution(df: DataFrame, by: Sequence[str], policy: str, metric: str, terms: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Differences of a metric between policies, one column per named (plus, minus) pair."""
    val = lambda p: F.max(F.when(c(policy) == p, c(metric)))
    return df.groupBy(*by).agg(*[(val(a) - val(b)).alias(n) for n, (a, b) in terms.items()])


def reproduction_gap(a: DataFrame, b: DataFrame, on: Sequence[str], cols: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Largest absolute difference per column between a recomputed and a stored table."""
    j = a.select(*on, *[c(x).alias(f"_a_{x}") for x in cols]).join(b.select(*on, *[c(x).alias(f"_b_{x}") for x in cols]), list(on), "full")
    gaps = [F.max(F.abs(c(f"_a_{x}") - c(f"_b_{x}"))).alias(f"gap_{x}") for x in cols]
    lone = F.count_if(c(f"_a_{cols[0]}").isNull() != c(f"_b_{cols[0]}").isNull()).alias("unmatched")
    row = j.agg(lone, *gaps)
    ok = c("unmatched") == 0
    for x in cols:
        ok = ok & (F.coalesce(f"gap_{x}", F.lit(0.0)) <= tolerance)
    return row.withColumn("passed", ok)
