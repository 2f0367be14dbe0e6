"""Walk-forward training sets, bagged MLlib models, scoring and calibration."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import unit_hash
from tidemark.operators.joins import asof_global
from tidemark.operators.quantiles import exact_quantiles
from tidemark.panel import Panel, Running
from tidemark.stage import stage

c = F.col

# fixed values: months a model may be retrained in
RETRAIN_MONTHS = {"annual": (1,), "semi": (1, 7), "quarterly": (1, 4, 7, 10), "monthly": tuple(range(1, 13))}


def retrain_calendar(spark: SparkSession, start: str, end: str, freq: str = "semi") -> DataFrame:
    """First days of the retrain months in [start, end]."""
    first = F.trunc(F.lit(start).cast("date"), "month")
    days = F.sequence(first, F.lit(end).cast("date"), F.expr("INTERVAL 1 MONTH"))
    df = spark.range(1).select(F.explode(days).alias("cutoff_ts"))
    return df.filter(F.month("cutoff_ts").isin(list(RETRAIN_MONTHS[freq])) & (c("cutoff_ts") >= F.lit(start).cast("date")))


def _candidates(ts: Column, freq: str) -> Column:
    return F.array(*[F.make_date(F.year(ts) + F.lit(dy), F.lit(m), F.lit(1)) for dy in (-1, 0, 1) for m in RETRAIN_MONTHS[freq]])


def next_retrain(ts: Column, freq: str = "semi") -> Column:
    """Strictly after the day."""
    return F.array_min(F.filter(_candidates(ts, freq), lambda d: d > ts))


def last_retrain(ts: Column, freq: str = "semi") -> Column:
    """On or before the day."""
    return F.array_max(F.filter(_candidates(ts, freq), lambda d: d <= ts))


def period_table(df: DataFrame, panel: Panel, freq: str = "semi", skip: int = 60) -> DataFrame:
    """First and last row of each test period per series and the last training row before it; only
    periods with more than ``skip`` rows before them."""
    n = {"annual": 12, "semi": 6, "quarterly": 3, "monthly": 1}[freq]
    d = panel.running(df.select(*panel.keys, panel.ts), {"_i": Running(F.lit(1), "count")})
    part = F.floor((F.month(panel.ts) - 1) / n).cast("int") + 1
    per = d.groupBy(*panel.keys, F.year(panel.ts).alias("year"), part.alias("part")).agg(
        F.min(panel.ts).alias("test_start"), F.max(panel.ts).alias("test_end"), F.min("_i").alias("_first")
    )
    return per.filter(c("_first") - 2 >= skip).select(*panel.keys, "year", "part", (c("_first") - 1).alias("n_train"), "test_start", "test_end")


def training_rows(df: DataFrame, panel: Panel, cutoffs: Sequence[str], horizon: int = 3, skip: int = 60, window_days: int | None = None) -> DataFrame:
    """Rows usable for training at each cutoff.

    A row belongs to a cutoff when it lies before it (and, with ``window_days``, inside the window).
    The first ``skip`` rows are warm-up (a quarter of a short window), and the last max(horizon, 5)
    before the cutoff are dropped, because their labels end after it.  The cutoffs are a short
    literal list, so a row is copied per cutoff without a join.
    """
    gap = max(horizon, 5)
    d = panel.running(df, {"_i": Running(F.lit(1), "count")})
    marks = F.array(*[F.lit(x).cast("date") for x in cutoffs])
    fits = lambda x: (x > c(panel.ts)) & (F.lit(True) if window_days is None else (F.date_sub(x, window_days) <= c(panel.ts)))
    d = d.withColumn("cutoff_ts", F.explode(F.filter(marks, fits)))
    size = d.groupBy(*panel.keys, "cutoff_ts").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_i0"))
    d = d.join(size, [*panel.keys, "cutoff_ts"])
    at = c("_i") - c("_i0")
    start = F.lit(skip) if window_days is None else F.least(F.lit(skip), F.floor(c("_n") / 4))
    return d.filter((at >= start) & (at <= c("_n") - gap)).drop("_i", "_i0", "_n")


def _poisson1() -> list[float]:
    """Cumulative Poisson(1) probabilities P(X <= 0), P(X <= 1), ... as far as a double tells them from 1."""
    out, term, k = [], math.exp(-1), 0
    while not out or math.fsum([out[-1], term]) > out[-1]:
        out.append(math.fsum([out[-1], term]) if out else term)
        k += 1
        term /= k
    return out


_POISSON1 = _poisson1()


def bootstrap_weight(seed: int, bag: Column, *row_key: Column) -> Column:
    """How often a row is drawn into a bag: Poisson(1) from a hash of (seed + 7 bag, row), the limit of
    drawing n of n with replacement, and the same under every partitioning."""
    u = unit_hash(F.lit(seed) + 7 * bag, *row_key)
    return F.size(F.filter(F.array(*[F.lit(p) for p in _POISSON1]), lambda p: u > p))


def fingerprint(config: Mapping) -> str:
    """12 hex characters that change with any training setting."""
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


# -- models ------------------------------------------------------------------------------------


def _learner(kind: str, label: str, weight: str | None, seed: int, size: int, depth: int):
    common = {"featuresCol": "_x", "labelCol": label, "seed": seed, "maxDepth": depth}
    if weight:
        common["weightCol"] = weight
    make = {
        "gbt_reg": lambda: GBTRegressor(maxIter=size, subsamplingRate=0.8, stepSize=0.05, **common),
        "gbt_cls": lambda: GBTClassifier(maxIter=size, subsamplingRate=0.8, stepSize=0.05, **common),
        "rf_reg": lambda: RandomForestRegressor(numTrees=size, **common),
        "rf_cls": lambda: RandomForestClassifier(numTrees=size, **common),
    }
    return make[kind]()


def fit_bags(train: DataFrame, features: Sequence[str], label: str, row_key: Sequence[str], bags: int, seed: int = 242,
             kind: str = "rf_reg", resample: bool = True, size: int = 20, depth: int = 4) -> list[PipelineModel]:
    """Bagged models: bag i uses seed + 7 i.  Regressors may be only reseeded (``resample=False``).

    Each fit is one distributed MLlib job over the same prepared input.
    """
    base = train.na.fill(0.0, list(features)).filter(c(label).isNotNull())
    out = []
    for i in range(bags):
        part, weight = base, None
        if resample:
            weight = "_w"
            part = base.withColumn(weight, bootstrap_weight(seed, F.lit(i), *[c(k) for k in row_key]).cast("double")).filter(c(weight) > 0)
        steps = [VectorAssembler(inputCols=list(features), outputCol="_x"), _learner(kind, label, weight, seed + 7 * i, size, depth)]
        out.append(Pipeline(stages=steps).fit(part))
    return out


def predict_mean(models: Sequence[PipelineModel], df: DataFrame, features: Sequence[str], out: str, probability: bool = False) -> DataFrame:
    """Mean of the bags' predictions (or of their class-1 probabilities)."""
    cols = df.columns
    cur = df.withColumns({f"_o_{f}": c(f) for f in features}).na.fill(0.0, list(features))
    total = F.lit(0.0)
    for i, m in enumerate(models):
        cur = m.transform(cur)
        val = vector_to_array("probability")[1] if probability else c("prediction")
        cur = cur.withColumn(f"_p{i}", val).drop("_x", "prediction", "probability", "rawPrediction")
        total = total + c(f"_p{i}")
    keep = [c(f"_o_{x}").alias(x) if x in features else c(x) for x in cols]
    return cur.select(*keep, (total / len(models)).alias(out))


def walk_forward(df: DataFrame, panel: Panel, features: Sequence[str], cutoffs: Sequence[str], label_reg: str, label_cls: str,
                 horizon: int = 3, bags: int = 2, seed: int = 242, kind: str = "rf", window_days: int | None = None,
                 frozen: bool = False, size: int = 20, depth: int = 4, store=None) -> DataFrame:
    """Predictions of every row by the newest model whose cutoff is on or before it.

    Training rows of a cutoff end before it by the purge gap, so no label reaches into the rows it
    predicts.  ``frozen`` keeps the first model for all later rows.  With a ``store`` (``ModelStore``) models of the same
    cutoff and settings are loaded instead of fitted.
    """
    cuts = list(cutoffs)[:1] if frozen else list(cutoffs)
    key = [*panel.keys, panel.ts]

    @cache
    def slices() -> DataFrame:
        # every fit passes over its rows several times
        return stage(training_rows(df, panel, cuts, horizon, window_days=window_days), "slices")

    def models(cut: str, task: str, label: str, **fit) -> list[PipelineModel]:
        make = lambda: fit_bags(slices().filter(c("cutoff_ts") == F.lit(cut).cast("date")), features, label, key, bags, seed, f"{kind}_{task}", size=size, depth=depth, **fit)
        if store is None:
            return make()
        settings = {"features": list(features), "label": label, "bags": bags, "seed": seed, "kind": f"{kind}_{task}", "size": size, "depth": depth, "horizon": horizon, "window_days": window_days}
        return store.models(df.sparkSession, cut, settings, bags, make)

    out = None
    for i, cut in enumerate(cuts):
        reg = models(cut, "reg", label_reg, resample=False)
        cls = models(cut, "cls", label_cls)
        test = df.filter(c(panel.ts) >= F.lit(cut).cast("date"))
        if i + 1 < len(cuts):
            test = test.filter(c(panel.ts) < F.lit(cuts[i + 1]).cast("date"))
        part = predict_mean(cls, predict_mean(reg, test, features, "pred"), features, "p_up", probability=True)
        part = part.withColumns({"cutoff_ts": F.lit(cut).cast("date"), "seed": F.lit(seed)})
        out = part if out is None else out.unionByName(part)
    return out


def models_as_of(decisions: DataFrame, models: DataFrame, ts: str = "ts") -> DataFrame:
    return asof_global(decisions, models, ts, "cutoff_ts", ["cutoff_ts"])


def residual_quantiles(models: Sequence[PipelineModel], train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                       qs: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Quantile forecasts as the point forecast plus the training residuals' quantiles."""
    fit = predict_mean(models, train.filter(c(label).isNotNull()), features, "pred")
    fit = fit.select((c(label) - c("pred")).alias("res"))
    cut = exact_quantiles(fit, [], "res", list(qs), "_r")
    out = predict_mean(models, test, features, "pred").withColumn("_r", cut.scalar())
    return out.withColumns({f"q{int(q * 100):02d}": c("pred") + F.get("_r", F.lit(i)) for i, q in enumerate(qs)}).drop("_r")


def leaves(models: Sequence[PipelineModel], df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``_leaves``: the leaf of each row in each tree of all bags."""
    cols = df.columns
    cur = df.withColumns({f"_o_{f}": c(f) for f in features}).na.fill(0.0, list(features))
    parts = []
    for i, m in enumerate(models):
        forest = m.stages[-1].copy()
        forest.setLeafCol(f"_l{i}")
        cur = PipelineModel([*m.stages[:-1], forest]).transform(cur).drop("_x", "prediction")
        parts.append(F.transform(vector_to_array(f"_l{i}"), lambda x: x.cast("int")))
    keep = [c(f"_o_{x}").alias(x) if x in features else c(x) for x in cols]
    return cur.select(*keep, F.concat(*parts).alias("_leaves"))


def leaf_table(train_leaves: DataFrame, label: str, qs: Sequence[float]) -> DataFrame:
    """``tree``, ``leaf``, ``q``: quantiles of the training labels in each leaf, exact."""
    rows = train_leaves.where(c(label).isNotNull()).select(label, F.posexplode("_leaves").alias("tree", "leaf"))
    return exact_quantiles(rows, ["tree", "leaf"], label, list(qs), "q")


def leaf_quantiles(models: Sequence[PipelineModel], train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                   qs: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Quantile forecasts that vary by row: the quantiles of the training labels in the row's leaf, averaged over the trees.

    The table of leaves has trees x leaves rows, which the settings of the forest bound whatever the data; it is looked up as
    one array of arrays, so neither training nor test rows are multiplied by the trees after it is made.
    """
    table = stage(leaf_table(leaves(models, train.filter(c(label).isNotNull()), features), label, qs), "leaves")
    own = F.map_from_entries(F.collect_list(F.struct("leaf", "q")))
    trees = table.groupBy("tree").agg(own.alias("_m"), F.max("leaf").alias("_top"))
    trees = trees.select("tree", F.transform(F.sequence(F.lit(0), c("_top")), lambda i: F.try_element_at("_m", i)).alias("_q"))
    dense = trees.agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "_q"))), lambda x: x["_q"]).alias("_t"))
    out = leaves(models, test, features).withColumn("_t", dense.scalar())
    hit = F.filter(F.transform("_leaves", lambda leaf, tree: F.get(F.get("_t", tree), leaf)), lambda q: q.isNotNull())
    out = predict_mean(models, out.withColumn("_q", hit), features, "pred")
    mean = lambda i: F.aggregate("_q", F.lit(0.0), lambda s, q: s + F.get(q, F.lit(i))) / F.nullif(F.size("_q"), F.lit(0))
    return out.withColumns({f"q{round(q * 100):02d}": mean(i) for i, q in enumerate(qs)}).drop("_leaves", "_t", "_q")


def fit_robust(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Linear model under Huber loss."""
    base = train.na.fill(0.0, list(features)).filter(c(label).isNotNull())
    lr = LinearRegression(featuresCol="_x", labelCol=label, loss="huber", maxIter=30, regParam=0.01)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), lr]).fit(base)


def ablation(train: DataFrame, test: DataFrame, sets: Mapping[str, Sequence[str]], label: str, row_key: Sequence[str], **fit) -> DataFrame:
    """Error and direction accuracy of models on named feature sets."""
    out = None
    for name, features in sets.items():
        models = fit_bags(train, features, label, row_key, **fit)
        p = predict_mean(models, test.filter(c(label).isNotNull()), features, "pred")
        row = p.agg(
            F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(c("pred") - c(label), 2))).alias("rmse"),
            F.avg(((c("pred") > 0) == (c(label) > 0)).cast("double")).alias("hit_rate"),
        ).select(F.lit(name).alias("features"), F.lit(len(features)).alias("n_features"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def importance(spark: SparkSession, models: Sequence[PipelineModel], features: Sequence[str]) -> DataFrame:
    """Mean impurity importance over the bags, ranked."""
    mean = np.mean([m.stages[-1].featureImportances.toArray() for m in models], axis=0)
    order = np.argsort(-mean, kind="stable")
    rows = [(features[i], float(mean[i]), r + 1) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")


# -- calibration -------------------------------------------------------------------------------


def _pava(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of y with weights w."""
    vals: list[float] = []
    wts: list[float] = []
    size: list[int] = []
    for v, k in zip(y, w):
        vals.append(v), wts.append(k), size.append(1)
        while len(vals) > 1 and vals[-2] >= vals[-1]:
            total = wts[-2] + wts[-1]
            vals[-2] = (vals[-2] * wts[-2] + vals[-1] * wts[-1]) / total
            wts[-2], size[-2] = total, size[-2] + size[-1]
            vals.pop(), wts.pop(), size.pop()
    return np.repeat(vals, size)


def calibrate_row(past_p: np.ndarray, past_y: np.ndarray, p: float) -> float:
    x, back = np.unique(past_p, return_inverse=True)
    w = np.bincount(back).astype(float)
    y = np.bincount(back, weights=past_y) / w
    return float(np.interp(p, x, np.clip(_pava(y, w), 0, 1)))


def recalibrated(df: DataFrame, panel: Panel, p: str = "p_up", fwd: str = "asset_ret", least: int = 52, lag: int = 2, out: str = "p_cal") -> DataFrame:
    """Isotonic recalibration that grows with the log: decision i is fitted on outcomes up to i - lag,
    and passes through unchanged while fewer than ``least`` are known.  Sequential per series."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])
    names = [f.name for f in schema.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(panel.ts, kind="stable")
        x = pdf[p].to_numpy(float)
        r = pdf[fwd].to_numpy(dtype=float, na_value=np.nan)
        res = x.copy()
        for i in range(len(x)):
            stop = max(0, i - lag + 1)
            known = ~np.isnan(r[:stop])
            if known.sum() >= least:
                res[i] = calibrate_row(x[:stop][known], (r[:stop][known] > 0).astype(float), x[i])
        return pdf.assign(**{out: res})[names]

    return df.groupBy(*panel.keys).applyInPandas(run, schema)
