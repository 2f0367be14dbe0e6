"""Correlations of all pairs of columns in one scan.

Every task reads its rows once and keeps, for each pair of columns, the number of rows where both are known, their
means over these rows and the centred moments.  The moments of a batch are a few products of matrices (known cells times
values), batches are merged by Chan's formula, and a task ends in one row per pair; Spark merges the tasks' rows by
the same formula in two small aggregations.  Centring before every product keeps the digits of columns whose level is
far larger than their spread.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.stage import stage

c = F.col
_SCHEMA = "a int, b int, n double, ma double, mb double, saa double, sbb double, sab double"


def _merge(x, y):
    """Moments of two sets of rows together (Chan, Golub and LeVeque)."""
    n = x[0] + y[0]
    w = np.divide(y[0], n, out=np.zeros_like(n), where=n > 0)
    da, db = y[1] - x[1], y[2] - x[2]
    k = x[0] * w
    return n, x[1] + w * da, x[2] + w * db, x[3] + y[3] + k * da * da, x[4] + y[4] + k * db * db, x[5] + y[5] + k * da * db


def _moments(v: np.ndarray):
    """n, means, centred moments of every pair of columns over the rows where both are known."""
    known = ~np.isnan(v)
    m = known.astype(float)
    level = np.divide(np.where(known, v, 0).sum(axis=0), m.sum(axis=0), out=np.zeros(v.shape[1]), where=m.sum(axis=0) > 0)
    x = np.where(known, v - level, 0.0)
    n = m.T @ m
    safe = np.maximum(n, 1)
    sa = x.T @ m  # of the row's column, where the other is known
    ma, mb = sa / safe, sa.T / safe
    saa = (x * x).T @ m - n * ma * ma
    sab = x.T @ x - n * ma * mb
    some = n > 0
    return n, np.where(some, ma + level[:, None], 0), np.where(some, mb + level[None, :], 0), np.maximum(saa, 0), np.maximum(saa.T, 0), sab


def gram(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``a``, ``b`` (names, in the order of ``cols``), ``n`` (rows where both are known) and ``corr`` (null where either side does not
    vary) of every pair."""
    cols = list(cols)
    pairs = np.triu_indices(len(cols), 1)

    def run(batches):
        total = None
        for batch in batches:
            v = np.column_stack([np.asarray(x.fill_null(float("nan")), float) for x in batch.columns]) if batch.num_rows else np.zeros((0, len(cols)))
            if len(v):
                one = _moments(v)
                total = one if total is None else _merge(total, one)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)) for p in pairs] + [pa.array(x[pairs]) for x in total], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    part = stage(df.select(*[c(x).cast("double").alias(x) for x in cols]).mapInArrow(run, _SCHEMA), "moments").where("n > 0")
    mean = part.groupBy("a", "b").agg(F.sum("n").alias("_n"), (F.sum(c("n") * c("ma")) / F.sum("n")).alias("_ma"), (F.sum(c("n") * c("mb")) / F.sum("n")).alias("_mb"))
    j = part.join(mean, ["a", "b"])
    da, db = c("ma") - c("_ma"), c("mb") - c("_mb")
    out = j.groupBy("a", "b").agg(
        F.first("_n").cast("long").alias("n"), F.sum(c("saa") + c("n") * da * da).alias("_saa"), F.sum(c("sbb") + c("n") * db * db).alias("_sbb"), F.sum(c("sab") + c("n") * da * db).alias("_sab")
    )
    names = F.array(*[F.lit(x) for x in cols])
    return out.select(F.get(names, c("a")).alias("a"), F.get(names, c("b")).alias("b"), "n", F.try_divide(c("_sab"), F.sqrt(c("_saa") * c("_sbb"))).alias("corr"))
