"""Expanding medians and sliding ranks against pandas, over gaps, ties and chunk borders."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators.order_stats import expanding_median
from tidemark.panel import Panel


def series(n=260):
    r = np.random.default_rng(4)
    made = {"a": r.normal(0, 1, n), "ties": r.integers(0, 4, n).astype(float), "none": np.full(n, np.nan), "one": np.full(n, 7.0)}
    made["a"][r.random(n) < 0.3] = np.nan
    made["ties"][:20] = np.nan
    days = pd.date_range("1969-11-05", periods=n, freq="D").date
    return made, pd.concat([pd.DataFrame({"series_id": k, "ts": days, "x": v}) for k, v in made.items()])


@pytest.mark.parametrize("chunk_rows", [16, 4096])
def test_expanding_median(spark, chunk_rows):
    made, pdf = series()
    df = spark.createDataFrame(pdf).withColumn("x", F.when((F.col("series_id") == "ties") | ~F.isnan("x"), F.col("x")))
    got = expanding_median(df, Panel(chunk_rows=chunk_rows), "x", "med").toPandas().sort_values(["series_id", "ts"])
    assert len(got) == len(pdf)
    for k, v in made.items():
        np.testing.assert_array_equal(got[got.series_id == k].med.astype(float), pd.Series(v).expanding().median(), err_msg=k)
    assert expanding_median(df.limit(0), Panel(), "x", "med").count() == 0


def test_sliding_rank_and_tail(spark):
    made, pdf = series()
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    p = Panel(chunk_rows=64)
    f, w = p.halo(df, 40), p.window()
    got = p.owned(f.withColumns({"rank": R.percent_rank("x", w, 40, 15), "tail": R.tail_mean("x", 0.2, w, 40, 15)})).toPandas().sort_values(["series_id", "ts"])
    for k, v in made.items():
        g = got[got.series_id == k]
        for i in range(len(v)):
            frame = v[max(0, i - 39) : i + 1]
            frame = frame[~np.isnan(frame)]
            if len(frame) < 15:
                assert np.isnan(float(g["rank"].iloc[i] or np.nan)) and np.isnan(float(g["tail"].iloc[i] if g["tail"].iloc[i] is not None else np.nan))
                continue
            assert g["rank"].iloc[i] == pytest.approx(pd.Series(frame).rank(pct=True).iloc[-1], rel=1e-12)
            assert g["tail"].iloc[i] == pytest.approx(frame[frame <= np.quantile(frame, 0.2)].mean(), rel=1e-12, abs=1e-15)
