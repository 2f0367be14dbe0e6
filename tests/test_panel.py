"""Chunking must never show in a result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import joins, regimes
from tidemark.panel import DAILY, Panel, Running, numbered

rng = np.random.default_rng(5)
DAYS = pd.date_range("1999-11-20", periods=300, freq="D")


def walk(n_series=3, gap=0.2):
    rows = []
    for s in range(n_series):
        keep = rng.random(len(DAYS)) > gap
        keep[0] = keep[-1] = True
        price = 100 * np.cumprod(1 + rng.normal(0, 0.02, len(DAYS)))
        rows.append(pd.DataFrame({"series_id": f"s{s}", "ts": DAYS.date, "x": price})[keep])
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark):
    pdf = walk()
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


PANELS = [Panel(chunk_rows=7), Panel(chunk_rows=64), DAILY]


def by_series(df, cols):
    return df.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)[cols]


@pytest.mark.parametrize("panel", PANELS)
@pytest.mark.parametrize("levels", [1, 2])
def test_running(frame, panel, levels):
    pdf, df = frame
    x = F.when(F.col("x") > 100, F.col("x"))
    specs = {
        "last": Running(x, "last"), "sum": Running(x, "sum"), "max": Running(x, "max"), "min": Running(x, "min"),
        "cnt": Running(x, "count"), "prod": Running(1 + F.col("x") / 1e4, "product"), "prev": Running(x, "prev"),
    }
    got = by_series(panel.running(df, specs, levels=levels), list(specs))
    p = pdf.sort_values(["series_id", "ts"]).reset_index(drop=True)
    v = p["x"].where(p["x"] > 100)
    g = v.groupby(p["series_id"])
    want = pd.DataFrame(
        {
            "last": g.ffill(), "sum": v.fillna(0).groupby(p["series_id"]).cumsum().where(g.ffill().notna()),
            "max": g.cummax().groupby(p["series_id"]).ffill(), "min": g.cummin().groupby(p["series_id"]).ffill(),
            "cnt": v.notna().astype(int).groupby(p["series_id"]).cumsum(),
            "prod": (1 + p["x"] / 1e4).groupby(p["series_id"]).cumprod(), "prev": g.shift(1),
        }
    )
    for col in want:
        np.testing.assert_allclose(got[col].astype(float), want[col].astype(float), rtol=1e-10, err_msg=col)


@pytest.mark.parametrize("panel", PANELS)
def test_running_backwards(frame, panel):
    pdf, df = frame
    got = by_series(panel.running(df, {"nxt": Running(F.col("x"), "prev")}, reverse=True), ["nxt"])
    want = pdf.sort_values(["series_id", "ts"]).groupby("series_id")["x"].shift(-1).reset_index(drop=True)
    np.testing.assert_allclose(got["nxt"].astype(float), want)


@pytest.mark.parametrize("panel", PANELS)
def test_fill_grid_with_long_gaps(spark, panel):
    rows = [("a", "2000-01-01", 1.0, 5), ("a", "2000-03-20", None, 6), ("a", "2000-03-25", 3.0, 7), ("b", "2000-02-02", 9.0, 1)]
    df = spark.createDataFrame(rows, "series_id string, ts string, x double, n int").withColumn("ts", F.to_date("ts"))
    got = panel.fill_grid(df, carry=["x"], zero=["n"]).toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)
    days = pd.date_range("2000-01-01", "2000-03-25")
    a = got[got.series_id == "a"].reset_index(drop=True)
    assert list(pd.to_datetime(a["ts"])) == list(days)
    assert a["x"].tolist() == [1.0] * (len(days) - 1) + [3.0]
    assert a["n"].sum() == 18 and (a["n"] == 0).sum() == len(days) - 3
    assert str(a["series_start"].iloc[-1]) == "2000-01-01"
    assert len(got[got.series_id == "b"]) == 1


@pytest.mark.parametrize("panel", PANELS)
def test_windows_see_full_frames_across_chunks(frame, panel):
    _, df = frame
    grid = panel.fill_grid(df, carry=["x"])
    f = panel.halo(grid, 30, 3)
    w = panel.window()
    out = panel.owned(f.withColumns({"m": R.mean("x", w, 30, 5), "nxt": F.lead("x", 3).over(w), "q": R.quantile("x", 0.1, w, 20)}))
    got = by_series(out, ["series_id", "x", "m", "nxt", "q"])
    g = got.groupby("series_id")["x"]
    np.testing.assert_allclose(got["m"], g.transform(lambda s: s.rolling(30, min_periods=5).mean()), rtol=1e-10)
    np.testing.assert_allclose(got["nxt"], g.shift(-3))
    np.testing.assert_allclose(got["q"], g.transform(lambda s: s.rolling(20).quantile(0.1)), rtol=1e-10)


@pytest.mark.parametrize("panel", PANELS)
@pytest.mark.parametrize("strict", [False, True])
def test_asof_matches_merge_asof(spark, frame, panel, strict):
    pdf, df = frame
    right = walk(3, gap=0.9).rename(columns={"x": "v"})
    got = by_series(joins.asof(df, spark.createDataFrame(right), panel, ["v"], strict=strict), ["series_id", "ts", "v"])
    l = pdf.assign(ts=pd.to_datetime(pdf["ts"])).sort_values("ts")
    r = right.assign(ts=pd.to_datetime(right["ts"])).sort_values("ts")
    want = pd.merge_asof(l, r, on="ts", by="series_id", allow_exact_matches=not strict).sort_values(["series_id", "ts"])
    np.testing.assert_allclose(got["v"].astype(float), want["v"])


@pytest.mark.parametrize("panel", PANELS)
def test_run_lengths_over_chunks(frame, panel):
    _, df = frame
    s = df.withColumn("state", F.when(F.col("x") > 100, "hi").otherwise("lo"))
    got = by_series(regimes.run_length(s, panel, "state"), ["series_id", "state", "run_length"])
    for _, g in got.groupby("series_id"):
        grp = (g["state"] != g["state"].shift()).cumsum()
        assert g["run_length"].tolist() == (g.groupby(grp).cumcount() + 1).tolist()


def test_rows_numbered_for_irregular_windows(frame):
    _, df = frame
    d, rows = numbered(df, Panel(chunk_rows=9))
    f = rows.halo(d, 5)
    out = by_series(rows.owned(f.withColumn("m", F.avg("x").over(rows.window().rowsBetween(-4, 0)))), ["series_id", "x", "m"])
    want = out.groupby("series_id")["x"].transform(lambda s: s.rolling(5, min_periods=1).mean())
    np.testing.assert_allclose(out["m"], want)


def test_expanding_deviation_far_from_zero(spark):
    """A level a billion times the spread: sums of squares around the first value keep their digits."""
    x = 1e9 + np.random.default_rng(4).normal(0, 1, 300)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "ts": DAYS.date, "x": x}))
    for size in (40, 4096):
        p = Panel(chunk_rows=size)
        y = F.col("x") - F.col("_o_x")
        got = p.running(p.with_origin(df, ["x"]), {"_n": Running(F.col("x"), "count"), "_s": Running(y, "sum"), "_ss": Running(y * y, "sum")})
        sd = F.sqrt((F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1))
        got = got.where("_n > 1").orderBy("ts").select(sd.alias("sd")).toPandas().sd
        np.testing.assert_allclose(got, pd.Series(x).expanding().std()[1:], rtol=1e-6)
