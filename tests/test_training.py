"""Training slices, bags and calibration."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import robustness as rob
from tidemark.operators import training as tr
from tidemark.panel import DAILY, Panel

c = F.col
rng = np.random.default_rng(4)


@pytest.fixture(scope="module")
def rows(spark):
    n = 400
    pdf = pd.DataFrame({"series_id": "s", "ts": pd.date_range("2020-01-01", periods=n).date})
    for k in range(4):
        pdf[f"x{k}"] = rng.normal(size=n)
    pdf["y"] = 0.5 * pdf.x0 - 0.3 * pdf.x1 + 0.1 * rng.normal(size=n)
    pdf["up"] = (pdf.y > 0).astype(float)
    return spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("horizon", [3, 5, 8])
def test_purge(rows, horizon):
    cut = dt.date(2020, 11, 1)
    t = tr.training_rows(rows, DAILY, [cut.isoformat()], horizon)
    last = t.agg(F.max("ts")).first()[0]
    gap = max(horizon, 5)
    assert last + dt.timedelta(days=horizon) <= cut
    assert (cut - last).days == gap
    assert t.agg(F.min("ts")).first()[0] == dt.date(2020, 1, 1) + dt.timedelta(days=60)


def test_slices_do_not_depend_on_chunks(rows):
    cuts = ["2020-08-01", "2020-12-01"]
    a = tr.training_rows(rows, DAILY, cuts, 3).select("ts", "cutoff_ts")
    b = tr.training_rows(rows.repartition(6), Panel(chunk_rows=33), cuts, 3).select("ts", "cutoff_ts")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bootstrap_weights_are_poisson_and_reproducible(spark):
    ids = spark.range(20_000)
    w = lambda d, s: [r[0] for r in d.orderBy("id").select(tr.bootstrap_weight(s, F.lit(1), c("id"))).collect()]
    a = w(ids, 1)
    assert a == w(ids.repartition(9), 1) and a != w(ids, 2)
    share = np.bincount(a, minlength=4)[:4] / len(a)
    np.testing.assert_allclose(share, [np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6], atol=0.012)


def test_bags_are_deterministic(rows):
    feats = [f"x{k}" for k in range(4)]
    fit = lambda s: tr.predict_mean(tr.fit_bags(rows, feats, "y", ["ts"], 2, seed=s, size=4, depth=3), rows, feats, "pred")
    get = lambda d: [r[0] for r in d.orderBy("ts").select("pred").collect()]
    a, b, other = get(fit(1)), get(fit(1)), get(fit(2))
    assert a == b and a != other


def test_walk_forward_uses_the_newest_model_before_the_row(rows):
    feats = [f"x{k}" for k in range(4)]
    cuts = ["2020-07-01", "2020-10-01"]
    out = tr.walk_forward(rows, DAILY, feats, cuts, "y", "up", bags=1, size=4, depth=3).toPandas()
    assert out["ts"].min() == dt.date(2020, 7, 1)
    want = out["ts"].map(lambda d: dt.date(2020, 10, 1) if d >= dt.date(2020, 10, 1) else dt.date(2020, 7, 1))
    assert (out["cutoff_ts"] == want).all()
    assert out["p_up"].between(0, 1).all()
    assert np.corrcoef(out["pred"], out["y"])[0, 1] > 0.3
    np.testing.assert_allclose(out.sort_values("ts")["x0"], rows.filter(c("ts") >= "2020-07-01").orderBy("ts").toPandas()["x0"])


def test_fingerprint():
    base = {"features": ["a", "b"], "bags": 160, "horizon": 3}
    f = tr.fingerprint(base)
    assert len(f) == 12 and f == tr.fingerprint(dict(reversed(list(base.items()))))
    assert f != tr.fingerprint({**base, "bags": 80})


def test_isotonic_fit_is_monotone_and_least_squares():
    p = rng.uniform(0, 1, 80)
    y = (rng.uniform(0, 1, 80) < p).astype(float)
    grid = np.linspace(0, 1, 50)
    fit = np.array([tr.calibrate_row(p, y, g) for g in grid])
    assert (np.diff(fit) >= -1e-12).all() and fit.min() >= 0 and fit.max() <= 1
    at = np.array([tr.calibrate_row(p, y, g) for g in p])
    # the mean over a pooled block equals the mean of its outcomes
    assert at.sum() == pytest.approx(y.sum(), rel=1e-9)


def test_recalibration_waits_for_outcomes(spark):
    n = 70
    pdf = pd.DataFrame({"series_id": "s", "ts": pd.date_range("2020-01-01", periods=n).date, "p_up": rng.uniform(0, 1, n), "asset_ret": rng.normal(0, 1, n)})
    out = tr.recalibrated(spark.createDataFrame(pdf), DAILY).toPandas().sort_values("ts").reset_index(drop=True)
    same = np.isclose(out["p_cal"], out["p_up"])
    assert same[:53].all() and not same[53:].all()
    i = 60
    assert out["p_cal"][i] == pytest.approx(tr.calibrate_row(pdf.p_up.values[: i - 1], (pdf.asset_ret.values[: i - 1] > 0).astype(float), pdf.p_up[i]))


def test_overfitting_probability_by_enumeration(spark):
    from itertools import combinations

    t, v, splits = 48, 4, 6
    m = rng.normal(0.003, 0.02, (t, v))
    rows = [("s", i, f"v{j}", float(m[i, j])) for i in range(t) for j in range(v)]
    df = spark.createDataFrame(rows, "series_id string, t int, variant string, r double")
    got = rob.backtest_overfitting(df, ["series_id"], "variant", "t", "r", splits=splits).first()
    parts = m.reshape(splits, t // splits, v)
    sharpe = lambda x: (x.mean(axis=0) - 0.0021) / x.std(axis=0)
    bad = total = 0
    for pick in combinations(range(splits), splits // 2):
        a = np.vstack([parts[i] for i in pick])
        b = np.vstack([parts[i] for i in range(splits) if i not in pick])
        so = sharpe(b)
        bad += (so < so[np.argmax(sharpe(a))]).mean() < 0.5
        total += 1
    assert got["n_halves"] == total and got["pbo"] == pytest.approx(bad / total)


def test_permutations_do_not_depend_on_blocks_or_partitions(spark):
    n = 60
    pdf = pd.DataFrame({
        "series_id": "s", "ts": pd.date_range("2020-01-03", periods=n, freq="7D").date, "pred": rng.normal(0, 0.02, n), "p_up": rng.uniform(0, 1, n),
        "k": 30.0, "asset_ret": rng.normal(0, 0.05, n), "cash_ret": 0.002,
    })
    df = spark.createDataFrame(pdf)
    one = rob.permutations(df, DAILY, 10).orderBy("perm").toPandas()
    two = rob.permutations(df.repartition(4), Panel(chunk_rows=20), 6, first=4).orderBy("perm").toPandas()
    np.testing.assert_allclose(one["cum"][4:], two["cum"], rtol=1e-12)
    np.testing.assert_allclose(one["max_dd"][4:], two["max_dd"], rtol=1e-12)
    assert one["cum"].nunique() == 10


def test_leaf_quantiles_equal_sql_over_stored_leaves(spark, tmp_path):
    """The spread follows the rows, and SQL over the stored leaves gives the same forecasts."""
    import duckdb

    rng = np.random.default_rng(5)
    n = 900
    x, z = rng.normal(0, 1, n), rng.normal(0, 1, n)
    y = x + rng.normal(0, 1, n) * np.where(x > 0, 2.0, 0.1)
    days = pd.date_range("2000-01-01", periods=n, freq="D").date
    pdf = pd.DataFrame({"series_id": "s", "ts": days, "x": x, "z": np.where(rng.random(n) < 0.1, np.nan, z), "y": np.where(np.arange(n) % 50 == 0, np.nan, y)})
    df = spark.createDataFrame(pdf).withColumns({k: F.when(~F.isnan(k), F.col(k)) for k in ("z", "y")})
    train, test = df.where("ts < '2002-01-01'"), df.where("ts >= '2002-01-01'")
    models = tr.fit_bags(train, ["x", "z"], "y", ["series_id", "ts"], 2, size=6, depth=3)
    got = tr.leaf_quantiles(models, train, test, ["x", "z"], "y").toPandas().sort_values("ts").reset_index(drop=True)
    for name, part in (("train", train.where("y is not null")), ("test", test)):
        tr.leaves(models, part, ["x", "z"]).write.parquet(f"{tmp_path}/{name}")
    sql = f"""WITH a AS (SELECT y, unnest(_leaves) AS leaf, generate_subscripts(_leaves, 1) AS tree FROM '{tmp_path}/train/*.parquet'),
      q AS (SELECT tree, leaf, quantile_cont(y, 0.1) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.9) AS c FROM a GROUP BY 1, 2),
      t AS (SELECT ts, unnest(_leaves) AS leaf, generate_subscripts(_leaves, 1) AS tree FROM '{tmp_path}/test/*.parquet')
      SELECT ts, avg(a) AS q10, avg(b) AS q50, avg(c) AS q90 FROM t JOIN q USING (tree, leaf) GROUP BY ts ORDER BY ts"""
    want = duckdb.sql(sql).df()
    assert len(got) == len(want) == test.count()
    for q in ("q10", "q50", "q90"):
        np.testing.assert_allclose(got[q], want[q], rtol=1e-12)
    spread = got.q90 - got.q10
    assert spread[got.x > 0.5].mean() > 2 * spread[got.x < -0.5].mean() and got.z.isna().any()
    assert tr.leaf_quantiles(models, train, test.limit(0), ["x", "z"], "y").count() == 0


def test_permuted_blocks_go_on_where_they_stopped(spark, tmp_path):
    n = 40
    r = np.random.default_rng(6)
    pdf = pd.DataFrame({
        "series_id": "s", "ts": pd.date_range("2020-01-03", periods=n, freq="7D").date, "pred": r.normal(0, 0.02, n), "p_up": r.uniform(0, 1, n),
        "k": 30.0, "asset_ret": r.normal(0, 0.05, n), "cash_ret": 0.002,
    })
    df = spark.createDataFrame(pdf)
    rob.permuted_blocks(df, DAILY, 10, str(tmp_path), block=5)
    made = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    got = rob.permuted_blocks(df, DAILY, 12, str(tmp_path), block=5).orderBy("perm").toPandas()
    assert all(f.stat().st_mtime_ns == t for f, t in made.items())
    want = rob.permutations(df, DAILY, 12).orderBy("perm").toPandas()
    np.testing.assert_allclose(got[["cum", "sharpe", "max_dd"]], want[["cum", "sharpe", "max_dd"]], rtol=1e-12)
    base = rob.unshuffled(df, DAILY).first()
    assert -1 < base.max_dd < 0
    summary = rob.permutation_summary(spark.createDataFrame(got), rob.unshuffled(df, DAILY), ["series_id"]).first()
    assert summary.n == 12 and summary.max_dd_p_value == pytest.approx((want.max_dd > base.max_dd).mean())


def test_a_changed_setting_forces_a_retrain(spark, tmp_path):
    from tidemark.operators.model_store import ModelStore

    r = np.random.default_rng(3)
    n = 260
    pdf = pd.DataFrame({"series_id": "s", "ts": pd.date_range("2000-01-01", periods=n).date, "x": r.normal(0, 1, n), "z": r.normal(0, 1, n)})
    pdf["y"], pdf["up"] = pdf.x + 0.1 * r.normal(0, 1, n), (pdf.x > 0).astype(int)
    df, store = spark.createDataFrame(pdf), ModelStore(str(tmp_path))

    def run(**more):
        return tr.walk_forward(df, DAILY, ["x", "z"], ["2000-06-01"], "y", "up", bags=1, size=3, depth=more.pop("depth", 2), store=store, **more).orderBy("ts").toPandas()

    one, two = run(), run()
    pd.testing.assert_frame_equal(one, two)
    actions = lambda: [x.action for x in store.log(spark).orderBy("at").collect()]
    assert actions() == ["fit", "fit", "load", "load"]
    run(depth=3)
    run(seed=7)
    run(window_days=100)
    assert actions()[4:] == ["fit"] * 6
    # what a run left without its mark is trained again
    for mark in tmp_path.rglob("_COMPLETE"):
        mark.unlink()
    pd.testing.assert_frame_equal(run(), one)
    assert actions()[10:] == ["fit", "fit"]
    frozen = tr.walk_forward(df, DAILY, ["x", "z"], ["2000-05-01", "2000-06-01"], "y", "up", bags=1, size=3, depth=2, frozen=True)
    assert frozen.select("cutoff_ts").distinct().count() == 1 and frozen.agg(F.max("ts")).first()[0] == pdf.ts.max()
