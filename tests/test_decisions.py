"""Boundary tables of the decision rules, controls, cash accrual and calendars."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import norm_cdf
from tidemark.operators import accounting as acc
from tidemark.operators import controls as ctl
from tidemark.operators import decisions as dec
from tidemark.operators import training as tr
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.regimes import sma_regime
from tidemark.panel import DAILY
from tidemark.plans.tables import RATE_STEPS, rate_steps

c = F.col


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr).collect()]


def test_sma_regime_boundaries(spark):
    rows = [(100.0, 90.0, 80.0), (100.0, 110.0, 90.0), (70.0, 90.0, 80.0), (90.0, 100.0, 90.0), (100.0, 100.0, 90.0), (110.0, 100.0, 100.0), (100.0, None, 80.0), (100.0, 90.0, None)]
    got = column(spark, rows, "p double, a double, b double", sma_regime(c("p"), c("a"), c("b")))
    assert got == ["BULL", "MILD", "BEAR", "BEAR", "MILD", "MILD", "MILD", "MILD"]


def test_confidence_range_and_symmetry(spark):
    ps = [i / 100 for i in range(101)]
    got = column(spark, [(p,) for p in ps], "p double", dec.confidence(c("p")))
    assert min(got) == 0.5 and max(got) <= 1
    np.testing.assert_allclose(got, got[::-1], rtol=1e-12)


def test_allocation_is_bounded_and_zero_on_negative(spark):
    rows = [(x / 10, float(k), p) for x in range(-10, 11) for k in (60, 30, 15) for p in (0.0, 0.3, 0.5, 0.7, 1.0)]
    got = column(spark, rows, "x double, k double, p double", dec.allocation(c("x"), c("k"), dec.confidence(c("p"))))
    assert all(0 <= a <= 1 for a in got)
    assert all(a == 0 for a, r in zip(got, rows) if r[0] <= 0)


def test_large_move_is_strict(spark):
    got = column(spark, [(0.079,), (0.08,), (0.081,), (-0.081,), (None,)], "r double", dec.large_move(c("r")))
    assert got == [False, False, True, True, False]


def test_retrain_calendar(spark):
    d = dt.date
    days = [d(2026, 3, 15), d(2026, 1, 1), d(2026, 7, 1), d(2026, 6, 30), d(2026, 8, 15), d(2026, 12, 31)]
    rows = [(x,) for x in days]
    assert column(spark, rows, "t date", tr.next_retrain(c("t"))) == [d(2026, 7, 1), d(2026, 7, 1), d(2027, 1, 1), d(2026, 7, 1), d(2027, 1, 1), d(2027, 1, 1)]
    assert column(spark, rows, "t date", tr.last_retrain(c("t"))) == [d(2026, 1, 1), d(2026, 1, 1), d(2026, 7, 1), d(2026, 1, 1), d(2026, 7, 1), d(2026, 7, 1)]


def history(spark, strat, asset=None, pred=None, conf=None):
    n = len(strat)
    rows = [
        ("s", dt.date(2020, 1, 3) + dt.timedelta(days=7 * i), strat[i], (asset or strat)[i], (pred or [0.01] * n)[i], (conf or [0.9] * n)[i])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "series_id string, ts date, strat_ret double, asset_ret double, pred double, conf double")


@pytest.mark.parametrize("strat,want", [([0.10, 0.935 / 1.10 - 1, None], -0.15), ([0.05, 0.05, None], 0.0), ([0.05, None], 0.0)])
def test_current_drawdown(spark, strat, want):
    got = ctl.current_drawdown(history(spark, strat), DAILY).first()["current_dd"]
    assert got == pytest.approx(want, abs=1e-12)


def last_quality(spark, asset, pred, conf=None):
    h = history(spark, asset, asset, pred, conf)
    q = ctl.rolling_quality(h, DAILY).orderBy(c("ts").desc()).first()
    return q["rolling_acc"], q["rolling_conf"]


def test_rolling_hit_rate(spark):
    assert last_quality(spark, [0.01] * 11, [0.02] * 11)[0] is None
    assert last_quality(spark, [0.01] * 12 + [None, None], [0.02] * 14)[0] == 1.0
    mixed = [0.01] * 6 + [-0.01] * 3 + [0.01] * 3
    assert last_quality(spark, mixed, [0.02] * 6 + [-0.02] * 6)[0] == pytest.approx(0.75)
    assert last_quality(spark, [-0.01] * 12 + [0.01] * 12, [0.02] * 24)[0] == 1.0
    assert last_quality(spark, [0.01] * 12, [0.0] * 12)[0] == 0.0


def controls(spark, alloc, dd, acc_, conf, derisk):
    row = spark.createDataFrame([(alloc, dd, acc_, conf)], "a double, d double, r double, f double")
    return row.select(*[v.alias(k) for k, v in ctl.apply_controls(c("a"), c("d"), c("r"), c("f"), derisk).items()]).first()


def test_control_order_and_gates(spark):
    assert controls(spark, 0.80, -0.20, None, None, False)["controlled_alloc"] == 0.15
    assert controls(spark, 0.05, -0.20, None, None, False)["controlled_alloc"] == 0.05
    assert controls(spark, 0.80, -0.03, None, None, False)["controlled_alloc"] == 0.80
    for conf, want in ((0.90, 0.40), (0.801, 0.40), (0.70, 0.80), (0.799, 0.80)):
        assert controls(spark, 0.80, 0.0, 0.0, conf, True)["controlled_alloc"] == pytest.approx(want)
    off = controls(spark, 0.80, 0.0, 0.0, 0.9, False)
    assert off["controlled_alloc"] == 0.80 and len(off["warnings"]) == 1
    both = controls(spark, 0.90, -0.20, 0.0, 0.9, True)
    assert both["controlled_alloc"] == pytest.approx(0.075) and both["kill_active"] and both["derisked"]


def psi_of(spark, base, cur):
    mk = lambda v: spark.createDataFrame([("f", None if x is None else float(x)) for x in v], "feature string, x double")
    r = ctl.psi(mk(base), mk(cur), ["feature"]).first()
    return r["psi"] if r else 0.0


def test_psi(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 1000)
    assert psi_of(spark, x, x) == pytest.approx(0, abs=1e-12)
    assert psi_of(spark, x, rng.normal(5, 1, 1000)) > 0.25
    assert psi_of(spark, x[:49], x) == 0.0
    assert psi_of(spark, x, x[:9]) == 0.0
    assert psi_of(spark, list(x) + [None] * 5, list(x) + [None] * 7) == pytest.approx(0, abs=1e-12)
    y = rng.normal(0.4, 1.3, 500)
    edges = np.concatenate([[-np.inf], np.unique(np.quantile(x, np.linspace(0, 1, 11)[1:-1])), [np.inf]])
    b, k = np.histogram(x, edges)[0] / 1000, np.histogram(y, edges)[0] / 500
    b, k = np.where(b == 0, 1e-6, b), np.where(k == 0, 1e-6, k)
    assert psi_of(spark, x, y) == pytest.approx(((k - b) * np.log(k / b)).sum(), rel=1e-9)


def test_cash_accrual(spark):
    days = spark.range(365).select(F.date_add(F.lit("1999-01-01").cast("date"), c("id").cast("int")).alias("ts"))
    rows = acc.cash_from_steps(days, rate_steps(spark)).toPandas()
    weekend = rows["ts"].map(lambda d: d.weekday() >= 5)
    assert (rows.loc[weekend, "cash_rate"] == 0).all()
    assert 250 <= (rows["cash_rate"] > 0).sum() <= 262
    assert 0.10 < (1 + rows["cash_rate"]).prod() - 1 < 0.14
    early = spark.createDataFrame([(dt.date(1990, 1, 3),)], "ts date")
    want = (1 + RATE_STEPS[0][1]) ** (1 / 252) - 1
    assert acc.cash_from_steps(early, rate_steps(spark)).first()["cash_rate"] == pytest.approx(want, rel=1e-12)


def test_normal_functions(spark):
    from tidemark.functions.special import norm_cdf as ref

    xs = [-9.0, -4.0, -1.5, -0.1, 0.0, 0.3, 2.0, 5.0, 8.5]
    np.testing.assert_allclose(column(spark, [(x,) for x in xs], "x double", norm_cdf(c("x"))), ref(xs), rtol=1e-12, atol=1e-16)


def test_exact_quantiles_on_large_skewed_groups(spark):
    """Both sides of the sketch threshold, with a third of the rows on one value."""
    df = spark.range(120_000).select(
        F.when(c("id") % 7 == 0, "small").otherwise("big").alias("g"),
        F.when(c("id") % 3 == 0, 5.0).otherwise(F.rand(3) * 10).alias("x"),
    ).cache()
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, ["g"], "x", qs).collect()}
    for g, part in df.toPandas().groupby("g"):
        np.testing.assert_allclose(got[g], np.quantile(part["x"], qs), rtol=1e-12)


def test_spaced_events(spark):
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=d)) for d in (0, 10, 29, 30, 45, 61, 90)]
    df = spark.createDataFrame(rows, "series_id string, ts date")
    got = sorted(r["ts"] for r in ctl.spaced_events(df, ["series_id"], "ts", F.lit(True), 30).collect())
    assert [(d - dt.date(2020, 1, 1)).days for d in got] == [0, 30, 61]
