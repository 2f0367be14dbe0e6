"""Training sets and models over the signal panel."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import training as tr
from tidemark.operators.labels import forward_returns
from tidemark.operators.model_store import ModelStore
from tidemark.panel import DAILY
from tidemark.plans import tables as t
from tidemark.plans.catalog import query
from tidemark.plans.feature_queries import ORD
from tidemark.stage import shared_dir, staged_once

c = F.col
FEATURES = ["day_ret", "vol30", "slope", "gap_short", "gap_long"]
CUTS = ["1999-01-01", "2000-01-01"]


def learning_rows(spark, sf_dir):
    """Features and the 3-row-ahead label of the signal panel, staged."""

    def make():
        s = t.signals(spark, sf_dir)
        s = s.withColumns({"slope": c("pred"), "gap_short": c("price") / c("sma_short") - 1, "gap_long": c("price") / c("sma_long") - 1})
        s = forward_returns(s, DAILY, 3, "price")
        return s.select("series_id", "ts", *FEATURES, c("target_return_3d").alias("y"), c("target_up_3d").alias("up"))

    return staged_once(spark, "learning", (sf_dir,), make)


@query(
    "retrain_calendar", "cutoff_ts",
    "SELECT CAST(d AS DATE) AS cutoff_ts FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS d), (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders) WHERE month(d) IN (1, 7) AND d >= date_trunc('month', a) AND d <= b",
)
def retrain_calendar(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    first, last = o.agg(F.trunc(F.min("o_orderdate"), "month")), o.agg(F.to_date(F.max("o_orderdate")))
    days = tr.retrain_calendar(spark, "1995-01-01", "2001-08-01")
    return days.filter((c("cutoff_ts") >= first.scalar()) & (c("cutoff_ts") <= last.scalar()))


@query(
    "retrain_dates", "series_id ts next_ts last_ts",
    f"""WITH {t.SQL_PANEL} SELECT series_id, ts, CASE WHEN month(ts) < 7 THEN make_date(year(ts), 7, 1) ELSE make_date(year(ts) + 1, 1, 1) END AS next_ts,
        CASE WHEN month(ts) >= 7 THEN make_date(year(ts), 7, 1) ELSE make_date(year(ts), 1, 1) END AS last_ts FROM panel""",
)
def retrain_dates(spark, sf_dir):
    p = t.panel(spark, sf_dir).select("series_id", "ts")
    return p.withColumns({"next_ts": tr.next_retrain(c("ts")), "last_ts": tr.last_retrain(c("ts"))})


@query(
    "test_periods", "series_id year part n_train test_start test_end",
    f"""WITH {t.SQL_PANEL}, n AS (SELECT series_id, ts, row_number() OVER {ORD} AS i FROM panel)
        SELECT series_id, CAST(year(ts) AS INTEGER) AS year, CAST(CASE WHEN month(ts) <= 6 THEN 1 ELSE 2 END AS INTEGER) AS part, min(i) - 1 AS n_train, min(ts) AS test_start, max(ts) AS test_end FROM n GROUP BY 1, 2, 3 HAVING min(i) - 2 >= 60""",
)
def test_periods(spark, sf_dir):
    return tr.period_table(t.panel(spark, sf_dir), DAILY, "semi")


def _slice_sql(start, where):
    return f"""WITH {t.SQL_PANEL}, cu AS (SELECT * FROM (VALUES (DATE '1997-01-01'), (DATE '1999-07-01'), (DATE '2001-01-01')) v(cutoff_ts)),
      r AS (SELECT series_id, cutoff_ts, ts, row_number() OVER (PARTITION BY series_id, cutoff_ts ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id, cutoff_ts) AS n FROM panel CROSS JOIN cu WHERE ts < cutoff_ts {where})
      SELECT series_id, cutoff_ts, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r WHERE i >= {start} AND i <= n - 5 GROUP BY 1, 2"""


_SLICES = ["1997-01-01", "1999-07-01", "2001-01-01"]


def _sizes(d):
    return d.groupBy("series_id", "cutoff_ts").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("purged_expanding_slices", "series_id cutoff_ts n first_ts last_ts", _slice_sql("60", ""))
def purged_expanding_slices(spark, sf_dir):
    return _sizes(tr.training_rows(t.panel(spark, sf_dir).select("series_id", "ts"), DAILY, _SLICES, 3))


@query("purged_rolling_slices", "series_id cutoff_ts n first_ts last_ts", _slice_sql("least(60, n // 4)", "AND ts >= cutoff_ts - INTERVAL 200 DAY"))
def purged_rolling_slices(spark, sf_dir):
    return _sizes(tr.training_rows(t.panel(spark, sf_dir).select("series_id", "ts"), DAILY, _SLICES, 3, window_days=200))


_UB = "(('0x' || substr(md5((242 + 7 * bag) || ':' || o_orderkey), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"


@query(
    "bootstrap_weights", "bag weight n",
    f"""SELECT bag, CAST(len(list_filter([{', '.join(map(repr, tr._POISSON1))}], lambda p: {_UB} > p)) AS INTEGER) AS weight, count(*) AS n FROM orders CROSS JOIN (SELECT unnest(range(4)) AS bag) GROUP BY 1, 2""",
)
def bootstrap_weights(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").select("o_orderkey").withColumn("bag", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return o.withColumn("weight", tr.bootstrap_weight(242, c("bag"), c("o_orderkey"))).groupBy("bag", "weight").agg(F.count(F.lit(1)).alias("n"))


@query(
    "model_as_of_decision", "series_id ts cutoff_ts",
    f"WITH {t.SQL_DECISIONS} SELECT series_id, ts, CASE WHEN month(ts) >= 7 THEN make_date(year(ts), 7, 1) ELSE make_date(year(ts), 1, 1) END AS cutoff_ts FROM decisions",
)
def model_as_of_decision(spark, sf_dir):
    return tr.models_as_of(t.decisions(spark, sf_dir).select("series_id", "ts"), tr.retrain_calendar(spark, "1995-01-01", "2001-12-31"))


@query("walk_forward_predictions", "series_id ts cutoff_ts seed pred:8 p_up:8")
def walk_forward_predictions(spark, sf_dir):
    return tr.walk_forward(learning_rows(spark, sf_dir), DAILY, FEATURES, CUTS, "y", "up", bags=2, size=8, depth=3)


@query("frozen_predictions", "series_id ts cutoff_ts seed pred:8 p_up:8")
def frozen_predictions(spark, sf_dir):
    """The first model keeps predicting after the second cutoff."""
    return tr.walk_forward(learning_rows(spark, sf_dir), DAILY, FEATURES, CUTS, "y", "up", bags=1, size=8, depth=3, frozen=True)


@query("model_store_log", "cutoff_ts kind depth action n")
def model_store_log(spark, sf_dir):
    """Three runs on one store: the second finds the models of the first, the third has another depth."""
    store = ModelStore(f"{shared_dir(spark)}/tidemark/store-{uuid.uuid4().hex[:12]}")
    for depth in (2, 2, 3):
        tr.walk_forward(learning_rows(spark, sf_dir), DAILY, FEATURES, CUTS, "y", "up", bags=1, size=4, depth=depth, store=store)
    setting = lambda name: F.get_json_object("settings", f"$.{name}")
    return store.log(spark).groupBy("cutoff_ts", setting("kind").alias("kind"), setting("depth").cast("int").alias("depth"), "action").agg(F.count(F.lit(1)).alias("n"))


def _split(spark, sf_dir):
    d = learning_rows(spark, sf_dir)
    train = tr.training_rows(d, DAILY, CUTS[1:], 3)
    return train, d.filter(c("ts") >= CUTS[1])


@query("quantile_forecasts", "series_id ts pred:8 q10:8 q50:8 q90:8")
def quantile_forecasts(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    models = tr.fit_bags(train, FEATURES, "y", ["series_id", "ts"], 2, size=12, depth=4)
    return tr.leaf_quantiles(models, train, test, FEATURES, "y")


@query("robust_forecasts", "series_id ts pred:8")
def robust_forecasts(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return tr.predict_mean([tr.fit_robust(train, FEATURES, "y")], test, FEATURES, "pred")


@query("feature_ablation", "features n_features n rmse:6 hit_rate:6")
def feature_ablation(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    sets = {"all": FEATURES, "no_trend": FEATURES[:3], "only_trend": FEATURES[3:]}
    return tr.ablation(train, test, sets, "y", ["series_id", "ts"], bags=1, size=8, depth=3)


@query("feature_importance", "feature importance:6 rank")
def feature_importance(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return tr.importance(spark, tr.fit_bags(train, FEATURES, "y", ["series_id", "ts"], 2, size=8, depth=3), FEATURES)


@query("isotonic_recalibration", "series_id ts p_up:8 p_cal:8")
def isotonic_recalibration(spark, sf_dir):
    d = t.decisions(spark, sf_dir).select("series_id", "ts", "p_up", "asset_ret")
    return tr.recalibrated(d, DAILY)
