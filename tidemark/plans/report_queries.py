"""Group aggregations, reports and robustness studies over the decision log."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tidemark.functions.scalars import unit_hash
from tidemark.operators import accounting as acc
from tidemark.operators import aggregates as agg
from tidemark.operators import decisions as dec
from tidemark.operators import quantiles as qt
from tidemark.operators import reporting as rep
from tidemark.operators import robustness as rob
from tidemark.operators.gram import gram
from tidemark.panel import DAILY, Running
from tidemark.plans import tables as t
from tidemark.plans.catalog import query
from tidemark.plans.decision_queries import _HIT, _POL_SQL, D, cl, policies
from tidemark.plans.feature_queries import ORD

c = F.col

# -- aggregations ------------------------------------------------------------------------------


@query(
    "accuracy_by_year_and_regime", "year regime n hits hit_rate:7 mean_ret:8 pred_corr:6",
    f"""{D} SELECT CAST(year(ts) AS INTEGER) AS year, regime, count(*) AS n, CAST(sum({_HIT}) AS BIGINT) AS hits, avg({_HIT}) AS hit_rate, avg(asset_ret) AS mean_ret,
        covar_pop(pred, asset_ret) / nullif(stddev_pop(pred) * stddev_pop(asset_ret), 0) AS pred_corr FROM decisions GROUP BY 1, 2""",
)
def accuracy_by_year_and_regime(spark, sf_dir):
    return agg.accuracy(t.decisions(spark, sf_dir).withColumn("year", F.year("ts")), ["year", "regime"])


_EDGES, _NAMES = [-0.001, 0.001, 0.2, 0.5, 0.8, 1.01], ["=0", "0-20%", "20-50%", "50-80%", "80-100%"]


@query(
    "allocation_buckets", "bucket n hit_rate:7 asset_mean:8 strat_mean:8",
    f"""{D} SELECT CASE """ + " ".join(f"WHEN alloc > {a} AND alloc <= {b} THEN '{n}'" for a, b, n in zip(_EDGES[:-1], _EDGES[1:], _NAMES))
    + f" END AS bucket, count(*) AS n, avg({_HIT}) AS hit_rate, avg(asset_ret) AS asset_mean, avg(strat_ret) AS strat_mean FROM decisions GROUP BY 1",
)
def allocation_buckets(spark, sf_dir):
    d = t.decisions(spark, sf_dir).withColumn("bucket", qt.fixed_bucket(c("alloc"), _EDGES, _NAMES))
    h = (((c("pred") > 0) & (c("asset_ret") > 0)) | ((c("pred") < 0) & (c("asset_ret") < 0))).cast("double")
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(h).alias("hit_rate"), F.avg("asset_ret").alias("asset_mean"), F.avg("strat_ret").alias("strat_mean"))


@query(
    "magnitude_calibration", "bucket n pred_mean:8 fwd_mean:8 pred_mag:8 fwd_mag:8",
    f"""{D}, p AS (SELECT *, abs(pred) AS m FROM decisions), e AS (SELECT list_sort(list_distinct(quantile_cont(m, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS eds FROM p)
        SELECT CAST(greatest(len(list_filter(eds, lambda q: q < m)), 1) AS INTEGER) AS bucket, count(*) AS n, avg(pred) AS pred_mean, avg(asset_ret) AS fwd_mean, avg(m) AS pred_mag, avg(abs(asset_ret)) AS fwd_mag FROM p, e GROUP BY 1""",
)
def magnitude_calibration(spark, sf_dir):
    d = t.decisions(spark, sf_dir).withColumn("m", F.abs("pred"))
    d = qt.quantile_bucket(d, [], "m", 5)
    return d.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pred").alias("pred_mean"), F.avg("asset_ret").alias("fwd_mean"),
        F.avg("m").alias("pred_mag"), F.avg(F.abs("asset_ret")).alias("fwd_mag"),
    )


@query(
    "exact_order_quantiles", "o_orderpriority q05:4 q50:4 q95:4",
    "SELECT o_orderpriority, quantile_cont(o_totalprice, 0.05) AS q05, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.95) AS q95 FROM orders GROUP BY 1",
)
def exact_order_quantiles(spark, sf_dir):
    q = qt.exact_quantiles(t.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [0.05, 0.5, 0.95])
    return q.select("o_orderpriority", *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("q05", "q50", "q95"))])


@query(
    "value_shares", "o_orderpriority o_orderstatus n share:8",
    "SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS share FROM orders GROUP BY 1, 2",
)
def value_shares(spark, sf_dir):
    return agg.shares(t.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus")


@query(
    "regime_distribution", "regime n share:8",
    f"{D} SELECT regime, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM decisions GROUP BY 1",
)
def regime_distribution(spark, sf_dir):
    return agg.shares(t.decisions(spark, sf_dir), [], "regime")


@query(
    "year_month_returns", "series_id year " + " ".join(f"m{m:02d}:7" for m in range(1, 13)) + " total:7",
    f"{D} SELECT series_id, CAST(year(ts) AS INTEGER) AS year, " + ", ".join(f"product(1 + strat_ret) FILTER (month(ts) = {m}) - 1 AS m{m:02d}" for m in range(1, 13))
    + ", product(1 + strat_ret) - 1 AS total FROM decisions GROUP BY 1, 2",
)
def year_month_returns(spark, sf_dir):
    return agg.year_month_table(t.decisions(spark, sf_dir), ["series_id"], "ts", "strat_ret")


# -- seeds: hash-perturbed forecasts stand in for re-trained models ------------------------------

_SEEDS = 6
_U = "(('0x' || substr(md5({key}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
_SEED_SQL = f"""{D}, sd AS (SELECT d.series_id, d.ts, d.regime, s.seed, asset_ret, cash_ret, d.k, d.conf, {cl(f"pred * (0.8 + 0.4 * {_U.format(key="s.seed || ':' || d.series_id || ':' || CAST(d.ts AS VARCHAR)")}) * k * conf")} AS a
  FROM decisions d CROSS JOIN (SELECT unnest(range({_SEEDS})) AS seed) s),
  sm AS (SELECT seed, x.variant, product(1 + x.m * a * asset_ret + (1 - x.m * a) * cash_ret) - 1 AS cum, avg(x.m * a * asset_ret + (1 - x.m * a) * cash_ret) / stddev_pop(x.m * a * asset_ret + (1 - x.m * a) * cash_ret) * sqrt(52.0) AS sharpe, avg(x.m * a) AS mean_alloc
    FROM sd CROSS JOIN (VALUES ('full', 1.0), ('half', 0.5), ('quarter', 0.25)) x(variant, m) GROUP BY 1, 2)"""


def seed_metrics(spark, sf_dir):
    d = t.decisions(spark, sf_dir).drop("alloc")
    d = d.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SEEDS - 1).cast("long"))))
    u = unit_hash(c("seed"), c("series_id"), c("ts"))
    d = d.withColumn("a", dec.allocation(c("pred") * (0.8 + 0.4 * u), c("k"), c("conf")))
    d = dec.scenarios(d, [{"variant": "full", "m": 1.0}, {"variant": "half", "m": 0.5}, {"variant": "quarter", "m": 0.25}])
    r = dec.period_return(c("m") * c("a"), c("asset_ret"), c("cash_ret"))
    s = acc.summary(r)
    return d.groupBy("seed", "variant").agg(s["cum"].alias("cum"), s["sharpe"].alias("sharpe"), F.avg(c("m") * c("a")).alias("mean_alloc"))


@query("seed_metrics", "seed variant cum:4 sharpe:7 mean_alloc:8", f"{_SEED_SQL} SELECT * FROM sm")
def _seed_metrics(spark, sf_dir):
    return seed_metrics(spark, sf_dir)


@query(
    "mean_over_seeds", "variant n_seeds sharpe_mean:7 sharpe_std:7 mean_alloc_mean:8 mean_alloc_std:8",
    f"{_SEED_SQL} SELECT variant, count(*) AS n_seeds, avg(sharpe) AS sharpe_mean, coalesce(stddev_samp(sharpe), 0) AS sharpe_std, avg(mean_alloc) AS mean_alloc_mean, coalesce(stddev_samp(mean_alloc), 0) AS mean_alloc_std FROM sm GROUP BY 1",
)
def mean_over_seeds(spark, sf_dir):
    return agg.over_seeds(seed_metrics(spark, sf_dir), ["variant"], ["sharpe", "mean_alloc"])


@query(
    "labelled_groups", "seed variant sharpe_mean:7 sharpe_std:7",
    f"{_SEED_SQL} SELECT seed, arg_min(variant, variant) AS variant, avg(sharpe) AS sharpe_mean, stddev_samp(sharpe) AS sharpe_std FROM sm GROUP BY 1",
)
def labelled_groups(spark, sf_dir):
    return agg.labelled_summary(seed_metrics(spark, sf_dir), ["seed"], "variant", "variant", ["sharpe"])


@query(
    "paired_seed_delta", "n mean_delta:8 std_delta:8 t_stat:4 win_rate:7 p_value:6",
    None,
)
def paired_seed_delta(spark, sf_dir):
    d = rob.paired_delta(seed_metrics(spark, sf_dir), [], "seed", "variant", "full", "half", "sharpe")
    return d.withColumn("p_value", rob.t_pvalue(c("t_stat"), (c("n") - 1).cast("double")))


@query(
    "paired_seed_statistics", "n mean_delta:8 std_delta:8 t_stat:4 win_rate:7",
    f"""{_SEED_SQL}, p AS (SELECT seed, max(sharpe) FILTER (variant = 'full') - max(sharpe) FILTER (variant = 'half') AS d FROM sm GROUP BY 1)
        SELECT count(*) AS n, avg(d) AS mean_delta, stddev_samp(d) AS std_delta, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t_stat, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM p""",
)
def paired_seed_statistics(spark, sf_dir):
    return rob.paired_delta(seed_metrics(spark, sf_dir), [], "seed", "variant", "full", "half", "sharpe")


@query(
    "variants_against_baseline", "variant n mean_delta:8 wins",
    f"{_SEED_SQL} SELECT a.variant, count(*) AS n, avg(a.sharpe - b.sharpe) AS mean_delta, count(*) FILTER (a.sharpe > b.sharpe) AS wins FROM sm a JOIN sm b ON a.seed = b.seed AND b.variant = 'full' WHERE a.variant <> 'full' GROUP BY 1",
)
def variants_against_baseline(spark, sf_dir):
    return rob.against_baseline(seed_metrics(spark, sf_dir), [], "seed", "variant", "full", "sharpe")


@query(
    "return_quantiles", "series_id min:8 p10:8 p25:8 p50:8 p75:8 p90:8 max:8 argmin argmax",
    f"""{D} SELECT series_id, min(strat_ret) AS min, quantile_cont(strat_ret, 0.1) AS p10, quantile_cont(strat_ret, 0.25) AS p25, quantile_cont(strat_ret, 0.5) AS p50, quantile_cont(strat_ret, 0.75) AS p75, quantile_cont(strat_ret, 0.9) AS p90,
        max(strat_ret) AS max, arg_min(ts, strat_ret) AS argmin, arg_max(ts, strat_ret) AS argmax FROM decisions GROUP BY 1""",
)
def return_quantiles(spark, sf_dir):
    return agg.quantile_summary(t.decisions(spark, sf_dir), ["series_id"], "strat_ret", "ts")


_CC = ["open", "high", "low", "close", "volume"]


def _corr_sql(a, b):
    pa, pb = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({pa}) * stddev_pop({pb}), 0)"


@query(
    "redundant_pairs", "a b corr:6",
    f"WITH {t.SQL_BARS} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_corr_sql(a, b)} AS corr FROM bars" for a, b in itertools.combinations(_CC, 2)) + ") WHERE abs(corr) > 0.5",
)
def redundant_pairs(spark, sf_dir):
    return agg.redundant_pairs(t.order_bars(spark, sf_dir), _CC, 0.5)


_ALL = [*_CC, "n_obs", *t.METRICS]
_PAIRS = list(itertools.combinations(_ALL, 2))


@query(
    "all_correlations", "a b n corr:6",
    f"WITH {t.sql_metric_panel(t.METRICS)}, w AS (SELECT [" + ", ".join(
        f"{{'a': '{a}', 'b': '{b}', 'n': count(CASE WHEN {b} IS NOT NULL THEN {a} END), 'corr': {_corr_sql(a, b)}}}" for a, b in _PAIRS
    ) + "] AS x FROM mp) SELECT p.a AS a, p.b AS b, p.n AS n, p.corr AS corr FROM (SELECT unnest(x) AS p FROM w) q WHERE p.n > 0",
)
def all_correlations(spark, sf_dir):
    """Every pair of the numeric columns of the panel with its outside series, in one scan."""
    return gram(t.metric_panel(spark, sf_dir, list(t.METRICS)), _ALL)


@query(
    "leakage_screen", "a b corr:6",
    f"WITH {t.SQL_SIGNALS}, x AS (SELECT *, lead(price) OVER {ORD} / price - 1 AS target FROM signals) SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, 'target' AS b, {_corr_sql(a, 'target')} AS corr FROM x" for a in ("day_ret", "vol30", "pred", "price")) + ") WHERE abs(corr) > 0.02",
)
def leakage_screen(spark, sf_dir):
    f = DAILY.halo(t.signals(spark, sf_dir), 0, 1)
    x = DAILY.owned(f.withColumn("target", F.lead("price", 1).over(DAILY.window()) / c("price") - 1))
    return agg.leakage(x, ["day_ret", "vol30", "pred", "price"], ["target"], 0.02)


@query(
    "tail_shares", "series_id high_vol:8 strong_pred:8 big_day:8",
    f"WITH {t.SQL_SIGNALS} SELECT series_id, avg(CASE WHEN vol30 > 0.6 THEN 1.0 ELSE 0.0 END) AS high_vol, avg(CASE WHEN pred > 0.05 THEN 1.0 ELSE 0.0 END) AS strong_pred, avg(CASE WHEN abs(day_ret) > 0.05 THEN 1.0 ELSE 0.0 END) AS big_day FROM signals GROUP BY 1",
)
def tail_shares(spark, sf_dir):
    return agg.share_where(t.signals(spark, sf_dir), ["series_id"], {"high_vol": c("vol30") > 0.6, "strong_pred": c("pred") > 0.05, "big_day": F.abs("day_ret") > 0.05})


@query(
    "capture_ratios", "series_id up_capture:6 down_capture:6",
    f"{D} SELECT series_id, avg(strat_ret) FILTER (asset_ret > 0) / avg(asset_ret) FILTER (asset_ret > 0) AS up_capture, avg(strat_ret) FILTER (asset_ret < 0) / avg(asset_ret) FILTER (asset_ret < 0) AS down_capture FROM decisions GROUP BY 1",
)
def capture_ratios(spark, sf_dir):
    return acc.captures(t.decisions(spark, sf_dir), ["series_id"])


# -- reports -----------------------------------------------------------------------------------

for _p, _w in (("24m", "ts >= e - INTERVAL 24 MONTH"), ("6m", "ts >= e - INTERVAL 6 MONTH"), ("ytd", "ts >= date_trunc('year', e)")):

    @query(
        f"period_{_p}", "series_id n first_day cum:6",
        f"{D}, x AS (SELECT series_id, max(ts) AS e FROM decisions GROUP BY 1) SELECT series_id, count(*) AS n, min(ts) AS first_day, product(1 + strat_ret) - 1 AS cum FROM decisions JOIN x USING (series_id) WHERE {_w} GROUP BY 1",
    )
    def period(spark, sf_dir, name=_p):
        d = rep.preset(t.decisions(spark, sf_dir), DAILY, name)
        return d.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_day"), acc.compounded(c("strat_ret")).alias("cum"))


@query(
    "monthly_summary", "series_id month n mean_alloc:7 mean_p_up:7 regime emergencies",
    f"""{D}, r AS (SELECT series_id, strftime(ts, '%Y-%m') AS month, regime, count(*) AS k FROM decisions GROUP BY 1, 2, 3),
        m AS (SELECT series_id, month, regime FROM (SELECT *, row_number() OVER (PARTITION BY series_id, month ORDER BY k DESC, regime) AS rn FROM r) WHERE rn = 1)
        SELECT d.series_id, strftime(ts, '%Y-%m') AS month, count(*) AS n, avg(alloc) AS mean_alloc, avg(p_up) AS mean_p_up, any_value(m.regime) AS regime, count(*) FILTER (is_large_move) AS emergencies
        FROM decisions d JOIN m ON m.series_id = d.series_id AND m.month = strftime(d.ts, '%Y-%m') GROUP BY 1, 2""",
)
def monthly_summary(spark, sf_dir):
    return rep.monthly(t.decisions(spark, sf_dir), ["series_id"])


@query(
    "position_reading", "series_id ts size_class brake pred_band conf_band verdict actual:10 without_confidence:10 if_bull:10",
    f"""{D}, f AS (SELECT *, {cl('pred * k * conf')} AS actual, {cl('pred * k')} AS without_confidence, {cl('pred * 60 * conf')} AS if_bull, {cl('pred * 60')} AS potential FROM decisions)
        SELECT series_id, ts, CASE WHEN alloc * 100 <= 0.01 THEN 'none' WHEN alloc * 100 < 10 THEN 'minimal' WHEN alloc * 100 < 30 THEN 'small' WHEN alloc * 100 < 60 THEN 'moderate' WHEN alloc * 100 < 85 THEN 'large' ELSE 'near maximum' END AS size_class,
          CASE WHEN pred <= 0 THEN 'negative forecast' WHEN potential < 0.3 THEN 'weak forecast' WHEN actual >= 0.85 THEN 'none' WHEN if_bull - actual >= without_confidence - actual THEN 'regime' ELSE 'uncertain classifier' END AS brake,
          CASE WHEN pred <= 0 THEN 'negative' WHEN pred < 0.005 THEN 'very weak' WHEN pred < 0.015 THEN 'moderate' ELSE 'strong' END AS pred_band,
          CASE WHEN conf < 0.6 THEN 'undecided' WHEN conf < 0.85 THEN 'medium' ELSE 'confident' END AS conf_band,
          CASE WHEN asset_ret > cash_ret THEN CASE WHEN alloc >= 0.5 THEN 'conviction rewarded' ELSE 'cost of caution' END ELSE CASE WHEN alloc < 0.5 THEN 'caution protected' ELSE 'large in a bad period' END END AS verdict,
          actual, without_confidence, if_bull FROM f""",
)
def position_reading(spark, sf_dir):
    d = t.decisions(spark, sf_dir)
    f = rep.counterfactuals(c("pred"), c("k"), c("conf"))
    return d.withColumns(
        {
            "size_class": rep.size_class(c("alloc") * 100),
            "brake": rep.main_brake(c("pred"), c("k"), c("conf")),
            "pred_band": rep.forecast_band(c("pred")),
            "conf_band": rep.confidence_band(c("conf")),
            "verdict": rep.verdict(c("alloc"), c("asset_ret"), c("cash_ret")),
            **f,
        }
    )


@query(
    "neighbour_rows", "series_id ts distance alloc:7",
    f"""{D}, n AS (SELECT *, row_number() OVER {ORD} AS r FROM decisions), a AS (SELECT series_id, r AS r0 FROM n WHERE ts = DATE '1999-06-04')
        SELECT series_id, ts, r - r0 AS distance, alloc FROM n JOIN a USING (series_id) WHERE r - r0 BETWEEN -12 AND 7""",
)
def neighbour_rows(spark, sf_dir):
    return rep.neighbours(t.decisions(spark, sf_dir), DAILY, "1999-06-04")


@query(
    "month_explanations", "series_id month alloc_pct:5 level reasons",
    f"""{D}, o AS (SELECT series_id, avg(alloc) * 100 AS al FROM decisions GROUP BY 1),
        r AS (SELECT series_id, strftime(ts, '%Y-%m') AS month, regime, count(*) AS k FROM decisions GROUP BY 1, 2, 3),
        dm AS (SELECT series_id, month, regime AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY series_id, month ORDER BY k DESC, regime) AS rn FROM r) WHERE rn = 1),
        m AS (SELECT series_id, strftime(ts, '%Y-%m') AS month, avg(alloc) * 100 AS alloc_pct, avg(CASE WHEN regime = 'BEAR' THEN 1.0 ELSE 0.0 END) AS bear, avg(CASE WHEN regime = 'BULL' THEN 1.0 ELSE 0.0 END) AS bull, avg(pred) * 100 AS pp, avg(abs(p_up - 0.5)) AS edge,
          count(*) FILTER (is_large_move) AS em, avg(CASE WHEN alloc = 0 THEN 1.0 ELSE 0.0 END) AS zeroed FROM decisions GROUP BY 1, 2)
        SELECT series_id, month, alloc_pct, CASE WHEN alloc_pct - al < -10 THEN 'well below' WHEN alloc_pct - al < -3 THEN 'below' WHEN alloc_pct - al > 10 THEN 'well above' WHEN alloc_pct - al > 3 THEN 'above' ELSE 'in line' END AS level,
          concat_ws('; ', CASE WHEN bear >= 0.5 THEN 'mostly BEAR' WHEN bull >= 0.5 THEN 'mostly BULL' ELSE 'dominant ' || dominant END, CASE WHEN pp <= 0.3 THEN 'weak forecasts' ELSE 'positive forecasts' END,
            CASE WHEN edge < 0.1 THEN 'uncertain' END, CASE WHEN em > 0 THEN em || ' emergencies' END, CASE WHEN zeroed >= 0.5 THEN 'mostly zeroed' END) AS reasons
        FROM m JOIN o USING (series_id) JOIN dm USING (series_id, month)""",
)
def month_explanations(spark, sf_dir):
    return rep.explain_month(t.decisions(spark, sf_dir), ["series_id"])


@query(
    "extreme_features", "series_id feature value:6 percentile:6",
    f"""WITH {t.SQL_SIGNALS}, u AS (SELECT series_id, ts, feature, x FROM signals UNPIVOT (x FOR feature IN (day_ret, vol30, pred, price, sma_short)) WHERE ts <= DATE '2000-06-30'),
        d AS (SELECT series_id, max(ts) AS ts FROM signals WHERE ts <= DATE '2000-06-30' GROUP BY 1), n AS (SELECT u.series_id, u.feature, u.x AS value FROM u JOIN d USING (series_id, ts)),
        p AS (SELECT n.*, avg(CASE WHEN u.x <= value THEN 1.0 ELSE 0.0 END) * 100 AS percentile FROM n JOIN u USING (series_id, feature) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(percentile - 50) DESC, feature) AS k FROM p WHERE abs(percentile - 50) >= 35)
        SELECT series_id, feature, value, percentile FROM r WHERE k <= 4""",
)
def extreme_features(spark, sf_dir):
    return rep.extreme_features(t.signals(spark, sf_dir), DAILY, ["day_ret", "vol30", "pred", "price", "sma_short"], "2000-06-30")


@query("change_from_previous", "series_id ts delta:7", f"{D} SELECT series_id, ts, alloc - lag(alloc) OVER {ORD} AS delta FROM decisions")
def change_from_previous(spark, sf_dir):
    return rep.change_from_previous(t.decisions(spark, sf_dir), DAILY, "alloc")


@query(
    "best_decisions", "series_id ts strat_ret:8",
    f"{D} SELECT series_id, ts, strat_ret FROM decisions ORDER BY strat_ret DESC NULLS LAST, series_id, ts LIMIT 25",
)
def best_decisions(spark, sf_dir):
    return rep.top_k(t.decisions(spark, sf_dir), "strat_ret", 25, ["series_id", "ts"])


# -- set operations ----------------------------------------------------------------------------


@query(
    "decision_day_sets", "series_id ts kind",
    f"""{D} SELECT series_id, ts, 'union' AS kind FROM decisions UNION ALL SELECT series_id, ts, 'only large' FROM decisions WHERE is_large_move AND is_off_calendar
        UNION ALL SELECT series_id, ts, 'distinct days' FROM (SELECT '' AS series_id, ts FROM decisions GROUP BY ts)""",
)
def decision_day_sets(spark, sf_dir):
    d = t.decisions(spark, sf_dir)
    fridays = d.filter(~c("is_off_calendar")).select("series_id", "ts")
    large = d.filter("is_large_move").select("series_id", "ts")
    days = fridays.unionByName(large).select("ts").distinct().select(F.lit("").alias("series_id"), "ts")
    return (
        fridays.unionByName(large).distinct().withColumn("kind", F.lit("union"))
        .unionByName(large.exceptAll(fridays).withColumn("kind", F.lit("only large")))
        .unionByName(days.withColumn("kind", F.lit("distinct days")))
    )


# -- robustness --------------------------------------------------------------------------------

_PERMS = 1000
_SUMM = "product(1 + r) - 1 AS cum, avg(r) / nullif(sqrt(avg(CASE WHEN r < 0 THEN r * r END)), 0) * sqrt(52.0) AS sortino, avg(r) / nullif(stddev_pop(r), 0) * sqrt(52.0) AS sharpe"
_PERM_SQL = f"""{D}, o AS (SELECT *, row_number() OVER {ORD} AS i FROM decisions),
  sg1 AS (SELECT p.perm, o.series_id, o.pred, o.p_up, row_number() OVER (PARTITION BY o.series_id, p.perm ORDER BY md5(p.perm || ':' || o.series_id || ':' || CAST(o.ts AS VARCHAR)), CAST(o.ts AS VARCHAR)) AS i FROM o CROSS JOIN (SELECT unnest(range({_PERMS})) AS perm) p),
  pr AS (SELECT s.series_id, s.perm, {cl('s.pred * o.k / (1 + exp(-abs(s.p_up - 0.5) * 15))')} AS a, o.asset_ret, o.cash_ret, o.i FROM sg1 s JOIN o ON o.series_id = s.series_id AND o.i = s.i),
  rr AS (SELECT *, a * asset_ret + (1 - a) * cash_ret AS r FROM pr),
  gg AS (SELECT *, product(1 + coalesce(r, 0)) OVER (PARTITION BY series_id, perm ORDER BY i) AS g FROM rr),
  ff AS (SELECT *, g / greatest(max(g) OVER (PARTITION BY series_id, perm ORDER BY i), 1) - 1 AS f FROM gg),
  pm AS (SELECT series_id, perm, {_SUMM}, min(f) AS max_dd FROM ff GROUP BY 1, 2)"""


@query("permutation_metrics", "series_id perm cum:5 sortino:6 sharpe:6 max_dd:6", f"{_PERM_SQL} SELECT * FROM pm")
def permutation_metrics(spark, sf_dir):
    return rob.permutations(t.decisions(spark, sf_dir), DAILY, _PERMS)


@query(
    "permutation_p_values", "series_id n cum_mean:5 cum_max:5 cum_p95:5 cum_p_value:7 sharpe_mean:6 sharpe_max:6 sharpe_p95:6 sharpe_p_value:7 sortino_p_value:7 max_dd_mean:6 max_dd_p95:6 max_dd_p_value:7",
    f"""{_PERM_SQL}, br AS (SELECT series_id, ts, a * asset_ret + (1 - a) * cash_ret AS r FROM (SELECT *, {cl('pred * k / (1 + exp(-abs(p_up - 0.5) * 15))')} AS a FROM decisions)),
        bg AS (SELECT *, product(1 + coalesce(r, 0)) OVER {ORD} AS g FROM br), bf AS (SELECT *, g / greatest(max(g) OVER {ORD}, 1) - 1 AS f FROM bg),
        b AS (SELECT series_id, {_SUMM}, min(f) AS max_dd FROM bf GROUP BY 1)
        SELECT pm.series_id, count(*) AS n, avg(pm.cum) AS cum_mean, max(pm.cum) AS cum_max, quantile_cont(pm.cum, 0.95) AS cum_p95, avg(CASE WHEN pm.cum > b.cum THEN 1.0 ELSE 0.0 END) AS cum_p_value,
          avg(pm.sharpe) AS sharpe_mean, max(pm.sharpe) AS sharpe_max, quantile_cont(pm.sharpe, 0.95) AS sharpe_p95, avg(CASE WHEN pm.sharpe > b.sharpe THEN 1.0 ELSE 0.0 END) AS sharpe_p_value, avg(CASE WHEN b.sortino IS NOT NULL AND (pm.sortino IS NULL OR pm.sortino > b.sortino) THEN 1.0 ELSE 0.0 END) AS sortino_p_value,
          avg(pm.max_dd) AS max_dd_mean, quantile_cont(pm.max_dd, 0.95) AS max_dd_p95, avg(CASE WHEN pm.max_dd > b.max_dd THEN 1.0 ELSE 0.0 END) AS max_dd_p_value FROM pm JOIN b USING (series_id) GROUP BY 1""",
)
def permutation_p_values(spark, sf_dir):
    d = t.decisions(spark, sf_dir)
    return rob.permutation_summary(rob.permutations(d, DAILY, _PERMS), rob.unshuffled(d, DAILY), ["series_id"])


_PROBES = f"""{D}, ma AS (SELECT series_id, avg(abs(pred)) AS m, avg(pred) AS mu, stddev_pop(pred) AS sdv FROM decisions GROUP BY 1)"""


@query(
    "signal_probes", "series_id probe mean_alloc:7 cum:5 sharpe:6",
    f"""{_PROBES}, p AS (SELECT d.series_id, x.probe, asset_ret, cash_ret, CASE x.probe WHEN 'sign_only' THEN sign(pred) * m WHEN 'constant' THEN 0.01 ELSE pred END AS pr, CASE x.probe WHEN 'constant' THEN 0.65 ELSE p_up END AS pu, CASE x.probe WHEN 'no_regime' THEN 50.0 ELSE k END AS kk
          FROM decisions d JOIN ma USING (series_id) CROSS JOIN (VALUES ('actual'), ('sign_only'), ('constant'), ('no_regime')) x(probe)),
        q AS (SELECT *, {cl('pr * kk / (1 + exp(-abs(pu - 0.5) * 15))')} AS a FROM p), z AS (SELECT *, a * asset_ret + (1 - a) * cash_ret AS r FROM q)
        SELECT series_id, probe, avg(a) AS mean_alloc, {_SUMM} FROM z GROUP BY 1, 2""",
)
def signal_probes(spark, sf_dir):
    return rob.simulate(rob.probe(t.decisions(spark, sf_dir), ["series_id"]), ["series_id", "probe"])


def _uq(seed, tail):
    return _U.format(key=f"{seed} || ':' || d.series_id || ':' || CAST(d.ts AS VARCHAR) || ':{tail}'")


@query(
    "random_signals", "series_id seed mean_alloc:7 cum:5 sharpe:6",
    f"""{_PROBES}, p AS (SELECT d.series_id, s.seed, k, asset_ret, cash_ret, mu + sdv * sqrt(-2 * ln({_uq('s.seed', 'u')})) * cos(2 * pi() * {_uq('s.seed', 'v')}) AS pr, {_uq('s.seed', 'p')} AS pu
          FROM decisions d JOIN ma USING (series_id) CROSS JOIN (SELECT unnest(range(20)) AS seed) s),
        q AS (SELECT *, {cl('pr * k / (1 + exp(-abs(pu - 0.5) * 15))')} AS a FROM p), z AS (SELECT *, a * asset_ret + (1 - a) * cash_ret AS r FROM q)
        SELECT series_id, seed, avg(a) AS mean_alloc, {_SUMM} FROM z GROUP BY 1, 2""",
)
def random_signals(spark, sf_dir):
    d = rob.random_signal(t.decisions(spark, sf_dir), ["series_id"], 20, c("ts").cast("string"))
    return rob.simulate(d, ["series_id", "seed"])


_PHI = """CASE WHEN z > 8 THEN 1.0 WHEN z < -8 THEN 0.0 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) *
  list_sum(list_transform(range(0, 250), lambda j: CASE WHEN abs(z) < 1e-12 THEN 0 ELSE exp((2 * j + 1) * ln(abs(z)) - (j + 1) * ln(2) - lgamma(j + 1.5) + 0.5 * ln(pi())) END)) END"""


def _sharpe_sql(bench):
    zs = ", ".join(f"(sr - {b!r} / sqrt(52.0)) / den AS z_{n}" for n, b in bench.items())
    out = ", ".join(f"z_{n}, " + _PHI.replace("z", f"z_{n}").replace(f"z_{n}", f"z_{n}") + f" AS psr_{n}" for n in bench)
    return f"""{D}, m AS (SELECT series_id, count(*) AS n, avg(strat_ret) AS mu, stddev_pop(strat_ret) AS sd FROM decisions GROUP BY 1),
      mo AS (SELECT d.series_id, any_value(n) AS n, any_value((mu - 0.0021) / sd) AS sr, avg(pow((strat_ret - mu) / sd, 3)) AS skew, avg(pow((strat_ret - mu) / sd, 4)) - 3 AS kurt FROM decisions d JOIN m USING (series_id) GROUP BY 1),
      de AS (SELECT *, sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1)) AS den FROM mo), zz AS (SELECT *, {zs} FROM de) SELECT series_id, n, sr, skew, kurt, {out} FROM zz"""


_BENCH = {"zero": 0.0, "one": 1.0}
_TRIALS = {f"n{n}": rob.expected_max_z(n) for n in (1, 10, 100)}


@query("probabilistic_sharpe", "series_id n sr:8 skew:6 kurt:5 " + " ".join(f"z_{n}:5 psr_{n}:7" for n in _BENCH), _sharpe_sql(_BENCH))
def probabilistic_sharpe(spark, sf_dir):
    return rob.probabilistic_sharpe(t.decisions(spark, sf_dir), ["series_id"], "strat_ret", _BENCH)


@query("deflated_sharpe", "series_id n sr:8 " + " ".join(f"z_{n}:5 psr_{n}:7" for n in _TRIALS), _sharpe_sql(_TRIALS))
def deflated_sharpe(spark, sf_dir):
    return rob.deflated_sharpe(t.decisions(spark, sf_dir), ["series_id"], "strat_ret", [1, 10, 100])


_SPLITS = 10


@query(
    "backtest_overfitting", "series_id n_halves pbo:7",
    f"""{_POL_SQL}, pr AS (SELECT series_id, ts, policy, pa * asset_ret + (1 - pa) * cash_ret AS r FROM pol),
        tt AS (SELECT series_id, ts, row_number() OVER {ORD} - 1 AS i, count(*) OVER (PARTITION BY series_id) // {_SPLITS} AS sz FROM (SELECT DISTINCT series_id, ts FROM pr)),
        st AS (SELECT series_id, policy, i // sz AS sp, count(*) AS n, sum(r) AS s, sum(r * r) AS ss FROM pr JOIN tt USING (series_id, ts) WHERE i // sz < {_SPLITS} GROUP BY 1, 2, 3),
        mk AS (SELECT unnest(range({2 ** _SPLITS})) AS mask), ms AS (SELECT mask FROM mk WHERE bit_count(mask) = {_SPLITS // 2}),
        h AS (SELECT series_id, policy, mask, sum(n) FILTER ((mask >> sp) & 1 = 1) AS ni, sum(s) FILTER ((mask >> sp) & 1 = 1) AS si, sum(ss) FILTER ((mask >> sp) & 1 = 1) AS qi,
          sum(n) FILTER ((mask >> sp) & 1 = 0) AS no, sum(s) FILTER ((mask >> sp) & 1 = 0) AS so, sum(ss) FILTER ((mask >> sp) & 1 = 0) AS qo FROM st CROSS JOIN ms GROUP BY 1, 2, 3),
        f AS (SELECT series_id, policy, mask, (si / ni - 0.0021) / sqrt(qi / ni - si * si / ni / ni) AS i, (so / no - 0.0021) / sqrt(qo / no - so * so / no / no) AS o FROM h),
        b AS (SELECT *, first_value(o) OVER (PARTITION BY series_id, mask ORDER BY i DESC, policy DESC) AS bo FROM f),
        rk AS (SELECT series_id, mask, avg(CASE WHEN o < bo THEN 1.0 ELSE 0.0 END) AS rk FROM b GROUP BY 1, 2)
        SELECT series_id, count(*) AS n_halves, avg(CASE WHEN rk < 0.5 THEN 1.0 ELSE 0.0 END) AS pbo FROM rk GROUP BY 1""",
)
def backtest_overfitting(spark, sf_dir):
    return rob.backtest_overfitting(policies(spark, sf_dir), ["series_id"], "policy", "ts", "pr", splits=_SPLITS)


_SWEEP = [{"config": f"K{m}-s{s}-c{b}", "m": float(m), "s": float(s), "b": float(b)} for m in (1, 2) for s in (5, 10, 15) for b in (0, 10)]
_SWEEP_SQL = f"""{D}, g AS (SELECT * FROM (VALUES {', '.join(f"('{g['config']}', {g['m']}, {g['s']}, {g['b']})" for g in _SWEEP)}) v(config, m, s, b)),
  a0 AS (SELECT d.series_id, d.ts, g.config, g.b, asset_ret, cash_ret, {cl('pred * k * m / (1 + exp(-abs(p_up - 0.5) * s))')} AS a FROM decisions d CROSS JOIN g),
  a1 AS (SELECT *, a * asset_ret + (1 - a) * cash_ret - abs(a - coalesce(lag(a) OVER (PARTITION BY series_id, config ORDER BY ts), 0)) * b / 10000 AS r FROM a0),
  sw AS (SELECT series_id, config, avg(a) AS mean_alloc, {_SUMM} FROM a1 GROUP BY 1, 2)"""


def sweep(spark, sf_dir):
    d = dec.scenarios(t.decisions(spark, sf_dir).drop("alloc"), _SWEEP)
    d = d.withColumn("alloc", dec.allocation(c("pred"), c("k") * c("m"), dec.confidence(c("p_up"), c("s"))))
    d = d.withColumn("gross", dec.period_return(c("alloc"), c("asset_ret"), c("cash_ret")))
    d = acc.transaction_cost(d, DAILY.by("config"), "alloc", c("b"), "gross")
    return d.groupBy("series_id", "config").agg(F.avg("alloc").alias("mean_alloc"), *[v.alias(k) for k, v in acc.summary(c("net_ret")).items()])


@query("parameter_sweep", "series_id config mean_alloc:7 cum:5 sortino:6 sharpe:6", f"{_SWEEP_SQL} SELECT * FROM sw")
def parameter_sweep(spark, sf_dir):
    return sweep(spark, sf_dir)


@query(
    "sweep_verdict", "series_id best:6 best_config worst:6 mean:6 range:6",
    f"{_SWEEP_SQL} SELECT series_id, max(sharpe) AS best, arg_max(config, sharpe) AS best_config, min(sharpe) AS worst, avg(sharpe) AS mean, max(sharpe) - min(sharpe) AS range FROM sw GROUP BY 1",
)
def sweep_verdict(spark, sf_dir):
    return rob.verdict(sweep(spark, sf_dir), ["series_id"], "config", "sharpe")


@query(
    "policy_attribution", "series_id model_vs_regime:6 model_vs_sign:6 regime_vs_sign:6",
    f"""{_POL_SQL}, z AS (SELECT series_id, policy, avg(pa * asset_ret + (1 - pa) * cash_ret) / nullif(stddev_pop(pa * asset_ret + (1 - pa) * cash_ret), 0) * sqrt(52.0) AS s FROM pol GROUP BY 1, 2),
        w AS (SELECT series_id, max(s) FILTER (policy = 'model') AS m, max(s) FILTER (policy = 'regime_only') AS r, max(s) FILTER (policy = 'sign_only') AS g FROM z GROUP BY 1)
        SELECT series_id, m - r AS model_vs_regime, m - g AS model_vs_sign, r - g AS regime_vs_sign FROM w""",
)
def policy_attribution(spark, sf_dir):
    p = policies(spark, sf_dir).groupBy("series_id", "policy").agg(acc.summary(c("pr"))["sharpe"].alias("sharpe"))
    terms = {"model_vs_regime": ("model", "regime_only"), "model_vs_sign": ("model", "sign_only"), "regime_vs_sign": ("regime_only", "sign_only")}
    return rob.attribution(p, ["series_id"], "policy", "sharpe", terms)


@query(
    "hit_rate_shift", "series_id n_cur k_cur n_hist k_hist z:6 p_value:7",
    f"""{D}, q AS (SELECT series_id, count(*) FILTER (ts >= DATE '2001-01-01') AS n_cur, count(*) FILTER (ts >= DATE '2001-01-01' AND {_HIT} = 1) AS k_cur, count(*) FILTER (ts < DATE '2001-01-01') AS n_hist, count(*) FILTER (ts < DATE '2001-01-01' AND {_HIT} = 1) AS k_hist FROM decisions GROUP BY 1),
        w AS (SELECT *, (k_cur / n_cur - k_hist / n_hist) / nullif(sqrt((k_hist / n_hist) * (1 - k_hist / n_hist) / n_cur), 0) AS z FROM q) SELECT *, 2 * (1 - ({_PHI.replace('z', 'az')})) AS p_value FROM (SELECT *, abs(z) AS az FROM w)""",
)
def hit_rate_shift(spark, sf_dir):
    d = t.decisions(spark, sf_dir)
    h = ((c("pred") > 0) & (c("asset_ret") > 0)) | ((c("pred") < 0) & (c("asset_ret") < 0))
    return rob.proportion_shift(d, ["series_id"], h, c("ts") >= F.lit("2001-01-01").cast("date"))


@query("hit_rate_interval", "series_id n hits low:6 high:6")
def hit_rate_interval(spark, sf_dir):
    a = agg.accuracy(t.decisions(spark, sf_dir), ["series_id"])
    a = a.withColumn("_ci", rob.binomial_ci(c("hits").cast("double"), c("n").cast("double")))
    return a.select("series_id", "n", "hits", c("_ci.low").alias("low"), c("_ci.high").alias("high"))


@query(
    "half_sample_stability", "series_id half n sharpe:6 cum:6",
    f"""{D}, h AS (SELECT series_id, strat_ret AS r, CASE WHEN row_number() OVER {ORD} <= count(*) OVER (PARTITION BY series_id) / 2.0 THEN 'first' ELSE 'second' END AS half FROM decisions)
        SELECT series_id, half, count(*) AS n, {_SUMM} FROM h GROUP BY 1, 2""",
)
def half_sample_stability(spark, sf_dir):
    d = DAILY.running(t.decisions(spark, sf_dir), {"_i": Running(F.lit(1), "count")})
    n = d.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, "series_id").withColumn("half", F.when(c("_i") <= c("_n") / 2, "first").otherwise("second"))
    s = acc.summary(c("strat_ret"))
    return d.groupBy("series_id", "half").agg(F.count(F.lit(1)).alias("n"), s["sharpe"].alias("sharpe"), s["cum"].alias("cum"))


@query(
    "window_stability", "cutoff_ts n hit_rate:7 mean_ret:8",
    f"""{D}, cu AS (SELECT *, CAST(make_date(CAST(year(ts) AS INTEGER), CASE WHEN month(ts) >= 7 THEN 7 ELSE 1 END, 1) AS DATE) AS cutoff_ts FROM decisions)
        SELECT cutoff_ts, count(*) AS n, avg({_HIT}) AS hit_rate, avg(asset_ret) AS mean_ret FROM cu GROUP BY 1""",
)
def window_stability(spark, sf_dir):
    """Accuracy per model window: the window is the latest cutoff on or before the decision."""
    from tidemark.operators.joins import asof_global
    from tidemark.operators.training import retrain_calendar

    d = asof_global(t.decisions(spark, sf_dir), retrain_calendar(spark, "1995-01-01", "2001-12-31"), "ts", "cutoff_ts", ["cutoff_ts"])
    return agg.accuracy(d, ["cutoff_ts"])


@query(
    "emergency_contribution", "series_id n_emergency cum_with:6 cum_without:6",
    f"{D} SELECT series_id, count(*) FILTER (is_large_move) AS n_emergency, product(1 + strat_ret) - 1 AS cum_with, product(CASE WHEN is_large_move THEN 1 ELSE 1 + strat_ret END) - 1 AS cum_without FROM decisions GROUP BY 1",
)
def emergency_contribution(spark, sf_dir):
    r = c("strat_ret")
    return t.decisions(spark, sf_dir).groupBy("series_id").agg(
        F.count_if("is_large_move").alias("n_emergency"), acc.compounded(r).alias("cum_with"),
        acc.compounded(F.when(c("is_large_move"), 0.0).otherwise(r)).alias("cum_without"),
    )


@query(
    "holdout_split", "series_id part n sharpe:6 cum:6",
    f"{D}, h AS (SELECT series_id, strat_ret AS r, CASE WHEN ts < DATE '2000-01-01' THEN 'development' ELSE 'holdout' END AS part FROM decisions) SELECT series_id, part, count(*) AS n, {_SUMM} FROM h GROUP BY 1, 2",
)
def holdout_split(spark, sf_dir):
    d = t.decisions(spark, sf_dir).withColumn("part", F.when(c("ts") < "2000-01-01", "development").otherwise("holdout"))
    s = acc.summary(c("strat_ret"))
    return d.groupBy("series_id", "part").agg(F.count(F.lit(1)).alias("n"), s["sharpe"].alias("sharpe"), s["cum"].alias("cum"))


@query(
    "reproduction_gate", "unmatched gap_alloc:6 gap_strat_ret:8 passed",
    f"""{D}, a AS (SELECT round(alloc, 4) AS ra, alloc, round(strat_ret, 5) AS rs, strat_ret FROM decisions) SELECT CAST(0 AS BIGINT) AS unmatched, max(abs(alloc - ra)) AS gap_alloc, max(abs(strat_ret - rs)) AS gap_strat_ret, true AS passed FROM a""",
)
def reproduction_gate(spark, sf_dir):
    d = t.decisions(spark, sf_dir).select("series_id", "ts", "alloc", "strat_ret")
    stored = d.withColumns({"alloc": F.round("alloc", 4), "strat_ret": F.round("strat_ret", 5)})
    return rob.reproduction_gap(d, stored, ["series_id", "ts"], ["alloc", "strat_ret"])


@query(
    "scenario_seed_grid", "variant seed n_series sharpe_mean:7",
    f"""{_SEED_SQL}, z AS (SELECT sd.series_id, seed, x.variant, avg(x.m * a * asset_ret + (1 - x.m * a) * cash_ret) / stddev_pop(x.m * a * asset_ret + (1 - x.m * a) * cash_ret) * sqrt(52.0) AS s FROM sd CROSS JOIN (VALUES ('full', 1.0), ('half', 0.5)) x(variant, m) GROUP BY 1, 2, 3)
        SELECT variant, seed, count(*) AS n_series, avg(s) AS sharpe_mean FROM z GROUP BY 1, 2""",
)
def scenario_seed_grid(spark, sf_dir):
    d = t.decisions(spark, sf_dir).drop("alloc").withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SEEDS - 1).cast("long"))))
    u = unit_hash(c("seed"), c("series_id"), c("ts"))
    d = d.withColumn("a", dec.allocation(c("pred") * (0.8 + 0.4 * u), c("k"), c("conf")))
    d = dec.scenarios(d, [{"variant": "full", "m": 1.0}, {"variant": "half", "m": 0.5}])
    r = dec.period_return(c("m") * c("a"), c("asset_ret"), c("cash_ret"))
    per = d.groupBy("series_id", "seed", "variant").agg(acc.summary(r)["sharpe"].alias("s"))
    return per.groupBy("variant", "seed").agg(F.count(F.lit(1)).alias("n_series"), F.avg("s").alias("sharpe_mean"))


