"""Decision layer, controls, accounting and metrics over the SQL-defined signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import accounting as acc
from tidemark.operators import controls as ctl
from tidemark.operators import decisions as dec
from tidemark.operators import joins
from tidemark.operators.regimes import sma_regime
from tidemark.operators.training import last_retrain, next_retrain
from tidemark.panel import DAILY, Running
from tidemark.plans import tables as t
from tidemark.plans.catalog import query
from tidemark.plans.feature_queries import ORD, win
from tidemark.plans.flagship import SQL_EQUITY

c = F.col
D = f"WITH {t.SQL_DECISIONS}"


def cl(x, lo="0.0", hi="1.0"):
    return f"greatest(least({x}, {hi}), {lo})"


SIG = "1 / (1 + exp(-abs(p_up - 0.5) * {s}))"

# -- sizing ------------------------------------------------------------------------------------

_CONF = ["sig15", "sig5", "conf1", "signed15"]


@query(
    "confidence_variants", "series_id ts variant conf:8 alloc:10",
    f"""{D}, v AS (SELECT d.series_id, d.ts, d.pred, d.k, x.variant, CASE x.variant WHEN 'sig15' THEN {SIG.format(s=15)} WHEN 'sig5' THEN {SIG.format(s=5)} WHEN 'conf1' THEN 1.0
        ELSE 1 / (1 + exp(-(p_up - 0.5) * CASE WHEN pred >= 0 THEN 1 ELSE -1 END * 15)) END AS conf FROM decisions d CROSS JOIN (VALUES ('sig15'), ('sig5'), ('conf1'), ('signed15')) x(variant))
        SELECT *, {cl('pred * k * conf')} AS alloc FROM v""",
)
def confidence_variants(spark, sf_dir):
    d = dec.scenarios(t.decisions(spark, sf_dir).drop("conf", "alloc"), [{"variant": v} for v in _CONF])
    d = d.withColumn("conf", dec.confidence_variant(c("variant"), c("pred"), c("p_up")))
    return d.withColumn("alloc", dec.allocation(c("pred"), c("k"), c("conf")))


@query(
    "rebalance_calendar", "series_id ts is_large_move on_week_day",
    f"""WITH {t.SQL_SIGNALS}, m AS (SELECT *, coalesce(abs(price / lag(price) OVER {ORD} - 1) > 0.08, false) AS is_large_move FROM signals)
        SELECT series_id, ts, is_large_move, isodow(ts) IN (3, 5) AS on_week_day FROM m WHERE is_large_move OR isodow(ts) IN (3, 5)""",
)
def rebalance_calendar(spark, sf_dir):
    f = DAILY.halo(t.signals(spark, sf_dir), 1)
    ret = R.pct_change("price", DAILY.window(), 1)
    f = f.withColumns({"is_large_move": dec.large_move(ret), "on_week_day": dec.on_calendar(c("ts"), (2, 4))})
    return DAILY.owned(f).filter(c("is_large_move") | c("on_week_day"))


@query(
    "seven_row_emergency", "series_id ts week_ret:8 fires",
    f"""WITH {t.SQL_SIGNALS}, m AS (SELECT series_id, ts, price / lag(price, 7) OVER {ORD} - 1 AS week_ret FROM signals) SELECT series_id, ts, week_ret, coalesce(abs(week_ret) > 0.15, false) AS fires FROM m""",
)
def seven_row_emergency(spark, sf_dir):
    f = DAILY.halo(t.signals(spark, sf_dir), 7)
    f = f.withColumn("week_ret", R.pct_change("price", DAILY.window(), 7))
    return DAILY.owned(f.withColumn("fires", dec.large_move(c("week_ret"), 0.15)))


@query(
    "held_allocation", "series_id ts alloc_held:7",
    f"{D}, j AS (SELECT s.series_id, s.ts, d.alloc FROM signals s LEFT JOIN decisions d USING (series_id, ts)) SELECT series_id, ts, last_value(alloc IGNORE NULLS) OVER {ORD} AS alloc_held FROM j",
)
def held_allocation(spark, sf_dir):
    s = t.signals(spark, sf_dir).select("series_id", "ts")
    j = s.join(t.decisions(spark, sf_dir).select("series_id", "ts", "alloc"), ["series_id", "ts"], "left")
    return dec.hold(j, DAILY, c("alloc"))


@query(
    "suppressed_emergencies", "series_id ts alloc:7 alloc_calm:7",
    f"{D} SELECT series_id, ts, alloc, coalesce(last_value(CASE WHEN NOT is_large_move THEN alloc END IGNORE NULLS) OVER {ORD}, 0) AS alloc_calm FROM decisions",
)
def suppressed_emergencies(spark, sf_dir):
    return dec.suppress(t.decisions(spark, sf_dir), DAILY, c("is_large_move"), "alloc", "alloc_calm")


@query(
    "volatility_overlays", "series_id ts targeted:7 scaled_k:6 cut:7 boosted:6 horizon_k:6",
    f"""{D}, p AS (SELECT series_id, ts, alloc, k, regime, vol30, lag(regime) OVER {ORD} AS pr, coalesce(date_diff('day', lag(ts) OVER {ORD}, ts), 1) AS step FROM decisions),
        g AS (SELECT *, sum(CASE WHEN pr IS DISTINCT FROM regime THEN 1 ELSE 0 END) OVER {ORD} AS grp FROM p),
        h AS (SELECT *, sum(step) OVER (PARTITION BY series_id, grp ORDER BY ts) AS days FROM g)
        SELECT series_id, ts, {cl('alloc * coalesce(greatest(least(0.5 / nullif(vol30, 0), 1.5), 0.5), 1.0)')} AS targeted,
          k * 0.7 / greatest(coalesce(vol30, 0.7), 0.1) AS scaled_k, alloc * CASE WHEN vol30 > 0.8 THEN 0.5 ELSE 1.0 END AS cut,
          CASE WHEN regime = 'BULL' AND days >= 60 THEN k * 1.5 ELSE k END AS boosted, k * 3 / 7 AS horizon_k FROM h""",
)
def volatility_overlays(spark, sf_dir):
    from tidemark.operators.regimes import days_in_state

    d = days_in_state(t.decisions(spark, sf_dir), DAILY, "regime", "days")
    return d.select(
        "series_id", "ts",
        dec.vol_target(c("alloc"), c("vol30"), 0.5, 0.5, 1.5).alias("targeted"),
        dec.vol_scaled_k(c("k"), c("vol30")).alias("scaled_k"),
        dec.vol_cut(c("alloc"), c("vol30"), 0.8, 0.5).alias("cut"),
        dec.persistence_boost(c("k"), c("regime"), c("days"), 60, 1.5).alias("boosted"),
        dec.horizon_scaled(c("k"), 7).alias("horizon_k"),
    )


_POL = ["model", "hybrid", "regime_only", "hold", "flat_k", "no_confidence", "sign_only", "model_in_bear"]
_POL_SQL = f"""{D}, pol AS (SELECT d.*, x.policy, CASE x.policy WHEN 'model' THEN alloc WHEN 'hybrid' THEN CASE WHEN regime = 'BULL' THEN 1.0 ELSE alloc END
  WHEN 'regime_only' THEN CASE regime WHEN 'BULL' THEN 1.0 WHEN 'MILD' THEN 0.5 ELSE 0.0 END WHEN 'hold' THEN 1.0 WHEN 'flat_k' THEN {cl('pred * 50 * conf')}
  WHEN 'no_confidence' THEN {cl('pred * k')} WHEN 'sign_only' THEN CASE WHEN pred > 0 THEN 0.5 ELSE 0.0 END ELSE CASE WHEN regime = 'BEAR' THEN alloc ELSE 1.0 END END AS pa
  FROM decisions d CROSS JOIN (VALUES {', '.join(f"('{p}')" for p in _POL)}) x(policy))"""


def policies(spark, sf_dir):
    d = dec.scenarios(t.decisions(spark, sf_dir), [{"policy": p} for p in _POL])
    a = dec.attribution_policy(c("policy"), c("pred"), c("regime"), c("conf"))
    d = d.withColumn("pa", a)
    return d.withColumn("pr", dec.period_return(c("pa"), c("asset_ret"), c("cash_ret")))


@query(
    "attribution_policies", "series_id policy n mean_alloc:7 cum:5",
    f"{_POL_SQL} SELECT series_id, policy, count(*) AS n, avg(pa) AS mean_alloc, product(1 + pa * asset_ret + (1 - pa) * cash_ret) - 1 AS cum FROM pol GROUP BY 1, 2",
)
def attribution_policies(spark, sf_dir):
    return policies(spark, sf_dir).groupBy("series_id", "policy").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pa").alias("mean_alloc"), acc.compounded(c("pr")).alias("cum")
    )


_QV = ["mean", "median", "kelly", "positive_floor", "spread", "hybrid"]


@query(
    "quantile_sizing", "series_id ts variant alloc:7",
    f"""{D}, b AS (SELECT series_id, ts, pred, k, conf, pred - 0.02 - 0.1 * abs(asset_ret) AS q10, pred * 0.9 AS q50, pred + 0.03 + 0.1 * abs(cash_ret) AS q90 FROM decisions),
        r AS (SELECT series_id, quantile_cont(q90 - q10, 0.75) AS ref FROM b GROUP BY 1)
        SELECT series_id, ts, variant, CASE variant WHEN 'mean' THEN {cl('pred * k * conf')} WHEN 'median' THEN {cl('q50 * k * conf')}
          WHEN 'kelly' THEN CASE WHEN q50 > 0 THEN {cl('q50 / greatest(abs(q10), 1e-4) * 0.1 * conf')} ELSE 0.0 END
          WHEN 'positive_floor' THEN CASE WHEN q10 > 0 THEN {cl('pred * k * conf')} ELSE 0.0 END
          WHEN 'spread' THEN {cl('pred * (k * greatest(least(ref / greatest(q90 - q10, 1e-4), 1.0), 0.3)) * conf')}
          ELSE CASE WHEN q10 > 0 THEN {cl('q50 * k * conf')} ELSE 0.0 END END AS alloc
        FROM b JOIN r USING (series_id) CROSS JOIN (VALUES {', '.join(f"('{v}')" for v in _QV)}) x(variant)""",
)
def quantile_sizing(spark, sf_dir):
    from tidemark.operators.quantiles import exact_quantiles

    d = t.decisions(spark, sf_dir).select(
        "series_id", "ts", "pred", "k", "conf", (c("pred") - 0.02 - 0.1 * F.abs("asset_ret")).alias("q10"),
        (c("pred") * 0.9).alias("q50"), (c("pred") + 0.03 + 0.1 * F.abs("cash_ret")).alias("q90"),
    ).withColumn("spread", c("q90") - c("q10"))
    ref = exact_quantiles(d, ["series_id"], "spread", [0.75], "_ref")
    d = dec.scenarios(d.join(ref, "series_id"), [{"variant": v} for v in _QV])
    a = dec.quantile_sizing(c("variant"), c("pred"), c("q10"), c("q50"), c("q90"), c("k"), c("conf"), c("_ref")[0])
    return d.withColumn("alloc", a)


_FLOORS = [0.0, -0.1, -0.25, -0.5, -1.0]


@query(
    "short_floor_sweep", "series_id floor n share_short:7 mean_short:7 cum:5",
    f"""{D}, f AS (SELECT d.*, x.floor, greatest(least(pred * k * conf, 1.0), x.floor) AS a FROM decisions d CROSS JOIN (VALUES {', '.join(f'({v})' for v in _FLOORS)}) x(floor))
        SELECT series_id, CAST(floor AS DOUBLE) AS floor, count(*) AS n, avg(CASE WHEN a < 0 THEN 1.0 ELSE 0.0 END) AS share_short, avg(CASE WHEN a < 0 THEN a END) AS mean_short, product(1 + a * asset_ret + (1 - a) * cash_ret) - 1 AS cum FROM f GROUP BY 1, 2""",
)
def short_floor_sweep(spark, sf_dir):
    d = dec.scenarios(t.decisions(spark, sf_dir), [{"floor": v} for v in _FLOORS])
    d = d.withColumn("a", dec.allocation(c("pred"), c("k"), c("conf"), lo=c("floor")))
    r = dec.period_return(c("a"), c("asset_ret"), c("cash_ret"))
    return d.groupBy("series_id", "floor").agg(
        F.count(F.lit(1)).alias("n"), F.avg((c("a") < 0).cast("double")).alias("share_short"),
        F.avg(F.when(c("a") < 0, c("a"))).alias("mean_short"), acc.compounded(r).alias("cum"),
    )


@query(
    "static_benchmarks", "series_id mix n cum:6",
    f"""WITH {t.SQL_SIGNALS}, d AS (SELECT series_id, ts, coalesce(day_ret, 0) AS r, cash_rate AS q, date_trunc('week', ts) AS wk FROM signals),
        st AS (SELECT series_id, x.mix, product(1 + x.w * r + (1 - x.w) * q) - 1 AS cum, count(*) AS n FROM d CROSS JOIN (VALUES ('cash', 0.0), ('30', 0.3), ('50', 0.5), ('hold', 1.0)) x(mix, w) GROUP BY 1, 2),
        wk AS (SELECT series_id, wk, 0.3 * product(1 + r) + 0.7 * product(1 + q) AS g, count(*) AS n FROM d GROUP BY 1, 2)
        SELECT series_id, mix, n, cum FROM st UNION ALL SELECT series_id, 'weekly 30', CAST(sum(n) AS BIGINT), product(g) - 1 FROM wk GROUP BY 1""",
)
def static_benchmarks(spark, sf_dir):
    """Constant mixes rebalanced daily, and 30/70 left to drift inside each week."""
    d = t.signals(spark, sf_dir).select("series_id", "ts", F.coalesce("day_ret", F.lit(0.0)).alias("r"), c("cash_rate").alias("q"))
    grid = [{"mix": "cash", "w": 0.0}, {"mix": "30", "w": 0.3}, {"mix": "50", "w": 0.5}, {"mix": "hold", "w": 1.0}]
    fixed = dec.scenarios(d, grid).groupBy("series_id", "mix").agg(
        F.count(F.lit(1)).alias("n"), acc.compounded(dec.period_return(c("w"), c("r"), c("q"))).alias("cum")
    )
    weeks = d.groupBy("series_id", F.date_trunc("week", "ts").alias("wk")).agg(
        (0.3 * F.product(1 + c("r")) + 0.7 * F.product(1 + c("q"))).alias("g"), F.count(F.lit(1)).alias("n")
    )
    drift = weeks.groupBy("series_id").agg(F.sum("n").alias("n"), (F.product("g") - 1).alias("cum"))
    return fixed.unionByName(drift.withColumn("mix", F.lit("weekly 30")))


@query(
    "missed_decisions", "series_id ts cutoff_ts",
    f"""{D}, lg AS (SELECT series_id, ts FROM decisions WHERE ts < DATE '2000-03-01' AND dayofyear(ts) % 5 <> 0),
        mx AS (SELECT series_id, max(ts) AS m FROM lg GROUP BY 1), cu AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '2001-07-01', INTERVAL 6 MONTH)) AS DATE) AS cutoff_ts)
        SELECT d.series_id, d.ts, (SELECT max(cutoff_ts) FROM cu WHERE cutoff_ts < d.ts) AS cutoff_ts FROM decisions d JOIN mx USING (series_id) ANTI JOIN lg USING (series_id, ts) WHERE d.ts > m""",
)
def missed_decisions(spark, sf_dir):
    d = t.decisions(spark, sf_dir).select("series_id", "ts")
    logged = d.filter((c("ts") < "2000-03-01") & (F.dayofyear("ts") % 5 != 0))
    months = F.sequence(F.lit("1996-01-01").cast("date"), F.lit("2001-07-01").cast("date"), F.expr("INTERVAL 6 MONTH"))
    models = spark.range(1).select(F.explode(months).alias("cutoff_ts"))
    return dec.missed(d, logged, ["series_id", "ts"], models)


@query(
    "action_text", "series_id ts action emergency_ret backfilled",
    f"""{D} SELECT series_id, ts, action, emergency_ret, contains(action, '[BACKFILLED') AS backfilled FROM (SELECT *, CASE WHEN is_large_move THEN CAST(format('{{:+.1f}}', daily_ret * 100) AS DOUBLE) END AS emergency_ret,
        format('ALLOC {{:.1f}}%', alloc * 100) || CASE WHEN is_large_move THEN format(' EMERGENCY (ret {{:+.1f}}%)', daily_ret * 100) ELSE '' END || CASE WHEN month(ts) = 7 THEN ' [BACKFILLED]' ELSE '' END AS action FROM decisions)""",
)
def action_text(spark, sf_dir):
    from tidemark.operators.reporting import action_fields

    d = t.decisions(spark, sf_dir)
    d = d.withColumn("action", dec.action_label(c("alloc"), c("is_large_move"), c("daily_ret"), F.month("ts") == 7))
    return d.withColumns(action_fields(c("action")))


@query(
    "forecast_health", "series_id n accuracy:7",
    f"""WITH {t.SQL_SIGNALS}, x AS (SELECT series_id, pred, lead(price) OVER {ORD} - price AS d, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS r FROM signals)
        SELECT series_id, count(*) AS n, CASE WHEN count(*) >= 10 THEN avg(CASE WHEN (pred > 0 AND d > 0) OR (pred < 0 AND d < 0) THEN 1.0 ELSE 0.0 END) END AS accuracy FROM x WHERE r <= 60 AND d IS NOT NULL GROUP BY 1""",
)
def forecast_health(spark, sf_dir):
    return ctl.health(t.signals(spark, sf_dir), DAILY)


@query(
    "outlying_features", "series_id feature z:6 alert",
    f"""WITH {t.SQL_SIGNALS}, u AS (SELECT series_id, ts, feature, x FROM signals UNPIVOT (x FOR feature IN (day_ret, vol30, pred))),
        n AS (SELECT s.series_id, s.ts, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS r FROM signals s),
        j AS (SELECT u.*, r FROM u JOIN n USING (series_id, ts)),
        z AS (SELECT series_id, feature, (max(CASE WHEN r = 1 THEN x END) - avg(CASE WHEN r > 30 THEN x END)) / stddev_samp(CASE WHEN r > 30 THEN x END) AS z FROM j GROUP BY 1, 2)
        SELECT *, coalesce(abs(z) > 4, false) AS alert FROM z""",
)
def outlying_features(spark, sf_dir):
    return ctl.outlying_now(t.signals(spark, sf_dir), DAILY, ["day_ret", "vol30", "pred"])


# -- controls ----------------------------------------------------------------------------------


@query(
    "closed_drawdown", "series_id n_closed current_dd:8",
    f"""{D}, cl AS (SELECT *, product(1 + strat_ret) OVER {ORD} AS g FROM decisions WHERE next_ts < DATE '2001-07-01'), p AS (SELECT *, max(g) OVER {ORD} AS pk FROM cl)
        SELECT series_id, count(*) AS n_closed, CASE WHEN count(*) >= 2 THEN arg_max(g / pk - 1, ts) ELSE 0 END AS current_dd FROM p GROUP BY 1""",
)
def closed_drawdown(spark, sf_dir):
    d = t.decisions(spark, sf_dir).withColumn("strat_ret", F.when(c("next_ts") < "2001-07-01", c("strat_ret")))
    return ctl.current_drawdown(d, DAILY)


_HIT = "CASE WHEN (pred > 0 AND asset_ret > 0) OR (pred < 0 AND asset_ret < 0) THEN 1.0 ELSE 0.0 END"


@query(
    "rolling_quality", "series_id ts rolling_acc:7 rolling_conf:7",
    f"{D} SELECT series_id, ts, CASE WHEN count(*) OVER {win(12)} >= 12 THEN avg({_HIT}) OVER {win(12)} END AS rolling_acc, CASE WHEN count(*) OVER {win(12)} >= 12 THEN avg(conf) OVER {win(12)} END AS rolling_conf FROM decisions",
)
def rolling_quality(spark, sf_dir):
    return ctl.rolling_quality(t.decisions(spark, sf_dir), DAILY)


@query(
    "control_status", "series_id ts controlled_alloc:7 kill_active derisked n_warnings",
    f"""WITH {SQL_EQUITY}, q AS (SELECT *, CASE WHEN count(*) OVER {win(12)} >= 12 THEN avg({_HIT}) OVER {win(12)} END AS ra, CASE WHEN count(*) OVER {win(12)} >= 12 THEN avg(conf + 0.25) OVER {win(12)} END AS rc FROM eqd),
        s AS (SELECT *, coalesce(drawdown <= -0.12, false) AS kill, coalesce(ra < 0.48 AND rc > 0.80, false) AS weak, coalesce(ra < 0.48 AND rc <= 0.80, false) AS unsure FROM q)
        SELECT series_id, ts, CASE WHEN kill THEN least(alloc, 0.15) ELSE alloc END * CASE WHEN weak THEN 0.5 ELSE 1 END AS controlled_alloc, kill AS kill_active, weak AS derisked,
          CAST(kill AS INTEGER) + CAST(weak AS INTEGER) + CAST(unsure AS INTEGER) AS n_warnings FROM s""",
)
def control_status(spark, sf_dir):
    d = acc.equity(t.decisions(spark, sf_dir).withColumn("conf", c("conf") + 0.25), DAILY, "strat_ret")
    d = ctl.rolling_quality(d, DAILY)
    d = d.withColumns(ctl.apply_controls(c("alloc"), c("drawdown"), c("rolling_acc"), c("rolling_conf"), derisk=True))
    return d.withColumn("n_warnings", F.size("warnings"))


_PATH_SQL = f"""WITH RECURSIVE {t.SQL_DECISIONS}, b AS (SELECT d.*, x.derisk, row_number() OVER (PARTITION BY series_id, x.derisk ORDER BY ts) AS rn,
    avg({_HIT}) OVER (PARTITION BY series_id, x.derisk ORDER BY ts ROWS BETWEEN 13 PRECEDING AND 2 PRECEDING) AS ra,
    avg(conf) OVER (PARTITION BY series_id, x.derisk ORDER BY ts ROWS BETWEEN 13 PRECEDING AND 2 PRECEDING) AS rc
    FROM decisions d CROSS JOIN (VALUES ('none'), ('plain48'), ('confgate')) x(derisk)),
  m AS (SELECT *, CASE WHEN rn - 2 >= 12 AND ra < 0.48 AND (derisk = 'plain48' OR (derisk = 'confgate' AND rc > 0.80)) THEN 0.5 ELSE 1.0 END AS mult FROM b),
  st AS (
    SELECT series_id, derisk, rn, alloc * mult AS a, alloc * mult * asset_ret + (1 - alloc * mult) * cash_ret AS r, CAST(1.0 AS DOUBLE) AS g2, CAST(0.0 AS DOUBLE) AS p2, CAST(1.0 AS DOUBLE) AS g1, CAST(0.0 AS DOUBLE) AS p1, CAST(1.0 AS DOUBLE) AS seen FROM m WHERE rn = 1
    UNION ALL
    SELECT n.series_id, n.derisk, n.rn, n.a, n.a * n.asset_ret + (1 - n.a) * n.cash_ret, n.g2, n.p2, n.g1, n.p1, CAST(n.rn AS DOUBLE) FROM (
      SELECT m.series_id, m.derisk, m.rn, m.asset_ret, m.cash_ret, s.g1 AS g2, s.p1 AS p2, s.g1 * (1 + s.r) AS g1, greatest(s.p1, s.g1 * (1 + s.r)) AS p1,
        CASE WHEN m.rn - 1 >= 3 AND s.g1 / s.p1 - 1 <= -0.12 THEN least(m.alloc, 0.15) ELSE m.alloc END * m.mult AS a
      FROM st s JOIN m ON m.series_id = s.series_id AND m.derisk = s.derisk AND m.rn = s.rn + 1) n)"""


@query(
    "path_dependent_controls", "series_id derisk ts controlled_alloc:7 controlled_ret:7",
    f"{_PATH_SQL} SELECT m.series_id, m.derisk, m.ts, st.a AS controlled_alloc, st.r AS controlled_ret FROM st JOIN m ON m.series_id = st.series_id AND m.derisk = st.derisk AND m.rn = st.rn",
)
def path_dependent_controls(spark, sf_dir):
    d = dec.scenarios(t.decisions(spark, sf_dir), [{"derisk": v} for v in ("none", "plain48", "confgate")])
    return ctl.path_controls(d, DAILY.by("derisk"))


@query(
    "one_pass_controls", "series_id ts controlled_alloc:7",
    f"""{D}, g AS (SELECT *, product(1 + strat_ret) OVER {ORD} AS g FROM decisions), p AS (SELECT *, g / max(g) OVER {ORD} - 1 AS dd FROM g),
        q AS (SELECT *, lag(dd) OVER {ORD} AS pdd, count(*) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS n,
          avg({_HIT}) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS ra FROM p)
        SELECT series_id, ts, CASE WHEN pdd <= -0.12 THEN least(alloc, 0.15) ELSE alloc END * CASE WHEN n >= 12 AND ra < 0.48 THEN 0.5 ELSE 1.0 END AS controlled_alloc FROM q""",
)
def one_pass_controls(spark, sf_dir):
    return ctl.one_pass_controls(t.decisions(spark, sf_dir), DAILY)


_RULES = ["none", "threshold", "ramp", "conf_gate", "vol_gate"]


@query(
    "derisk_alternatives", "series_id rule mean_alloc:7 cum:5",
    f"""{D}, q AS (SELECT *, CASE WHEN count(*) OVER {win(12)} >= 12 THEN avg({_HIT}) OVER {win(12)} END AS ra, CASE WHEN count(*) OVER {win(12)} >= 12 THEN avg(conf) OVER {win(12)} END AS rc FROM decisions),
        a AS (SELECT q.*, x.rule, alloc * coalesce(CASE x.rule WHEN 'threshold' THEN CASE WHEN ra < 0.48 THEN 0.5 ELSE 1.0 END WHEN 'ramp' THEN CASE WHEN ra IS NOT NULL THEN least(greatest((ra - 0.4) / (0.55 - 0.4), 0.0), 1.0) * 0.5 + 0.5 END
          WHEN 'conf_gate' THEN CASE WHEN ra < 0.48 AND rc > 0.8 THEN 0.5 ELSE 1.0 END WHEN 'vol_gate' THEN CASE WHEN ra < 0.48 AND vol30 > 0.8 THEN 0.5 ELSE 1.0 END END, 1.0) AS na FROM q CROSS JOIN (VALUES {', '.join(f"('{r}')" for r in _RULES)}) x(rule))
        SELECT series_id, rule, avg(na) AS mean_alloc, product(1 + na * asset_ret + (1 - na) * cash_ret) - 1 AS cum FROM a GROUP BY 1, 2""",
)
def derisk_alternatives(spark, sf_dir):
    q = ctl.rolling_quality(t.decisions(spark, sf_dir), DAILY)
    q = q.withColumn("ramp_acc", c("rolling_acc"))
    d = dec.scenarios(q, [{"rule": r} for r in _RULES])
    a = ctl.derisk_rule(c("rule"), c("alloc"), c("rolling_acc"), c("rolling_conf"), c("vol30"))
    a = F.when((c("rule") == "ramp") & c("rolling_acc").isNull(), c("alloc")).otherwise(a)
    d = d.withColumn("na", a)
    return d.groupBy("series_id", "rule").agg(
        F.avg("na").alias("mean_alloc"), acc.compounded(dec.period_return(c("na"), c("asset_ret"), c("cash_ret"))).alias("cum")
    )


@query(
    "psi_panel", "series_id feature psi:6 n_base n_cur",
    f"""WITH {t.SQL_SIGNALS}, u AS (SELECT series_id, ts, feature, x FROM signals UNPIVOT (x FOR feature IN (day_ret, vol30, pred))),
        e AS (SELECT series_id, max(ts) AS e FROM signals GROUP BY 1), r AS (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS r FROM signals),
        base AS (SELECT u.* FROM u JOIN e USING (series_id) WHERE ts <= e - INTERVAL 2 MONTH AND ts >= (e - INTERVAL 2 MONTH) - INTERVAL 12 MONTH),
        cur AS (SELECT u.* FROM u JOIN r USING (series_id, ts) WHERE r <= 60),
        ed AS (SELECT series_id, feature, list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS eds FROM base GROUP BY 1, 2),
        b AS (SELECT series_id, feature, len(list_filter(eds, lambda q: q <= x)) AS bin, count(*) AS nb FROM base JOIN ed USING (series_id, feature) GROUP BY 1, 2, 3),
        k AS (SELECT series_id, feature, len(list_filter(eds, lambda q: q <= x)) AS bin, count(*) AS nc FROM cur JOIN ed USING (series_id, feature) GROUP BY 1, 2, 3),
        j AS (SELECT series_id, feature, bin, coalesce(nb, 0) AS nb, coalesce(nc, 0) AS nc FROM b FULL JOIN k USING (series_id, feature, bin)),
        s AS (SELECT *, sum(nb) OVER (PARTITION BY series_id, feature) AS tb, sum(nc) OVER (PARTITION BY series_id, feature) AS tc FROM j),
        p AS (SELECT *, CASE WHEN nb = 0 THEN 1e-6 ELSE nb / tb END AS pb, CASE WHEN nc = 0 THEN 1e-6 ELSE nc / tc END AS pc FROM s)
        SELECT series_id, feature, sum((pc - pb) * ln(pc / pb)) AS psi, CAST(max(tb) AS BIGINT) AS n_base, CAST(max(tc) AS BIGINT) AS n_cur FROM p GROUP BY 1, 2""",
)
def psi_panel(spark, sf_dir):
    return ctl.psi_panel(t.signals(spark, sf_dir), DAILY, ["day_ret", "vol30", "pred"])


@query(
    "mean_shift", "series_id feature hist_mean:7 cur_mean:7 z:6",
    f"""WITH {t.SQL_SIGNALS}, u AS (SELECT series_id, ts, feature, x FROM signals UNPIVOT (x FOR feature IN (day_ret, vol30, pred)))
        SELECT series_id, feature, avg(x) FILTER (ts < DATE '2001-01-01') AS hist_mean, avg(x) FILTER (ts >= DATE '2001-01-01') AS cur_mean,
          (avg(x) FILTER (ts >= DATE '2001-01-01') - avg(x) FILTER (ts < DATE '2001-01-01')) / stddev_samp(x) FILTER (ts < DATE '2001-01-01') AS z FROM u GROUP BY 1, 2""",
)
def mean_shift(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    return ctl.mean_shift(s, ["series_id"], ["day_ret", "vol30", "pred"], c("ts") >= F.lit("2001-01-01").cast("date"), top=0)


_CUT = "CAST(make_date(CAST(year(ts) AS INTEGER), CASE WHEN month(ts) >= 7 THEN 7 ELSE 1 END, 1) AS DATE)"
_NEXT_CUT = "CAST(make_date(CAST(year(ts) AS INTEGER) + CASE WHEN month(ts) >= 7 THEN 1 ELSE 0 END, CASE WHEN month(ts) >= 7 THEN 1 ELSE 7 END, 1) AS DATE)"


@query(
    "retrain_triggers", "series_id ts drawdown_since:8 vol_ratio:7 drawdown_fired accuracy_fired volatility_fired move_fired any_fired",
    f"""WITH {SQL_EQUITY}, q AS (SELECT *, {_CUT} AS cut, CASE WHEN count(*) OVER {win(8)} >= 8 THEN avg({_HIT}) OVER {win(8)} END AS ra FROM eqd),
        s AS (SELECT *, equity / max(equity) OVER c - 1 AS drawdown_since, vol30 / nullif(first_value(vol30 IGNORE NULLS) OVER c, 0) AS vol_ratio FROM q
              WINDOW c AS (PARTITION BY series_id, cut ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        f AS (SELECT series_id, ts, drawdown_since, vol_ratio, coalesce(drawdown_since <= -0.1, false) AS drawdown_fired, coalesce(ra < 0.4, false) AS accuracy_fired,
                coalesce(vol_ratio > 1.5 OR vol_ratio < 1 / 1.5, false) AS volatility_fired, coalesce(abs(asset_ret) > 0.15, false) AS move_fired FROM s)
        SELECT *, drawdown_fired OR accuracy_fired OR volatility_fired OR move_fired AS any_fired FROM f""",
)
def retrain_triggers(spark, sf_dir):
    """Conditions since the last scheduled retrain."""
    d = acc.equity(t.decisions(spark, sf_dir), DAILY, "strat_ret")
    d = ctl.rolling_quality(d, DAILY, window=8).withColumn("_cut", last_retrain(c("ts")))
    d = ctl.since_retrain(d, DAILY, "_cut")
    return d.withColumns(
        {
            "drawdown_fired": ctl.trigger({"drawdown": 0.1}),
            "accuracy_fired": ctl.trigger({"accuracy": 0.4}),
            "volatility_fired": ctl.trigger({"volatility": 1.5}),
            "move_fired": ctl.trigger({"big_move": 0.15}),
            "any_fired": ctl.trigger({"drawdown": 0.1, "accuracy": 0.4, "volatility": 1.5, "big_move": 0.15}),
        }
    )


@query(
    "spaced_retrains", "series_id ts",
    f"""WITH RECURSIVE {t.SQL_DECISIONS}, f AS (SELECT series_id, ts FROM decisions WHERE abs(asset_ret) > 0.08),
        w AS (SELECT series_id, min(ts) AS ts FROM f GROUP BY 1 UNION ALL
          SELECT w.series_id, (SELECT min(f.ts) FROM f WHERE f.series_id = w.series_id AND f.ts >= w.ts + INTERVAL 30 DAY) FROM w WHERE w.ts IS NOT NULL)
        SELECT series_id, ts FROM w WHERE ts IS NOT NULL""",
)
def spaced_retrains(spark, sf_dir):
    return ctl.spaced_events(t.decisions(spark, sf_dir), ["series_id"], "ts", F.abs("asset_ret") > 0.08, 30)


@query(
    "regime_shift_trigger", "series_id ts trained shift_fired",
    f"""{D}, rg AS (SELECT series_id, {_NEXT_CUT} AS cut, ts, CASE WHEN sma_short IS NULL OR sma_long IS NULL OR price IS NULL THEN 'MILD'
          WHEN price > sma_short AND sma_short > sma_long THEN 'BULL' WHEN price > sma_long THEN 'MILD' ELSE 'BEAR' END AS r FROM signals),
        rn AS (SELECT series_id, cut, r, row_number() OVER (PARTITION BY series_id, cut ORDER BY count(*) DESC, r) AS i FROM rg WHERE date_diff('day', ts, cut) <= 30 GROUP BY 1, 2, 3),
        o AS (SELECT d.series_id, ts, {_CUT} AS cut, regime FROM decisions d), t AS (SELECT o.*, coalesce(rn.r, 'MILD') AS trained, regime <> coalesce(rn.r, 'MILD') AS oth FROM o LEFT JOIN rn ON rn.series_id = o.series_id AND rn.cut = o.cut AND rn.i = 1),
        p AS (SELECT *, sum(CASE WHEN oth IS DISTINCT FROM po THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, cut ORDER BY ts) AS g FROM (SELECT *, lag(oth) OVER (PARTITION BY series_id, cut ORDER BY ts) AS po FROM t))
        SELECT series_id, ts, trained, oth AND row_number() OVER (PARTITION BY series_id, cut, g ORDER BY ts) >= 4 AS shift_fired FROM p""",
)
def regime_shift_trigger(spark, sf_dir):
    """Four decisions in a row, since the last retrain, in another regime than it was trained in."""
    s = t.signals(spark, sf_dir).withColumn("regime", sma_regime(c("price"), c("sma_short"), c("sma_long")))
    trained = ctl.trained_regime(s.select("series_id", "ts", "regime"), DAILY, "regime", next_retrain(c("ts")))
    d = t.decisions(spark, sf_dir).select("series_id", "ts", "regime").withColumn("cutoff_ts", last_retrain(c("ts")))
    d = d.join(trained, ["series_id", "cutoff_ts"], "left").withColumn("trained", F.coalesce("trained", F.lit("MILD")))
    return ctl.regime_shift(d, DAILY.by("cutoff_ts"), "trained", "regime", 4)


@query(
    "realised_volatility_scaled_k", "series_id ts realised:8 scaled_k:6",
    f"""WITH {t.SQL_SIGNALS}, l AS (SELECT series_id, ts, ln(price / lag(price) OVER {ORD}) AS x FROM signals),
        r AS (SELECT series_id, ts, CASE WHEN count(x) OVER {win(20)} = 20 THEN stddev_pop(x) OVER {win(20)} * sqrt(365.0) END AS realised FROM l)
        SELECT *, 30.0 * greatest(least(0.7 / greatest(coalesce(realised, 0.7), 0.1), 1.5), 0.5) AS scaled_k FROM r""",
)
def realised_volatility_scaled_k(spark, sf_dir):
    """K by the population deviation of the last 20 log returns."""
    f = DAILY.halo(t.signals(spark, sf_dir).select("series_id", "ts", "price"), 21)
    f = f.withColumn("x", F.ln(c("price") / F.lag("price", 1).over(DAILY.window())))
    w = R.frame(DAILY.window(), 20)
    f = f.withColumn("realised", F.when(F.count("x").over(w) == 20, F.stddev_pop("x").over(w) * F.sqrt(F.lit(365.0))))
    return DAILY.owned(f).withColumn("scaled_k", dec.vol_scaled_k(F.lit(30.0), c("realised"), lo=0.5, hi=1.5))


# -- accounting --------------------------------------------------------------------------------


@query("cash_accrual", "ts cash_rate:12", f"SELECT ts, {t.SQL_CASH} AS cash_rate FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders)")
def cash_accrual(spark, sf_dir):
    days = t.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("ts")).distinct()
    return acc.cash_from_steps(days, t.rate_steps(spark))


_OBS = "o AS (SELECT CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) / 1e9 AS rate FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1)"


def _observed(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").withColumn("ts", F.to_date("o_orderdate")).filter(F.weekday("ts") < 5)
    return o.groupBy("ts").agg((F.avg("o_totalprice") / 1e9).alias("rate"))


@query(
    "observed_cash", "series_id ts cash_rate:10",
    f"WITH {t.SQL_PANEL}, {_OBS} SELECT series_id, ts, coalesce(rate, 0) AS cash_rate FROM panel LEFT JOIN o USING (ts)",
)
def observed_cash(spark, sf_dir):
    return acc.cash_from_observed(t.panel(spark, sf_dir).select("series_id", "ts"), _observed(spark, sf_dir))


@query(
    "observed_cash_summary", "year n_days mean_rate:10 annualised:8 total:8",
    f"WITH {_OBS} SELECT CAST(year(ts) AS INTEGER) AS year, count(rate) AS n_days, avg(rate) AS mean_rate, pow(1 + avg(rate), 252) - 1 AS annualised, product(1 + rate) - 1 AS total FROM o GROUP BY 1",
)
def observed_cash_summary(spark, sf_dir):
    return acc.cash_summary(_observed(spark, sf_dir))


_MTM = f"""{D}, dm AS (SELECT s.series_id, s.ts, coalesce(s.day_ret, 0) AS r, s.cash_rate AS q, d.alloc AS a FROM signals s ASOF JOIN decisions d ON s.series_id = d.series_id AND s.ts > d.ts),
  daily AS (SELECT series_id, ts, a AS alloc, r AS asset_ret, q AS cash_ret, a * r + (1 - a) * q AS strat_ret FROM dm)"""


def mark_to_market(spark, sf_dir):
    from tidemark.stage import staged_once

    return staged_once(
        spark, "daily", (sf_dir,),
        lambda: acc.daily_mark_to_market(t.daily_returns(spark, sf_dir), t.decisions(spark, sf_dir), DAILY),
    )


@query("daily_mark_to_market", "series_id ts alloc:7 strat_ret:8", f"{_MTM} SELECT * FROM daily")
def daily_mark_to_market(spark, sf_dir):
    return acc.daily_mark_to_market(t.daily_returns(spark, sf_dir), t.decisions(spark, sf_dir), DAILY)


@query(
    "same_day_step_fill", "series_id ts strat_ret:8",
    f"{D} SELECT s.series_id, s.ts, d.alloc * coalesce(s.day_ret, 0) + (1 - d.alloc) * s.cash_rate AS strat_ret FROM signals s ASOF JOIN decisions d ON s.series_id = d.series_id AND s.ts >= d.ts",
)
def same_day_step_fill(spark, sf_dir):
    return acc.daily_mark_to_market(t.daily_returns(spark, sf_dir), t.decisions(spark, sf_dir), DAILY, same_day=True)


@query(
    "transaction_costs", "series_id bps total_turnover:6 net_cum:5",
    f"""{D}, k AS (SELECT d.*, x.bps, abs(alloc - coalesce(lag(alloc) OVER (PARTITION BY series_id, x.bps ORDER BY ts), 0)) AS tv FROM decisions d CROSS JOIN (VALUES (0.0), (5.0), (10.0), (25.0)) x(bps))
        SELECT series_id, CAST(bps AS DOUBLE) AS bps, sum(tv) AS total_turnover, product(1 + strat_ret - tv * bps / 10000) - 1 AS net_cum FROM k GROUP BY 1, 2""",
)
def transaction_costs(spark, sf_dir):
    d = dec.scenarios(t.decisions(spark, sf_dir), [{"bps": b} for b in (0.0, 5.0, 10.0, 25.0)])
    d = acc.transaction_cost(d, DAILY.by("bps"), "alloc", c("bps"), "strat_ret")
    return d.groupBy("series_id", "bps").agg(F.sum("turnover").alias("total_turnover"), acc.compounded(c("net_ret")).alias("net_cum"))


@query(
    "implied_cash", "series_id ts implied:8 repaired:8",
    f"""{D}, r AS (SELECT *, CASE WHEN 1 - alloc > 1e-3 THEN (strat_ret - alloc * asset_ret) / (1 - alloc) ELSE 0.0021 END AS implied,
          CASE WHEN alloc <= 0.001 THEN strat_ret WHEN alloc < 0.9 THEN (strat_ret - alloc * asset_ret) / (1 - alloc) END AS raw FROM decisions),
        b AS (SELECT *, CASE WHEN raw IS NOT NULL THEN {cl('raw', '0.0', '0.008')} END AS rc FROM r),
        m AS (SELECT *, median(rc) OVER {win(8)} AS m8, (SELECT median(rc) FROM b b2 WHERE b2.series_id = b.series_id) AS md FROM b)
        SELECT series_id, ts, implied, coalesce(rc, m8, md) AS repaired FROM m""",
)
def implied_cash(spark, sf_dir):
    d = t.decisions(spark, sf_dir)
    d = d.withColumn("implied", acc.implied_cash(c("strat_ret"), c("alloc"), c("asset_ret")))
    return acc.repaired_cash(d, DAILY, "strat_ret", "alloc", "asset_ret", "repaired")


@query(
    "geometric_spread", "series_id ts n_days daily:10",
    f"{D} SELECT series_id, ts, CAST(date_diff('day', ts, next_ts) AS INTEGER) AS n_days, pow(1 + cash_ret, 1.0 / greatest(date_diff('day', ts, next_ts), 1)) - 1 AS daily FROM decisions",
)
def geometric_spread(spark, sf_dir):
    d = t.decisions(spark, sf_dir).withColumn("n_days", F.datediff("next_ts", "ts"))
    return d.withColumn("daily", acc.geometric_daily(c("cash_ret"), c("n_days")))


@query(
    "curves", "series_id ts curve:5 drawdown:7 rebased:5",
    f"""{_MTM}, g AS (SELECT *, product(1 + strat_ret) OVER {ORD} AS g FROM daily), z AS (SELECT series_id, min(ts) AS t0 FROM daily WHERE ts >= DATE '1998-01-01' GROUP BY 1),
        gz AS (SELECT g.series_id, g.g AS g0 FROM g JOIN z ON g.series_id = z.series_id AND g.ts = z.t0)
        SELECT g.series_id, g.ts, 100 * g AS curve, g / greatest(max(g) OVER {ORD}, 1.0) - 1 AS drawdown, CASE WHEN g.ts >= t0 THEN 100 * g / g0 END AS rebased FROM g JOIN z USING (series_id) JOIN gz USING (series_id)""".replace("OVER (PARTITION BY series_id ORDER BY ts), 1.0)", "OVER (PARTITION BY g.series_id ORDER BY g.ts), 1.0)"),
)
def curves(spark, sf_dir):
    d = mark_to_market(spark, sf_dir)
    full = acc.equity(d, DAILY, "strat_ret", base=100.0, out="curve")
    part = acc.rebased(d, DAILY, "strat_ret", "1998-01-01", "rebased").select("series_id", "ts", "rebased")
    return full.join(part, ["series_id", "ts"], "left")


@query(
    "currency_leg", "series_id ts fx_ret:8",
    f"""WITH {t.SQL_PANEL}, f AS (SELECT CAST(l_shipdate AS DATE) AS ts, avg(l_quantity) AS fx FROM lineitem GROUP BY 1), j AS (SELECT series_id, ts, close, last_value(fx IGNORE NULLS) OVER {ORD} AS v FROM panel LEFT JOIN f USING (ts)),
        b AS (SELECT *, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fx2 FROM j)
        SELECT series_id, ts, close * fx2 / (lag(close) OVER {ORD} * lag(fx2) OVER {ORD}) - 1 AS fx_ret FROM b""",
)
def currency_leg(spark, sf_dir):
    fx = t.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("ts")).agg(F.avg("l_quantity").alias("fx"))
    j = joins.on_calendar(t.panel(spark, sf_dir).select("series_id", "ts", "close").join(fx, "ts", "left"), DAILY, ["fx"], both_ways=True)
    f = DAILY.halo(j.withColumn("_p", c("close") * c("fx")), 1)
    return DAILY.owned(f.withColumn("fx_ret", R.pct_change("_p", DAILY.window(), 1)))


_EXEC = ["close", "thresh", "nextclose", "noemerg"]


@query(
    "execution_conventions", "series_id conv n cum:5",
    f"""{D}, near AS (SELECT series_id, ts, lag(price) OVER {ORD} AS pp, lead(ts) OVER {ORD} AS nt, lead(price) OVER {ORD} AS np FROM signals),
        e AS (SELECT d.*, x.conv, CASE WHEN x.conv = 'noemerg' THEN coalesce(last_value(CASE WHEN NOT is_large_move THEN alloc END IGNORE NULLS) OVER (PARTITION BY d.series_id, x.conv ORDER BY d.ts), 0) ELSE alloc END AS a,
          CASE WHEN x.conv = 'thresh' AND is_large_move THEN pp * (1 + sign(daily_ret) * 0.08) WHEN x.conv = 'nextclose' AND is_large_move AND nt IS NOT NULL THEN np ELSE price END AS ep
          FROM decisions d JOIN near USING (series_id, ts) CROSS JOIN (VALUES {', '.join(f"('{v}')" for v in _EXEC)}) x(conv)),
        r AS (SELECT *, coalesce(lead(ep) OVER (PARTITION BY series_id, conv ORDER BY ts), price * (1 + asset_ret)) / ep - 1 AS br FROM e)
        SELECT series_id, conv, count(*) AS n, product(1 + a * br + (1 - a) * cash_ret) - 1 AS cum FROM r GROUP BY 1, 2""",
)
def execution_conventions(spark, sf_dir):
    """Period returns chained between consecutive execution points, per convention."""
    f = DAILY.halo(t.signals(spark, sf_dir).select("series_id", "ts", "price"), 1, 1)
    w = DAILY.window()
    f = f.withColumns({"prev_price": F.lag("price", 1).over(w), "nt": F.lead("ts", 1).over(w), "np": F.lead("price", 1).over(w)})
    near = DAILY.owned(f).drop("price")
    d = dec.scenarios(t.decisions(spark, sf_dir).join(near, ["series_id", "ts"]), [{"conv": v} for v in _EXEC])
    p = DAILY.by("conv")
    d = dec.suppress(d, p, c("is_large_move"), "alloc", "_calm")
    d = d.withColumn("a", F.when(c("conv") == "noemerg", c("_calm")).otherwise(c("alloc")))
    point = acc.execution_point(c("conv"), c("ts"), c("price"), c("prev_price"), c("nt"), c("np"), c("is_large_move"), c("daily_ret"))
    d = p.running(d.withColumn("_ep", point.getField("price")), {"_next": Running(c("_ep"), "prev")}, reverse=True)
    out = F.coalesce("_next", c("price") * (1 + c("asset_ret")))
    r = dec.period_return(c("a"), out / c("_ep") - 1, c("cash_ret"))
    return d.groupBy("series_id", "conv").agg(F.count(F.lit(1)).alias("n"), acc.compounded(r).alias("cum"))


@query(
    "split_day_returns", "series_id ts split_ret:8",
    f"""{D}, a AS (SELECT *, coalesce(lag(alloc) OVER {ORD}, 0) AS pa, sign(daily_ret) * 0.08 AS r1 FROM decisions)
        SELECT d.series_id, d.ts, (1 + pa * r1) * (1 + alloc * ((1 + d.daily_ret) / (1 + r1) - 1)) - 1 + (1 - alloc) * s.cash_rate AS split_ret FROM a d JOIN signals s USING (series_id, ts) WHERE is_large_move""",
)
def split_day_returns(spark, sf_dir):
    d = DAILY.running(t.decisions(spark, sf_dir), {"_pa": Running(c("alloc"), "prev")})
    d = d.join(t.signals(spark, sf_dir).select("series_id", "ts", "cash_rate"), ["series_id", "ts"]).filter("is_large_move")
    r = acc.split_day(F.coalesce("_pa", F.lit(0.0)), c("alloc"), c("daily_ret"), F.signum("daily_ret") * 0.08, c("cash_rate"))
    return d.withColumn("split_ret", r)


# -- metrics -----------------------------------------------------------------------------------


def _metrics_sql(src, ppy):
    return f"""SELECT series_id, count(*) AS n, product(1 + strat_ret) - 1 AS cum, avg(strat_ret) AS mean_ret, stddev_pop(strat_ret) * sqrt({ppy}.0) AS vol,
      avg(strat_ret) / sqrt(avg(CASE WHEN strat_ret < 0 THEN strat_ret * strat_ret END)) * sqrt({ppy}.0) AS sortino,
      avg(strat_ret - cash_ret) / sqrt(avg(pow(least(strat_ret - cash_ret, 0), 2))) * sqrt({ppy}.0) AS sortino_excess,
      avg(strat_ret) / nullif(stddev_pop(strat_ret), 0) * sqrt({ppy}.0) AS sharpe,
      avg(strat_ret - cash_ret) / nullif(stddev_pop(strat_ret - cash_ret), 0) * sqrt({ppy}.0) AS sharpe_excess, min(drawdown) AS max_dd,
      pow(product(1 + strat_ret), 1 / (date_diff('day', min(ts), max(ts)) / 365.25)) - 1 AS cagr,
      (pow(product(1 + strat_ret), 1 / (date_diff('day', min(ts), max(ts)) / 365.25)) - 1) / abs(min(drawdown)) AS calmar FROM {src} GROUP BY 1"""


_MCOLS = "series_id n cum:5 mean_ret:8 vol:6 sortino:6 sortino_excess:6 sharpe:6 sharpe_excess:6 max_dd:7 cagr:6 calmar:5"


@query("decision_metrics", _MCOLS, f"WITH {SQL_EQUITY} {_metrics_sql('eqd', 52)}")
def decision_metrics(spark, sf_dir):
    d = acc.equity(t.decisions(spark, sf_dir), DAILY, "strat_ret")
    return acc.metrics(d, ["series_id"], "strat_ret", "cash_ret", 52)


@query(
    "daily_metrics", _MCOLS,
    f"""{_MTM}, g AS (SELECT *, product(1 + strat_ret) OVER {ORD} AS g FROM daily), e AS (SELECT *, g / greatest(max(g) OVER {ORD}, 1.0) - 1 AS drawdown FROM g) {_metrics_sql('e', 365)}""",
)
def daily_metrics(spark, sf_dir):
    d = acc.equity(mark_to_market(spark, sf_dir), DAILY, "strat_ret")
    return acc.metrics(d, ["series_id"], "strat_ret", "cash_ret", 365)


@query(
    "per_year_returns", "series_id year strat_ret:6 asset_ret:6 cash_ret:8 avg_alloc:7",
    f"{D} SELECT series_id, CAST(year(ts) AS INTEGER) AS year, product(1 + strat_ret) - 1 AS strat_ret, product(1 + asset_ret) - 1 AS asset_ret, product(1 + cash_ret) - 1 AS cash_ret, avg(alloc) AS avg_alloc FROM decisions GROUP BY 1, 2",
)
def per_year_returns(spark, sf_dir):
    return acc.per_year(t.decisions(spark, sf_dir), ["series_id"], ["strat_ret", "asset_ret", "cash_ret"], alloc="alloc")


@query(
    "direction_stats", "series_id regime n hit_rate:7 sign_agreement:7 pred_corr:7",
    f"{D} SELECT series_id, regime, count(*) AS n, avg({_HIT}) AS hit_rate, avg(CASE WHEN (pred > 0) = (asset_ret > 0) THEN 1.0 ELSE 0.0 END) AS sign_agreement, corr(pred, asset_ret) AS pred_corr FROM decisions GROUP BY 1, 2",
)
def direction_stats(spark, sf_dir):
    return acc.direction_stats(t.decisions(spark, sf_dir), ["series_id", "regime"])


@query(
    "exposure_shares", "series_id mean_alloc:7 max_alloc:7 share_at_cap:7 share_above_70:7 share_near_zero:7 share_zero:7 alloc_corr:7",
    f"""{D} SELECT series_id, avg(alloc) AS mean_alloc, max(alloc) AS max_alloc, avg(CASE WHEN alloc >= 0.99 THEN 1.0 ELSE 0.0 END) AS share_at_cap, avg(CASE WHEN alloc >= 0.7 THEN 1.0 ELSE 0.0 END) AS share_above_70,
        avg(CASE WHEN alloc <= 0.01 THEN 1.0 ELSE 0.0 END) AS share_near_zero, avg(CASE WHEN alloc = 0 THEN 1.0 ELSE 0.0 END) AS share_zero, corr(alloc, asset_ret) AS alloc_corr FROM decisions GROUP BY 1""",
)
def exposure_shares(spark, sf_dir):
    return acc.exposure(t.decisions(spark, sf_dir), ["series_id"])


@query(
    "turnover", "series_id mean_turnover:7 total_turnover:6",
    f"{D}, a AS (SELECT series_id, abs(alloc - coalesce(lag(alloc) OVER {ORD}, 0)) AS tv FROM decisions) SELECT series_id, avg(tv) AS mean_turnover, sum(tv) AS total_turnover FROM a GROUP BY 1",
)
def turnover(spark, sf_dir):
    return acc.turnover(t.decisions(spark, sf_dir), DAILY)


@query(
    "factsheet", "series_id share_of_cash:5 months_at_or_above_cash:7 n_months up_capture:6 down_capture:6 best:7 best_ts worst:7 worst_ts exposure:7 share_zero:7",
    f"""{_MTM}, a AS (SELECT series_id, product(1 + strat_ret) - 1 AS s, product(1 + cash_ret) - 1 AS q FROM daily GROUP BY 1),
        m AS (SELECT series_id, date_trunc('month', ts) AS mo, product(1 + strat_ret) - 1 AS s, product(1 + cash_ret) - 1 AS q FROM daily GROUP BY 1, 2),
        mm AS (SELECT series_id, avg(CASE WHEN s >= q THEN 1.0 ELSE 0.0 END) AS months_at_or_above_cash, count(*) AS n_months FROM m GROUP BY 1),
        b AS (SELECT series_id, max(strat_ret) AS best, min(strat_ret) AS worst, arg_max(ts, strat_ret) AS best_ts, arg_min(ts, strat_ret) AS worst_ts, avg(alloc) AS exposure, avg(CASE WHEN alloc = 0 THEN 1.0 ELSE 0.0 END) AS share_zero,
          avg(strat_ret) FILTER (asset_ret > 0) / avg(asset_ret) FILTER (asset_ret > 0) AS up_capture, avg(strat_ret) FILTER (asset_ret < 0) / avg(asset_ret) FILTER (asset_ret < 0) AS down_capture FROM decisions GROUP BY 1)
        SELECT *, CASE WHEN q > 0.001 THEN s / q END AS share_of_cash FROM a JOIN mm USING (series_id) JOIN b USING (series_id)""",
)
def factsheet(spark, sf_dir):
    return acc.factsheet(mark_to_market(spark, sf_dir), t.decisions(spark, sf_dir), DAILY)


def _two(src, ppy, name):
    return f"SELECT series_id, '{name}' AS frequency, count(*) AS n, product(1 + strat_ret) - 1 AS cum, avg(strat_ret) / sqrt(avg(CASE WHEN strat_ret < 0 THEN strat_ret * strat_ret END)) * sqrt({ppy}.0) AS sortino, avg(strat_ret) / stddev_pop(strat_ret) * sqrt({ppy}.0) AS sharpe FROM {src} GROUP BY 1"


@query("two_frequencies", "series_id frequency n cum:5 sortino:6 sharpe:6", f"{_MTM} {_two('decisions', 52, 'decision')} UNION ALL {_two('daily', 365, 'daily')}")
def two_frequencies(spark, sf_dir):
    return acc.two_frequencies(t.decisions(spark, sf_dir), mark_to_market(spark, sf_dir), ["series_id"])


@query("constant_cash", "series_id ts rate:12", f"{D} SELECT series_id, ts, pow(1.13, 1.0 / 365) - 1 AS rate FROM decisions")
def constant_cash(spark, sf_dir):
    return t.decisions(spark, sf_dir).select("series_id", "ts", acc.constant_cash(0.13).alias("rate"))
