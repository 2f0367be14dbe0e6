"""Cleaning, imputation, sources and sinks over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean
from tidemark.panel import DAILY, Running
from tidemark.plans import tables as t
from tidemark.plans.catalog import query
from tidemark.plans.feature_queries import ORD, mean, q, std
from tidemark.sources import bars as src
from tidemark.sources import files

c = F.col

# a panel whose price is missing on days without orders
GAPS = t.SQL_PANEL + """, g AS (
  SELECT s.series_id, s.ts, b.close, b.volume, b.open, b.high, b.low FROM spine s LEFT JOIN bars b USING (series_id, ts))"""


def gappy(spark, sf_dir):
    from tidemark.stage import staged_once

    return staged_once(
        spark, "gappy", (sf_dir,),
        lambda: DAILY.fill_grid(t.order_bars(spark, sf_dir)).select("series_id", "ts", "close", "volume", "open", "high", "low"),
    )


# -- sources -----------------------------------------------------------------------------------


@query("daily_bars", "series_id ts open high low close volume:2 n_obs", f"WITH {t.SQL_BARS} SELECT * FROM bars")
def daily_bars(spark, sf_dir):
    return t.order_bars(spark, sf_dir)


@query("calendar_fill", "series_id ts open high low close volume:2 n_obs series_start", f"WITH {t.SQL_PANEL} SELECT * FROM panel")
def calendar_fill(spark, sf_dir):
    return DAILY.fill_grid(t.order_bars(spark, sf_dir), carry=["open", "high", "low", "close"], zero=["volume", "n_obs"])


@query(
    "events_to_daily_stats", "event_type ts value_sum:4 value_mean:6 value_max value_min value_count",
    """SELECT event_type, CAST(ts AS DATE) AS ts, sum(value) AS value_sum, avg(value) AS value_mean,
       max(value) AS value_max, min(value) AS value_min, count(value) AS value_count FROM events GROUP BY 1, 2""",
)
def events_to_daily_stats(spark, sf_dir):
    return src.bucket_stats(t.table(spark, sf_dir, "events"), ["event_type"], F.to_date("ts"), c("value"))


@query(
    "hourly_event_bars", "series_id ts open high low close volume:2 n_obs",
    """SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS open, max(value) AS high,
       min(value) AS low, arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, count(*) AS n_obs
       FROM events GROUP BY 1, 2""",
)
def hourly_event_bars(spark, sf_dir):
    return t.hourly_bars(spark, sf_dir).withColumn("ts", c("ts").cast("timestamp_ntz"))


@query(
    "last_known_per_day", "o_orderpriority ts o_totalprice o_orderstatus",
    """SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ts,
       arg_max(p, o_orderkey) FILTER (p IS NOT NULL) AS o_totalprice, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus
       FROM (SELECT *, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS p FROM orders) GROUP BY 1, 2""",
)
def last_known_per_day(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").withColumn("o_totalprice", F.when(c("o_totalprice") > 50000, c("o_totalprice")))
    return src.last_per_bucket(o, ["o_orderpriority"], F.to_date("o_orderdate"), c("o_orderkey"), ["o_totalprice", "o_orderstatus"])


@query(
    "canonical_columns", "day price account",
    "SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS price, o_custkey AS account FROM orders",
)
def canonical_columns(spark, sf_dir):
    df, _ = src.rename_present(t.table(spark, sf_dir, "orders"), {"o_orderdate": "day", "o_totalprice": "price", "o_custkey": "account", "o_absent": "gone"})
    return df.withColumn("day", F.to_date("day"))


@query(
    "kline_arrays", "o_orderpriority open high close volume n_trades open_time close_time",
    """SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) AS open, NULL::DOUBLE AS high,
       CAST(o_totalprice AS DOUBLE) AS close, CAST(o_custkey AS DOUBLE) AS volume, o_orderkey AS n_trades,
       o_orderdate AS open_time, o_orderdate + INTERVAL 86399 SECOND + INTERVAL 999 MILLISECOND AS close_time FROM orders""",
)
def kline_arrays(spark, sf_dir):
    """Orders dressed as exchange records (arrays of text with one bad number) and parsed back."""
    o = t.table(spark, sf_dir, "orders").withColumn("_ms", F.unix_millis(c("o_orderdate").cast("timestamp")))
    row = F.array(
        c("_ms").cast("string"), c("o_totalprice").cast("string"), F.lit("n/a"), c("o_totalprice").cast("string"),
        c("o_totalprice").cast("string"), c("o_custkey").cast("string"), (c("_ms") + 86399999).cast("string"), F.lit("0"),
        c("o_orderkey").cast("string"), F.lit("0"), F.lit("0"), F.lit("0"),
    )
    out = src.klines(o.select("o_orderpriority", F.to_json(F.array(row)).alias("payload")), "payload")
    return out.withColumns({x: c(x).cast("timestamp_ntz") for x in ("open_time", "close_time")})


@query(
    "closed_candles", "series_id ts close n_obs",
    """WITH b AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS close, count(*) AS n_obs
       FROM events GROUP BY 1, 2) SELECT * FROM b WHERE ts + INTERVAL 1 HOUR < (SELECT max(ts) FROM events)""",
)
def closed_candles(spark, sf_dir):
    """Bars whose hour is over at the time of the newest event."""
    b = t.hourly_bars(spark, sf_dir)
    now = t.table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp"))
    b = b.withColumn("_close", c("ts") + F.expr("INTERVAL 1 HOUR"))
    return src.closed_only(b, "_close", now.scalar()).withColumn("ts", c("ts").cast("timestamp_ntz"))


@query(
    "nested_supply", "ts stablecoin_supply",
    """SELECT CAST(make_timestamp(epoch_us(ts)) AS DATE) AS ts, CASE WHEN k % 3 = 0 THEN CAST(k AS DOUBLE) ELSE value END AS stablecoin_supply
       FROM (SELECT ts, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
       WHERE CASE WHEN k % 3 = 0 THEN CAST(k AS DOUBLE) ELSE value END > 0""",
)
def nested_supply(spark, sf_dir):
    """JSON with the figure in one of two nested places; zero figures dropped; epoch to day."""
    e = t.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    doc = F.when(c("k") % 3 == 0, F.concat(F.lit('{"a":{"usd":'), c("k"), F.lit("}}"))).otherwise(F.concat(F.lit('{"b":{"usd":'), c("value"), F.lit("}}")))
    e = e.withColumn("doc", F.from_json(doc, "struct<a:struct<usd:double>,b:struct<usd:double>>"))
    return src.circulating_supply(e, c("doc.a.usd"), c("doc.b.usd"), F.unix_seconds(c("ts").cast("timestamp")))


@query(
    "epoch_round_trip", "event_id day midnight_ms day_from_seconds",
    """SELECT event_id, CAST(ts AS DATE) AS day, epoch_ms(date_trunc('day', ts)) AS midnight_ms, CAST(ts AS DATE) AS day_from_seconds FROM events""",
)
def epoch_round_trip(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    ms = F.unix_millis(c("ts").cast("timestamp"))
    return e.select(
        "event_id", src.to_utc_day(ms).alias("day"), src.day_to_ms(F.to_date("ts")).alias("midnight_ms"),
        src.to_utc_day(F.unix_seconds(c("ts").cast("timestamp")), "s").alias("day_from_seconds"),
    )


@query(
    "metrics_outer_merge", "ts a_qty n_qty r_qty",
    """SELECT CAST(l_shipdate AS DATE) AS ts, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a_qty,
       max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n_qty, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r_qty
       FROM lineitem GROUP BY 1""",
)
def metrics_outer_merge(spark, sf_dir):
    long = t.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("ts"), c("l_returnflag").alias("name"), c("l_quantity").alias("value"))
    w = src.metrics_wide(long, ["ts"], "name", "value", ["A", "N", "R"])
    return w.select("ts", c("A").alias("a_qty"), c("N").alias("n_qty"), c("R").alias("r_qty"))


@query(
    "warehouse_slug", "ts value",
    """SELECT CAST(o_orderdate AS DATE) AS ts, max(o_totalprice) AS value FROM orders
       WHERE o_orderpriority = '2-HIGH' AND o_orderdate >= DATE '1997-01-01' GROUP BY 1""",
)
def warehouse_slug(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").withColumnRenamed("o_totalprice", "value")
    return files.warehouse_daily(o, "2-HIGH", "value", F.lit("1997-01-01").cast("date"), F.to_date("o_orderdate"), c("o_orderpriority"))


@query(
    "source_priority", "ts value:4 source",
    """WITH a AS (SELECT CAST(l_shipdate AS DATE) AS ts, avg(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1),
       b AS (SELECT CAST(l_shipdate AS DATE) AS ts, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1)
       SELECT ts, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 0 ELSE 1 END AS source FROM a FULL JOIN b USING (ts)""",
)
def source_priority(spark, sf_dir):
    li = t.table(spark, sf_dir, "lineitem").withColumn("ts", F.to_date("l_shipdate"))
    best = li.filter((c("l_returnflag") == "R") & (c("l_quantity") > 45)).groupBy("ts").agg(F.avg("l_extendedprice").alias("value"))
    rest = li.groupBy("ts").agg(F.avg("l_extendedprice").alias("value"))
    return src.by_priority([best, rest], ["ts"], "value")


@query(
    "source_registry", "series_id ts close gold:6 fear_greed",
    f"""WITH {t.SQL_PANEL}, m AS (SELECT CAST(l_shipdate AS DATE) AS ts, {t.METRICS['gold']} AS gold FROM lineitem GROUP BY 1)
        SELECT series_id, ts, close, gold, 50.0 AS fear_greed FROM panel LEFT JOIN m USING (ts)""",
)
def source_registry(spark, sf_dir):
    df, _ = src.attach_sources(
        t.panel(spark, sf_dir), ["ts"], {"metrics": t.daily_metrics(spark, sf_dir, ["gold"]), "broken": None}
    )
    return src.constant_series(df, fear_greed=50)


@query(
    "day_first_rates", "o_orderkey day rate:8",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_custkey / 100.0 AS rate FROM orders",
)
def day_first_rates(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    day, rate = src.day_first_rate(F.date_format("o_orderdate", "dd/MM/yyyy"), c("o_custkey").cast("string"))
    return o.select("o_orderkey", day.alias("day"), rate.alias("rate"))


# -- sinks: the merge rules, without the write --------------------------------------------------

_BATCHES = """a AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2),
  b AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, min(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1, 2)"""


def _batches(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").select(c("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), "o_totalprice", "o_orderkey")
    a = o.filter(c("o_orderkey") % 3 != 0).groupBy("k", "d").agg(F.max("o_totalprice").alias("v"))
    b = o.filter(c("o_orderkey") % 3 != 1).groupBy("k", "d").agg(F.min("o_totalprice").alias("v"))
    return a, b


@query("upsert_new_wins", "k d v", f"WITH {_BATCHES} SELECT k, d, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (k, d)")
def upsert_new_wins(spark, sf_dir):
    return files.upsert(*_batches(spark, sf_dir), ["k", "d"], "new")


@query("upsert_old_wins", "k d v", f"WITH {_BATCHES} SELECT k, d, coalesce(a.v, b.v) AS v FROM a FULL JOIN b USING (k, d)")
def upsert_old_wins(spark, sf_dir):
    return files.upsert(*_batches(spark, sf_dir), ["k", "d"], "old")


@query("append_missing_keys", "k d v", f"WITH {_BATCHES} SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a USING (k, d)")
def append_missing_keys(spark, sf_dir):
    return files.append_missing(*_batches(spark, sf_dir), ["k", "d"])


@query(
    "close_out_log", "series_id ts alloc:7 next_ts realised:8",
    f"""WITH {t.SQL_DECISIONS}, log AS (SELECT series_id, ts, alloc, price FROM decisions)
        SELECT series_id, ts, alloc, lead(ts) OVER {ORD} AS next_ts, lead(price) OVER {ORD} / price - 1 AS realised FROM log""",
)
def close_out_log(spark, sf_dir):
    """Replacing a row closes the one before it: realised returns are recomputed by a lead."""
    log = t.decisions(spark, sf_dir).select("series_id", "ts", "alloc", "price")
    older = log.filter(c("ts") < "2000-01-01")
    newer = log.filter(c("ts") >= "1999-06-01")
    merged = files.upsert(older, newer, ["series_id", "ts"])
    nxt = DAILY.running(merged, {"_n": Running(F.struct(c("ts").alias("t"), c("price").alias("p")), "prev")}, reverse=True)
    return nxt.select("series_id", "ts", "alloc", c("_n.t").alias("next_ts"), (c("_n.p") / c("price") - 1).alias("realised"))


@query(
    "aligned_append", "o_orderkey o_custkey note",
    "SELECT o_orderkey, o_custkey, 'old' AS note FROM orders WHERE o_orderkey < 100 UNION ALL SELECT o_orderkey, o_custkey, NULL FROM orders WHERE o_orderkey >= 100",
)
def aligned_append(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    old = o.filter(c("o_orderkey") < 100).select("o_orderkey", "o_custkey", F.lit("old").alias("note"))
    new = o.filter(c("o_orderkey") >= 100).select("o_custkey", "o_orderstatus", "o_orderkey")
    return old.unionByName(files.aligned(new, old))


# -- cleaning ----------------------------------------------------------------------------------


@query("date_range", "series_id ts close", f"WITH {t.SQL_BARS} SELECT series_id, ts, close FROM bars WHERE ts BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'")
def date_range(spark, sf_dir):
    return clean.between(t.order_bars(spark, sf_dir), "ts", "1996-03-01", "1998-02-28").select("series_id", "ts", "close")


for _keep, _fn in (("last", "DESC"), ("first", "ASC")):

    @query(
        f"dedupe_keep_{_keep}", "o_custkey o_orderkey o_totalprice",
        f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {_fn}, o_orderkey {_fn}) AS r FROM orders) WHERE r = 1",
    )
    def dedupe(spark, sf_dir, keep=_keep):
        o = t.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
        return clean.first_or_last_per_key(o, ["o_custkey"], [c("o_orderdate"), c("o_orderkey")], keep)


@query(
    "forward_fill", "series_id ts close volume:2",
    f"WITH {GAPS} SELECT series_id, ts, last_value(close IGNORE NULLS) OVER {ORD} AS close, coalesce(last_value(volume IGNORE NULLS) OVER {ORD}, 0) AS volume FROM g",
)
def forward_fill(spark, sf_dir):
    df = clean.fill_forward(gappy(spark, sf_dir), DAILY, ["close"])
    return clean.fill_forward(df, DAILY, ["volume"], then_zero=True)


@query(
    "backward_fill", "series_id ts sma:6",
    f"WITH {GAPS}, m AS (SELECT series_id, ts, {mean('close', 14, 5)} AS s FROM g) SELECT series_id, ts, first_value(s IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sma FROM m",
)
def backward_fill(spark, sf_dir):
    from tidemark.functions import rolling as R

    f = DAILY.halo(gappy(spark, sf_dir), 14)
    df = DAILY.owned(f.withColumn("sma", R.mean("close", DAILY.window(), 14, 5)))
    return clean.fill_backward(df, DAILY, ["sma"])


_MEDIAN = q("close", 0.5, 365, 30)


@query(
    "impute_median_first", "series_id ts close:4",
    f"WITH {GAPS}, m AS (SELECT series_id, ts, coalesce(close, {_MEDIAN}) AS close FROM g) SELECT series_id, ts, coalesce(last_value(close IGNORE NULLS) OVER {ORD}, 0) AS close FROM m",
)
def impute_median_first(spark, sf_dir):
    return clean.impute_median_first(gappy(spark, sf_dir), DAILY, ["close"])


@query(
    "impute_forward_first", "series_id ts lagged:4",
    f"WITH {GAPS}, l AS (SELECT series_id, ts, lag(close, 40) OVER {ORD} AS lagged FROM g), m AS (SELECT series_id, ts, last_value(lagged IGNORE NULLS) OVER {ORD} AS lagged FROM l) SELECT series_id, ts, coalesce(lagged, {q('lagged', 0.5, 365, 30)}, 0) AS lagged FROM m",
)
def impute_forward_first(spark, sf_dir):
    f = DAILY.halo(gappy(spark, sf_dir), 40)
    df = DAILY.owned(f.withColumn("lagged", F.lag("close", 40).over(DAILY.window())))
    return clean.impute_forward_first(df, DAILY, ["lagged"])


@query(
    "first_median_fill", "series_id ts close:4",
    f"""WITH {GAPS}, n AS (SELECT *, count(close) OVER {ORD} AS k FROM g), m AS (SELECT series_id, quantile_cont(close, 0.5) AS md FROM n WHERE close IS NOT NULL AND k <= 30 GROUP BY 1)
        SELECT series_id, ts, coalesce(close, md) AS close FROM g JOIN m USING (series_id)""",
)
def first_median_fill(spark, sf_dir):
    return clean.fill_first_median(gappy(spark, sf_dir), DAILY, ["close"])


@query(
    "neutral_fill", "series_id ts basis_pct upper_shadow gap_pct close",
    f"WITH {GAPS} SELECT series_id, ts, coalesce(close, 0) AS basis_pct, coalesce(high, 0.5) AS upper_shadow, coalesce(open, 0) AS gap_pct, close FROM g",
)
def neutral_fill(spark, sf_dir):
    g = gappy(spark, sf_dir)
    return clean.fill_neutral(g.select("series_id", "ts", c("close").alias("basis_pct"), c("high").alias("upper_shadow"), c("open").alias("gap_pct"), "close"))


@query(
    "cross_column_fill", "series_id ts futures_close high_low",
    f"WITH {GAPS} SELECT series_id, ts, coalesce(CASE WHEN volume > 300000 THEN close END, open) AS futures_close, coalesce(volume, high - low, 0) AS high_low FROM g",
)
def cross_column_fill(spark, sf_dir):
    g = gappy(spark, sf_dir).withColumns({"futures_close": F.when(c("volume") > 300000, c("close")), "high_low": c("volume")})
    g = clean.fill_from(g, {"futures_close": c("open"), "high_low": c("high") - c("low")})
    return g.withColumn("high_low", clean.prefer(c("high_low"), F.lit(0.0)))


@query(
    "ohlc_repair", "series_id ts high low",
    f"WITH {t.SQL_BARS}, d AS (SELECT *, high - 100000 AS h2, low + 100000 AS l2 FROM bars) SELECT series_id, ts, greatest(open, h2, close) AS high, least(open, l2, close) AS low FROM d",
)
def ohlc_repair(spark, sf_dir):
    b = t.order_bars(spark, sf_dir)
    return clean.repair_ohlc(b.withColumns({"high": c("high") - 100000, "low": c("low") + 100000}))


@query(
    "constant_clip", "series_id ts close",
    f"WITH {GAPS} SELECT series_id, ts, CASE WHEN close IS NOT NULL THEN greatest(least(close, 400000.0), 50000.0) END AS close FROM g",
)
def constant_clip(spark, sf_dir):
    from tidemark.functions.scalars import clip

    return gappy(spark, sf_dir).withColumn("close", clip("close", F.lit(50000.0), F.lit(400000.0)))


@query(
    "quantile_clip", "series_id ts close:4",
    f"WITH {GAPS} SELECT series_id, ts, CASE WHEN close IS NOT NULL THEN greatest(least(close, {q('close', 0.99, 365, 30)}), {q('close', 0.01, 365, 30)}) END AS close FROM g",
)
def quantile_clip(spark, sf_dir):
    return clean.clip_rolling_quantiles(gappy(spark, sf_dir), DAILY, ["close"])


_EXP = f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    "sigma_winsorise", "series_id ts volume:3",
    f"""WITH {GAPS}, b AS (SELECT series_id, ts, volume,
        coalesce({mean('volume', 365, 30)}, CASE WHEN count(volume) OVER {_EXP} >= 30 THEN avg(volume) OVER {_EXP} END) AS mu,
        coalesce({std('volume', 365, 30)}, CASE WHEN count(volume) OVER {_EXP} >= 30 THEN stddev_samp(volume) OVER {_EXP} END) AS sd FROM g)
        SELECT series_id, ts, CASE WHEN volume IS NOT NULL THEN greatest(least(volume, mu + 2.0 * sd), mu - 2.0 * sd) END AS volume FROM b""",
)
def sigma_winsorise(spark, sf_dir):
    return clean.winsorise(gappy(spark, sf_dir), DAILY, ["volume"], sigma=2.0)


@query(
    "availability_flags", "series_id ts has_futures_data has_price",
    f"WITH {GAPS} SELECT series_id, ts, CASE WHEN ts >= DATE '1998-09-08' THEN 1 ELSE 0 END AS has_futures_data, CASE WHEN close IS NOT NULL THEN 1 ELSE 0 END AS has_price FROM g",
)
def availability_flags(spark, sf_dir):
    g = clean.availability(gappy(spark, sf_dir), {"has_futures_data": ("ts", "1998-09-08")})
    return g.withColumn("has_price", c("close").isNotNull().cast("int"))


@query(
    "column_profile", "name n_null n_usable deviation:2",
    f"WITH {GAPS} " + " UNION ALL ".join(
        f"SELECT '{x}' AS name, count(*) - count({x}) AS n_null, count(*) FILTER ({x} IS NOT NULL AND {x} <> 0) AS n_usable, stddev_samp({x}) AS deviation FROM g"
        for x in ("close", "volume", "open")),
)
def column_profile(spark, sf_dir):
    return clean.column_profile(gappy(spark, sf_dir), ["close", "volume", "open"])


@query(
    "null_audit", "name n_null",
    f"WITH {GAPS} " + " UNION ALL ".join(f"SELECT '{x}' AS name, count(*) - count({x}) AS n_null FROM g" for x in ("close", "volume", "open", "high", "low")),
)
def null_audit(spark, sf_dir):
    return clean.null_audit(gappy(spark, sf_dir), ["close", "volume", "open", "high", "low"])


@query(
    "drop_thin_and_constant", "series_id ts close",
    f"WITH {GAPS} SELECT series_id, ts, close FROM g WHERE close IS NOT NULL",
)
def drop_thin_and_constant(spark, sf_dir):
    g = gappy(spark, sf_dir).select("series_id", "ts", "close").withColumns({"flat": F.lit(3.0), "thin": F.when(c("ts") == "1995-01-02", 1.0)})
    g, thin = clean.drop_thin(g, ["close", "flat", "thin"], 30)
    g, flat = clean.drop_constant(g, [x for x in ("close", "flat") if x in g.columns])
    if thin != ["thin"] or flat != ["flat"]:
        raise ValueError(f"dropped {thin} and {flat}")
    g, _ = clean.select_available(g, ["series_id", "ts", "close", "absent"])
    return clean.finite_rows(g, ["close"]).na.drop(subset=["close"])


@query(
    "feature_matrix", "series_id ts close volume:2",
    f"WITH {GAPS} SELECT series_id, ts, coalesce(close, 0) AS close, coalesce(volume, 0) AS volume FROM g",
)
def feature_matrix(spark, sf_dir):
    return clean.finite_rows(gappy(spark, sf_dir), ["close", "volume"], null_to_zero=True)


@query(
    "weekly_to_daily", "series_id ts value",
    f"""WITH {t.SQL_BARS}, wk AS (SELECT series_id, ts, close FROM bars WHERE isodow(ts) = 1),
        sp AS (SELECT series_id, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM wk GROUP BY 1)
        SELECT series_id, ts, last_value(close IGNORE NULLS) OVER {ORD} AS value FROM sp LEFT JOIN wk USING (series_id, ts)""",
)
def weekly_to_daily(spark, sf_dir):
    weekly = t.order_bars(spark, sf_dir).filter(F.weekday("ts") == 0).select("series_id", "ts", c("close").alias("value"))
    return DAILY.fill_grid(weekly, carry=["value"])


@query(
    "safe_reciprocals", "series_id ts ratio:8 guarded:8",
    f"WITH {GAPS} SELECT series_id, ts, close / nullif(high - low, 0) AS ratio, close / ((high - low) + 1) AS guarded FROM g",
)
def safe_reciprocals(spark, sf_dir):
    span = c("high") - c("low")
    return gappy(spark, sf_dir).withColumns({"ratio": F.try_divide("close", span), "guarded": c("close") / (span + 1)})


