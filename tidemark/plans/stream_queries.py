"""Streams over the events table, run to completion and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.panel import HOURLY
from tidemark.plans import tables as t
from tidemark.plans.catalog import query
from tidemark.stage import shared_dir
from tidemark.streaming import bars as st

c = F.col


def event_stream(spark, sf_dir):
    schema = t.table(spark, sf_dir, "events").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return src.withColumn("ts", c("ts").cast("timestamp"))


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(df, mode: str = "append", then=None):
    """Run a stream over everything there is, into files, and read them back.  ``then`` adds input that a second
    run from the same checkpoint takes."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        for more in (None, then) if then else (None,):
            if more:
                more()
            q = (
                df.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
                .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").start()
            )
            q.awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query(
    "streamed_closed_bars", "series_id ts open high low close n_obs",
    """WITH b AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS n_obs FROM events GROUP BY 1, 2)
       SELECT * FROM b WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def streamed_closed_bars(spark, sf_dir):
    b = st.closed_bars(event_stream(spark, sf_dir), c("event_type"), "ts", c("value"), c("event_id"))
    return drained(b).withColumn("ts", c("ts").cast("timestamp_ntz"))


@query(
    "streamed_sliding_stats", "series_id from_ts to_ts mean:6 std:6 n",
    """WITH w AS (SELECT event_type AS series_id, value, unnest(generate_series(0, 3)) AS k, date_trunc('hour', ts) AS h FROM events),
       s AS (SELECT series_id, h - INTERVAL 1 HOUR * k AS from_ts, value FROM w)
       SELECT series_id, from_ts, from_ts + INTERVAL 4 HOUR AS to_ts, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM s GROUP BY 1, 2
       HAVING from_ts + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def streamed_sliding_stats(spark, sf_dir):
    s = st.sliding_stats(event_stream(spark, sf_dir), c("event_type"), "ts", c("value"), "4 hours", "1 hour")
    return drained(s).withColumns({x: c(x).cast("timestamp_ntz") for x in ("from_ts", "to_ts")})


FILES, DELAY_DAYS = 4, 36_500


def bar_files(bars, path: str, files: int = FILES):
    """Bars dealt over files by a hash, so that every file has bars of all times."""
    bars.repartition(files, F.xxhash64("series_id", "ts")).write.parquet(path)


def heartbeat(spark, path: str):
    """One row without a series, so far ahead that the watermark passes all bars."""
    bars = spark.read.parquet(path)
    beyond = bars.agg((F.max("ts").cast("timestamp") + F.expr(f"INTERVAL '{DELAY_DAYS + 1}' DAY")).cast(bars.schema["ts"].dataType).alias("ts"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in bars.schema.fields if f.name != "ts"]
    beyond.select("*", *rest).select(*bars.columns).coalesce(1).write.mode("append").parquet(path)


def _in_order(spark, sf_dir, run):
    """Hourly bars from files in any order, one file a batch; then the end of input."""
    path = f"{shared_dir(spark)}/tidemark/bars-{uuid.uuid4().hex[:12]}"
    bar_files(t.hourly_bars(spark, sf_dir), path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return drained(run(stream, f"{DELAY_DAYS} days"), then=lambda: heartbeat(spark, path))


_HB = "WITH b AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS open, arg_max(value, event_id) AS close FROM events GROUP BY 1, 2)"


@query(
    "streamed_move_alerts", "series_id ts close ret:7",
    f"{_HB}, r AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY series_id ORDER BY ts), 0) - 1 AS ret FROM b) SELECT series_id, ts, close, ret FROM r WHERE abs(ret) > 0.08",
)
def streamed_move_alerts(spark, sf_dir):
    return _in_order(spark, sf_dir, lambda s, delay: st.move_alerts(s, delay=delay)).withColumn("ts", c("ts").cast("timestamp_ntz"))


@query(
    "streamed_state_runs", "series_id ts state run_length",
    f"""{_HB}, s AS (SELECT *, CASE WHEN close > open THEN 'up' ELSE 'flat or down' END AS state FROM b),
        g AS (SELECT *, sum(CASE WHEN state IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ts) AS grp FROM (SELECT *, lag(state) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM s))
        SELECT series_id, ts, state, row_number() OVER (PARTITION BY series_id, grp ORDER BY ts) AS run_length FROM g""",
)
def streamed_state_runs(spark, sf_dir):
    state = F.when(c("close") > c("open"), "up").otherwise("flat or down").alias("state")
    return _in_order(spark, sf_dir, lambda s, delay: st.state_runs(s.select("series_id", "ts", state), delay)).withColumn("ts", c("ts").cast("timestamp_ntz"))


@query(
    "stale_series", "series_id behind stale",
    """WITH l AS (SELECT event_type AS series_id, max(date_trunc('hour', ts)) AS l FROM events GROUP BY 1)
       SELECT series_id, CAST(date_diff('hour', l, (SELECT max(ts) FROM events) + INTERVAL 2 HOUR) AS BIGINT) AS behind, date_diff('hour', l, (SELECT max(ts) FROM events) + INTERVAL 2 HOUR) > 2 AS stale FROM l""",
)
def stale_series(spark, sf_dir):
    b = t.hourly_bars(spark, sf_dir)
    now = t.table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp") + F.expr("INTERVAL 2 HOURS"))
    return st.staleness(b, HOURLY, now.scalar(), slack=2)
