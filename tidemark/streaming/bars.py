"""Events to closed bars, incremental features, upserts, alerts and running states on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.registry import FEATURES, Registry
from tidemark.panel import Panel
from tidemark.sources.files import append_missing, upsert
from tidemark.stage import stage

c = F.col


def closed_bars(events: DataFrame, key: Column, ts: str, price: Column, order: Column, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling-window bars.  In append mode a bar is emitted once, when the watermark has passed its
    end, so an unfinished candle never leaves the job."""
    df = events.select(key.alias("series_id"), c(ts), price.alias("_p"), order.alias("_o")).withWatermark(ts, delay)
    out = df.groupBy("series_id", F.window(ts, width).alias("_w")).agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
        F.max_by("_p", "_o").alias("close"), F.count(F.lit(1)).alias("n_obs"),
    )
    return out.select("series_id", c("_w.start").alias("ts"), "open", "high", "low", "close", "n_obs")


def sliding_stats(events: DataFrame, key: Column, ts: str, x: Column, width: str, slide: str, delay: str = "10 minutes") -> DataFrame:
    """Time-based sliding mean and deviation (row-based windows stay batch)."""
    df = events.select(key.alias("series_id"), c(ts), x.alias("_x")).withWatermark(ts, delay)
    out = df.groupBy("series_id", F.window(ts, width, slide).alias("_w")).agg(
        F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.count("_x").alias("n")
    )
    return out.select("series_id", c("_w.start").alias("from_ts"), c("_w.end").alias("to_ts"), "mean", "std", "n")


# -- tables kept by foreachBatch ---------------------------------------------------------------


def _read_or_none(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def upsert_batch(path: str, keys: Sequence[str], part: str, keep: str = "new"):
    """foreachBatch writer: merge a batch into a table partitioned by ``part``.

    Only the partitions the batch touches are read and rewritten.  The merged rows are staged before
    they replace their source, and running a batch twice gives the same table.
    """

    def write(batch: DataFrame, _id: int) -> None:
        spark = batch.sparkSession
        batch = stage(batch, "batch")
        old = _read_or_none(spark, path)
        merged = batch
        if old is not None:
            touched = batch.select(part).distinct()
            near = old.join(touched, part, "left_semi").select(*batch.columns)
            merged = upsert(near, batch, keys, keep)
        merged = stage(merged, "merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)

    return write


def new_features(stored: DataFrame, fresh: DataFrame, panel: Panel, names: Sequence[str], registry: Registry = FEATURES) -> DataFrame:
    """Features of the fresh bars only, computed from the stored history they look back on.

    A filter on time cannot pass below a window, so the history is cut first, to the look-back the
    registry knows, and the result is cut again to the fresh rows.  The oldest fresh row is one
    number, used as a literal so that the cut reaches the scan of the stored bars.
    """
    _, back, _, _ = registry.plan(stored.columns, names)
    oldest = fresh.agg(F.min(panel.pos())).first()[0]
    if oldest is not None:
        stored = stored.filter(c(panel.ts) >= panel.at(F.lit(oldest - back)))
    since = fresh.groupBy(*panel.keys).agg(F.min(panel.pos()).alias("_since"))
    both = append_missing(stored, fresh, [*panel.keys, panel.ts]).join(since, list(panel.keys))
    both = both.filter(panel.pos() >= c("_since") - back)
    built, _ = registry.build(both, panel, names, keep=["_since"])
    return built.filter(panel.pos() >= c("_since")).drop("_since")


def feature_batch(bars_path: str, features_path: str, panel: Panel, names: Sequence[str]):
    """foreachBatch writer: add the features of new bars (bars already known are ignored) and then the bars
    themselves.

    Both go to a folder of the batch that a replay overwrites, and a batch never reads its own bars, so
    running it again after a failure at any point gives the same tables.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = [*panel.keys, panel.ts]
        old = _read_or_none(spark, bars_path)
        if old is not None and "batch" in old.columns:
            old = old.where(c("batch") != batch_id).drop("batch")
        fresh = stage(batch, "fresh")
        if old is not None:
            first = fresh.agg(F.min(panel.ts)).first()[0]
            seen = old.filter(c(panel.ts) >= F.lit(first)).select(*key)
            fresh = stage(fresh.join(seen, key, "left_anti"), "fresh")
        history = fresh.limit(0) if old is None else old
        new_features(history, fresh, panel, names).write.mode("overwrite").parquet(f"{features_path}/batch={batch_id}")
        fresh.write.mode("overwrite").parquet(f"{bars_path}/batch={batch_id}")

    return write


# -- rows in the order of their time --------------------------------------------------------------


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(",")]


class InOrder(StatefulProcessor):
    """Hands the rows of a series to ``step`` in the order of their time, whatever batches they came in.

    A row waits in the key's buffer until the watermark has passed it; an event-time timer stands at the
    oldest waiting row.  What was handed over is final, so a row that comes behind the watermark is dropped, and
    a row that comes again before that replaces the first.  A row without a series only moves the
    watermark.  ``value``, ``carried`` and ``out`` are the schemas of what a row brings, of what is passed on
    and of what comes out.
    """

    value: str
    carried: str
    out: str

    def step(self, carried: tuple | None, ts, row: tuple) -> tuple[tuple, tuple | None]:
        """What is passed on, and the rest of an output row or None."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", f"ts timestamp, {self.value}")
        self.passed = handle.getValueState("passed", self.carried)
        self.due = handle.getValueState("due", "at long")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            return iter(())
        first = None
        for row in rows:
            at = int(row["ts"].timestamp() * 1_000_000)
            self.waiting.updateValue((at,), (row["ts"], *(row[x] for x in _names(self.value))))
            first = at if first is None else min(first, at)
        if first is not None:
            at = -(-first // 1000)
            if not self.due.exists():
                self._wake(at)
            elif at < self.due.get()[0]:
                self.handle.deleteTimer(self.due.get()[0])
                self._wake(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, ready, left = timerValues.getCurrentWatermarkInMs() * 1000, [], None
        for (at,), row in self.waiting.iterator():
            if at <= now:
                ready.append((at, row))
            else:
                left = at if left is None else min(left, at)
        carried = tuple(self.passed.get()) if self.passed.exists() else None
        named, out = Row("series_id", "ts", *_names(self.out)), []
        for at, row in sorted(ready, key=lambda x: x[0]):
            self.waiting.removeKey((at,))
            carried, found = self.step(carried, row[0], tuple(row)[1:])
            if found is not None:
                out.append(named(key[0], row[0], *found))
        if ready:
            self.passed.update(carried)
        self.due.clear()
        if left is not None:
            self._wake(-(-left // 1000))
        return iter(out)

    def close(self) -> None:
        pass


class Moves(InOrder):
    value, carried, out = "close double", "close double", "close double, ret double"

    def __init__(self, threshold: float):
        self.threshold = threshold

    def step(self, carried, ts, row):
        (close,), prev = row, carried[0] if carried else None
        ret = close / prev - 1 if prev and close is not None else None
        return (close,), (close, ret) if ret is not None and abs(ret) > self.threshold else None


class Runs(InOrder):
    value, carried, out = "state string", "state string, n long", "state string, run_length long"

    def step(self, carried, ts, row):
        n = carried[1] + 1 if carried and carried[0] == row[0] else 1
        return (row[0], n), (row[0], n)


def in_order(rows: DataFrame, processor: InOrder, delay: str) -> DataFrame:
    """Rows of a stream (``series_id``, ``ts`` and what the processor names) in the order of their time.  ``delay`` has to
    cover how far behind the newest row one may come.  Needs the RocksDB state store."""
    rows = rows.select("series_id", c("ts").cast("timestamp").alias("ts"), *_names(processor.value)).withWatermark("ts", delay)
    return rows.groupBy("series_id").transformWithState(processor, f"series_id string, ts timestamp, {processor.out}", "append", "EventTime")


def move_alerts(bars: DataFrame, threshold: float = 0.08, delay: str = "10 minutes") -> DataFrame:
    """Bars whose close moved more than the threshold from the bar before."""
    return in_order(bars, Moves(threshold), delay)


def state_runs(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Length of the current run of ``state`` per series."""
    return in_order(rows, Runs(), delay)


def staleness(bars: DataFrame, panel: Panel, now: Column, slack: int = 1) -> DataFrame:
    """Series whose last bar is more than ``slack`` steps behind."""
    last = bars.groupBy(*panel.keys).agg(F.max(panel.ts).alias("last_ts"))
    behind = panel.pos(now) - panel.pos(c("last_ts"))
    return last.withColumns({"behind": behind, "stale": behind > slack})
