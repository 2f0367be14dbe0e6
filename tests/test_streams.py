"""Rows in the order of their time, however they are dealt over micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.plans import stream_queries as sq
from tidemark.streaming import bars as st

T0 = dt.datetime(2020, 1, 1)


class Value:
    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return self.x

    def update(self, x):
        self.x = x

    def clear(self):
        self.x = None


class Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        del self[k]


class Handle:
    """The state of one key, and timers that fire when the watermark reaches them."""

    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):  # noqa: N802
        return Map()

    def getValueState(self, *_):  # noqa: N802
        return Value()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def played(processor, batches, key, delay_hours):
    """Batches of rows of one key through the processor, with a watermark that follows the newest row."""
    handle, out, newest, mark = Handle(), [], T0, 0
    processor.init(handle)
    for rows in [*batches, None]:
        if rows is None:
            mark = 10**15
        else:
            out += processor.handleInputRows(key, (r for r in rows if r["ts"].timestamp() * 1000 > mark), Clock(mark))
            newest = max([newest, *(r["ts"] for r in rows)])
            mark = max(mark, int((newest - dt.timedelta(hours=delay_hours)).timestamp() * 1000))
        while handle.timers and min(handle.timers) <= mark:
            handle.timers.remove(min(handle.timers))
            out += processor.handleExpiredTimer(key, Clock(mark), None)
    assert not processor.waiting and not handle.timers
    return out


def runs(rows):
    out, last, n = [], None, 0
    for ts, state in rows:
        n = n + 1 if state == last and out else 1
        last = state
        out.append((ts, state, n))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_any_batches_give_the_same_rows(seed):
    rng = random.Random(seed)
    rows = [Row(ts=T0 + dt.timedelta(hours=i), state=rng.choice(["a", "b", None]), close=rng.choice([1.0, 1.05, 2.0, 0.0, None])) for i in range(120)]
    dealt = rows[:]
    if seed % 2:
        rng.shuffle(dealt)  # any order: the delay covers all of it
    cuts = sorted(rng.sample(range(1, 120), seed))
    batches = [dealt[a:b] for a, b in zip([0, *cuts], [*cuts, 120])]
    got = played(st.Runs(), batches, ("s",), 500)
    assert [(r.ts, r.state, r.run_length) for r in got] == runs([(r.ts, r.state) for r in rows])
    got, prev, want = played(st.Moves(0.08), batches, ("s",), 500), None, []
    for r in rows:
        if prev and r.close is not None and abs(r.close / prev - 1) > 0.08:
            want.append((r.ts, r.close, r.close / prev - 1))
        prev = r.close
    assert [(r.ts, r.close, r.ret) for r in got] == want


def test_late_and_repeated_rows():
    at = lambda h, s: Row(ts=T0 + dt.timedelta(hours=h), state=s)
    batches = [[at(0, "a"), at(10, "a"), at(9, "x")], [at(1, "late"), at(9, "a")], [at(20, "a")]]
    got = played(st.Runs(), batches, ("s",), 5)
    assert [(r.state, r.run_length) for r in got] == [("a", 1), ("a", 2), ("a", 3), ("a", 4)]
    assert played(st.Runs(), batches, (None,), 5) == []


def test_files_in_any_order(spark, tmp_path):
    """Three files dealt by hash, one a batch, then the end of input."""
    rng = random.Random(9)
    rows = [(s, T0 + dt.timedelta(hours=i), rng.choice("ab")) for s in ("x", "y") for i in range(100)]
    d = spark.createDataFrame(rows, "series_id string, ts timestamp, state string")
    sq.bar_files(d, f"{tmp_path}/in", 3)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = sq.drained(st.state_runs(stream, f"{sq.DELAY_DAYS} days"), then=lambda: sq.heartbeat(spark, f"{tmp_path}/in")).where(F.col("series_id").isNotNull()).collect()
    want = [(s, *r) for s in ("x", "y") for r in runs([(t, v) for k, t, v in rows if k == s])]
    assert sorted((r.series_id, r.ts, r.state, r.run_length) for r in got) == want
