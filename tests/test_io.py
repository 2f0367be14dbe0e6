"""Readers, sinks and streaming writers on files."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.features import FEATURES
from tidemark.panel import DAILY
from tidemark.sources import bars, files
from tidemark.streaming import bars as st

c = F.col


def frame(spark, rows, schema="series_id string, ts date, close double"):
    return spark.createDataFrame(rows, schema)


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def test_csv_with_junk_header_rows(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("date,a\nTicker,B\nDate,\n2020-01-01,1.5\n2020-01-02,bad\n")
    df = files.drop_unparsed(files.read_csv(spark, str(p), "ts date, a double"), ["ts"])
    assert [tuple(r) for r in df.orderBy("ts").collect()] == [(day(0), 1.5), (day(1), None)]


def test_newest_file_and_file_key(spark, tmp_path):
    for i in (1, 2, 3):
        frame(spark, [("a", day(i), float(i))]).coalesce(1).write.parquet(str(tmp_path / f"seed_{i}.parquet"))
        time.sleep(1.1)
    got = files.newest_file(spark, str(tmp_path / "seed_*.parquet" / "*.parquet"))
    assert got.first()["close"] == 3.0
    p = tmp_path / "flat"
    p.mkdir()
    for i in (4, 5):
        (p / f"seed_{i}.csv").write_text(f"{i}.0\n")
    df = files.with_file_key(spark.read.schema("x double").csv(str(p)), r"seed_(\d+)", "seed")
    assert sorted((r["x"], r["seed"]) for r in df.collect()) == [(4.0, 4), (5.0, 5)]


def test_pruned_read_reports_missing(spark, tmp_path):
    frame(spark, [("a", day(0), 1.0)]).write.parquet(str(tmp_path / "t"))
    df, missing = files.read_present(spark, str(tmp_path / "t"), ["close", "absent"])
    assert df.columns == ["close"] and missing == ["absent"]


def test_resumable_dump(spark, tmp_path):
    path = str(tmp_path / "dump")
    df = spark.range(6).select((c("id") % 3).alias("seed"), c("id").alias("v"))
    assert files.dump_missing_partitions(df.filter("seed < 2"), path, "seed") == 2
    assert files.dump_missing_partitions(df, path, "seed") == 1
    assert files.dump_missing_partitions(df, path, "seed") == 0
    assert spark.read.parquet(path).count() == 6


def test_resumable_dump_of_odd_names(spark, tmp_path):
    path = str(tmp_path / "dump")
    rows = [("a b", 1), ("x/y=z%", 2), (None, 3), ("", 4), ("ü:1", 5)]
    df = spark.createDataFrame(rows, "name string, v long")
    assert files.dump_missing_partitions(df.where("v != 1"), path, "name") == 3
    assert files.dump_missing_partitions(df, path, "name") == 1
    assert files.dump_missing_partitions(df, path, "name") == 0
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5]


def test_upsert_rules(spark):
    old = frame(spark, [("a", day(0), 1.0), ("a", day(1), 2.0)])
    new = frame(spark, [("a", day(1), 9.0), ("a", day(2), 3.0)])
    take = lambda d: [r["close"] for r in d.orderBy("ts").collect()]
    assert take(files.upsert(old, new, ["series_id", "ts"])) == [1.0, 9.0, 3.0]
    assert take(files.upsert(old, new, ["series_id", "ts"], keep="old")) == [1.0, 2.0, 3.0]
    assert take(files.append_missing(old, new.drop("close").withColumn("close", F.lit(7.0)), ["series_id", "ts"])) == [1.0, 2.0, 7.0]
    # a replacing null wins too
    gone = frame(spark, [("a", day(1), None)])
    assert take(files.upsert(old, gone, ["series_id", "ts"])) == [1.0, None]


def test_summary_document_and_overwrite(spark, tmp_path):
    files.summary_document(spark.range(3).agg(F.sum("id").alias("total")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["total"] == 3
    files.overwrite(spark.range(2), str(tmp_path / "o"))
    files.overwrite(spark.range(5), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5


def test_epoch_days_do_not_depend_on_zone(spark):
    rows = [(x,) for x in ("2019-01-01", "2020-02-29", "2021-07-01", "2021-03-13", "2021-03-14")]
    df = spark.createDataFrame(rows, "d string").withColumn("ms", bars.day_to_ms(F.to_date("d")))
    got = df.select("d", bars.to_utc_day(c("ms")).cast("string").alias("back"), "ms").collect()
    for r in got:
        assert r["back"] == r["d"]
        want = dt.datetime.fromisoformat(r["d"]).replace(tzinfo=dt.timezone.utc).timestamp() * 1000
        assert r["ms"] == int(want)


def test_upsert_batch_is_idempotent_and_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    mk = lambda rows: frame(spark, rows).withColumn("month", F.date_format("ts", "yyyy-MM"))
    write = st.upsert_batch(path, ["series_id", "ts"], "month")
    write(mk([("a", day(0), 1.0), ("a", day(40), 2.0)]), 0)
    late = mk([("a", day(0), 5.0), ("a", day(1), 6.0)])
    write(late, 1)
    once = sorted(tuple(r) for r in spark.read.parquet(path).select("ts", "close").collect())
    write(late, 1)
    twice = sorted(tuple(r) for r in spark.read.parquet(path).select("ts", "close").collect())
    assert once == twice == [(day(0), 5.0), (day(1), 6.0), (day(40), 2.0)]


def test_incremental_features_equal_the_batch_result(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(s, day(i), float(p)) for s in "ab" for i, p in enumerate(100 * np.cumprod(1 + rng.normal(0, 0.02, 160)))]
    df = frame(spark, rows).withColumn("series_start", F.lit(day(0)))
    names = ["return_7d", "sma_50d", "zscore_50d"]
    src = str(tmp_path / "in")
    df.filter(c("ts") < day(120)).write.parquet(src)
    write = st.feature_batch(str(tmp_path / "bars"), str(tmp_path / "feat"), DAILY, names)

    def drain():
        q = (
            spark.readStream.schema(df.schema).parquet(src).writeStream.trigger(availableNow=True)
            .option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(write).start()
        )
        q.awaitTermination()

    drain()
    df.filter(c("ts") >= day(115)).write.mode("append").parquet(src)  # five days arrive twice
    drain()
    got = spark.read.parquet(str(tmp_path / "feat")).toPandas().sort_values(["series_id", "ts"])
    want = FEATURES.build(df, DAILY, names)[0].toPandas().sort_values(["series_id", "ts"])
    assert len(got) == len(want) == 320
    np.testing.assert_allclose(got[names].astype(float), want[names].astype(float), rtol=1e-9)
    # a batch that ran and is run again, whole or only as far as the features
    write(df.filter(c("ts") >= day(115)), 1)
    again = spark.read.parquet(str(tmp_path / "feat")).toPandas().sort_values(["series_id", "ts"])
    np.testing.assert_allclose(again[names].astype(float), got[names].astype(float), rtol=1e-9)
    assert len(again) == 320 and spark.read.parquet(str(tmp_path / "bars")).count() == 320


def test_staleness(spark):
    df = frame(spark, [("a", day(0), 1.0), ("b", day(5), 1.0)])
    got = {r["series_id"]: r["stale"] for r in st.staleness(df, DAILY, F.lit(day(6))).collect()}
    assert got == {"a": True, "b": False}


@pytest.mark.parametrize("payload,rows", [('[["0","1.5","2","1","1.7","10","86399999","0","3","0","0","0"],["86400000","x","2","1","1.7","10","172799999","0","3","0","0","0"]]', [1.5, None])])
def test_klines(spark, payload, rows):
    got = bars.klines(spark.createDataFrame([(payload,)], "payload string"), "payload", prefix="spot_")
    assert [r["spot_open"] for r in got.orderBy("open_time").collect()] == rows
