"""File scans: declared schemas, pruned columns, newest file, key from file name; and the sinks."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the folder that Spark writes a null partition value to.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def read_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """CSV with a declared schema.  Junk lines (extra headers) do not parse and come out as null
    in the first column, where ``drop_unparsed`` removes them."""
    opts = {"header": "true", "mode": "PERMISSIVE", "enforceSchema": "true", **options}
    return spark.read.schema(schema).options(**opts).csv(path)


def drop_unparsed(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(required))


def newest_file(spark: SparkSession, glob: str, fmt: str = "parquet", **options) -> DataFrame:
    """Only the most recently modified file that matches.

    The listing is metadata only; the reader is then given that one path, so nothing else is
    opened.
    """
    listing = (
        spark.read.format("binaryFile").load(glob)
        .select("path", "modificationTime")
        .agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
    )
    path = listing.first()["path"]
    return spark.read.format(fmt).options(**options).load(path)


def with_file_key(df: DataFrame, pattern: str, name: str, cast: str = "int") -> DataFrame:
    """A key taken from the file name (one read for a directory of per-seed files)."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast(cast))


def read_present(spark: SparkSession, path: str, wanted: Sequence[str], fmt: str = "parquet", **options):
    """Scan only the wanted columns that exist; the rest is reported."""
    df = spark.read.format(fmt).options(**options).load(path)
    have = [c for c in wanted if c in df.columns]
    return df.select(*have), [c for c in wanted if c not in df.columns]


def warehouse_daily(df: DataFrame, slug: str, value: str, since: Column, day: Column, slugs: Column) -> DataFrame:
    """Warehouse table filtered by slug and date, one (largest) value per day.  Both filters
    reach the scan."""
    return (
        df.filter((slugs == slug) & (day >= since))
        .groupBy(day.cast("date").alias("ts"))
        .agg(F.max(F.col(value).cast("double")).alias(value))
    )


# -- sinks ---------------------------------------------------------------------------------------


def overwrite(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(*by) if by else w).save(path)


def aligned(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in order; absent ones null."""
    types = {f.name: f.dataType for f in like.schema.fields}
    return df.select(
        *[
            F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c)
            for c, t in types.items()
        ]
    )


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: str = "new") -> DataFrame:
    """Merge two batches by key.  ``keep='new'`` replaces, ``keep='old'`` only adds.

    ``max_by`` over the batch number is a map-side-combinable pick of a whole row, cheaper than
    sorting the union for a row_number.
    """
    first, second = (old, new) if keep == "new" else (new, old)
    cols = [c for c in old.columns if c not in keys]
    both = (
        aligned(first, old).withColumn("_batch", F.lit(0))
        .unionByName(aligned(second, old).withColumn("_batch", F.lit(1)))
    )
    pick = F.max_by(F.struct(*cols), F.struct("_batch", *cols)).alias("_row")
    return both.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols]).select(*old.columns)


def append_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add only keys that are not there yet."""
    add = aligned(new, old).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(add)


def written_partitions(spark, path: str, by: str) -> set[str]:
    """Values of ``by`` as the folder names of a partitioned table give them; none where nothing is written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return {unquote(x.removeprefix(f"{by}=")) for x in names if x.startswith(f"{by}=")}


def dump_missing_partitions(df: DataFrame, path: str, by: str) -> int:
    """Resumable dump: partitions already written are skipped; returns how many were added.

    Only the folder names are compared, never the data, and the input is computed once, by the write.
    A null or empty ``by`` is the partition that Spark names for it.
    """
    spark = df.sparkSession
    done = written_partitions(spark, path, by)
    value = F.col(by).cast("string")
    name = F.when(value.isNull() | (value == ""), _NO_VALUE).otherwise(value)
    todo = df.where(~name.isin(sorted(done))) if done else df
    todo.write.mode("append").partitionBy(by).parquet(path)
    return len(written_partitions(spark, path, by) - done)


def summary_document(df: DataFrame, path: str) -> None:
    """A one-row summary as a JSON document."""
    df.coalesce(1).write.mode("overwrite").json(path)
