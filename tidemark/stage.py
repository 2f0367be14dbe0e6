"""Written stage boundaries.

A table that several later steps read (the panel, the signals, the decisions) is written once as
parquet to the shared folder the cluster names in ``spark.checkpoint.dir`` and read back: lineage
ends there, an executor that is lost later costs nothing upstream, readers prune columns, and Spark
knows the size of what it reads when it chooses joins.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_DONE: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Only a local master without one gets a temporary folder, which goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def stage(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _version(spark: SparkSession, inputs: tuple) -> tuple:
    """What the input folders hold just now: name, length and time of each entry."""
    out = []
    for x in inputs:
        if not isinstance(x, str):
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            out += sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
    return tuple(out)


def staged_once(spark: SparkSession, label: str, inputs: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The staged result of ``make`` for these inputs, written at most once per application and version of
    the input folders."""
    key = (spark.sparkContext.applicationId, label, inputs, _version(spark, inputs))
    path = _DONE.get(key)
    if path is None:
        path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex[:12]}"
        make().write.parquet(path)
        _DONE[key] = path
    return spark.read.parquet(path)
