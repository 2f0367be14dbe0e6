"""Fitted pipelines kept by cutoff and settings.

Models lie in the folder of their cutoff and of the fingerprint of every setting they were trained with,
and are found again by both: a run with the same settings loads them, a changed setting has another
fingerprint and trains anew.  A folder counts once its mark is written, after all of its bags, so what
a run that ended early left behind is trained again.  Every request is a row of the log.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.training import fingerprint

LOG = "cutoff_ts date, config string, settings string, action string, bags int, at timestamp"


@dataclass(frozen=True)
class ModelStore:
    """``path`` is a folder that all executors share."""

    path: str

    def folder(self, cutoff: str, settings: Mapping) -> str:
        return f"{self.path}/models/cutoff={cutoff}/config={fingerprint(settings)}"

    def _mark(self, spark: SparkSession, folder: str):
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_COMPLETE")
        return mark.getFileSystem(spark._jsc.hadoopConfiguration()), mark

    def models(self, spark: SparkSession, cutoff: str, settings: Mapping, bags: int, fit: Callable[[], list[PipelineModel]]) -> list[PipelineModel]:
        """The bags of a cutoff and settings: loaded if they are there, else fitted and kept."""
        folder = self.folder(cutoff, settings)
        fs, mark = self._mark(spark, folder)
        action = "load" if fs.exists(mark) else "fit"
        if action == "load":
            out = [PipelineModel.load(f"{folder}/bag={i}") for i in range(bags)]
        else:
            out = fit()
            for i, m in enumerate(out):
                m.write().overwrite().save(f"{folder}/bag={i}")
            fs.create(mark, True).close()
        row = (dt.date.fromisoformat(cutoff), fingerprint(settings), json.dumps(settings, sort_keys=True), action, len(out), dt.datetime.now())
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return out

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(LOG).parquet(f"{self.path}/log")
