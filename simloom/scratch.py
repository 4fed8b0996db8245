"""Tables that cut lineage, written to the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only a
session without that setting whose master is local (tests, a laptop) gets a
folder of its own; on a cluster it would lie on one machine, so that is refused.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one where none is set and all runs on this machine."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{_SETTING} must name a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="simloom-")
        spark.conf.set(_SETTING, found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one run, under a folder of their own.

    A table that a later one replaces should be dropped with ``drop``; what is
    left goes when the interpreter ends, since a returned DataFrame may still
    read it.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/simloom-{label}-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.folder}/{name}")

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)

    def _clear(self) -> None:
        if self.spark.sparkContext._jsc is None:
            return
        try:
            self._delete(self.folder)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return
