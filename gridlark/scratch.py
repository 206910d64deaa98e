"""Intermediate tables in the folder that driver and executors share.

Tables are written as Parquet below ``spark.checkpoint.dir``.  A written table
cuts lineage, is computed once and survives the loss of executors.  ``drop``
removes a table that nothing reads any more; those that a returned, still lazy
result reads stay until the interpreter ends.
"""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; below the warehouse where a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set spark.checkpoint.dir: {warehouse} may be another folder on every machine")
    return f"{warehouse.rstrip('/')}/_intermediate"


@contextmanager
def short_shuffles(spark: SparkSession):
    """Remove a write's shuffle files when it ends: what was written is not computed again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """The intermediate tables of one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and return what reads it back."""
        path = f"{self.root}/{name}"
        with short_shuffles(self.spark):
            df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        """Remove everything; a session that has ended leaves it to the cluster."""
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.root)
            except Exception:  # noqa: BLE001  the JVM may be gone at exit
                pass
