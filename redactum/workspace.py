"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where the session names one. Where it is unset a
    local session gets a temporary folder, and so does ``local-cluster``, whose executors
    run on the same machine; any other session has to name one, as no folder of one
    machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = getattr(spark, "_redactum_shared", None)
        if own is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            own = "file://" + tempfile.mkdtemp(prefix="redactum-")
            spark._redactum_shared = own
        found = own
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _FOLDERS:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001, S112 - the session may be gone by now; the others are still tried
            continue


class Workspace:
    """A folder of written tables that cut a plan's lineage.

    ``write`` computes a DataFrame once into the shared folder and returns the
    table read back, so that lost executors never cause more than the current
    step to run again. ``drop`` removes a table that nothing reads any more;
    what a returned DataFrame still reads goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        _FOLDERS.append((spark, self.path))

    def folder(self, name: str) -> str:
        self.count += 1
        return f"{self.path}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        path = self.folder(name)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._redactum_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._redactum_path)
