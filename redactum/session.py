"""Sessions, and the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a context, so that their Python finds it."""
    context = spark.sparkContext
    if getattr(context, "_redactum_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="redactum-zip-")) / "redactum.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(to))
    context._redactum_shipped = True
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores if it has fewer partitions than there are cores, up to 64.

    A small file is one task, however much work its rows are. Inputs of 64 partitions
    or of one for each core are left as they are, without a shuffle.
    """
    cores = min(64, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session as tests and the benchmark use it."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(shuffle))
    b = b.config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
