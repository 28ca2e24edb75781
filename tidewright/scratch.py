"""Scratch tables: what later jobs read from files instead of lineage.

They go to the shared folder named by ``spark.checkpoint.dir``. Only in local mode, where
that is unset, a temporary folder of this machine is used; on a cluster it is an error.
``tables_made`` tells which tables a job has written, ``discard`` removes them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_making: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that outlive a job."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tidewright-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path, noted by ``tables_made``."""
    path = f"{scratch_root(spark)}/tables/{uuid.uuid4().hex}/{name}"
    for made in _making:
        made.append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of the scratch tables written inside the block."""
    _making.append([])
    try:
        yield _making[-1]
    finally:
        _making.pop()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
        parent.getFileSystem(conf).delete(parent, True)
