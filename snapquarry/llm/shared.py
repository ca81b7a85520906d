"""Shared storage and small helpers for the training-data operators.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``,
which the driver and all executors see, so a lost executor costs a re-run of its
tasks and nothing else.  Only where that setting is absent and driver and executors are one
process (tests, notebooks) is a temporary folder created and set.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SETTING = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, taken from the session; set here only where it is unset and Spark runs in one process."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not root:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="snapquarry-")
        spark.conf.set(_SETTING, root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts lineage and fixes the rows, so that later passes see the same rows
    even if a task is run again.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, with the session's Arrow batches bounded by bytes where that is not set.

    A batch of 10,000 rows, Spark's only bound by default, may be gigabytes of long texts.
    """
    conf = df.sparkSession.conf
    if _BATCH not in conf.getAll:
        conf.set(_BATCH, str(4 << 20))
    return df.mapInArrow(run, schema)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise`."""
    files = df.inputFiles()
    if files:
        drop_path(df.sparkSession, files[0].rsplit("/", 1)[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
