"""Tables in the folder that driver and executors share: a lineage ends there and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: The folder of a local session that names none.
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of this machine, for a local session only."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
    if not _local:
        _local.append(f"file://{tempfile.mkdtemp(prefix='tidemill-')}")
    return _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back; an empty table keeps its columns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it, for tasks that read or write files themselves."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
