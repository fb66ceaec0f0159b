"""Shared pieces of the training-data operators: reading, scratch tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: The white space between words of quality rules and shingles, as a regex class.
SPACES = r"[\x20\x09-\x0D]"
_CHECKPOINT = "spark.checkpoint.dir"
#: The folder of a local session that names none.
_local: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a folder of this machine will do for a local session only; a cluster has to name one.
    """
    found = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT} to a folder that driver and executors share")
        if not _local:
            _local.append(f"file://{tempfile.mkdtemp(prefix='tidemill-')}")
        found = _local[0]
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and survives lost executors.

    An empty table is written and read back as one of the same columns.
    """
    return read_scratch(write_scratch(df, name), df)


def write_scratch(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def read_scratch(path: str, like: DataFrame) -> DataFrame:
    return like.sparkSession.read.schema(like.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more; one that is gone already, or no path at all, is no error."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has no more than so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def whole_number_ids(df: DataFrame, *columns: str) -> None:
    """Refuse, before anything runs, identifiers that are not of a whole-number type."""
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, IntegralType):
            raise TypeError(f"{c} has to be of a whole-number type, not {kind.simpleString()}")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
