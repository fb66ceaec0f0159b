"""An extension: the cross-source merge kept up to date from a stream of postings, by state per key."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedupe import merge_key

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _preference(row: Row) -> tuple:
    """Larger is better; as in the merge of whole tables: a description, easy application, the longer description, the earlier row."""
    text, easy = row["description"], row["easy_apply"]
    n = -1 if text is None else len(text)
    return min(n, 1), -1 if easy is None else int(easy), n, -row["seq"]


class Merged(StatefulProcessor):
    """The best row of a key and the place of its first one; a key's new row is emitted if either has changed."""

    def __init__(self, schema: T.StructType):
        self.fields, self.state_schema = schema.fieldNames(), schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.best.get() if self.best.exists() else None
        before = None if held is None else Row(**dict(zip(self.fields, held)))
        best, first = before, None if before is None else before["first_seen"]
        for row in rows:
            first = row["seq"] if first is None else min(first, row["seq"])
            if best is None or _preference(row) > _preference(best):
                best = row
        new = tuple(first if f == "first_seen" else best[f] for f in self.fields)
        if before is None or new != tuple(before[f] for f in self.fields):
            self.best.update(new)
            yield Row(key=key[0], **dict(zip(self.fields, new)))

    def close(self) -> None:
        pass


def finished(spark: SparkSession, target: str) -> dict[int, str]:
    """Batch number -> folder of the batches that were written to their end."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{target}/b*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    folders = [f.getPath().getParent().toString() for f in found or ()]
    return {int(f.rpartition("/b")[2]): f for f in folders if re.fullmatch(r"\d+", f.rpartition("/b")[2])}


def latest(spark: SparkSession, target: str) -> DataFrame | None:
    """The merged table after the last finished batch, or None before the first: the last row written of each key.

    A folder that is missing among the batches is an error, as its rows would be.
    """
    folders = finished(spark, target)
    if not folders:
        return None
    gone = set(range(max(folders) + 1)) - set(folders)
    if gone:
        raise FileNotFoundError(f"batches {sorted(gone)} are missing below {target}")
    parts = [spark.read.parquet(folder).withColumn("__batch", F.lit(n)) for n, folder in folders.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    row = F.struct(*[F.col(c) for c in rows.columns if c not in ("key", "__batch")])
    return rows.groupBy("key").agg(F.max_by(row, "__batch").alias("row")).select("row.*")


def keep_merged(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch of postings (with seq) into the merged table under target; `latest` reads it.

    The best row of each key is state, so a batch writes the keys that it changes and nothing else, into a
    folder of its own name; a batch that is run again writes the same folder again.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    schema = T.StructType([*stream.schema.fields, T.StructField("first_seen", T.LongType())])
    out = T.StructType([T.StructField("key", T.StringType()), *schema.fields])
    changed = stream.withColumn("key", F.sha2(merge_key(), 256)).groupBy("key").transformWithState(
        statefulProcessor=Merged(schema), outputStructType=out, outputMode="Update", timeMode="None"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/b{batch_id}")

    return (
        changed.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        .queryName(f"merge_{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()
    )
