"""File sources and sinks: postings, delimited lines, text trees, configuration-backed records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..functions.text import squeeze
from ..operators.scan import is_text_path
from ..schema import POSTING
from .scratch import opened


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file systems find the path (or pattern)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def _present(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Missing and null text are both empty, a missing flag is false."""
    empty = {T.StringType(): F.lit(""), T.BooleanType(): F.lit(False)}
    return df.withColumns({f.name: F.coalesce(f.name, empty[f.dataType]) for f in schema if f.dataType in empty})


def _records(spark: SparkSession, path: str, schema: T.StructType, array: bool | None) -> DataFrame:
    if array is None:
        first = spark.read.text(path).where(F.trim("value") != "").select(F.left(F.ltrim("value"), F.lit(1)).alias("c")).first()
        array = first is not None and first.c == "["
    return spark.read.schema(schema).option("multiLine", array).json(path)


def read_postings(spark: SparkSession, path: str, schema: T.StructType = POSTING, array: bool | None = None) -> DataFrame:
    """Records as `write_json` writes them: a JSON array per file, or a record per line; a missing file is an empty table.

    array: which of the two, None to see by the first character. A file of lines is read in splits, one
    with an array by one task.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return _present(_records(spark, path, schema, array), schema)


def read_numbered_postings(spark: SparkSession, path: str, schema: T.StructType = POSTING) -> DataFrame:
    """`read_postings` of one file, with seq: the records' places in it."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("seq", T.LongType()), *schema.fields]))
    return _present(numbered(_records(spark, path, schema, None)).drop("file"), schema)


def write_json(df: DataFrame, path: str, array: bool = False) -> None:
    """A record per line; or, for readers of whole files, an array per part, which is streamed like lines."""
    if not array:
        df.write.mode("overwrite").json(path)
        return

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for b in batches:
            lines = []
            for record in b.column(0):
                lines.append(mark + record.as_py())
                mark = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": pa.array(["[]" if mark == "[" else "]"], pa.string())})

    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    rows.mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)


def parse_lines(lines: DataFrame, today: str, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """`URL | Company | Position | Location | Description` per line; blanks, comments and other starts go."""
    text = F.trim(F.regexp_replace(F.col(line), "[\\t\\r\\n]", " "))
    parts = F.transform(F.split(text, r"\|"), lambda p: F.trim(p))
    part = lambda i: F.coalesce(F.get("parts", F.lit(i)), F.lit(""))
    rows = lines.where((text != "") & ~text.startswith("#")).select(*keep, parts.alias("parts")).where(part(0).startswith("http"))
    return rows.withColumn("url", urls.clean(part(0))).select(
        *keep, squeeze(part(1)).alias("company"), squeeze(part(2)).alias("position"), "url", F.lit(today).alias("date"),
        squeeze(part(3)).alias("location"), urls.source("url").alias("source"), squeeze(part(4)).alias("description"),
        F.lit(False).alias("easy_apply"), F.lit("manual_import").alias("search_keyword"), urls.posting_id("url").alias("job_id"),
    )


def read_lines(spark: SparkSession, path: str, today: str) -> DataFrame:
    """parse_lines over a text file, in file order by seq; a missing file is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("seq", T.LongType()), *POSTING.fields]))
    return parse_lines(numbered_lines(spark, path), today, keep=("seq",))


def numbered(rows: DataFrame) -> DataFrame:
    """rows, as a file source gives them, with file and seq: their number in the file, from 0, read in splits.

    A row's number is its place in its block plus the rows of the blocks before it; blocks are told apart by
    where they start, and counted in a pass of their own.
    """
    placed = rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"), *rows.columns,
    )
    blocks = placed.groupBy("file", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "__block", "__first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    seq = F.col("__before") + F.col("__at") - F.col("__first")
    return placed.join(starts, ["file", "__block"]).select("file", seq.alias("seq"), *rows.columns)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, value): the lines of text files with their numbers."""
    return numbered(spark.read.option("lineSep", "\n").text(path))


def normal_line() -> Column:
    return F.rtrim(F.concat_ws(" | ", "url", "company", "position", "location", "description"))


def write_lines(df: DataFrame, path: str, seq: str = "seq") -> None:
    """The normalised lines, one per posting, in order."""
    df.orderBy(seq).select(normal_line().alias("value")).write.mode("overwrite").text(path)


def write_named_texts(rows: DataFrame, path: str = "path", text: str = "text") -> None:
    """Each row's text under its own path (a URI); a task that runs again writes the same files again."""

    def write(part) -> None:
        for row in part:
            system, where = opened(row[0])
            system.create_dir(where.rpartition("/")[0], recursive=True)
            with system.open_output_stream(where) as out:
                out.write((row[1] or "").encode())

    rows.select(path, text).foreachPartition(write)


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file below root, whatever its name; root may be one file.

    The driver lists the first level only, tasks list each folder in it.
    """
    root = root.rstrip("/")
    system, where = opened(root)
    prefix = root.removesuffix(where)
    top = system.get_file_info(where)
    found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where))
    rows = [(prefix + f.path, None if f.type == fs.FileType.Directory else f.size) for f in found]
    schema = pa.schema([("path", pa.string()), ("size", pa.int64())])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(*(c.to_pylist() for c in b.columns)):
                files = [(path, size)]
                if size is None:
                    system, where = opened(path)
                    start = path.removesuffix(where)
                    infos = system.get_file_info(fs.FileSelector(where, recursive=True))
                    files = [(start + f.path, f.size) for f in infos if f.type == fs.FileType.File]
                for k in range(0, len(files), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*files[k : k + 10_000]), schema.types)], schema=schema)

    listed = spark.createDataFrame(rows, "path string, size long")
    return listed.repartition(max(1, len(rows))).mapInArrow(below, "path string, size long")


def read_text_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the text files below root, hidden ones too; other files are not opened.

    Bytes that are no UTF-8 become U+FFFD. Files are read one by one, each whole.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, where = opened(path)
                with system.open_input_stream(where) as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "content": pa.array([text], pa.string())})

    wanted = file_tree(spark, root).where(is_text_path(F.col("path"))).select("path")
    return wanted.repartition("path").mapInArrow(read, "path string, content string")
