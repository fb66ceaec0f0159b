"""Data sources for search pages and remote records, and the sink for planned upserts.

Effects stay at this edge. A fetcher or client is an importable name ("module:attribute") given as an
option, so that tests and queries run against local fakes and only a deployment talks to a network.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.extract import BLOCKED
from .scratch import new_path

PAGE_SIZE = 500


def named(name: str):
    """The object that "module:attribute" names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class _Pushed:
    """Filters that a source answers itself: one value, or one of several, of the columns in `answered`."""

    answered: tuple[str, ...] = ()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.wanted: dict[str, set] = {}
        for f in filters:
            if not isinstance(f, (EqualTo, In, IsNotNull)) or len(f.attribute) != 1 or f.attribute[0] not in self.answered:
                yield f  # for Spark
                continue
            if isinstance(f, IsNotNull):
                continue  # these columns are never null
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[f.attribute[0]] = values & self.wanted.get(f.attribute[0], values)

    def asks(self, **values) -> bool:
        wanted = getattr(self, "wanted", {})
        return all(v in wanted.get(c, (v,)) for c, v in values.items())


class _Query(InputPartition):
    def __init__(self, seq: int, region: str, title: str, hours: int):
        self.seq, self.region, self.title, self.hours = seq, region, title, hours


class SearchPages(DataSource):
    """One partition per region, title and look-back, region outermost; an empty region list is one placeholder.

    Options: fetcher ("module:attribute", called with the layout and the request's parameters, giving the
    page), layout (1 or 2), regions and titles (JSON arrays), hours (a number or a JSON array), pause
    (seconds between attempts), attempts. A query that keeps failing, or whose page refuses the request,
    gives no row, and the others go on. Filters on region, search_keyword and hours choose the searches
    that are made.
    """

    @classmethod
    def name(cls) -> str:
        return "search_pages"

    def schema(self) -> str:
        return "seq int, region string, search_keyword string, html string, hours int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SearchReader(self.options)


class _SearchReader(_Pushed, DataSourceReader):
    answered = ("region", "search_keyword", "hours")

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Query]:
        regions = json.loads(self.options.get("regions", "[]")) or [""]
        titles = json.loads(self.options.get("titles", "[]"))
        back = json.loads(self.options.get("hours", "24"))
        each = [(r, t, h) for r in regions for t in titles for h in (back if isinstance(back, list) else [back])]
        return [_Query(k, r, t, h) for k, (r, t, h) in enumerate(each) if self.asks(region=r, search_keyword=t, hours=h)]

    def read(self, partition: _Query) -> Iterator[tuple]:
        if partition is None:  # what Spark plans where no search is wanted
            return
        fetch = named(self.options["fetcher"])
        layout = int(self.options.get("layout", 1))
        asked = request(layout, partition.title, partition.region, partition.hours)
        for attempt in range(int(self.options.get("attempts", 1))):
            if attempt:
                time.sleep(float(self.options.get("pause", 0)))
            try:
                page = fetch(layout, asked)
                if layout == 2:
                    refuse_blocked(page)
            except (OSError, Blocked):
                continue
            yield partition.seq, partition.region, partition.title, page, partition.hours
            return


def recency(hours: int, layout: int) -> str:
    """How each search site is told to look back: seconds, or whole days but one at least."""
    return f"r{hours * 3600}" if layout == 1 else str(max(1, hours // 24))


def request(layout: int, title: str, region: str, hours: int) -> dict[str, str]:
    """The parameters of a search, newest first."""
    if layout == 1:
        return {"keywords": title, "location": region, "f_TPR": recency(hours, 1), "sortBy": "DD", "start": "0"}
    return {"q": title, "l": region, "fromage": recency(hours, 2), "sort": "date"}


class Blocked(RuntimeError):
    """The site answered with a page that refuses the request."""


def refuse_blocked(page: str) -> None:
    low = page.lower()
    if any(mark in low for mark in BLOCKED):
        raise Blocked("the search page refuses the request")


def fetch_details(rows: DataFrame, fetcher: str, layout: int, n: int) -> DataFrame:
    """(job_id, html): the detail pages of the first n rows by seq and card_no that have an identifier.

    fetcher: "module:attribute", called with the layout and the identifier; one that fails gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = named(fetcher)
        for b in batches:
            found = []
            for job_id in b.column(0).to_pylist():
                try:
                    found.append({"job_id": job_id, "html": fetch(layout, job_id)})
                except OSError:
                    continue
            yield pa.RecordBatch.from_pylist(found, pa.schema([("job_id", pa.string()), ("html", pa.string())]))

    first = rows.orderBy("seq", "card_no").limit(n).where("job_id <> ''").select("job_id").distinct()
    return first.mapInArrow(run, "job_id string, html string")


class RemoteFields(DataSource):
    """The field definitions of a remote table: (field, ui_type).

    Option client: "module:attribute", called without arguments, giving {"items": [{"field_name", "ui_type"}]}.
    """

    @classmethod
    def name(cls) -> str:
        return "remote_fields"

    def schema(self) -> str:
        return "field string, ui_type string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FieldReader(self.options)


class _FieldReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        last = {item["field_name"]: item.get("ui_type") for item in named(self.options["client"])().get("items", [])}
        yield from last.items()


class _View(InputPartition):
    def __init__(self, name: str):
        self.name = name


class RemoteRecords(DataSource):
    """All records of a remote table, page after page: (seq, record_id, fields as JSON, view).

    Option client: "module:attribute", called with page_size and page_token, giving
    {"items": [{"record_id", "fields"}], "has_more", "page_token"}. With the option views (a JSON array)
    each view is a partition, the client is also given its name, and a filter on view chooses among them;
    seq counts within a view.
    """

    @classmethod
    def name(cls) -> str:
        return "remote_records"

    def schema(self) -> str:
        return "seq long, record_id string, fields string, view string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RecordReader(self.options)


class _RecordReader(_Pushed, DataSourceReader):
    answered = ("view",)

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_View]:
        return [_View(v) for v in json.loads(self.options.get("views", '[""]')) if self.asks(view=v)]

    def read(self, partition: _View) -> Iterator[tuple]:
        if partition is None:
            return
        client, token, seq = named(self.options["client"]), "", 0
        view = (partition.name,) if "views" in self.options else ()
        while True:
            page = client(int(self.options.get("page_size", PAGE_SIZE)), token, *view)
            for item in page.get("items", []):
                yield seq, item["record_id"], json.dumps(item.get("fields", {}), ensure_ascii=False), partition.name
                seq += 1
            if not page.get("has_more"):
                return
            token = page.get("page_token", "")


_REQUEST = "action string, record_id string, payload string, key string"


def apply_upserts(plan: DataFrame, sender: str, dry_run: bool = True) -> DataFrame:
    """Send (action, record_id, payload) rows to sender; (action, n) of what was, or would be, done.

    sender: "module:attribute", called with action, record_id, payload and a key. The key is a digest of
    the row and of its number among equal rows, the same in every attempt and every run: the sender passes
    it on as the request's idempotency key, so that a task that runs again creates nothing twice, while
    equal rows of one plan are all sent.

    The plan is evaluated once, into staged requests; nothing is sent unless all of them were staged. The
    counts are those of the tasks that sent them, whatever the remote table holds by then.
    """
    if dry_run:
        return plan.groupBy("action").count().withColumnRenamed("count", "n")
    spark = plan.sparkSession
    spark.dataSource.register(UpsertSink)
    staging = new_path(spark, "upserts")
    digest = F.sha2(F.to_json(F.struct("action", "record_id", "payload")), 256)
    requests = plan.select("action", "record_id", "payload", digest.alias("key"))
    # equal rows meet in one task, next to each other, and are numbered there as they pass
    requests.repartition("key").sortWithinPartitions("key").write.format("remote_upserts").mode("append").options(staging=staging).save()
    staged = [r.file for r in spark.read.schema("file string").json(f"{staging}/{STAGED}").collect()]  # one per task
    if staged:
        rows = spark.read.schema(_REQUEST).json(staged)
        rows.write.format("remote_upserts").mode("append").options(staging=staging, sender=sender).save()
    counts = f"{staging}/{SENT}" if staged else f"{staging}/{STAGED}"
    return spark.read.schema("action string, n long").json(counts).where("action IS NOT NULL")


STAGED, SENT = "staged.json", "sent.json"


@dataclass
class _Done(WriterCommitMessage):
    """What one task did: the file that it staged, or how often it sent each action."""

    file: str = ""
    counts: dict[str, int] = field(default_factory=dict)


class UpsertSink(DataSource):
    """The sink of planned upserts, in two phases: without a sender rows are staged, with one they are sent.

    Options: staging (a folder of the shared file system), sender. A phase counts once its job commits:
    the first then lists its files as staged, the second writes its counts. A job that is aborted leaves no
    list, and its files are deleted.
    """

    @classmethod
    def name(cls) -> str:
        return "remote_upserts"

    def schema(self) -> str:
        return _REQUEST

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return (_SendWriter if "sender" in self.options else _StageWriter)(self.options)


class _StageWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.staging = options["staging"]

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.staging.replace("s3a://", "s3://", 1))

    def write(self, rows: Iterator[Row]) -> _Done:
        system, folder = self._system()
        system.create_dir(folder, recursive=True)
        name, n, last = f"part-{uuid.uuid4().hex}.json", 0, None
        with system.open_output_stream(f"{folder}/{name}") as out:
            for row in rows:
                n, last = (n + 1 if row.key == last else 0), row.key
                request = row.asDict() | {"key": f"{row.key}:{n}"}
                out.write((json.dumps(request) + "\n").encode())
        return _Done(file=name)

    def _listed(self, name: str, lines: list[dict]) -> None:
        system, folder = self._system()
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as out:
            out.write("".join(json.dumps(x) + "\n" for x in lines).encode())

    def commit(self, messages: list[_Done | None]) -> None:
        self._listed(STAGED, [{"file": f"{self.staging}/{m.file}"} for m in messages if m])

    def abort(self, messages: list[_Done | None]) -> None:
        system, folder = self._system()
        for m in messages:
            if m and m.file:
                system.delete_file(f"{folder}/{m.file}")


class _SendWriter(_StageWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        self.sender = options["sender"]

    def write(self, rows: Iterator[Row]) -> _Done:
        send, counts = named(self.sender), Counter()
        for row in rows:
            send(row.action, row.record_id, row.payload, row.key)
            counts[row.action] += 1
        return _Done(counts=dict(counts))

    def commit(self, messages: list[_Done | None]) -> None:
        total = sum((Counter(m.counts) for m in messages if m), Counter())
        self._listed(SENT, [{"action": a, "n": n} for a, n in total.items()])


def alert(summary: str, details: str, sender: str) -> dict:
    """One alert row: details cut to 120 characters, score 0."""
    row = {"summary": summary, "details": details[:120], "matching_score": 0}
    payload = json.dumps(row)
    named(sender)("create", None, payload, hashlib.sha256(payload.encode()).hexdigest())
    return row


def register(spark) -> None:
    """Make the sources known to a session, and let it hand them the filters that they answer."""
    for source in (SearchPages, RemoteRecords, RemoteFields, UpsertSink):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
