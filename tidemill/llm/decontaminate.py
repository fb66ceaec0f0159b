"""Benchmark decontamination by an FM-index per shard of the training texts.

Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. A window is ten
consecutive words of a benchmark item; a shorter item is one window. A task cuts its documents into
shards of SHARD_BYTES at most (a longer text is one of its own), indexes each, finds every window by
backward search over wavelet-matrix ranks, locates the occurrences by sampled suffix positions and
merges them into removal spans.

Only runs of words in which every neighbouring pair is a pair of some window can hold a window of two
words or more; the index leaves out all others, which changes no result.

The benchmark is a stated query set. It is taken in blocks of BLOCK_WINDOWS windows, give or take one
item. The driver holds, and a task searches, one block at a time: with more blocks than one, each is
a pass of its own over the texts whose hits go to the shared folder, keyed by a digest of the text, and
the passes are joined back at the end. The training side is never moved by a single block.

Defined cases: a null or empty text has no words; items with a null id, null text or no word are left
out; items that share a text or an id each count as their ids (an id counts once); repeated documents
are judged one by one; doc_id may be of any type and, like all columns of kept rows, is passed on as it
is; other columns are ignored by the report; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .fmindex import FMIndex

WINDOW = 10
BLOCK_WINDOWS = 200_000
SHARD_BYTES = 16 << 20
#: Word bytes as they are with A-Z lower-cased; all others become spaces.
_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Windows:
    """One block of windows as integer rows by length, with the items each belongs to."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text)
            for k in range(max(1, len(ids) - size + 1)):
                found.setdefault(ids[k : k + size], set()).add(number[item])
        self.by_length = {}
        for n in sorted({len(w) for w in found}):
            rows = [w for w in found if len(w) == n]
            owners = [sorted(found[w]) for w in rows]
            self.by_length[n] = (
                np.array(rows, np.int64).reshape(len(rows), n),
                np.cumsum([0, *map(len, owners)]),
                np.array([o for own in owners for o in own], np.int64),
            )
        self.sigma = len(self.vocabulary) + 1
        pairs = [r[:, k] * self.sigma + r[:, k + 1] for r, _, _ in self.by_length.values() for k in range(r.shape[1] - 1)]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        self.least = min(self.by_length, default=0)


def _runs(ids: np.ndarray, doc: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The runs worth indexing: symbols with closing zeros, and the word each came from (-1 for zeros)."""
    known = ids > 0
    if windows.least > 1:
        pair = ids[:-1] * windows.sigma + ids[1:]
        at = np.minimum(np.searchsorted(windows.pairs, pair), max(0, len(windows.pairs) - 1))
        linked = (windows.pairs[at] == pair) & known[:-1] & known[1:] & (doc[:-1] == doc[1:])
        known = np.concatenate([linked, [False]]) | np.concatenate([[False], linked])
    else:
        linked = known[:-1] & known[1:] & (doc[:-1] == doc[1:])
    kept = np.flatnonzero(known)
    if not len(kept):
        return np.zeros(0, np.int64), kept
    last = np.ones(len(kept), bool)
    last[:-1] = ~((kept[1:] == kept[:-1] + 1) & linked[np.minimum(kept[:-1], len(linked) - 1)])
    at = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(last)[:-1]])
    symbols, source = np.zeros(len(kept) + int(last.sum()), np.int64), np.full(len(kept) + int(last.sum()), -1)
    symbols[at], source[at] = ids[kept], kept
    return symbols, source


def search_shard(texts: list[list[bytes]], windows: Windows) -> tuple[np.ndarray, list[set[str]]]:
    """For the words of a shard's documents: which are hit, and the items found in each document."""
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    doc = np.repeat(np.arange(len(texts)), lengths)
    delta, items = np.zeros(total + 1, np.int64), [set() for _ in texts]
    if windows.by_length and total:
        get = windows.vocabulary.get
        ids = np.fromiter((get(w, 0) for t in texts for w in t), np.int64, total)
        symbols, source = _runs(ids, doc, windows)
        index = FMIndex(symbols, windows.sigma) if len(symbols) else None
        for n, (rows, first, owners) in windows.by_length.items() if index else ():
            low, high = index.search(rows)
            counts = high - low
            which = np.repeat(np.arange(len(rows)), counts)
            suffix = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(which))
            at = source[index.locate(suffix)]
            np.add.at(delta, at, 1)
            np.add.at(delta, at + n, -1)
            for d, w in set(zip(doc[at].tolist(), which.tolist())):
                items[d].update(windows.items[o] for o in owners[first[w] : first[w + 1]])
    return np.cumsum(delta[:-1]) > 0, items


def _blocks(benchmark: DataFrame, size: int) -> Iterator:
    """Broadcasts of the benchmark's windows, block by block; the driver holds one block."""
    context, held, n = benchmark.sparkSession.sparkContext, [], 0
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), "text")
    for item, text in rows.toLocalIterator():
        found = words(text)
        if found:
            held.append((item, found))
            n += max(1, len(found) - size + 1)
        if n >= BLOCK_WINDOWS:
            yield context.broadcast(Windows(held, size))
            held, n = [], 0
    if held:
        yield context.broadcast(Windows(held, size))


def _parts(batch: pa.RecordBatch, texts: list[str]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in shards of at most SHARD_BYTES characters, a longer text being one of its own."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (n < SHARD_BYTES or end == at):
            n += len(texts[end])
            end += 1
        yield batch.slice(at, end - at), texts[at:end]
        at = end


def _searched(batches: Iterator[pa.RecordBatch], windows: Windows | None):
    """(part of a batch, its texts, words of each text, places of the hit words of each, items of each) by shard."""
    for batch in batches:
        column = batch.column(batch.schema.names.index("text"))
        for part, texts in _parts(batch, [t.as_py() or "" for t in column]):
            split = [words(t) for t in texts]
            first = np.cumsum([0, *map(len, split)])
            if windows is None:
                yield part, texts, np.diff(first), [np.zeros(0, np.int64)] * len(texts), [set()] * len(texts)
                continue
            hit, items = search_shard(split, windows)
            at = np.flatnonzero(hit)
            bounds = np.searchsorted(at, first)
            places = [at[bounds[k] : bounds[k + 1]] - first[k] for k in range(len(texts))]
            yield part, texts, np.diff(first), places, items


def _runs_of(places: np.ndarray) -> list[dict]:
    """Increasing word places as runs, end exclusive."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    starts, ends = places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)] + 1
    return [{"start": a, "end": e} for a, e in zip(starts.tolist(), ends.tolist())]


def _spans(text: str, runs: list[dict]) -> list[dict]:
    """Runs of words as code-point spans of the text."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)] if runs else []
    return [{"start": places[r["start"]][0], "end": places[r["end"] - 1][1]} for r in runs]


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"


def _report(part: pa.RecordBatch, texts: list[str], n_words, runs: list[list[dict]], items: list[list[str]]) -> pa.RecordBatch:
    n_hit = [sum(r["end"] - r["start"] for r in own) for own in runs]
    digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    columns = [
        part.column(part.schema.names.index("doc_id")), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()),
        pa.array([_spans(t, own) for t, own in zip(texts, runs)], _SPAN),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", *[x.split()[0] for x in _REPORT.split(", ")]])


def _digest():
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _passes(docs: DataFrame, shared: Iterator) -> DataFrame:
    """(digest, runs, items) of every text that a window hits, one pass over the texts per block."""

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _, _, places, items in _searched(batches, block.value):
                hit = [k for k, p in enumerate(places) if len(p)]
                columns = [part.column(0).take(pa.array(hit, pa.int64())), pa.array([_runs_of(places[k]) for k in hit], _SPAN)]
                columns.append(pa.array([sorted(items[k]) for k in hit], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, ["digest", "runs", "items"])

        return run

    texts, out = docs.select(_digest().alias("digest"), "text"), None
    for block in shared:
        found = texts.mapInArrow(search(block), "digest string, runs array<struct<start:int,end:int>>, items array<string>")
        found = materialise(found.dropDuplicates(["digest"]), "contaminated")
        out = found if out is None else out.unionByName(found)
        block.unpersist()
    # at most one row per block and text
    return out.groupBy("digest").agg(
        F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )


def _first_two(blocks: Iterator) -> tuple[list, Iterator]:
    """Up to two blocks, and all of them again."""
    head = list(islice(blocks, 2))
    return head, chain(head, blocks)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the removal spans of every document."""
    head, shared = _first_two(_blocks(benchmark, size))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_REPORT}"
    if len(head) < 2:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts, n_words, places, items in _searched(batches, head[0].value if head else None):
                yield _report(part, texts, n_words, [_runs_of(p) for p in places], items)

        return docs.select("doc_id", "text").mapInArrow(run, kind)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            runs = []
            for own in b.column(2).to_pylist():
                ranges = [np.arange(r["start"], r["end"]) for r in own or ()]
                runs.append(_runs_of(np.unique(np.concatenate([np.zeros(0, np.int64), *ranges]))))
            items = [x or [] for x in b.column(3).to_pylist()]
            yield _report(b, texts, [len(words(t)) for t in texts], runs, items)

    rows = docs.select("doc_id", "text", _digest().alias("digest")).join(_passes(docs, shared), "digest", "left")
    return rows.select("doc_id", "text", "runs", "items").mapInArrow(join, kind)


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window occurs, with all their columns as they are."""
    head, shared = _first_two(_blocks(benchmark, size))
    if not head:
        return docs
    if len(head) > 1:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _digest().alias("digest"))
        return rows.join(_passes(docs, shared).select("digest"), "digest", "left_anti").select("row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, places, _ in _searched(batches, head[0].value):
            yield part.filter(pa.array([len(p) == 0 for p in places], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
