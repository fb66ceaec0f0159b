"""Removal of repeated substrings by a distributed sparse suffix array.

Every byte covered by a string of `least` bytes that also starts earlier (smaller doc_id, or earlier
in the same document) is removed. Strings are judged on the input.

1. Each string of `least` bytes has one anchor, the byte 16-gram in it with the least key; equal
   strings have equal anchors. Keys put frequent 16-grams last (by a sketch of fixed size), so that a
   common phrase does not become the anchor of unlike strings. Consecutive strings with one anchor
   form a context.
2. Anchors meet by 16-gram hash. Equal contexts: all but the first are removed, and only the first
   within each batch is sent on, so a passage in any number of documents costs one entry a batch.
   A 16-gram with one context needs no more; of the others the first of each context stays.
3. The texts of those contexts are fetched, and the suffixes from their anchors are sorted into an
   enhanced suffix array per hash partition; a stack scan gives its common-prefix intervals, a test
   for left diversity the maximal repeats with all their occurrences (`suffixes.maximal_repeats`).
   All occurrences but the first are removed.
4. The spans of each document are merged and applied.

Equality of 16-grams and contexts in step 2 is by two 64-bit hashes together; step 3 compares bytes.

Defined cases: a null or empty text has no bytes and nothing is removed; texts shorter than `least`
are kept whole; rows with a null doc_id come first; rows that share a doc_id are ordered by a hash of
their text, and fully equal rows are the same document (each gets its result); extra columns are
ignored; doc_id has to be of a whole-number type, others are refused; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_number_ids, width
from .hashing import U64, hash_grams, hash_ranges, mix, running_sums, sliding_min
from .sketch import cells, frequency_classes
from .suffixes import maximal_repeats, piecewise_repeats

LEAST = 100
GRAM = 16
#: Texts are hashed in pieces that fit a processor cache; anchors are sent in pages from several of them.
CHUNK_BYTES = 1 << 18
PAGE_ANCHORS = 200_000
_PLACE = 26
#: One anchor as it is sent: 16-gram hash, context hash, document, anchor, bytes of context before and after it.
_ANCHOR = np.dtype([("hash", "<u8"), ("context", "<u8"), ("ord", "<i8"), ("at", "<u4"), ("before", "u1"), ("after", "u1")])
_SLAB = 60_000


def with_order(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ord, doc_id, text, and keep): ord is unique per (doc_id, text) and orders documents; it is doc_id itself if that is unique."""
    whole_number_ids(docs, "doc_id")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)
    clash = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if clash.isEmpty():
        return rows.select(F.col("doc_id").cast("long").alias("ord"), "doc_id", "text", *keep)
    hashed = rows.withColumn("tie", F.xxhash64("text"))
    ordered = hashed.select("doc_id", "tie").distinct().orderBy(F.asc_nulls_first("doc_id"), "tie")
    # ids of rows grow along the sorted partitions; written once, they no longer depend on how these are made
    numbered = materialise(ordered.select(F.col("doc_id").alias("id"), "tie", F.monotonically_increasing_id().alias("ord")), "document-order")
    return hashed.join(numbered, F.col("doc_id").eqNullSafe(F.col("id")) & (hashed["tie"] == numbered["tie"])).select(
        "ord", "doc_id", "text", *keep
    )


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts) of some MB at a time; a longer text is a chunk of its own."""
    for b in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(b.iloc[:, 0], b["text"]):
            data = t.encode()
            ids.append(i)
            texts.append(data)
            held += len(data)
            if held >= CHUNK_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def anchors(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: np.ndarray | None, least: int):
    """(hash, anchor, first string's start, last string's end) per context of the texts at starts to ends.

    sums: the running sums of the joined texts. classes: the frequency class of each sketch cell, or
    None for plain order.
    """
    empty = np.zeros(0, np.int64)
    w = least - GRAM + 1
    n = len(sums) - least
    long_ = ends - starts >= least
    if n <= 0 or not long_.any():
        return np.zeros(0, U64), empty, empty, empty
    grams = hash_grams(sums, GRAM)
    found = []
    step = (1 << _PLACE) - 2 * least  # places must fit their bits; parts overlap by the strings that span the bound
    for base in range(0, n, step):
        part = grams[base : base + step + w - 1]
        key = (part >> U64(_PLACE + 4)) << U64(_PLACE) | np.arange(len(part), dtype=U64)
        if classes is not None:
            key |= classes[cells(part)].astype(U64) << U64(60)
        found.append((sliding_min(key, w) & U64((1 << _PLACE) - 1)).astype(np.int64) + base)
    at = found[0] if len(found) == 1 else np.concatenate(found)
    # strings within one text: those that start at starts to ends - least
    marks = np.zeros(len(at) + 1, np.int8)
    marks[starts[long_]] += 1
    marks[ends[long_] - least + 1] -= 1
    inside = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= new[1:] | ~inside[1:]
    return grams[at[first]], at[first], first, np.flatnonzero(stop) + least


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts with 0xFF after each, their starts and ends."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    return b"\xff".join(texts) + b"\xff", ends - sizes, ends


def anchor_page(held: list[np.ndarray], parts: int) -> pd.DataFrame:
    """(part, kind, data): entries by part (kind 0), and those equal to an earlier one of the page (kind 1)."""
    page = np.concatenate(held)
    page = page[np.lexsort((page["at"], page["ord"], page["context"], page["hash"]))]
    again = np.zeros(len(page), bool)
    again[1:] = (page["hash"][1:] == page["hash"][:-1]) & (page["context"][1:] == page["context"][:-1])
    part = (mix(page["hash"]) % U64(parts)).astype(np.int64)
    rows = [(int(part[0]), 1, page[again].tobytes())] if again.any() else []
    page, part = page[~again], part[~again]
    order = np.argsort(part, kind="stable")
    page, bounds = page[order], np.searchsorted(part[order], np.arange(parts + 1))
    rows += [(p, 0, page[bounds[p] : bounds[p + 1]].tobytes()) for p in range(parts) if bounds[p] < bounds[p + 1]]
    return pd.DataFrame(rows, columns=["part", "kind", "data"])


def _anchor_pages(parts: int, classes, least: int):
    """Batches of documents -> pages (part, kind, data): anchors by hash, and spans already settled on the way."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, n = classes.value, [], 0
        for ids, texts in chunks(batches):
            joined, starts, ends = _joined(texts)
            sums = running_sums(joined)
            h, at, lo, hi = anchors(sums, starts, ends, known, least)
            doc = np.searchsorted(ends, at)
            page = np.zeros(len(h), _ANCHOR)
            page["hash"], page["context"] = h, hash_ranges(sums, lo, hi)
            page["ord"], page["at"] = np.array(ids, np.int64)[doc], at - starts[doc]
            page["before"], page["after"] = at - lo, hi - at
            held.append(page)
            n += len(page)
            if n >= PAGE_ANCHORS:
                yield anchor_page(held, parts)
                held, n = [], 0
        if n:
            yield anchor_page(held, parts)

    return run


def _settled(spans: np.ndarray) -> pd.DataFrame:
    at = spans["at"].astype(np.int64)
    return _rows(0, spans["ord"], at - spans["before"], at + spans["after"], at, spans["hash"])


def _rows(kind: int, ord_, start, end, at, h) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(ord_), kind, np.int32), "ord": ord_, "start": start, "end": end, "at": at, "hash": h.view(np.int64)})


_FOUND = "kind int, ord long, start long, end long, at long, hash long"


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All anchors of a partition -> spans to remove (kind 0) and contexts whose texts must be compared (kind 1)."""
    pages = []
    for b in batches:
        for kind, data in zip(b["kind"], b["data"]):
            page = np.frombuffer(data, _ANCHOR)
            if kind:
                yield _settled(page)
            else:
                pages.append(page)
    if not pages:
        return
    page = np.concatenate(pages)
    pages.clear()
    page = page[np.argsort(page["hash"], kind="stable")]
    h = page["hash"]
    twin = np.zeros(len(h), bool)
    twin[1:] = h[1:] == h[:-1]
    twin[:-1] |= twin[1:]
    page = page[twin]
    if not len(page):
        return
    page = page[np.lexsort((page["at"], page["ord"], page["context"], page["hash"]))]
    new_hash = np.ones(len(page), bool)
    new_hash[1:] = page["hash"][1:] != page["hash"][:-1]
    new_context = new_hash.copy()
    new_context[1:] |= page["context"][1:] != page["context"][:-1]
    if (~new_context).any():
        yield _settled(page[~new_context])
    first = page[new_context]
    group = np.cumsum(new_hash[new_context]) - 1
    first = first[np.bincount(group)[group] > 1]
    at = first["at"].astype(np.int64)
    yield _rows(1, first["ord"], at - first["before"], at + first["after"], at, first["hash"])


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with the contexts asked of them -> one row per context with its bytes."""
    for b in batches:
        rows = []
        for ord_, text, asked in zip(b["ord"], b["text"], b["asked"]):
            data = text.encode()
            rows += [(a["hash"], ord_, a["at"], a["at"] - a["start"], data[a["start"] : a["end"]]) for a in asked]
        yield pd.DataFrame(rows, columns=["hash", "ord", "at", "before", "context"])


def _repeats(least: int):
    """Contexts in order of hash -> (group, length, ord, start) of the occurrences of each maximal repeat."""

    def slabs(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= _SLAB:
                whole = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted(whole["hash"].to_numpy(), whole["hash"].iloc[-1]))
                if cut:
                    yield whole.iloc[:cut]
                held, n = [whole.iloc[cut:]], len(whole) - cut
        if n:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for slab in slabs(batches):
            context, before = slab["context"].tolist(), slab["before"].tolist()
            left = [c[:k][::-1] for c, k in zip(context, before)]
            right = [c[k:] for c, k in zip(context, before)]
            yield slab, maximal_repeats(slab["hash"].to_numpy(), left, right, least, least - GRAM, least)

    return run


def _plain_anchors(classes, least: int):
    """Documents -> every anchor, none settled; the strings of its context start from `before` to `fewest` bytes before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in chunks(batches):
            joined, starts, ends = _joined(texts)
            h, at, lo, hi = anchors(running_sums(joined), starts, ends, classes.value, least)
            doc = np.searchsorted(ends, at)
            ord_ = np.array(ids, np.int64)[doc]
            yield pd.DataFrame({"hash": h.view(np.int64), "ord": ord_, "at": at - starts[doc], "before": at - lo, "fewest": at - hi + least})

    return run


def _pieces(depth: int, size: int):
    """Documents with the anchors asked of them -> per anchor the bytes before it and the size bytes from depth behind it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in f"{_ASKED}, {_PIECE}".split(", ")]
        for b in batches:
            rows, held = [], 0
            for ord_, text, asked in zip(b["ord"], b["text"], b["asked"]):
                data = text.encode()
                for a in asked:
                    at, before, fewest = a["at"], a["before"], a["fewest"]
                    piece = data[at + depth : at + depth + size]
                    rows.append((a["hash"], a["key_ord"], a["key_at"], ord_, at, before, fewest, data[max(0, at - before - 1) : at][::-1], piece))
                    held += len(piece) + 200
                    if held >= _PIECE_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return run


_ASKED = "hash long, key_ord long, key_at long, ord long, at long, before long, fewest long"
_PIECE = "left binary, piece binary"
_GROUPS = f"{_ASKED}, length long, start long"
_PIECE_BYTES = 1 << 24
_FIRST_PIECE = 128
_MOST_ROWS = 1 << 18


def _piece_groups(least: int, depth: int, size: int):
    """Pieces in order of key -> occurrences of the repeats that end in them (length set), and anchors to go on with (length null)."""

    def keys(batches):
        held = []
        for b in batches:
            for key, own in b.groupby(["hash", "key_ord", "key_at"], sort=False):
                if held and held[0] != key:
                    yield held[0], pd.concat(held[1], ignore_index=True)
                    held = []
                held = held or [key, []]
                held[1].append(own)
        if held:
            yield held[0], pd.concat(held[1], ignore_index=True)

    def table(rows):
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _GROUPS.split(", ")]).astype({"length": "Int64", "start": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for key, own in keys(batches):
            own = own.drop_duplicates(["ord", "at"])  # rows that are fully equal are one document
            if len(own) < 2:
                continue
            ord_, at, before, fewest = (own[c].tolist() for c in ("ord", "at", "before", "fewest"))
            ended, onward = piecewise_repeats(own["left"].tolist(), before, fewest, own["piece"].tolist(), least, depth, size)
            for shared, d, group in ended:
                rows += [(key[0], 0, 0, ord_[m], at[m], shared, fewest[m], shared + d, at[m] - shared) for m in group]
                if len(rows) >= _MOST_ROWS:
                    yield table(rows)
                    rows = []
            for group in onward:
                o, a = min((ord_[m], at[m]) for m in group)
                rows += [(key[0], o, a, ord_[m], at[m], before[m], fewest[m], None, None) for m in group]
        yield table(rows)

    return run


def _later(least: int):
    """Contexts in order of hash -> the span of each that some earlier occurrence of a maximal repeat covers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for slab, found in _repeats(least)(batches):
            ord_, at = slab["ord"].tolist(), slab["at"].tolist()
            lo, hi = at.copy(), at.copy()
            for before, after, group in found:
                first = min(group, key=lambda m: (ord_[m], at[m]))
                for m in group:
                    if m != first:  # all spans of a context hold its anchor, so their union is one span
                        lo[m] = min(lo[m], at[m] - before)
                        hi[m] = max(hi[m], at[m] + after)
            out = pd.DataFrame({"ord": ord_, "start": lo, "end": hi})
            yield out[out["start"] < out["end"]]

    return run


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, text, spans in zip(b["doc_id"], b["text"], b["spans"]):
            data = text.encode()
            merged: list[list[int]] = []
            for start, end in sorted((s["start"], s["end"]) for s in spans) if spans is not None else ():
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            bounds = [0, *(x for m in merged for x in m), len(data)]
            kept = b"".join(data[i:j] for i, j in zip(bounds[::2], bounds[1::2]))
            rows.append((doc_id, len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), merged))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _with_classes(docs: DataFrame, least: int):
    """Documents with their order, those of least bytes or more, and the frequency classes of their 16-grams."""

    def hashes(b: pd.DataFrame) -> np.ndarray:
        out = [np.zeros(0, U64)]
        for _, texts in chunks([b]):
            joined, starts, ends = _joined(texts)
            out.append(anchors(running_sums(joined), starts, ends, None, least)[0])
        return np.concatenate(out)

    ordered = with_order(docs)
    long_enough = ordered.where(F.octet_length("text") >= least).select("ord", "text")
    return ordered, long_enough, docs.sparkSession.sparkContext.broadcast(frequency_classes(long_enough, hashes))


def _contexts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Documents dealt by ord, and what their anchors' meeting found."""
    spark = docs.sparkSession
    parts = 4 * width(spark)
    ordered, long_enough, classes = _with_classes(docs, least)
    pages = long_enough.mapInPandas(_anchor_pages(parts, classes, least), "part int, kind int, data binary")
    found = pages.repartition(width(spark), "part").mapInPandas(_meet, _FOUND)
    # both later joins with the texts use this exchange, so they name the same columns and filter
    dealt = ordered.where("ord IS NOT NULL").repartition(width(spark), "ord")
    return dealt, materialise(found, "substring-anchors")


def _with_texts(dealt: DataFrame, found: DataFrame) -> DataFrame:
    asked = found.where("kind = 1").groupBy("ord").agg(F.collect_list(F.struct("hash", "at", "start", "end")).alias("asked"))
    fetched = dealt.join(asked, "ord").select("ord", "doc_id", "text", "asked").mapInPandas(
        _fetch, "hash long, ord long, at long, before long, context binary"
    )
    return fetched.repartition(width(dealt.sparkSession), "hash").sortWithinPartitions("hash")


def repeat_groups(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(hash, before, length, ord, start): all occurrences of every maximal repeat of least bytes or more, however long.

    Occurrences with the same hash, before and length that spell the same string form a group. A repeat
    is found at the first anchor in it. Texts are compared from there on in pieces of doubling size; only
    sets that share a whole piece and differ in the byte ahead of their contexts (or start a text) ask for
    the next one, so inside equal passages nothing is fetched again. The occurrences of all maximal repeats
    can outgrow the texts by far (a run of n equal bytes has about n * n / 2): `remove_repeats` needs none
    of them. All contexts of one 16-gram are compared in one task.
    """
    spark = docs.sparkSession
    ordered, long_enough, classes = _with_classes(docs, least)
    found = materialise(long_enough.mapInPandas(_plain_anchors(classes, least), "hash long, ord long, at long, before long, fewest long"), "anchors")
    often = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    none = F.lit(0).cast("long")
    asked = found.join(often, "hash", "left_semi").select("hash", none.alias("key_ord"), none.alias("key_at"), "ord", "at", "before", "fewest")
    dealt = materialise(long_enough.dropDuplicates(["ord"]), "repeat-texts")
    steps, depth, size = [], 0, _FIRST_PIECE
    while not steps or not asked.isEmpty():
        by_doc = asked.groupBy("ord").agg(F.collect_set(F.struct("hash", "key_ord", "key_at", "at", "before", "fewest")).alias("asked"))
        pieces = dealt.join(by_doc, "ord").select("ord", "text", "asked").mapInPandas(_pieces(depth, size), f"{_ASKED}, {_PIECE}")
        key = ["hash", "key_ord", "key_at"]
        step = pieces.repartition(width(spark), *key).sortWithinPartitions(*key).mapInPandas(_piece_groups(least, depth, size), _GROUPS)
        steps.append(materialise(step, "repeat-groups"))
        asked = steps[-1].where("length IS NULL").drop("length", "start")
        depth, size = depth + size, 2 * size
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out.where("length IS NOT NULL").select("hash", "before", "length", "ord", "start")


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans per document."""
    dealt, found = _contexts(docs, least)
    later = _with_texts(dealt, found).mapInPandas(_later(least), "ord long, start long, end long")
    spans = found.where("kind = 0").select("ord", "start", "end").unionByName(later)
    by_doc = spans.groupBy("ord").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.join(by_doc, "ord", "left").select("doc_id", "text", "spans").mapInPandas(
        _removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    )
