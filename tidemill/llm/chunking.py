"""Removal of repeated chunks, cut where the content says so.

A gear hash rolls over the bytes: it shifts by one bit a byte and adds a fixed random value of the
byte, so it depends on the last 32 bytes only. A chunk ends where the hash's top bits are zero, not
before `least` bytes and at `most` bytes at the latest. An insertion changes the chunks it touches; the
cuts behind it fall into place again. Chunks are known by a 128-bit digest; of equal chunks the first
(smaller doc_id, or earlier in the same document) stays and the bytes of the others are removed.

Within a page of documents equal chunks are settled at once and only the first is sent on, so a
passage in any number of documents costs one entry a page.

A last piece of fewer than `least` bytes is too short to be known by itself. With `whole`, as in op4, it
is known by its bytes and those of the chunk before it, and a text under `least` by all its bytes, so an
exact copy loses every byte; without, such pieces stay.

Defined cases: a null or empty text has no chunk; rows with a null doc_id come first; rows that share a
doc_id are ordered by a hash of their text, fully equal rows are the same document; extra columns are
ignored; doc_id has to be of a whole-number type, others are refused; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, width
from .substrings import _ANCHOR, _FOUND, PAGE_ANCHORS, _joined, _meet, _removed, anchor_page, chunks, with_order

#: Bytes of the shortest chunk and of the longest (at most 255), and how many top bits must be zero at a cut, so that the mean
#: chunk has about LEAST + 2**BITS bytes. Shorter chunks find more of what repeats, but common phrases too.
LEAST, MOST, BITS = 80, 255, 5
_GEAR = np.random.default_rng(20240301).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_places(data: bytes, bits: int = BITS) -> np.ndarray:
    """Ends at which the gear hash of the 32 bytes before allows a cut."""
    h, w = _GEAR[np.frombuffer(data, np.uint8)], 1
    while w < 32:
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
        w *= 2
    return np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1


def cut(allowed: list[int], start: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """The ends of the chunks of the bytes from start to end."""
    out = []
    while end - start > least:
        k = bisect_left(allowed, start + least)
        start = min(allowed[k] if k < len(allowed) else end, start + most, end)
        out.append(start)
    if start < end:
        out.append(end)
    return out


def _pages(parts: int, whole: bool, least: int, most: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for ids, texts in chunks(batches):
            joined, starts, ends = _joined(texts)
            allowed, rows = cut_places(joined, bits).tolist(), []
            for i, start, end in zip(ids, starts.tolist(), ends.tolist()):
                before = at = start
                for stop in cut(allowed, start, end, least, most):
                    short = stop - at < least
                    if whole or not short:
                        digest = hashlib.blake2b(joined[before if short else at : stop], digest_size=16).digest()
                        rows.append((int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little"), i, at - start, 0, stop - at))
                    before, at = at, stop
            if rows:
                held.append(np.array(rows, _ANCHOR))
                n += len(rows)
            if n >= PAGE_ANCHORS:
                yield anchor_page(held, parts)
                held, n = [], 0
        if n:
            yield anchor_page(held, parts)

    return run


def remove_chunks(docs: DataFrame, whole: bool = False, least: int = LEAST, most: int = MOST, bits: int = BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans per document."""
    if not 0 < least <= most <= 255:
        raise ValueError("chunks have at most 255 bytes")
    spark = docs.sparkSession
    ordered = with_order(docs)
    pages = ordered.select("ord", "text").mapInPandas(_pages(4 * width(spark), whole, least, most, bits), "part int, kind int, data binary")
    found = materialise(pages.repartition(width(spark), "part").mapInPandas(_meet, _FOUND), "chunks")
    by_doc = found.where("kind = 0").groupBy("ord").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ordered.join(by_doc, "ord", "left").select("doc_id", "text", "spans").mapInPandas(
        _removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    )
