"""Sketches of fixed size over all tasks: how often hashes fall into each of its cells, and which ids occur.

The first only ranks hashes by frequency; whatever order comes out of it, the operators that use it
stay exact. Its size does not grow with the data: a hash stands out once it holds more than a few
millionths of all occurrences.

Parts of a sketch are made by at most spark.sql.shuffle.partitions tasks, each reading several splits,
and added up by _BLOCKS tasks, each for its own cells, so that neither grows with the number of splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import width
from .hashing import mix

CELLS = 1 << 18
_BLOCKS = 64


def cells(hashes: np.ndarray, n: int = CELLS) -> np.ndarray:
    """The cell of each hash, out of n (a power of two): its top bits."""
    return (hashes >> np.uint64(65 - n.bit_length())).astype(np.int64)


def _merged(parts: DataFrame, cells_: int, kind, join) -> np.ndarray:
    """The elementwise join of all tasks' arrays, given as (block, data) rows; the driver gets _BLOCKS rows."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b["block"], b["data"]):
                part = np.frombuffer(data, kind)
                found[block] = join(found[block], part) if block in found else part
        yield pd.DataFrame({"block": list(found), "data": [x.tobytes() for x in found.values()]})

    whole = np.zeros((_BLOCKS, cells_ // _BLOCKS), kind)
    for block, data in parts.repartition(_BLOCKS, "block").mapInPandas(add, _PARTS).collect():
        whole[block] = join(whole[block], np.frombuffer(data, kind))
    return whole.ravel()


_PARTS = "block int, data binary"


def _rows(whole: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"block": range(_BLOCKS), "data": [x.tobytes() for x in whole.reshape(_BLOCKS, -1)]})


def frequency_classes(df: DataFrame, hashes: Callable[[pd.DataFrame], np.ndarray], n: int = CELLS) -> np.ndarray:
    """Per cell: 0 if it holds no more than chance puts there, else 1 to 15, by powers of two above that."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n, np.uint32)
        for b in batches:
            np.add.at(total, cells(hashes(b), n), 1)
        if total.any():
            yield _rows(total)

    total = _merged(df.coalesce(width(df.sparkSession)).mapInPandas(count, _PARTS), n, np.uint32, np.add).astype(np.int64)
    typical = np.median(total) if total.any() else 0
    limit = typical + 6 * np.sqrt(typical) + 8
    ratio = np.maximum(total, 1) / limit
    return np.where(total > limit, np.minimum(15, 1 + np.floor(np.log2(np.maximum(ratio, 1)))), 0).astype(np.uint8)


#: Bits per id of a filter, and its greatest size: with more ids than that has room for there is no filter.
ID_BITS, MOST_BYTES = 8, 1 << 24


def _probes(ids: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    bits = np.uint64(8 * size - 1)
    return [(h & bits).astype(np.int64), ((h >> np.uint64(32)) & bits).astype(np.int64)]


def membership_filter(ids: DataFrame) -> Callable[[Column], Column]:
    """A predicate that holds for all values of the only column of ids, and for few others.

    A Bloom filter that spares a later join's shuffle most rows without a partner. It has ID_BITS per id
    and never more than MOST_BYTES; beyond that the predicate always holds. The join decides in any case.
    """
    name, n = ids.columns[0], ids.count()
    size = max(1 << 12, 1 << (n * ID_BITS // 8 - 1).bit_length()) if n else 1 << 12
    if size > MOST_BYTES:
        return lambda x: F.lit(True)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            for at in _probes(b[name].to_numpy(), size):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if bits.any():
            yield _rows(bits)

    whole = _merged(ids.coalesce(width(ids.sparkSession)).mapInPandas(mark, _PARTS), size, np.uint8, np.bitwise_or)
    shared = ids.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def member(x: pd.Series) -> pd.Series:
        bits, found = shared.value, np.ones(len(x), bool)
        for at in _probes(x.to_numpy(), size):
            found &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return pd.Series(found)

    return member
