"""Minimax contiguous partition of documents into shards of nearly equal bytes.

Equal texts form one atomic group. Groups are put in the order of a 63-bit hash of their text and
cut into contiguous shards so that the largest shard is as small as possible: the smallest feasible
capacity is found by binary search, each capacity being checked greedily, and the cuts are then set
within that capacity as close to even spacing as they can be.

The groups stay in a table. The driver only sees sums of 2**16 ranges of the hash and, round by
round, of finer ranges around the places where a cut can fall, until these hold single groups; its
memory does not depend on the number of documents.

Defined cases: a null text counts as the empty text (16 bytes); rows with a null or repeated doc_id
keep their own rows; two texts with the same hash count as one group; with fewer groups than shards
some shards stay empty; doc_id may be of any type and other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_side

SHARDS = 40
OVERHEAD = 16
_BITS = 63
_FIRST, _STEP = 16, 8
#: Numbering blocks per shard: a shard's rows are numbered block by block.
BLOCKS = 256


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("key"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


class _Atoms:
    """Consecutive ranges of the hash as (first key, bits, bytes, groups, largest group), in order."""

    def __init__(self, atoms: list[tuple[int, int, int, int, int]]):
        self.atoms = sorted(atoms)
        self.ends = list(accumulate(a[2] for a in self.atoms))
        self.total = self.ends[-1]

    def reach(self, start: int, capacity: int) -> int:
        """The last boundary not beyond start + capacity."""
        k = bisect_right(self.ends, start + capacity)
        return max(start, self.ends[k - 1] if k else 0)

    def feasible(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.reach(at, capacity)
        return at >= self.total

    def smallest(self, low: int, shards: int) -> int:
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.feasible(mid, shards) else (mid + 1, high)
        return low

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Boundaries, as bytes before them, nearest to even spacing among those that keep every shard within capacity."""
        earliest, at = [], self.total
        for _ in range(shards - 1):  # from the end: the first boundary from which the rest still fits
            k = bisect_left(self.ends, at - capacity)
            at = min(at, self.ends[k] if at > capacity else 0)
            earliest.append(at)
        out, at = [], 0
        for j, least in enumerate(reversed(earliest), 1):
            most, ideal = self.reach(at, capacity), j * self.total / shards
            k = bisect_left(self.ends, ideal)
            near = min((b for b in ([0] + self.ends[max(0, k - 1) : k + 1])), key=lambda b: abs(b - ideal))
            at = min(max(near, least, at), most)
            out.append(at)
        return out

    def unsettled(self, low: int, high: int, shards: int) -> list[tuple[int, int, int, int, int]]:
        """Ranges of several groups into which a cut may fall for a capacity from low to high, or near an even cut."""
        found, a, b = set(), 0, 0
        for j in range(1, shards + 1):
            ka = bisect_right(self.ends, a + low)
            a = self.ends[ka - 1] if ka else 0
            kb = min(bisect_left(self.ends, b + high), len(self.ends) - 1)
            b = self.ends[kb]
            ki = bisect_left(self.ends, j * self.total / shards)
            found |= {*range(ka, kb + 1), *range(ki - 1, ki + 2)}
        at = self.total
        for _ in range(shards):
            at -= high
            k = bisect_left(self.ends, at)
            found |= {k - 1, k, k + 1}
        return [self.atoms[k] for k in found if 0 <= k < len(self.atoms) and self.atoms[k][3] > 1 and self.atoms[k][1]]


def _sums(groups: DataFrame, bits: int) -> DataFrame:
    start = F.shiftleft(F.shiftright("key", bits), bits)
    return groups.groupBy(start.alias("start")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("groups"), F.max("bytes").alias("largest")
    )


def shard_cuts(groups: DataFrame, shards: int = SHARDS) -> list[int]:
    """The first keys of shards 1, 2, ...; groups: (key, bytes), one row per group."""
    bits = _BITS - _FIRST
    found = [(r.start, bits, r.bytes, r.groups, r.largest) for r in _sums(groups, bits).toLocalIterator()]
    if not found:
        return []
    while True:
        atoms = _Atoms(found)
        low = max(-(-atoms.total // shards), max(a[4] for a in found))
        high = atoms.smallest(low, shards)
        open_ = atoms.unsettled(low, high, shards)
        if not open_:
            break
        spans = sorted({(a[0], a[1]) for a in open_})
        finer = []
        for width in sorted({w for _, w in spans}):
            # a few ranges per shard, as literals
            part = groups.where(F.shiftleft(F.shiftright("key", width), width).isin([s for s, w in spans if w == width]))
            below = max(0, width - _STEP)
            finer += [(r.start, below, r.bytes, r.groups, r.largest) for r in _sums(part, below).toLocalIterator()]
        gone = set(spans)
        found = [a for a in found if (a[0], a[1]) not in gone] + finer
    firsts, ends = [a[0] for a in atoms.atoms], atoms.ends
    return [firsts[k] if (k := bisect_right(ends, c)) < len(firsts) else 1 << _BITS for c in atoms.cuts(high, shards)]


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null under this law) per document."""
    rows = _rows(docs)
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    cuts = [c for c in shard_cuts(groups, shards) if c < 1 << _BITS]
    shard = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    block = F.pmod(F.xxhash64("doc_id", "key"), F.lit(BLOCKS)).cast("int")
    placed = materialise(rows.withColumns({"shard": shard, "block": block}), "shard-rows")
    # numbered within (shard, block); blocks of a shard follow one another
    sizes = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "key")
    return placed.join(small_side(offsets, shards * BLOCKS), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
