"""Exact Jaccard join of documents by their word shingles, as a join in a metric space.

A document is the set of its distinct five-word shingles; the distance is one minus the Jaccard
similarity. Two documents link at a similarity of THRESHOLD percent or more. Candidates are found by
64-bit hashes of shingles; whether a pair links is decided by its words themselves (`ExactSets`). Equal
sets are one point, named by a 64-bit key; a second key, from an independent hash of the words, is
compared within each, and should two unlike sets ever share the first, all is hashed anew with another
seed.

1. Regions. All points share one order of shingles, rare ones first (by a sketch of fixed size). Of
   two linked points each has one of its first n - ceil(0.75 n) + 1 shingles in common with those of
   the other; the points that share one such shingle form a region. Within a batch equal points go
   once.
2. A region of at most LEAF points (a switch by size of the path, not of the result) is joined directly, keeping the pairs that their sizes and the
   places of the shared shingle allow and that did not meet at a shingle just before. A parity bitmap of each set gives a lower bound of the
   difference, which rules most other pairs out; the rest are checked on the texts.
3. Larger regions that overlap are put together and split by pivots. Each pivot's distance to every
   point is measured. Points within the threshold of a pivot need no further link among themselves.
   The others are dealt into blocks by their distance to the first pivot, and each block is compared
   with the blocks whose distances lie within the triangle inequality's window of its own, so that
   documents near a boundary are replicated to all regions that can hold a partner. This is exact.
4. Links become components by rounds of contraction.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing;
with fewer than five words the whole sequence is the one shingle; repeated rows are one point;
component_id is the least non-null doc_id of the component (null if there is none); doc_id has to be
of a whole-number type.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, read_scratch, width, write_scratch
from .components import connected_components
from .hashing import U64, hash_words, mix, words_of
from .sketch import cells, frequency_classes, membership_filter
from .substrings import chunks, with_order

SIZE = 5
THRESHOLD = 75
LEAF = 256
CELLS = 1 << 20
PIVOTS = 8
PAGE_ENTRIES = 300_000
#: Characters of text whose sets are held at once when pairs are measured.
MEASURED = 1 << 20
BLOCK = 256
#: Width of the distance ranges by which blocks are dealt, in thousandths.
RANGE = 50
_STEP = U64(0x9E3779B97F4A7C15)
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
BEFORE = 3
#: One shingle of a point as it is sent; before: those just ahead of it in the order, 0 for none.
_ENTRY = np.dtype([("token", "<u8"), ("before", "<u8", BEFORE), ("key", "<i8"), ("size", "<u4"), ("place", "<u2")])


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size word hashes."""
    n = len(h) - size + 1
    out = np.full(n, size, U64)
    for j in range(size):
        out = out * _STEP + h[j : j + n]
    return mix(out)


class Sets:
    """The shingle sets of some texts, as hashes: tokens[first[k]:first[k + 1]] is sorted and distinct.

    With keys, each set also has a key by these hashes and a second one by independent ones.
    """

    def __init__(self, texts: list[bytes], seed: int = 0, keys: bool = True, second: bool = False):
        joined = b"\n".join(texts).lower()  # bytes.lower() changes A-Z only
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        starts, ends = words_of(joined, _WORD)
        h = hash_words(joined, starts, ends, 2 * seed)
        other = hash_words(joined, starts, ends, 2 * seed + 1) if second else None
        word = np.searchsorted(starts, bounds)
        counts = np.diff(word)
        parts, others = [], []
        with np.errstate(over="ignore"):
            whole = _shingles(h, SIZE) if len(h) >= SIZE else h[:0]
            whole_other = _shingles(other, SIZE) if second and len(h) >= SIZE else None
            for at, c in zip(word.tolist(), counts.tolist()):
                if c >= SIZE:
                    own = whole[at : at + c - SIZE + 1]
                    if second:
                        order = np.argsort(own, kind="stable")
                        own = own[order]
                        others.append(whole_other[at : at + c - SIZE + 1][order])
                    else:
                        own.sort()
                else:
                    own = _shingles(h[at : at + c], c) if c else h[:0]
                    if second:
                        others.append(_shingles(other[at : at + c], c) if c else h[:0])
                parts.append(own)
            tokens = np.concatenate([np.zeros(0, U64), *parts])
            lengths = np.array([len(p) for p in parts], np.int64)
            first = np.cumsum(lengths) - lengths
            keep = np.ones(len(tokens), bool)
            keep[1:] = tokens[1:] != tokens[:-1]
            keep[first[lengths > 0]] = True
            self.tokens = tokens[keep]
            self.first = np.concatenate([[0], np.cumsum(keep)])[np.append(first, len(tokens))]
            self.sizes = np.diff(self.first)
            if keys:
                self.keys = self._keys(self.tokens, _STEP * U64(2 * seed))
            if second:
                self.second = self._keys(np.concatenate([np.zeros(0, U64), *others])[keep], _STEP * U64(2 * seed + 1))

    def _keys(self, tokens: np.ndarray, step: np.uint64) -> np.ndarray:
        """A key of each set: a sum of hashes of its tokens."""
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(tokens + step))])
        return mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.sizes.astype(U64)).view(np.int64)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.tokens[self.first[k] : self.first[k + 1]]


class ExactSets:
    """The shingle sets of some texts by their words, numbered within these texts; the same fields as Sets.

    Words are numbered by a dictionary, runs of two, four and five words by the numbers of their parts.
    """

    def __init__(self, texts: list[bytes]):
        words = [t.lower().split() for t in texts]  # white space of bytes is that of words
        known: dict = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for own in words for w in own), np.int64)
        five = ids[:0]
        if len(ids) >= SIZE:
            two = self._numbered(ids[:-1], ids[1:])
            five = self._numbered(self._numbered(two[:-2], two[2:])[:-1], ids[4:])
        parts, at, few = [], 0, {}
        for own in words:
            c = len(own)
            if c >= SIZE:
                parts.append(np.unique(five[at : at + c - SIZE + 1]))
            else:
                parts.append(np.array([-1 - few.setdefault(tuple(own), len(few))] if own else [], np.int64))
            at += c
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.tokens = np.concatenate([ids[:0], *parts])

    @staticmethod
    def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number for each pair (a, b), equal for equal pairs."""
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    def __getitem__(self, k: int) -> np.ndarray:
        return self.tokens[self.first[k] : self.first[k + 1]]


def links(common: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: int) -> np.ndarray:
    return 100 * common >= threshold * (size_a + size_b - common)


def parity(tokens: np.ndarray) -> bytes:
    """One bit per cell, of about as many cells as tokens: whether an odd number of tokens fall there."""
    cells_ = 1 << max(6, int(len(tokens) - 1).bit_length())
    counts = np.bincount((tokens & U64(cells_ - 1)).astype(np.int64), minlength=cells_)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """No more than the number of tokens in one set only: cells whose parities differ, at the coarser width."""
    x, y = (np.frombuffer(p, np.uint8) for p in (a, b))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def _points(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in chunks(batches):
            s = Sets(texts, seed, second=True)
            bitmaps = [parity(s[k]) for k in range(len(ids))]
            yield pd.DataFrame({"ord": ids, "n_shingles": s.sizes, "key": s.keys, "second": s.second, "parity": bitmaps})

    return run


def _region_pages(parts: int, classes, threshold: int, seed: int):
    """Batches of documents -> pages (part, data) of the entries of each point once a page."""

    def entries(s: Sets, seen: set[int], known: np.ndarray) -> Iterator[np.ndarray]:
        for k, (key, n) in enumerate(zip(s.keys.tolist(), s.sizes.tolist())):
            if not n or key in seen:
                continue
            seen.add(key)
            own, length = s[k], n - -(-threshold * n // 100) + 1
            rank = known[cells(own, CELLS)]
            if rank.any():
                own = own[np.argsort(rank, kind="stable")]
            page = np.zeros(length, _ENTRY)
            page["token"], page["key"], page["size"] = own[:length], key, n
            for j in range(1, min(BEFORE, length - 1) + 1):
                page["before"][j:, j - 1] = own[: length - j]
            page["place"] = np.minimum(np.arange(length), 65535)
            yield page

    def pages(held: list[np.ndarray]) -> pd.DataFrame:
        page = np.concatenate(held)
        part = (page["token"] % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        page, bounds = page[order], np.searchsorted(part[order], np.arange(parts + 1))
        full = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
        return pd.DataFrame({"part": full, "data": [page[bounds[p] : bounds[p + 1]].tobytes() for p in full]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, seen, n = classes.value, [], set(), 0
        for _, texts in chunks(batches):
            for page in entries(Sets(texts, seed), seen, known):
                held.append(page)
                n += len(page)
            if n >= PAGE_ENTRIES:
                yield pages(held)
                held, seen, n = [], set(), 0
        if n:
            yield pages(held)

    return run


def _regions(threshold: int):
    def leaf_pairs(page: np.ndarray, starts: np.ndarray, size: int) -> Iterator[np.ndarray]:
        """Pairs of the regions of one size that sizes and places allow."""
        i, j = np.triu_indices(size, 1)
        step = max(1, 500_000 // len(i))
        for c in range(0, len(starts), step):
            at = starts[c : c + step, None]
            x, y = page[(at + i).ravel()], page[(at + j).ravel()]
            sx, sy = x["size"].astype(np.int64), y["size"].astype(np.int64)
            most = 1 + np.minimum(sx - x["place"], sy - y["place"]) - 1
            ok = links(np.minimum(most, np.minimum(sx, sy)), sx, sy, threshold)
            for k in range(BEFORE):  # pairs with a shingle in common among those just before also met there
                own = x["before"][:, k]
                ok &= (own == 0) | (y["before"] != own[:, None]).all(axis=1)
            found = np.stack([x["key"][ok], y["key"][ok]], axis=1)
            yield np.unique(np.sort(found, axis=1), axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages = [np.frombuffer(d, _ENTRY) for b in batches for d in b["data"]]
        if not pages:
            return
        page = np.concatenate(pages)
        pages.clear()
        page = page[np.argsort(page["token"], kind="stable")]
        twin = np.zeros(len(page), bool)
        twin[1:] = page["token"][1:] == page["token"][:-1]
        twin[:-1] |= twin[1:]
        page = page[twin]
        page = page[np.lexsort((page["key"], page["token"]))]
        keep = np.ones(len(page), bool)
        keep[1:] = (page["token"][1:] != page["token"][:-1]) | (page["key"][1:] != page["key"][:-1])
        page = page[keep]
        starts = np.flatnonzero(np.concatenate([[True], page["token"][1:] != page["token"][:-1]])[: len(page)])
        sizes = np.diff(np.append(starts, len(page)))
        pairs = [np.zeros((0, 2), np.int64)]
        for size in np.unique(sizes[(sizes > 1) & (sizes <= LEAF)]):
            pairs += leaf_pairs(page, starts[sizes == size], int(size))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        yield pd.DataFrame({"kind": 1, "a": pairs[:, 0], "b": pairs[:, 1]})
        large = sizes > LEAF
        inside = np.repeat(large, sizes)
        heads = np.repeat(page["key"][starts[large]], sizes[large])
        stars = np.unique(np.stack([heads, page["key"][inside]], axis=1), axis=0)
        yield pd.DataFrame({"kind": 2, "a": stars[:, 0], "b": stars[:, 1]})

    return run


def _measure(threshold: int):
    """Pairs with both texts -> common shingles, sizes and whether they link."""

    def measured(b: pd.DataFrame) -> pd.DataFrame:
        texts: dict[str, int] = {}
        left = [texts.setdefault(t, len(texts)) for t in b["text_a"]]
        right = [texts.setdefault(t, len(texts)) for t in b["text_b"]]
        s = ExactSets([t.encode() for t in texts])
        common = np.array([len(np.intersect1d(s[x], s[y], assume_unique=True)) for x, y in zip(left, right)], np.int64)
        sa, sb = s.sizes[left], s.sizes[right]
        union = np.maximum(1, sa + sb - common)
        return pd.DataFrame(
            {"a": b["a"], "b": b["b"], "linked": links(common, sa, sb, threshold), "distance": 1000 * (union - common) // union}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = np.cumsum(b["text_a"].str.len().to_numpy() + b["text_b"].str.len().to_numpy())
            for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(size // MEASURED)) + 1):
                if len(part):
                    yield measured(b.iloc[part])

    return run


def _possible(threshold: int):
    """Pairs whose parities allow a link: as many different tokens rule it out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            apart = np.array([least_difference(x, y) for x, y in zip(b["parity_a"], b["parity_b"])], np.int64)
            ok = apart * (100 + threshold) <= (100 - threshold) * (b["n_a"] + b["n_b"]).to_numpy()
            yield b.loc[ok, ["a", "b", "ra", "rb"]]

    return run


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of points with the documents that stand for them, sizes and parities."""
    for x in "ab":
        names = [F.col("key").alias(x), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}")]
        pairs = pairs.join(classes.select(*names), x)
    return pairs


def _check(named: DataFrame, dealt: DataFrame, threshold: int) -> DataFrame:
    """(a, b, ra, rb) -> a, b, linked, distance in thousandths, by the texts of the documents ra and rb."""
    named = materialise(named.select("a", "b", "ra", "rb"), "pairs")
    wanted = membership_filter(named.select(F.explode(F.array("ra", "rb")).alias("ord")))
    few = dealt.where(wanted(F.col("ord")))
    one = few.select(F.col("ord").alias("ra"), F.col("text").alias("text_a"))
    two = few.select(F.col("ord").alias("rb"), F.col("text").alias("text_b"))
    return named.join(one, "ra").join(two, "rb").select("a", "b", "text_a", "text_b").mapInPandas(
        _measure(threshold), "a long, b long, linked boolean, distance long"
    )


def _block_links(threshold: int):
    """Rows of (pair of blocks, side, key, text), in order -> links, a spanning set per pair of blocks."""

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        s = ExactSets([t.encode() for t in group["text"]])
        keys, near = group["key"].to_numpy(), group["side"].to_numpy() == 0
        ones, twos = np.flatnonzero(near), np.flatnonzero(~near)
        doc = np.repeat(np.arange(len(keys)), s.sizes)
        _, token = np.unique(s.tokens, return_inverse=True)
        shared = np.bincount(token)[token] > 1
        _, token = np.unique(token[shared], return_inverse=True)
        doc, common = doc[shared], np.zeros((len(ones), len(twos)), np.float32)
        for base in range(0, int(token.max(initial=-1)) + 1, 4096):
            now = (token >= base) & (token < base + 4096)
            cell = np.zeros((len(keys), 4096), np.float32)
            cell[doc[now], token[now] - base] = 1
            common += cell[ones] @ cell[twos].T
        linked = links(common.astype(np.int64), s.sizes[ones][:, None], s.sizes[twos][None, :], threshold)
        linked &= keys[ones][:, None] != keys[twos][None, :]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for x, y in zip(*np.nonzero(linked)):
            a, b = int(keys[ones[x]]), int(keys[twos[y]])
            ra, rb = find(a), find(b)
            if ra != rb:
                root[ra] = rb
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            ids = b["pair"].to_numpy()
            bounds = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            for i, j in zip(bounds[:-1], bounds[1:]):
                yield joined(b.iloc[i:j])
            rest = b.iloc[bounds[-1] :] if len(b) else None
        if rest is not None and len(rest):
            yield joined(rest)

    return run


def _large_regions(found: DataFrame, classes: DataFrame, dealt: DataFrame, threshold: int) -> DataFrame:
    """The links (a, b) that connect the points of the larger regions."""
    spark, stars = dealt.sparkSession, found.where("kind = 2").select("a", "b").distinct()
    members = materialise(
        connected_components(stars).select(F.col("root").alias("region"), F.col("node").alias("key")), "regions"
    )
    # pivots: the least hash in each of PIVOTS strata of the region
    drawn = F.xxhash64("key")
    pivots = members.groupBy("region", F.pmod(drawn, F.lit(PIVOTS)).alias("p")).agg(F.min_by("key", drawn).alias("pivot"))
    pivots = materialise(pivots, "pivots")
    spokes = members.join(pivots, "region").where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    measured = materialise(_check(_named(spokes, classes), dealt, threshold), "spokes")
    near = measured.where("linked").select("a", "b")
    # the points that one pivot's links connect are settled among themselves: the largest such group of a region
    groups = connected_components(near)
    label = members.join(groups.select(F.col("node").alias("key"), "root"), "key", "left").select(
        "region", "key", F.coalesce("root", "key").alias("label")
    )
    sizes = label.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    first = pivots.groupBy("region").agg(F.min_by("pivot", "p").alias("pivot"))
    ranges = (
        label.join(main, "region").join(first, "region")
        .join(measured.select(F.col("a").alias("pivot"), F.col("b").alias("key"), "distance"), ["pivot", "key"], "left")
        .select("region", "key", (F.col("label") != F.col("main")).alias("open"), F.floor(F.coalesce("distance", F.lit(0)) / RANGE).alias("at"))
    )
    ranges = materialise(ranges, "ranges")
    counts = ranges.groupBy("region", "at", "open").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt_out = materialise(
        ranges.join(counts, ["region", "at", "open"]).select(
            "region", "key", "at", "open", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")
        ),
        "blocks",
    )
    blocks = dealt_out.select("region", "at", "open", "block").distinct()
    opened = blocks.where("open").select("region", F.col("at").alias("at_0"), F.col("block").alias("block_0"))
    window = -(-(1000 * (100 - threshold) // 100 + 1) // RANGE) + 1
    others = blocks.select("region", F.col("at").alias("at_1"), F.col("open").alias("open_1"), F.col("block").alias("block_1"))
    met = opened.join(others, "region").where(F.abs(F.col("at_0") - F.col("at_1")) <= window)
    # two open blocks meet once
    met = met.where(~F.col("open_1") | (F.struct("at_0", "block_0") <= F.struct("at_1", "block_1")))
    pair = F.xxhash64("region", "at_0", "block_0", "at_1", "open_1", "block_1")
    met = materialise(met.withColumn("pair", pair), "block-pairs")
    spot = dealt_out.select("region", "key", "at", "open", "block")
    one = met.select("region", F.col("at_0").alias("at"), F.lit(True).alias("open"), F.col("block_0").alias("block"), "pair", F.lit(0).alias("side"))
    two = met.select("region", F.col("at_1").alias("at"), F.col("open_1").alias("open"), F.col("block_1").alias("block"), "pair", F.lit(1).alias("side"))
    sides = spot.join(one.unionByName(two), ["region", "at", "open", "block"]).select("pair", "side", "key")
    spots = members.join(classes.select("key", F.col("rep").alias("ord")), "key").select("key", "ord")
    wanted = membership_filter(spots.select("ord"))
    texts = dealt.where(wanted(F.col("ord"))).join(spots, "ord").select("key", "text")
    placed = sides.join(texts, "key").repartition(width(spark), "pair").sortWithinPartitions("pair", "side")
    compared = placed.select("pair", "side", "key", "text").mapInPandas(_block_links(threshold), "a long, b long")
    return near.unionByName(compared)


def _rooted(docs: DataFrame, threshold: int) -> DataFrame:
    """(ord, doc_id, n_shingles, root) of every document; root is null for an empty set."""
    spark = docs.sparkSession
    parts = 4 * width(spark)
    ordered = with_order(docs)
    texts = ordered.select("ord", "text").where("text <> ''")

    def tokens(b: pd.DataFrame) -> np.ndarray:
        return np.concatenate([np.zeros(0, U64), *(Sets(t, keys=False).tokens for _, t in chunks([b]))])

    classes_of = spark.sparkContext.broadcast(frequency_classes(texts, tokens, CELLS))
    scratch: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        scratch.append(write_scratch(df, name))
        return read_scratch(scratch[-1], df)

    for seed in count():
        points = kept(texts.mapInPandas(_points(seed), "ord long, n_shingles long, key long, second long, parity binary"), "points")
        classes = kept(points.where("n_shingles > 0").groupBy("key").agg(
            F.min("ord").alias("rep"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity"),
            (F.min("second") != F.max("second")).alias("clash"),
        ), "classes")
        if classes.where("clash").isEmpty():
            break
    points, classes = points.drop("second"), classes.drop("clash")
    pages = texts.mapInPandas(_region_pages(parts, classes_of, threshold, seed), "part int, data binary")
    found = kept(pages.repartition(width(spark), "part").mapInPandas(_regions(threshold), "kind int, a long, b long"), "regions")
    dealt = ordered.select("ord", "text").where("ord IS NOT NULL")
    pairs = found.where("kind = 1").select("a", "b").distinct()
    possible = _named(pairs, classes).mapInPandas(_possible(threshold), "a long, b long, ra long, rb long")
    edges = _check(possible, dealt, threshold).where("linked").select("a", "b")
    if not found.where("kind = 2").isEmpty():
        edges = edges.unionByName(_large_regions(found, classes, dealt, threshold))
    roots = connected_components(edges)
    named = points.drop("parity").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select(
        "ord", "n_shingles", F.coalesce("root", "key").alias("root")
    )
    rows = materialise(ordered.select("ord", "doc_id").join(named.distinct(), "ord", "left"), "rooted")
    discard(spark, *scratch)
    return rows


def _is_empty():
    return F.coalesce("n_shingles", F.lit(0)) == 0


def jaccard_join(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows = _rooted(docs, threshold)
    some = rows.where(~_is_empty())
    least = some.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    none = rows.where(_is_empty()).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.join(least, "root").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id").unionByName(none)


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs with one row, of the first document, of each group of linked ones.

    Every row with an empty set stays, repeated or not. Of several rows with the first document's id and
    text the one stays whose JSON form has the least digest; rows that are equal in all columns are one.

    What stays is settled on a narrow table, which the rows meet in one join.
    """
    rows = _rooted(docs, threshold)
    first = rows.where(~_is_empty()).groupBy("root").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("first"))
    each = rows.groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.first(_is_empty()).alias("empty"))
    stays = materialise(
        each.join(first, "ord", "left").where("empty OR first").select("ord", (~F.col("empty") & (F.col("n") > 1)).alias("again")), "stays"
    )
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    # the same join at every size: the narrow side is hashed, the rows are not sorted
    numbered = with_order(whole, ("row",)).join(stays.hint("shuffle_hash"), "ord").select("ord", "again", "row")
    if stays.where("again").isEmpty():
        return numbered.select("row.*")
    repeated = numbered.where("again").groupBy("ord").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return numbered.where("NOT again").select("row.*").unionByName(repeated.select("row.*"))
