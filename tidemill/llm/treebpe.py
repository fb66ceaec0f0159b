"""Byte-level BPE by ranks, encoding by a tree reduction over token sequences.

Token sequences form a monoid: joining the encodings of two neighbouring byte strings gives the encoding
of both together. A pre-token is halved down to LEAF bytes, and neighbours are joined on the way up.
Joining re-encodes a window around the boundary, at first the last token of the left and the first of the
right side, and widens it on the side where it is not settled yet.

When a window is settled: a sequence is the encoding of its bytes if and only if each two neighbours in it
are, taken alone, encoded as these two. (Merges go by rank, then from the left. Up to the first merge that
crosses a bound between two tokens, the merges inside them are those of the two taken alone, in the same
order; so the crossing merge would be made there too.) Left and right are encodings, so is the window; it
remains to see that the pairs at the window's two ends hold.

Decoding joins the vocabulary's byte strings up the same kind of tree.

The ids of a pre-token are kept in a cache of bounded size, since most pre-tokens are common words.

Defined cases: a null or empty text has no tokens; a text, or one pre-token, of any length is encoded
whole; repeated rows give repeated results; doc_id may be of any type and is passed on as it is; other
columns are ignored; an empty table gives an empty one; a rank file that lacks a single byte is refused.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import _Cache

#: Bytes that are encoded directly, below which nothing is halved.
LEAF = 4
#: Ids that are decoded directly.
LEAF_IDS = 64
PAIRS_KEPT = 1 << 18
#: Unicode white space: fixed values.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters (beside ASCII ones, both ends of U+00C0 to U+024F) of texts that the standard engine can split, which is faster.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_OTHER = re.compile(f"[^\x00-\x7f{_LATIN}]")


def _spelled(pattern: str, classes: dict[str, str]) -> str:
    """pattern with the classes \\s, \\S, \\p{L} and \\p{N} spelled out, within brackets or by themselves."""
    out, inside = [], False
    for token in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        if token == r"\S":
            out.append(f"[^{classes[chr(92) + 's']}]")
        elif token in classes:
            out.append(classes[token] if inside else f"[{classes[token]}]")
        else:
            out.append(token)
            inside = token == "[" or (inside and token != "]")
    return "".join(out)


class TreeEncoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the ranks have to hold every single byte")
        self.strings = {rank: token for token, rank in self.ranks.items()}
        self._split = regex.compile(_spelled(pattern, {r"\s": _SPACES})).findall
        self._split_latin = re.compile(_spelled(pattern, {r"\s": r"\t-\r ", r"\p{L}": _LATIN, r"\p{N}": "0-9"})).findall
        self.holds = lru_cache(PAIRS_KEPT)(lambda a, b: self.direct(self.strings[a] + self.strings[b]) == [a, b])
        self._ids = _Cache(lambda token: array("I", self.encode_piece(token.encode())).tobytes())

    def direct(self, piece: bytes) -> list[int]:
        """The ids of a leaf or window: pairs merged by rank, then from the left."""
        get, n = self.ranks.get, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # end[i]: of the symbol at i, 0 for none
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            h = before[i]
            if h >= 0 and (r := get(piece[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        return [self.ranks[piece[i:e]] for i, e in enumerate(end) if e]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both, given that of each."""
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.direct(self.decode(left[-i:] + right[:j]))
            left_holds = i >= len(left) or self.holds(left[-i - 1], window[0])
            right_holds = j >= len(right) or self.holds(window[-1], right[j])
            if left_holds and right_holds:
                return left[: max(0, len(left) - i)] + window + right[j:]
            i, j = i if left_holds else 2 * i, j if right_holds else 2 * j

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.direct(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token; one that is in the vocabulary is its own token."""
        rank = self.ranks.get(piece)
        return self.tree(piece) if rank is None else [rank]

    def encode(self, text: str) -> array:
        latin = text.isascii() or not _OTHER.search(text)
        pieces = (self._split_latin if latin else self._split)(text)
        return array("I", b"".join(map(self._ids.__getitem__, pieces)))

    def decode(self, ids: list[int] | array) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.strings.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TreeEncoder:
    """One encoder, with its cache, per Python worker."""
    return TreeEncoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode
        for b in batches:
            ids = [encode(t.as_py() or "") for t in b.column(1)]
            n = pa.array([len(x) for x in ids], pa.int64())
            starts = pa.array([0, *n.to_numpy().cumsum()], pa.int32())
            flat = pa.array(array("i", b"".join(x.tobytes() for x in ids)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.ListArray.from_arrays(starts, flat)], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path, pattern).decode
        for b in batches:
            texts = [decode(x.as_py() or []).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encoding_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; ids and texts stay in the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = encoder(path, pattern), hashlib.sha256
        for b in batches:
            n, made, back = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids))
                made.append(sha(" ".join(map(str, ids)).encode()).hexdigest())
                back.append(sha(bpe.decode(ids)).hexdigest())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(made, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
