"""Byte-level BPE, encoding by a priority queue over a linked symbol list.

Reads a tokenizer file (vocabulary, merges, added tokens) and gives the ids that its own library
gives with special tokens not added. A pre-token's symbols form a doubly linked list; all mergeable
neighbours wait in a heap by merge rank and place. The best entry is merged unless it is stale (one
of its symbols has changed since), and the two new neighbourhoods enter the heap. Decoding joins the
byte strings of the vocabulary.

The ids of a pre-token are kept in a two-generation cache of bounded size, since most pre-tokens are
common words.

Defined cases: a null or empty text has no tokens; a text of any length is encoded whole; repeated
rows give repeated results; doc_id may be of any type and is passed on as it is; other columns are
ignored; a tokenizer file of another kind is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Unicode white space as the tokenizer's pattern sees it, and the pattern itself: fixed values.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)
#: The same tokens by a faster engine, for texts of ASCII and Latin letters only (both ends of U+00C0 to U+024F).
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_QUICK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r {_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_NOT_QUICK = re.compile(rf"[^\x00-\x7f{_LATIN}]")
CACHED = 500_000
_KEPT_LENGTH = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Cache(dict):
    """make(key) for missing keys; holds at most two generations of CACHED entries."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= _KEPT_LENGTH:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class BytePairEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens", [])
        split, plain = spec.get("pre_tokenizer") or {}, ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "dropout")
        if (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError("only byte-level pre-tokenizers by the usual pattern, without a prefix space, are supported")
        if spec.get("normalizer") or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in plain):
            raise ValueError("only plain byte-pair models without a normaliser are supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that strip or need word bounds are not supported")
        to_byte = byte_alphabet()
        vocab = model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in added)])
        self.strings: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in text)
        self.added = {t["content"]: t["id"] for t in added}
        for text, i in self.added.items():
            self.strings[i] = text.encode()
        self.byte_ids = [0] * 256
        for c, b in to_byte.items():
            self.byte_ids[b] = vocab[c]
        #: left id << 32 | right id -> (rank, merged id)
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        longest_first = sorted(self.added, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self._tokens = _Cache(lambda token: array("I", self.merge(token.encode())).tobytes())

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. A heap entry is rank * width + place, so that it is one integer."""
        ids, get = [self.byte_ids[b] for b in piece], self.pairs.get
        n = width = len(ids)
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [m[0] * width + i for i in range(n - 1) if (m := get(ids[i] << 32 | ids[i + 1]))]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), width)
            left, j = ids[i], after[i]
            if left < 0 or j >= n:
                continue  # stale: merged into its left neighbour, or without a right one
            m = get(left << 32 | ids[j])
            if m is None or m[0] != rank:
                continue  # stale: one of the two has changed
            ids[i], ids[j] = merged, _ = m[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := get(merged << 32 | ids[k]):
                    heappush(heap, m[0] * width + i)
            h = before[i]
            if h >= 0 and (m := get(ids[h] << 32 | merged)):
                heappush(heap, m[0] * width + h)
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> bytes:
        quick = text.isascii() or not _NOT_QUICK.search(text)
        return b"".join(map(self._tokens.__getitem__, (_QUICK if quick else _PATTERN).findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self._split is None or not any(t in text for t in self.added):
            return self._plain(text)
        parts = self._split.split(text)
        return b"".join(array("I", [self.added[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def forget(self) -> None:
        """Give the cache back."""
        self._tokens.clear()
        self._tokens.old = {}

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """One encoder, with its cache, per Python worker."""
    return BytePairEncoder(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        yield from encoded(bpe, batches)
        bpe.forget()  # other stages run in the same worker, and need the room

    def encoded(bpe: BytePairEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            ids = [bpe.encode(t) for t in texts]
            same = [bpe.decode(x) == t for x, t in zip(ids, texts)]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            columns = [b.column(0), n, pa.array(ids, pa.binary()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, round_trip boolean")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; ids and texts stay in the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = encoder(path), hashlib.sha256
        for b in batches:
            n, made, back = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                made.append(sha(ids).hexdigest())
                back.append(sha(bpe.decode(ids).encode()).hexdigest())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(made, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
