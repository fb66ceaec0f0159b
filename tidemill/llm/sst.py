"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; each partition writes one shard file to
the shared folder, and all reading goes through these files. A shard is

    data blocks | block index | Bloom filter | footer

A data block holds entries in key order, keys prefix-compressed against the entry before, and is
compressed as a whole (zstandard). The sparse index has one entry per block (first key, place, ids before it).
The footer has the places of both and a magic number. `Shard.get` looks a key up by Bloom filter, a
binary search in the index and one block; `Shard.scan` reads blocks in order.

Each task attempt writes a file of its own name and reports it in the manifest; only files in the
manifest are read, so a lost or repeated task leaves no trace in the result.

Defined cases: a null or empty text has only the end id; a null doc_id sorts first; ids are exact over
the whole range of a long, beside nulls too; rows with equal doc_id all stay, ordered by a hash of their
text; a text of any length is encoded whole, a stretch at a time; doc_id has to be of a whole-number type,
others are refused; other columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import materialise, scratch_path, whole_number_ids, width

END_ID = 2
BLOCK_BYTES = 1 << 18
MAGIC = b"SSTTOK01"
_FOOTER = struct.Struct("<QQQQQQ8s")
_INDEX = struct.Struct("<QIQI")  # offset, bytes, ids before, first entry
_PROBES, _BITS_PER_KEY = 7, 10
_U64 = (1 << 64) - 1


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do, null first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", int(doc_id) + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> Iterator[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return ((a + k * b & _U64) % bits for k in range(_PROBES))


class ShardWriter:
    """Writes entries, given in key order, to out; only the index, the keys' hashes and one block are held."""

    def __init__(self, out):
        self.out, self.at, self.ids, self.entries = out, 0, 0, 0
        self.first = self.last = b""
        self._index: list[tuple[bytes, int, int, int, int]] = []
        self._hashes = array("Q")
        self._packer = zstandard.ZstdCompressor(level=1)
        self._open()

    def _open(self) -> None:
        self._block, self._prev, self._start = bytearray(), b"", (self.ids, self.entries)
        self._first = b""

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        if not self.entries:
            self.first = key
        if not self._block:
            self._first = key
        shared = 0
        for x, y in zip(key, self._prev):
            if x != y:
                break
            shared += 1
        self._block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self._prev = self.last = key
        self._hashes.extend(struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest()))
        self.ids += len(ids) // 4
        self.entries += 1
        if len(self._block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self._block:
            packed = self._packer.compress(bytes(self._block))
            self._index.append((self._first, self.at, len(packed), *self._start))
            self._write(packed)
        self._open()

    def close(self) -> None:
        self._flush()
        index_at = self.at
        for key, at, size, before, entry in self._index:
            self._write(_varint(len(key)) + key + _INDEX.pack(at, size, before, entry))
        bloom_at, bits = self.at, max(64, self.entries * _BITS_PER_KEY)
        marked, hashes = np.zeros(bits, bool), np.frombuffer(self._hashes, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(_PROBES):
                marked[(hashes[::2] + np.uint64(j) * hashes[1::2]) % np.uint64(bits)] = True
        self._write(np.packbits(marked, bitorder="little").tobytes())
        self._write(_FOOTER.pack(index_at, len(self._index), bloom_at, bits, self.entries, self.ids, MAGIC))
        self.out.close()


class Shard:
    """A written shard, opened for lookups and scans."""

    def __init__(self, source):
        self.source, self._unpacker = source, zstandard.ZstdDecompressor()
        source.seek(source.size() - _FOOTER.size)
        index_at, blocks, bloom_at, self.bits, self.entries, self.ids, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(index_at)
        data, at, self.index = source.read(bloom_at - index_at), 0, []
        for _ in range(blocks):
            n, at = _read_varint(data, at)
            self.index.append((data[at : at + n], *_INDEX.unpack_from(data, at + n)))
            at += n + _INDEX.size
        self.firsts = [e[0] for e in self.index]
        source.seek(bloom_at)
        self.bloom = source.read((self.bits + 7) // 8)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes, int]]:
        _, at, size, before, _ = self.index[block]
        self.source.seek(at)
        data, at, key = self._unpacker.decompress(self.source.read(size)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + n], before
            before += n // 4
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes, int]]:
        """(key, ids, ids before it in the shard) of all entries in order."""
        for block in range(len(self.index)):
            yield from self._entries(block)

    def get(self, key: bytes) -> list[bytes]:
        """The ids of each entry with this key."""
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        block, found = max(0, bisect_right(self.firsts, key) - 1), []
        while block > 0 and self.firsts[block] == key:
            block -= 1
        for block in range(block, len(self.index)):
            if self.firsts[block] > key:
                break
            found += [ids for k, ids, _ in self._entries(block) if k == key]
        return found


#: Characters outside ASCII that the tokenizer's normaliser at most changes to lower case: letters whose lower-case forms
#: are single and among them, and marks that are neither letter, digit, space nor combining.
_LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_MARKS = "\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u2030-\u205e\u20ac"
_NOT_QUICK = re.compile(rf"[^\x00-\x7f{_LETTERS}{_MARKS}]")
#: The pre-tokenizer's pieces of such texts, in lower case; and runs between white space for all others.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^\t-\r a-z{_LETTERS}0-9]+")
_RUNS = re.compile(r"[^ \t-\r]+")
#: str.split() also cuts at these, which are no white space to the tokenizer.
_CONTROL = re.compile("[\x1c-\x1f]")
#: The normaliser and pre-tokenizer under which texts may be cut into pieces: fixed values of the file's format.
_CUTS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "behavior": "Removed", "invert": True,
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
CACHED, _KEPT_LENGTH = 400_000, 64


class Recent(dict):
    """make(key) for missing keys; holds at most two generations of CACHED values of short keys."""

    def __init__(self, make):
        super().__init__()
        self._make, self._old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= _KEPT_LENGTH:
            if len(self) >= CACHED:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordTokenizer:
    """The tokenizers library, whose model is called once per piece of text that was not met lately.

    The normaliser and pre-tokenizer of these files drop white space and cut a text into pieces that are
    encoded each by itself, so the ids of a text are those of its runs between white space in order, and
    those of a run are those of its pieces. A text with characters beyond the simple ones goes through the
    whole library by runs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._cuts = all(spec.get(k) == v for k, v in _CUTS.items()) and not spec["model"].get("dropout")
        self._model, self._shown = self._tokenizer.model, {b: c for c, b in byte_alphabet().items()}
        self._pieces = Recent(self._of_piece)
        self._runs = Recent(self._of_run)

    def _library(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _of_piece(self, piece: str) -> bytes:
        shown = "".join(map(self._shown.__getitem__, piece.encode()))
        return array("I", [t.id for t in self._model.tokenize(shown)]).tobytes()

    def _of_run(self, run: str) -> bytes:
        pieces = _PIECES.findall(run)
        return self._pieces[run] if len(pieces) == 1 else b"".join(map(self._pieces.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; a file of another kind gets each text whole."""
        return b"".join(map(self._of_stretch, stretches(text))) if self._cuts else self._library(text)

    def _of_stretch(self, text: str) -> bytes:
        if _special(text):
            return b"".join(map(self._library, _RUNS.findall(text)))
        low = text.lower()
        runs = low.split() if low.isascii() and not _CONTROL.search(low) else _RUNS.findall(low)
        return b"".join(map(self._runs.__getitem__, runs))


def _special(text: str) -> bool:
    """Whether the pieces of text are not those of _PIECES: characters beyond the simple ones, or the mark of an added token."""
    return "<|" in text or not text.isascii() and _NOT_QUICK.search(text) is not None


_SPACE = re.compile(r"[ \t-\r]")


def stretches(text: str) -> Iterator[str]:
    """text in parts of at most a million characters, cut at white space; a longer run is a part of its own."""
    if len(text) <= 1_000_000:
        yield text
        return
    at = 0
    while at < len(text):
        end = at + 1_000_000
        if end < len(text):
            cut = max(text.rfind(c, at + 1, end) for c in " \n\t\r")
            m = None if cut > at else _SPACE.search(text, end)
            end = cut if cut > at else m.start() if m else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _open(uri: str):
    """The file system and path of a URI; Spark's names for S3 are the one that pyarrow knows."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


_MANIFEST = "shard string, first_key binary, last_key binary, entries long, ids long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write docs as shards under folder; the manifest: shard, first_key, last_key, entries and ids per file."""
    whole_number_ids(docs, "doc_id")
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, encode = None, f"{folder}/{uuid.uuid4().hex}.sst", word_tokenizer(tokenizer).encode
        for b in batches:
            if out is None and b.num_rows:
                system, path = _open(uri)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = ShardWriter(system.open_output_stream(path))
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                out.add(key_of(doc_id), encode(text.as_py() or "") + end)
        if out is not None:
            out.close()
            found = {"shard": uri, "first_key": out.first, "last_key": out.last, "entries": out.entries, "ids": out.ids}
            yield pa.RecordBatch.from_pylist([found])

    order = F.xxhash64("text")
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", order.alias("tie"))
        .repartitionByRange(width(docs.sparkSession), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    return ranged.select("doc_id", "text").mapInArrow(run, _MANIFEST)


_ENTRY = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read back from the files of manifest."""

    def rows(uri: str, base: int) -> Iterator[dict]:
        system, path = _open(uri)
        with system.open_input_file(path) as source:
            for key, ids, before in Shard(source).scan():
                yield {"doc_id": id_of(key), "start": base + before, "n_tokens": len(ids) // 4, "ids_crc32": zlib.crc32(ids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                each = rows(uri, base)
                while held := list(islice(each, 20_000)):
                    yield pa.RecordBatch.from_pylist(held, _ENTRY)

    # one row per file
    before = Window.orderBy("first_key", "last_key", "shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return based.repartition(width(manifest.sparkSession)).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_shards(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs as shards in the shared folder and report on each document from the files."""
    folder = scratch_path(docs.sparkSession, "token-shards")
    return read_shards(materialise(write_shards(docs, tokenizer, folder), "token-manifest"))
