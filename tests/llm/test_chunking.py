import collections
import random

from pyspark.sql import functions as F

from tests.llm import brute
from tidemill.llm import chunking, queries


def plain_cut(data, least=chunking.LEAST, most=chunking.MOST, bits=chunking.BITS):
    """Chunk ends, byte by byte: the hash of the 32 bytes before a place, however far the chunk's start is."""
    gear, h, start, out = [int(g) for g in chunking._GEAR], 0, 0, []
    for k, byte in enumerate(data, 1):
        h = (h << 1) + gear[byte] & 0xFFFFFFFF
        if k - start >= most or k - start >= least and h >> 32 - bits == 0 and len(data) - start > least:
            out.append(k)
            start = k
    return out if start == len(data) else [*out, len(data)]


def plain(rows, whole=False):
    """(order, text) -> (bytes, removed, digest), chunk by chunk; equal orders are one document.

    whole: a short last piece is known together with the chunk before it; without it such pieces stay."""
    first, cuts = {}, {}
    for o, text in rows:
        b = text.encode()
        ends = plain_cut(b)
        cuts[o] = [(a, e) for a, e in zip([0, *ends], ends)]
        for n, (a, e) in enumerate(cuts[o]):
            known = b[cuts[o][max(0, n - 1)][0] if e - a < chunking.LEAST else a : e]
            first[known] = min(first.get(known, (o, a)), (o, a))
    out = {}
    for o, text in rows:
        b = text.encode()
        kept = b""
        for n, (a, e) in enumerate(cuts[o]):
            short = e - a < chunking.LEAST
            known = b[cuts[o][max(0, n - 1)][0] if short else a : e]
            if short and not whole or first[known] == (o, a):
                kept += b[a:e]
        out[o] = (len(b), len(b) - len(kept), brute.sha(kept))
    return out


def test_cuts_resist_insertions():
    r = random.Random(1)
    text = bytes(r.choice(b"abcdefgh ") for _ in range(20000))
    ends = chunking.cut(chunking.cut_places(text).tolist(), 0, len(text))
    moved = b"an insertion" + text
    again = {e - 12 for e in chunking.cut(chunking.cut_places(moved).tolist(), 0, len(moved))}
    assert ends[-1] == len(text) and len(again & set(ends)) > 0.97 * len(ends)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert all(chunking.LEAST <= s <= chunking.MOST for s in sizes[:-1])
    for n in (0, 1, chunking.LEAST, chunking.LEAST + 1, chunking.MOST, 5000):
        assert chunking.cut(chunking.cut_places(text[:n]).tolist(), 0, n) == plain_cut(text[:n])
    assert chunking.cut(chunking.cut_places(b"a" * 900).tolist(), 0, 900) == plain_cut(b"a" * 900)


def test_chunks_equal_plain_version(spark, documents, texts):
    for whole in (False, True):
        want = plain(texts, whole)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in chunking.remove_chunks(documents, whole).collect()}
        assert got == want and sum(w[1] for w in want.values()) > 0


def test_chunks_hard_rows(spark, hard_docs, hard_rows, no_docs):
    tie = {(r.doc_id, r.text): r.h for r in hard_docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows = [((i is not None, i or 0, tie[i, t]), t or "") for i, t in hard_rows]
    for whole in (False, True):
        want = plain(rows, whole)
        got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in chunking.remove_chunks(hard_docs, whole).collect())
        assert got == collections.Counter((i, *want[o]) for (i, _), (o, _) in zip(hard_rows, rows))
    assert chunking.remove_chunks(no_docs).count() == 0


def test_query_removes_exact_copies_whole(spark, tmp_path):
    r = random.Random(5)
    texts = ["x", "short text", "a" * 39, "a" * 79, "é" * 20, *("".join(r.choice("abcdefgh ") for _ in range(n)) for n in range(30, 420, 7))]
    rows = [(k * 1000 + i, t) for k in range(3) for i, t in enumerate(texts)]
    rows += [(5000 + i, t + " and more of it") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in queries.op4_content_chunks(spark, str(tmp_path)).collect()}
    least = {r.doc_id: r.n_removed for r in chunking.remove_chunks(docs).collect()}
    for i, t in rows:
        n = len(t.encode())
        if i < 5000:
            assert got[i] == (n, n if i >= 1000 else 0)
        assert least[i] <= got[i][1] < n + (i >= 1000)
