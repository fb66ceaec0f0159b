"""Fill-in-the-middle, source divergence and the tree encoder, against plain versions."""

import base64
import collections
import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemill.llm import divergence, infill, treebpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# -- fill in the middle --


def filled(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = sha(f"7:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return i, n, "spm" if h4 % 100 < 50 else "psm", len(p), len(m), out


def test_fill_in_middle(spark, hard_docs, hard_rows, no_docs):
    r = random.Random(5)
    more = [(100 + k, "\n".join(words(r, r.randint(0, 9), "aé \r") for _ in range(k)) + "\n" * (k % 3)) for k in range(40)]
    more += [(200, "a <P> b\nc"), (201, "\n" * 50_000), (202, "<S\n>" * 9 + "<"), (203, "<P\n><" * 7), (204, "x\x00y\n𝄞"), (205, "line\n" * 200_000)]
    docs = hard_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    made = infill.fill_in_middle(docs)
    back = infill.restored(F.col("output"), F.col("form"))
    got = collections.Counter(tuple(x) for x in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back).collect())
    assert got == collections.Counter((*filled(i, t), t or "") for i, t in hard_rows + more)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(no_docs).count() == 0
    assert infill.fill_in_middle(docs, rate=0).where("form <> 'plain'").isEmpty()
    named = spark.createDataFrame([("a1", "one\ntwo\n", 3)], "doc_id string, text string, `output.x` int")
    assert infill.fill_in_middle(named).first().n == 2


# -- divergence --


def audited(rows, top=200, least=3):
    docs = [[(x or "") for x in r] for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t)) for _, _, t in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [(d[1], w) for d, w in zip(docs, terms) if d[0] == lang]
        held = collections.Counter(t for _, w in own for t in set(w))
        kept = {t for t, n in held.items() if n >= least}
        groups = {s: collections.Counter() for s, _ in own}
        for s, w in own:
            groups[s].update(t for t in w if t in kept)
        whole = sum(groups.values(), collections.Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in groups.items():
            pairs = [(sum(f(share(c, t), share(d, t)) for t in kept), o) for o, d in groups.items() if o != s]
            over = [(f(share(c, t), share(whole, t)), t) for t in c if share(c, t) > share(whole, t)]
            for part, found, k in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:k]
                out |= {(lang, s, part, item, value, n + 1) for n, (value, item) in enumerate(ranked)}
    return out


@pytest.fixture(scope="module")
def audit_rows():
    r = random.Random(8)
    vocabulary = [words(r, 1, "abAÉ") + "-x" * (k % 3) for k in range(60)] + ["a" * k for k in range(1, 40)] + ["zz" + "q" * 5000 + c for c in "abc"]
    rows = []
    for k in range(220):
        few = vocabulary[: 20 + 40 * (k % 3)] if k % 2 else vocabulary
        rows.append((r.choice(["en", "en", "de", None]), r.choice(["hot", "hot", "b", "c", None, ""]), " ".join(r.choices(few, k=r.randint(0, 60)))))
    rows += rows[:20] + [("en", "empty", None), ("en", "blank", " 12 _ "), ("xx", "only", "a b c"), ("xx", "other", None), ("yy", "only", "d d d")]
    return rows


@pytest.mark.parametrize("top,few", [(200, 50_000), (7, 50_000), (1, 0)])
def test_divergence(spark, audit_rows, monkeypatch, top, few):
    monkeypatch.setattr(divergence, "FEW_GROUPS", few)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in audit_rows], "lang string, source string, text string, n int, term string, `value.p` int").repartition(6)
    got = [tuple(r) for r in divergence.source_divergence(docs, top).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(audit_rows, top)
    if top == 1:
        assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_radix_select_with_ties_only(spark):
    """All values equal, terms that are prefixes of each other: only the bytes decide."""
    r = random.Random(2)
    terms = sorted({"a" * k for k in range(1, 60)} | {"a" * 30 + words(r, 1, "abé\U0001d11e") for _ in range(80)} | {"b"}, key=str.encode)
    rows = [("l", s, t, v) for s, v in (("one", 0), ("two", (1 << 60) + 5)) for t in terms] + [("l", "few", t, 9) for t in terms[:3]]
    df = spark.createDataFrame(rows, "lang string, source string, term string, value long").repartition(3)
    for top in (1, 3, 41, len(terms)):
        got = collections.Counter(tuple(x) for x in divergence.top_terms(df, top).collect())
        assert got == collections.Counter(x for x in rows if x[1] == "few" and terms.index(x[2]) < top or x[1] != "few" and terms.index(x[2]) < top)


def test_counts_survive_flushes(spark, audit_rows, monkeypatch):
    docs = spark.createDataFrame(audit_rows, "lang string, source string, text string").coalesce(1)
    whole = collections.Counter(tuple(r) for r in divergence.term_counts(docs).collect())
    batches = lambda: docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in docs.columns]).toArrow().to_batches()
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    sums = collections.Counter()
    for b in divergence._count(iter(batches())):
        for x in b.to_pylist():
            sums[x["lang"], x["source"], x["term"]] += 1j * x["docs"] + x["n"]
    assert {(*k, int(v.real), int(v.imag)) for k, v in sums.items()} == set(whole)


# -- tree encoder --


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_text(r):
    n, kind = r.randrange(1, 60), r.randrange(6)
    if kind == 0:
        return "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x3000), r.randrange(0x1F300, 0x1F600), r.randrange(1, 0xD7FF)])) for _ in range(n))
    if kind == 1:
        return "".join(r.choice(" \t\n\r\x0b\x1c\x1d\x85\xa0 　a'1") for _ in range(n))
    if kind == 2:
        return r.choice("az=- !") * (n * 20)
    return "".join(r.choice(["ab", "0123456789abcdef", "thereinationsuponwithal"][kind - 3]) for _ in range(n * 6))


@pytest.mark.parametrize("leaf", [1, 4])
def test_tree_encoder_equals_the_library(monkeypatch, library, leaf):
    monkeypatch.setattr(treebpe, "LEAF", leaf)
    own, r = treebpe.TreeEncoder(RANKS, public_tokenizers.PATTERN), random.Random(leaf)
    for t in [*(odd_text(r) for _ in range(1500)), "a" * 20_000, words(r, 3, "xyz") * 3000]:
        ids = own.encode(t)
        assert list(ids) == library.encode_ordinary(t) and own.decode(ids).decode() == t


def test_joins_are_associative():
    own, r = treebpe.TreeEncoder(RANKS, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(300):
        s = odd_text(r).encode()
        i, j = sorted((r.randrange(len(s) + 1), r.randrange(len(s) + 1)))
        a, b, c = (own.direct(x) for x in (s[:i], s[i:j], s[j:]))
        assert own.join(own.join(a, b), c) == own.join(a, own.join(b, c)) == own.tree(s) == own.direct(s)


def test_tree_encoding_of_documents(spark, hard_docs, hard_rows, no_docs, library, documents, texts):
    def want(i, t):
        ids = library.encode_ordinary(t or "")
        return i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")

    for docs, rows in ((hard_docs, hard_rows), (documents, texts)):
        got = collections.Counter(tuple(r) for r in treebpe.encoding_digests(docs, RANKS, public_tokenizers.PATTERN).collect())
        assert got == collections.Counter(want(i, t) for i, t in rows)
    encoded = treebpe.encode_documents(hard_docs, RANKS, public_tokenizers.PATTERN)
    assert collections.Counter((r.doc_id, r.n_tokens, *r.ids) for r in encoded.collect()) == collections.Counter(
        (i, len(x), *x) for i, x in ((i, library.encode_ordinary(t or "")) for i, t in hard_rows)
    )
    back = collections.Counter(tuple(r) for r in treebpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect())
    assert back == collections.Counter((i, t or "") for i, t in hard_rows)
    assert treebpe.encoding_digests(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_ranks_without_all_bytes_are_refused(tmp_path):
    (tmp_path / "ranks").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        treebpe.TreeEncoder(str(tmp_path / "ranks"), public_tokenizers.PATTERN)
