import collections
import math
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import words
from tidemill.llm import bpe, components, jaccard, quality


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (200, 200), (300, 102), (102, 101)] + [(1000, k) for k in range(1001, 1100)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    groups = collections.defaultdict(set)
    for n, r in got.items():
        groups[r].add(n)
    assert sorted(map(len, groups.values())) == [4, 61, 100]
    assert components.connected_components(edges.limit(0)).count() == 0


def joined(rows):
    """(doc_id, text) rows -> Counter of (doc_id, n_shingles, component_id); equal rows are one point."""
    sets = {k: brute.shingle_set(t) for k, (_, t) in enumerate(rows)}
    root = brute.components(sets)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    return collections.Counter((i, len(sets[k]), (least.get(root[k]) if sets[k] else i)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("leaf", [256, 2])
def test_jaccard(spark, hard_docs, hard_rows, no_docs, monkeypatch, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_join(hard_docs).collect())
    assert got == joined(hard_rows)
    if leaf == 2:
        assert jaccard.jaccard_join(no_docs).count() == 0
        kept = jaccard.keep_one(hard_docs)
        assert kept.columns == hard_docs.columns
        want = len({r for k, r in brute.components({k: brute.shingle_set(t) for k, (_, t) in enumerate(hard_rows)}).items() if brute.shingle_set(hard_rows[k][1])})
        empty = sum(not brute.shingle_set(t) for _, t in hard_rows)
        assert kept.count() == want + empty
        assert jaccard.keep_one(no_docs).count() == 0


def test_keep_one_loses_no_row(spark):
    same = "one two three four five six seven"
    rows = [(1, None, "a"), (1, "", "b"), (1, None, "c"), (1, None, "c"), (None, " ", "d"), (2, same, "x"), (2, same, "y"), (2, same, None), (3, same, "z"), (None, "alone here", "e")]
    docs = spark.createDataFrame([(i, t, x, None) for i, t, x in rows], "doc_id long, text string, ord string, root int")
    kept = [jaccard.keep_one(docs.repartition(n)) for n in (1, 4)]
    one, two = ([tuple(r) for r in k.collect()] for k in kept)
    assert kept[0].columns == docs.columns and sorted(one, key=repr) == sorted(two, key=repr)
    got = collections.Counter(r[:3] for r in one)
    assert all(got[r] == n for r, n in collections.Counter(r for r in rows if not (r[1] or "").strip()).items())
    assert sum(n for r, n in got.items() if r[1] == same) == 1 and got[None, "alone here", "e"] == 1 and len(one) == 7


def test_jaccard_documents(spark, documents, texts):
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_join(documents).collect())
    assert got == joined(texts)


def test_unlike_sets_with_one_key_get_another_seed(spark, monkeypatch):
    keys, seeds = jaccard.Sets._keys, []

    def colliding(self, tokens, step):
        return keys(self, tokens, step) * (0 if step == 0 else 1)  # with the first seed all sets have the same key

    monkeypatch.setattr(jaccard.Sets, "_keys", colliding)
    pages = jaccard._region_pages
    monkeypatch.setattr(jaccard, "_region_pages", lambda *args: seeds.append(args[-1]) or pages(*args))
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l m"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in jaccard.jaccard_join(docs).collect()) == joined(rows)
    assert seeds in ([0], [1])  # workers may not see the patch; where they do, the second seed is used


def test_keys_are_independent():
    texts = [b"a b c d e f", b"a b c d e g", b"", b"a b c d e f"]
    one, two = jaccard.Sets(texts, second=True), jaccard.Sets(texts, 1, second=True)
    assert one.keys[0] == one.keys[3] != one.keys[1] and one.second[0] == one.second[3] != one.second[1]
    assert len({one.keys[0], one.second[0], two.keys[0], two.second[0]}) == 4


def test_membership_filter(spark, monkeypatch):
    from tidemill.llm import sketch

    ids = spark.range(0, 100_000, 7).select(F.col("id").alias("ord"))
    wanted = sketch.membership_filter(ids)
    rows = spark.range(100_000).where(wanted(F.col("id"))).select(F.count_if(F.col("id") % 7 == 0).alias("a"), F.count(F.lit(1)).alias("b")).first()
    assert rows.a == ids.count() and rows.b < 2 * rows.a
    assert spark.range(10).where(sketch.membership_filter(ids.limit(0))(F.col("id"))).count() == 0
    monkeypatch.setattr(sketch, "MOST_BYTES", 1 << 12)
    assert spark.range(10).where(sketch.membership_filter(ids)(F.col("id"))).count() == 10


def test_parity_is_a_lower_bound():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 5, 64, 100, 700):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n // 2], r.integers(0, 1 << 63, n, dtype=np.uint64)])
        assert jaccard.least_difference(jaccard.parity(a), jaccard.parity(b)) <= len(set(a.tolist()) ^ set(b.tolist()))
        assert jaccard.least_difference(jaccard.parity(a), jaccard.parity(a)) == 0


def test_metrics(spark, hard_docs, hard_rows, documents, texts):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for docs, rows in ((hard_docs, hard_rows), (documents, texts)):
        got = collections.Counter((r.doc_id, *(r[c] for c in columns)) for r in quality.metrics(docs, ("doc_id",)).collect())
        assert got == collections.Counter((i, *brute.metrics(t)) for i, t in rows)


def tail(n, k, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))


def test_fewest_labels(spark):
    row = spark.range(1).select(quality.fewest_labels(1).alias("a"), quality.fewest_labels(4).alias("b")).first()
    for n, strata in ((row.a, 1), (row.b, 4)):
        assert tail(n, 0, quality.RISK) <= quality.DELTA / strata < tail(n - 1, 0, quality.RISK)
    assert (row.a, row.b) == (149, 217)


def test_binomial_tail(spark):
    cases = [(50, 0), (50, 3), (2000, 5), (100000, 600)]
    df = spark.createDataFrame(cases, "n long, k long")
    for row in df.select("n", "k", quality._tail("n", "k", 0.01).alias("t")).collect():
        assert math.isclose(row.t, tail(row.n, row.k, 0.01), rel_tol=1e-6)


def labelled(spark, rows):
    docs = spark.createDataFrame([r[:3] + (r[0], "x") for r in rows], "doc_id long, text string, lang string, n_words long, row string")
    return docs, spark.createDataFrame([(r[0], r[3]) for r in rows if r[3] is not None] + [(7, None), (None, 1)], "doc_id long, quality int")


def test_cutoffs_keep_their_promise(spark, hard_docs, no_docs):
    text = lambda sym: " ".join(f"w{k}" for k in range(30)) + " " + "#" * sym
    rows = [(k, text(0 if k % 500 else 20), "en", 1) for k in range(4000)] + [(5000 + k, text(20), "en", 0) for k in range(50)] + [(9000, text(20), "xx", 1)]
    docs, labels = labelled(spark, rows)
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert got[1].cut_symbols == 5 and got[1].kept and not got[5001].kept  # 8 of 4,000 good ones over it: certified
    assert got[9000].kept and got[9000].cut_symbols is None  # one label certifies nothing
    want = brute.kept([(i, s, t) for i, t, s, _ in rows], {r[0] for r in rows if r[3]}, quality.LADDER)
    assert {i for i, r in got.items() if r.kept} == want
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    empty = labels.limit(0)
    assert quality.quality_rules(hard_docs, empty).where("kept = base_failed").count() == 0
    assert quality.keep_good(hard_docs, empty).columns == hard_docs.columns
    assert quality.quality_rules(no_docs, labels).count() == 0 and quality.keep_good(no_docs, labels).count() == 0


def doubling(n, a="a", b="b"):
    """The word of n letters that begins a, b, b, a: each half but the first is the one before with its letters changed."""
    while len(a) < n:
        a, b = a + b, b + a
    return a


def test_unlike_words_of_many_letters_are_unlike_documents(spark):
    rows, i = [], 0
    for n in (2**k for k in range(10, 17)):
        for w in (doubling(n), doubling(n, "b", "a")):
            rows += [(i, w), (i + 1, f"one {w} two three four five"), (i + 2, w)]
            i += 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in jaccard.jaccard_join(docs).collect()) == joined(rows)
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == {k for k, _ in rows if k % 3 < 2}


def test_word_hashes_and_exact_sets():
    import numpy as np

    from tidemill.llm.hashing import hash_words

    r = random.Random(9)
    long_ = ["".join(r.choice("ab") for _ in range(n)) for n in (1, 7, 8, 9, 16, 63, 64, 65, 200) for _ in range(30)]
    texts = [" ".join(r.choices(long_, k=r.randint(0, 12))) for _ in range(200)] + [" ".join(long_)] * 2
    found = {}
    for t in texts:
        data = t.encode()
        spans = [(m.start(), m.end()) for m in brute.WORDS.finditer(t)]
        starts, ends = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
        for seed in (0, 1):
            for (a, b), h in zip(spans, hash_words(data, starts, ends, seed).tolist()):
                assert found.setdefault((seed, t[a:b]), h) == h  # wherever the word stands
    assert len(set(found.values())) == len(found)
    hashed, exact = jaccard.Sets([t.encode() for t in texts]), jaccard.ExactSets([t.encode() for t in texts])
    want = [brute.shingle_set(t) for t in texts]
    assert hashed.sizes.tolist() == exact.sizes.tolist() == [len(w) for w in want]
    for x in range(0, 200, 7):
        for y in range(200):
            for s in (hashed, exact):
                assert len(set(s[x].tolist()) & set(s[y].tolist())) == len(want[x] & want[y])


def test_ids_that_are_no_numbers_are_refused(spark):
    from tidemill.llm import chat, chunking, sst, substrings

    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    shards = lambda d: sst.token_shards(d, public_tokenizers.path("word_bpe_49k.json"))
    for run in (jaccard.jaccard_join, jaccard.keep_one, substrings.remove_repeats, chunking.remove_chunks, shards):
        with pytest.raises(TypeError):
            run(docs)
    with pytest.raises(TypeError):
        chat.format_turns(spark.createDataFrame([("c", 1, "user", "t")], "conv_id string, turn long, role string, text string"))


def test_thin_strata_and_a_failed_step_ends_the_ladder(spark):
    text = lambda k, sym: " ".join(f"w{k}x{j}" for j in range(25)) + " " + "#" * sym
    rows = [(1000 * n + k, text(k, 0), s, 1) for n, s in enumerate(("de", "fr", None)) for k in range(110)]
    rows += [(9000 + n, text(n, 30), s, None) for n, s in enumerate(("de", "fr", "new", None, "en"))]  # 'new' has no label
    rows += [(20000 + k, text(k, 12 if k % 20 == 0 else 0), "en", 1) for k in range(400)]  # 5 % have 12 symbols
    docs, labels = labelled(spark, rows)
    for pooled in (False, True):
        got = {r.doc_id: r for r in quality.quality_rules(docs, labels, pooled=pooled).collect()}
        assert [got[9000 + n].kept for n in range(5)] == [not pooled, not pooled, True, not pooled, False]
        assert got[0].cut_symbols == (5 if pooled else None) and got[9002].cut_symbols is None
        assert got[20001].cut_symbols == 80 and got[20001].cut_dup_lines == 50
        want = brute.kept([(i, s or "", t) for i, t, s, _ in rows], {r[0] for r in rows if r[3]}, quality.LADDER, pooled=pooled)
        assert {i for i, r in got.items() if r.kept} == want == {r.doc_id for r in quality.keep_good(docs, labels, pooled=pooled).collect()}


def test_queries_run_and_oracles_agree(spark, sf):
    from tests.compare import assert_same
    from tidemill.llm import queries

    for name, sql in queries.oracle_sql().items():
        assert assert_same(queries.queries()[name](spark, sf), sf, sql) > 0, name


@pytest.fixture(scope="module")
def planted(spark, sf, tmp_path_factory):
    """The smallest tables with more labelled documents, so that cutoffs are certified, and documents that they reject."""
    r, folder = random.Random(3), f"file://{tmp_path_factory.mktemp('planted')}"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    clean = [(100_000 + k, words(r, 40), "en", "s", 0) for k in range(300)]
    junk = [(200_000 + k, words(r, 25) + " " + "#$%" * 20, "en", "s", 0) for k in range(6)]
    weak = [(300_000, words(r, 30) + " user=bob Zx9Zx9Zx9Zx9Zx9Zx9QQ https://x.org/a end", "en", "s", 0), (300_001, words(r, 30) + " user=bob", "xx", "s", 0)]
    more = spark.createDataFrame(clean + junk + weak, "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more).repartition(5).write.parquet(f"{folder}/documents.parquet")
    good = spark.createDataFrame([(i, 1) for i, *_ in clean], "doc_id long, quality int")
    labels.unionByName(good, allowMissingColumns=True).write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_against_brute_force(spark, planted):
    import corpus_pipeline

    documents = spark.read.parquet(f"{planted}/documents.parquet")
    texts = [tuple(r) for r in documents.select("doc_id", F.coalesce("lang", F.lit("")), "text").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{planted}/benchmark.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{planted}/labels.parquet").where("quality > 0").collect()}
    stays = brute.kept(texts, good, quality.LADDER)
    passed_base = {i for i, _, t in texts if not brute.base_fails(brute.metrics(t))}
    assert len(passed_base) > len(stays) and not stays & set(range(200_000, 200_006))  # a certified cutoff rejects
    kept = [(i, t) for i, _, t in texts if i in stays]
    root = brute.components({i: brute.shingle_set(t) for i, t in kept})
    kept = [(i, t) for i, t in kept if root[i] == i and not brute.contaminated(t, bench)[4]]
    assert any(k > 2 for i, t in kept for _, k, _ in brute.all_spans(t))  # a weak part is linked
    own = bpe.BytePairEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: own.encode(brute.redacted(t)) for i, t in kept}
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, planted).collect()}
    assert set(got) == set(want)
    assert sum(got[i] != want[i] for i in want) == 0


def test_pipeline_stages_return_the_columns_of_documents(spark, sf, documents):
    import corpus_pipeline

    docs, empty = documents, documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf)
        nothing = stage(spark, empty, sf)
        assert nothing.count() == 0 and nothing.columns == found.columns
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = found
            assert docs.columns == documents.columns
