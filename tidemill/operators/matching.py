"""Phrases inside texts for rule sets of any size: an inverted index over character grams.

`contains` for every phrase and text is what the scoring operators do with some hundred phrases, as
literals of the plan. Here the phrases are a table. Each has one anchor, its rarest run of eight
characters, or of three, two or one if it has fewer. Where the anchors fit into a task, the runs of each text
are looked up in it, and the phrases that met are verified at once. Otherwise the runs meet the anchors in an
equi-join of narrow rows, and the pairs that met are verified by `contains`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import Rules
from ..sources.scratch import materialise, new_path, opened

#: Lengths of anchors. Runs of three are in most long texts; those of eight are nearly as rare as what holds them.
SIZES = (1, 2, 3, 8)
#: Texts by which runs are ranked by frequency; the rank decides only which run of a phrase is its anchor.
SAMPLE = 300
#: Anchors up to which every task holds them all, with their phrases.
FEW_ANCHORS = 200_000
#: Pairs that met, up to which they are broadcast to the texts that they are verified on.
FEW_PAIRS = 100_000


def runs(text: Column | str, n: int) -> Column:
    """The distinct runs of n characters of a text, in one pass: what stands ahead of each place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def anchors(phrases: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(phrase, n, gram): the anchor of each distinct phrase that is not null or empty.

    Runs that are frequent in the first SAMPLE texts are avoided.
    """
    distinct = phrases.where("phrase <> ''").select("phrase").distinct()
    fits = F.coalesce(*[F.when(F.length("phrase") >= n, n) for n in reversed(SIZES)])
    sized = distinct.withColumn("n", fits)
    by_size = F.coalesce(*[F.when(F.col("n") == n, runs("phrase", n)) for n in SIZES])
    grams = sized.select("phrase", "n", F.explode(by_size).alias("gram"))
    seen = texts.limit(SAMPLE).select(F.explode(F.concat(*[runs(text, n) for n in SIZES[2:]])).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("seen"))
    ranked = grams.join(seen, "gram", "left")
    best = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("gram"))).alias("best")
    return ranked.groupBy("phrase", "n").agg(best).select("phrase", "n", F.col("best.gram").alias("gram"))


#: Multiplier of the polynomial hashes of runs, and the bits of a hash that mark a place in a table of flags.
_BASE, _BITS = np.uint64(0x9E3779B97F4A7C15), 22


def _hashes(text: str, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, the places in the flags of the runs of n characters, in order) for n from 1."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = codes
    for n in range(1, min(longest, len(codes)) + 1):
        if n > 1:
            h = h[:-1] * _BASE + codes[n - 1 :]
        yield n, (h * _BASE) >> np.uint64(64 - _BITS)


@lru_cache(maxsize=1)
def _index(path: str) -> dict[int, tuple[np.ndarray, dict[str, list[str]]]]:
    """By length, flags that most runs fail, and the phrases of each run; a phrase no longer than the longest anchor is its own."""
    system, where = opened(path)
    found: dict[int, dict[str, list[str]]] = {}
    for r in pq.read_table(where, filesystem=system, partitioning=None).to_pylist():
        gram = r["phrase"] if len(r["phrase"]) <= SIZES[-1] else r["gram"]
        found.setdefault(len(gram), {}).setdefault(gram, []).append(r["phrase"])
    index = {}
    for n, grams in found.items():
        flags = np.zeros(1 << _BITS, bool)
        for g in grams:
            flags[dict(_hashes(g, n))[n]] = True
        index[n] = flags, grams
    return index


def _phrases_inside(path: str):
    """Batches of (key, text) -> (key, phrase), by the anchors under a path; flags only spare the look-up of most runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(path)
        for b in batches:
            at, phrases = [], []
            for row, text in enumerate(b.column(1)):
                text = text.as_py()
                for n, places in _hashes(text, SIZES[-1]):
                    if n in index:
                        flags, grams = index[n]
                        met = grams.keys() & {text[i : i + n] for i in np.flatnonzero(flags[places]).tolist()}
                        inside = [p for g in met for p in grams[g] if len(p) == n or p in text]
                        at += [row] * len(inside)
                        phrases += inside
                if phrases and (len(phrases) >= 50_000 or row == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(phrases, pa.string())], ["key", "phrase"])
                    at, phrases = [], []

    return run


def phrase_matches(texts: DataFrame, phrases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, phrase) for each text (of a unique key) and each distinct phrase inside it; case and spaces count.

    Null texts and null or empty phrases match nothing; repeated phrases count once, join the rule table for
    its entries.
    """
    # a generator of one row, so that a text made by expressions is made once, not once per use
    named = texts.select(F.col(key).alias("key"), F.explode(F.array(text)).alias("text")).where("text IS NOT NULL")
    path = new_path(texts.sparkSession, "anchors")
    anchors(phrases, named, "text").write.parquet(path)
    index = texts.sparkSession.read.schema("phrase string, n int, gram string").parquet(path)
    sizes = [r.n for r in index.select("n").distinct().collect()]  # of SIZES
    few = index.limit(FEW_ANCHORS + 1).count() <= FEW_ANCHORS
    if not sizes:
        return named.select(F.col("key").alias(key), F.lit("").alias("phrase")).limit(0)
    if few:
        return named.mapInArrow(_phrases_inside(path), f"key {named.schema['key'].dataType.simpleString()}, phrase string").select(F.col("key").alias(key), "phrase")
    # runs of all lengths in one pass over the texts; those of different lengths never meet
    narrow = named.select("key", F.explode(F.concat(*[runs("text", n) for n in sizes])).alias("gram"))
    met = narrow.join(index, "gram").select("key", "phrase")
    met = materialise(met, "phrase-pairs")
    some = F.broadcast(met) if met.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS else met
    return named.join(some, "key").where(F.contains("text", F.col("phrase"))).select(F.col("key").alias(key), "phrase")


#: Section names of the rule table that hold no phrases of their own.
RULE_COLUMNS = "section string, grp string, grp_ord int, phrase string, phrase_ord int, value double"


def rule_rows(rules: Rules) -> list[tuple]:
    """A rule set as rows of the long table: an entry per phrase, in order, with its points, weight or penalty."""
    lists = {
        "hard_title": rules.hard_title, "hard_experience": rules.hard_experience, "hard_visa": rules.hard_visa,
        "hard_student": rules.hard_student, "heavy": rules.heavy, "medium": rules.medium, "medium_risks": rules.medium_risks,
        "soft_risks": rules.soft_risks, "training": rules.training,
    }
    points = {"title_points": rules.title_points, "body_points": rules.body_points, "delivery": rules.delivery, "visa_positive": rules.visa_positive}
    groups = [(section, "", 0, [(p, None) for p in phrases]) for section, phrases in lists.items()]
    groups += [(section, "", 0, list(pairs)) for section, pairs in points.items()]
    for k, (track, (title, body)) in enumerate(rules.tracks.items()):
        groups += [("track_title", track, k, [(p, 6) for p in title]), ("track_body", track, k, [(p, 2) for p in body])]
    groups += [("evidence", g, k, [(p, None) for p in phrases]) for k, (g, phrases) in enumerate(rules.evidence.items())]
    groups += [("gap", g, k, [(p, penalty) for p in phrases]) for k, (g, (phrases, penalty)) in enumerate(rules.gaps.items())]
    return [(s, g, o, p, i, None if v is None else float(v)) for s, g, o, entries in groups for i, (p, v) in enumerate(entries)]


def rule_table(spark, rules: Rules) -> DataFrame:
    return spark.createDataFrame(rule_rows(rules), RULE_COLUMNS)


def rule_hits(texts: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, grp, n entries inside the text, value summed over them) from a rule table; an entry listed twice counts twice."""
    matched = phrase_matches(texts, rules, key, text)
    entries = rules.select("section", "grp", "phrase", "value")
    return matched.join(entries, "phrase").groupBy(key, "section", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("value")
    )
