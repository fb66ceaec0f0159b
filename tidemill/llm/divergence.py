"""Audit of how the sources of a language diverge in their terms.

Each language keeps the terms that occur in at least `least_docs` of its documents, V of them. A group (a
language's source, or the whole language) gives a kept term with `count` occurrences the share
p = 1 + floor(SCALE * (count + 1) / (N + V)), N being the group's occurrences of all kept terms. The
divergence of p from q is floor((p - q)**2 / q). All arithmetic is in whole numbers.

1. Counting. A task counts the terms of its texts per group and sends each once per flush; equal keys are
   added up before and after the shuffle, so a hot source or word is a few numbers per task.
2. Pairs, sparse and corrected by a baseline. All terms that a group lacks have one share p0, so two
   sources diverge by V * f(p0, q0), corrected at the terms that occur in one of them by
   f(p, q0) - f(p0, q0) (taken once per distinct share, with its number of terms), and where both have the
   term by f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). No absent term is ever a row.
3. Ranking by radix select. The 200 terms of a group are found by histograms over value bits: four rounds
   of 16 bits, each a distributed count per (group, digit), lead to the value of the last rank. Ties there
   are refined in the same way by the next bytes after their common prefix. Only rows above the threshold
   are then sorted.

Bounds: shares are at most SCALE + 1, so squares and sums over a language's terms fit 64 bits up to a
thousand million kept terms; products with counts are decimals.

Defined cases: null text, lang and source are ''; every row is a document, repeated or not, whatever its
doc_id; a text without terms still makes its group occur; a language without kept terms gives pairs of
value 0 and no terms; columns beyond the three are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_side

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
#: Counts and bytes of text that a task holds before it sends them.
HELD_TERMS, HELD_BYTES = 300_000, 1 << 25
#: Groups up to which their table is broadcast; a row has some hundred bytes.
FEW_GROUPS = 50_000
#: Parts into which the rows of a language are dealt when they meet its other sources by a shuffle.
SALTS = 32
_DIGIT = 16
#: Lower-cased bytes of terms; a space for all others.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_GROUP = ("lang", "source")


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occurs: dict[tuple, Counter] = defaultdict(Counter)
    within: dict[tuple, Counter] = defaultdict(Counter)
    held_terms = held_bytes = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurs.items():
            docs = within[lang, source]
            rows = [(lang, source, None, 0, 0), *((lang, source, t, n, docs[t]) for t, n in counts.items())]
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[k : k + 50_000]), _COUNTS)], schema=_COUNTS)
        occurs.clear()
        within.clear()

    for b in batches:
        for lang, source, text in zip(*(b.column(k) for k in range(3))):
            group, text = (lang.as_py(), source.as_py()), text.as_py()
            terms, own = terms_of(text), occurs[group]
            held_terms -= len(own)
            own.update(terms)
            within[group].update(set(terms))
            held_terms += len(own)
            held_bytes += len(text)
            if held_bytes >= HELD_BYTES or held_terms >= HELD_TERMS:
                yield from flush()
                held_terms = held_bytes = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs that hold it); a row with a null term for every group that occurs."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kept: str) -> str:
    """SQL of a share; null where a language has no kept terms."""
    wide = "CAST({} AS DECIMAL(19, 0))".format
    return f"CASE WHEN {kept} > 0 THEN 1 + CAST({SCALE} AS DECIMAL(10, 0)) * {wide(f'{n} + 1')} div {wide(f'{total} + {kept}')} END"


def _f(p: str, q: str) -> str:
    """SQL of the divergence of share p from share q."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _kept(counted: DataFrame, least_docs: int) -> DataFrame:
    """The counts of kept terms (and the rows without a term), with the language's occurrences; head marks one row a term."""
    of_term = Window.partitionBy("lang", "term")
    rows = counted.select(
        *_GROUP, "term", "n", F.sum("docs").over(of_term).alias("held_by"), F.sum("n").over(of_term).alias("lang_n"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("head"),
    )
    return rows.where(F.col("term").isNull() | (F.col("held_by") >= least_docs)).drop("held_by")


def _groups(kept: DataFrame) -> DataFrame:
    """(lang, source, total, kept, lang_total, p0): one row per occurring group."""
    has = F.col("term").isNotNull()
    of_lang = kept.groupBy("lang").agg(F.count_if(has & F.col("head")).alias("kept"), F.sum("n").alias("lang_total"))
    groups = kept.groupBy(*_GROUP).agg(F.sum("n").alias("total")).join(of_lang, "lang")
    return groups.withColumn("p0", F.expr(_share("0", "total", "kept")))


def _shares(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, term, p, p0, value) of the terms that occur in a group; value where p exceeds the language's share."""
    rows = kept.where("term IS NOT NULL").join(groups, [*_GROUP])
    shares = rows.select(*_GROUP, "term", "p0", F.expr(_share("n", "total", "kept")).alias("p"), F.expr(_share("lang_n", "lang_total", "kept")).alias("q"))
    return shares.select(*_GROUP, "term", "p", "p0", F.expr(f"CASE WHEN p > q THEN {_f('p', 'q')} END").alias("value"))


def _with_others(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """rows (lang, source, ...) beside each other source of the language: item and its p0 as item_p0.

    Many groups meet by a shuffle in which every language's rows are dealt into SALTS parts.
    """
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("item_p0"))
    if few:
        return rows.join(F.broadcast(others), "lang").where("item <> source")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    others = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(others, ["lang", "salt"]).where("item <> source").drop("salt")


def _pairs(shares: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language."""
    both = lambda there, back: F.explode(F.array(
        F.struct("lang", "source", "item", F.expr(there).alias("part")),
        F.struct(F.col("lang"), F.col("item").alias("source"), F.col("source").alias("item"), F.expr(back).alias("part")),
    ))
    base = _with_others(groups.select(*_GROUP, "kept", "p0"), groups, few).select(
        *_GROUP, "item", F.expr(f"CASE WHEN kept > 0 THEN kept * {_f('p0', 'item_p0')} ELSE 0L END").alias("part")
    )
    alike = shares.groupBy(*_GROUP, "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    one = _with_others(alike, groups, few).select(both(
        f"m * ({_f('p', 'item_p0')} - {_f('p0', 'item_p0')})", f"m * ({_f('item_p0', 'p')} - {_f('item_p0', 'p0')})"
    ).alias("x")).select("x.*")
    own = shares.select("lang", "term", "source", "p", "p0")
    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("p0").alias("r0"))
    two = own.join(other, ["lang", "term"]).where("source < item").select(both(
        f"{_f('p', 'r')} - {_f('p', 'r0')} - {_f('p0', 'r')} + {_f('p0', 'r0')}",
        f"{_f('r', 'p')} - {_f('r', 'p0')} - {_f('r0', 'p')} + {_f('r0', 'p0')}",
    ).alias("x")).select("x.*")
    return base.unionByName(one).unionByName(two).groupBy(*_GROUP, "item").agg(F.sum("part").alias("value"))


def _beside(rows: DataFrame, state: DataFrame) -> DataFrame:
    return rows.join(small_side(state, FEW_GROUPS), [*_GROUP])


def _crossing(cells: DataFrame, order) -> DataFrame:
    """Of each group's cells (digit, cell: its rows) the one that holds rank `need`; need becomes the rank within it."""
    upto = Window.partitionBy(*_GROUP).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    above = cells.withColumn("above", F.sum("cell").over(upto) - F.col("cell"))
    return above.where("above < need AND need <= above + cell").withColumn("need", F.col("need") - F.col("above")).drop("above")


def _value_thresholds(rows: DataFrame, top: int) -> DataFrame:
    """(lang, source, threshold, need, cell) of each group with more than `top` rows: the value of rank `top`,
    how many rows of just that value are taken, and how many there are."""
    counts = rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("cell"))
    state = materialise(counts.where(F.col("cell") > top).select(*_GROUP, F.lit(0).cast("long").alias("threshold"), F.lit(top).cast("long").alias("need")), "ranks")
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        active = _beside(rows.select(*_GROUP, "value"), state)
        if shift < 64 - _DIGIT:
            active = active.where(F.shiftright("value", shift + _DIGIT) == F.col("threshold"))
        digit = F.shiftright("value", shift).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        cells = active.groupBy(*_GROUP, "threshold", "need", digit.alias("digit")).agg(F.count(F.lit(1)).alias("cell"))
        found = _crossing(cells, F.desc("digit"))
        state = materialise(found.select(*_GROUP, (F.shiftleft("threshold", _DIGIT) + F.col("digit")).alias("threshold"), "need", "cell"), "ranks")
    return state


def _common_prefix(a: str, b: str) -> str:
    """SQL of the length of the common prefix of two strings, bit by bit from the top."""
    longer = f"(n + shiftleft(1, i)) <= least(length({a}), length({b})) AND left({a}, n + shiftleft(1, i)) = left({b}, n + shiftleft(1, i))"
    return f"aggregate(sequence(30, 0, -1), 0, (n, i) -> CASE WHEN {longer} THEN n + shiftleft(1, i) ELSE n END)"


def _tie_bounds(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(lang, source, bound) of the groups that take only some of the rows of their threshold: the last term taken.

    Terms go as hexadecimal digits, which are in the order of their bytes. Every round either takes rows for
    good or drops some, and no group needs more rounds than ranks.
    """
    open_ = state.where("need < cell")
    tied = materialise(_beside(rows, open_.select(*_GROUP, "threshold")).where("value = threshold").select(*_GROUP, F.hex("term").alias("code")), "ties")
    ends = tied.groupBy(*_GROUP).agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    left = materialise(ends.join(open_, [*_GROUP]).select(*_GROUP, "need", F.expr(f"left(lo, {_common_prefix('lo', 'hi')})").alias("prefix")), "tie-ranks")
    done = None
    while not left.isEmpty():
        active = _beside(tied, left).where("startswith(code, prefix)")
        digit = F.expr(f"substr(code, length(prefix) + 1, {_DIGIT // 4})").alias("digit")
        cells = active.groupBy(*_GROUP, "need", digit).agg(F.count(F.lit(1)).alias("cell"), F.min("code").alias("lo"), F.max("code").alias("hi"))
        found = materialise(_crossing(cells, F.asc("digit")), "tie-cells")
        settled = found.where("need = cell").select(*_GROUP, F.col("hi").alias("bound"))
        done = settled if done is None else done.unionByName(settled)
        left = materialise(found.where("need < cell").select(*_GROUP, "need", F.expr(f"left(lo, {_common_prefix('lo', 'hi')})").alias("prefix")), "tie-ranks")
    return done if done is not None else state.select(*_GROUP, F.lit("").alias("bound")).limit(0)


def top_terms(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Of rows (lang, source, term, value), value being no less than 0, each group's first `top` by value, descending, and term."""
    state = _value_thresholds(rows, top)
    if state.isEmpty():
        return rows
    limits = materialise(state.join(_tie_bounds(rows, state), [*_GROUP], "left").select(*_GROUP, "threshold", "bound"), "limits")
    within = F.expr("threshold IS NULL OR value > threshold OR (value = threshold AND (bound IS NULL OR hex(term) <= bound))")
    return rows.join(small_side(limits, FEW_GROUPS), [*_GROUP], "left").where(within).select(*rows.columns)


def source_divergence(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank; see the module's head.

    A window ranks at most `top` terms of a group; the pairs of a source are ranked by an external sort of
    its peers' rows, which hold three fields each.
    """
    kept = materialise(_kept(term_counts(docs), least_docs), "kept-terms")
    groups = materialise(_groups(kept), "term-groups")
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    shares = materialise(_shares(kept, F.broadcast(groups) if few else groups), "term-shares")
    terms = top_terms(shares.where("value IS NOT NULL").select(*_GROUP, "term", "value"), top)
    rows = _pairs(shares, groups, few).select(*_GROUP, F.lit("pair").alias("part"), "item", "value").unionByName(
        terms.select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    )
    by_rank = Window.partitionBy(*_GROUP, "part").orderBy(F.desc("value"), "item")
    return rows.select(*_GROUP, "part", "item", "value", F.row_number().over(by_rank).alias("rank"))
