"""Quality rules whose cutoffs carry a guarantee on wrongly rejected good documents.

Word and line metrics are computed per whole text. A ladder of rules goes from loose to strict: each
step tightens the cutoff of one signal, and a document fails a step if any of its signals exceeds its
cutoff there. For each stratum (language) the labelled good documents that pass the base rules are a
holdout. Step by step an exact binomial test asks whether more than `risk` of the stratum's good
documents fail; the last step before the first that cannot rule this out is the stratum's rule. Tests
in a fixed order need no division of the error by the number of steps, so each stratum has
delta / (number of strata) to itself, and with probability 1 - delta every rule keeps its promise: at
most `risk` of a stratum's good documents are wrongly rejected. With no step certified the ladder
rejects nothing there.

A stratum with fewer good labels than could certify anything (`fewest_labels`: 149 for one stratum at
the default risk and error, 217 for four) is thin: nothing is certified there and the ladder rejects
nothing, as in a language without labels. With `pooled` all thin strata are tested together as one, named
POOL, and share its rule; the promise then holds for their good documents as a whole only. A language
without labels has no cutoffs in either case.

Defined cases: a null or empty text has no words, hence base_failed. A null language is the
stratum ''. Label rows with a null quality or doc_id are ignored; of several rows for a document the
best counts. Repeated documents are judged one by one, each counting in the holdout. Without labels only
the base rules reject. Other columns are ignored by the report and passed on by `keep_good`, whatever
their names; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, small_side

#: Signal -> (numerator, denominator, cutoffs from loose to strict); a document exceeds cutoff c if num > c * den.
SIGNALS = {
    "symbols": (lambda c: 100 * c("n_symbols"), lambda c: c("n_words"), (160, 80, 40, 20, 10, 5)),
    "dup_lines": (lambda c: 100 * c("n_dup_lines"), lambda c: c("n_lines"), (60, 50, 40, 30, 20, 10)),
    "long_words": (lambda c: 10 * c("word_chars"), lambda c: c("n_words"), (100, 90, 80, 75, 70, 65)),
}
#: The steps, each a cutoff per signal in order: all at their loosest, then one signal tighter at a time, in turn.
LADDER = [
    tuple(cutoffs[level + (k < turn)] for k, (_, _, cutoffs) in enumerate(SIGNALS.values()))
    for level in range(5)
    for turn in range(len(SIGNALS))
] + [tuple(cutoffs[5] for _, _, cutoffs in SIGNALS.values())]
RISK = 0.02
DELTA = 0.05
POOL = "*"
WINDOW = 8
MAX_STRATA = 10_000


def _covered(windows: Column) -> Column:
    """Number of words inside windows that occur twice or more; windows: the hash of each start."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # the one-element array binds the sorted pairs to a name, so that they are built once
    twins = F.transform(
        F.array(pairs),
        lambda p: F.filter(p, lambda x, j: (F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"])),
    )[0]
    starts = F.sort_array(F.transform(twins, lambda x: x["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + F.lit(WINDOW)).alias("end")
        ),
        lambda acc: acc["n"],
    )


def metrics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The metrics of each text beside the columns in keep.

    Eight-word windows are compared by 64-bit hashes within one text only, where two different
    windows agree by chance with a probability below n**2 / 2**65.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select(
        *keep,
        F.filter(F.split(text, f"{SPACES}+"), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    hashed = words.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    last = F.size("h") - WINDOW
    window = lambda i: F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(WINDOW)])
    windows = hashed.select(
        *[c for c in hashed.columns if c != "h"],
        F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), window)).alias("at"),
    )
    twice = F.size(F.array_distinct("at")) < F.size("at")
    return windows.select(
        *[c for c in windows.columns if c != "at"],
        F.when(F.col("at").isNotNull() & twice, _covered(F.col("at"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _exceeds(signal: str, cutoff: Column | int) -> Column:
    num, den, _ = SIGNALS[signal]
    return num(F.col) > cutoff * den(F.col)


def _fails(cutoffs) -> Column:
    """Whether a signal exceeds its cutoff; a null cutoff is never exceeded."""
    out = F.lit(False)
    for s, c in zip(SIGNALS, cutoffs):
        out = out | F.coalesce(_exceeds(s, c), F.lit(False))
    return out


def fewest_labels(strata: Column | int, risk: float = RISK, delta: float = DELTA) -> Column:
    """The number of good labels below which even a step that none of them fails is not certified."""
    level = F.lit(delta) / (strata if isinstance(strata, Column) else F.lit(strata))
    return F.ceil(F.log(level) / math.log(1 - risk))


def _tail(n: str, k: str, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly: each term follows from the one before, scaled by the latest."""
    step = f"((CAST({n} AS DOUBLE) - i + 1) / i * {p / (1 - p)!r}D)"
    return F.expr(
        f"aggregate(CASE WHEN {k} > 0 THEN sequence(1L, {k}) ELSE array() END,"
        f" named_struct('t', {n} * ln(1 - {p!r}D), 's', 1D),"
        f" (acc, i) -> named_struct('t', acc.t + ln({step}), 's', acc.s / {step} + 1),"
        f" acc -> exp(acc.t) * acc.s)"
    )


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, pooled: bool = False) -> DataFrame:
    """(stratum, one column per signal): the rule of each labelled stratum; null cutoffs where none is certified.

    pooled: thin strata take the rule of all of them together; without, they have none and are left out.
    measured: stratum, doc_id and the metrics.
    """
    best = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = measured.join(best.where("quality > 0").select("doc_id"), "doc_id").where(~base_failed())
    fails = F.array(*[F.count_if(_fails(step)) for step in LADDER])
    counts = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), fails.alias("k"))
    # one row per language from here on
    total = counts.agg(F.count(F.lit(1)).alias("strata"))
    sized = counts.crossJoin(F.broadcast(total)).withColumn("thin", F.col("n") < fewest_labels(F.col("strata"), risk, delta))  # a single row
    if not pooled:
        sized = sized.where("NOT thin")
    named = sized.withColumn("of", F.when(F.col("thin"), POOL).otherwise(F.concat(F.lit("="), "stratum")))
    groups = named.groupBy("of").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("k", F.lit(i))) for i in range(len(LADDER))]).alias("k"))
    many = groups.crossJoin(F.broadcast(groups.agg(F.count(F.lit(1)).alias("tested"))))  # a single row
    steps = many.select("of", "n", "tested", F.posexplode("k").alias("step", "fail"))
    failed = steps.where(~((F.col("fail") < risk * F.col("n")) & (_tail("n", "fail", risk) <= F.lit(delta) / F.col("tested"))))
    last = failed.groupBy("of").agg(F.min("step").alias("stop"))
    table = F.array(*[F.struct(*[F.lit(c).alias(f"cut_{s}") for s, c in zip(SIGNALS, step)]) for step in LADDER])
    rule = F.get(table, F.coalesce("stop", F.lit(len(LADDER))) - 1)
    ruled = named.select("stratum", "of").join(last, "of", "left").withColumn("rule", rule)
    return ruled.select("stratum", *[F.col(f"rule.cut_{s}").alias(f"cut_{s}") for s in SIGNALS])


def _ruled(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """rows (with stratum and the metrics) with the cutoffs of their stratum, null where it has none."""
    return rows.join(small_side(cutoffs, MAX_STRATA), "stratum", "left")


def _kept() -> Column:
    return ~base_failed() & ~_fails([F.col(f"cut_{s}") for s in SIGNALS])


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, pooled: bool = False) -> DataFrame:
    """One row per document: doc_id, metrics, base_failed, the cutoffs used and kept."""
    keep = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("stratum"))
    measured = materialise(metrics(keep, ("doc_id", "stratum")), "quality-metrics")
    cutoffs = materialise(certified_cutoffs(measured, labels, risk, delta, pooled), "quality-cutoffs")
    return _ruled(measured, cutoffs).select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), *[f"cut_{s}" for s in SIGNALS], _kept().alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, pooled: bool = False) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    The metrics are made twice, once for the cutoffs and once beside the rows: no text is shuffled, and no
    copy of the corpus stays in the shared folder.
    """
    stratum = F.coalesce("lang", F.lit("")).alias("stratum")
    measured = materialise(metrics(docs.select("doc_id", "text", stratum), ("doc_id", "stratum")), "quality-metrics")
    cutoffs = materialise(certified_cutoffs(measured, labels, risk, delta, pooled), "quality-cutoffs")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = metrics(docs.select(row, "text", stratum), ("row", "stratum"))
    # out of a generator of one row the metrics are not moved into the filter, where they would be made once more
    bound = rows.select("row", "stratum", F.inline(F.array(F.struct(*[c for c in rows.columns if c not in ("row", "stratum")]))))
    return _ruled(bound, cutoffs).where(_kept()).select("row.*")
