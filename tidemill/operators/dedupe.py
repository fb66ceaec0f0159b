"""Deduplication by key: one row per key, chosen by preference, ties to the earlier row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.text import posting_key


def keep_best(df: DataFrame, keys: Sequence[Column | str], prefer: Sequence[Column], seq: Sequence[str] | None = None) -> DataFrame:
    """The row of each key that is largest by prefer, and among equals the earliest by seq.

    seq: numeric columns that order the rows, `order_of(df)` if not given. `first_seen` is the place of
    the key's first row and gives the output order, whichever row survives: the value of seq, or a struct
    of its values if there are several. An incoming first_seen is replaced. A window per key would put a
    hot key into one task; the aggregate combines before the shuffle instead, so a key may hold any share
    of the rows.
    """
    seq = order_of(df) if seq is None else seq
    fields = [F.col(c) for c in df.columns if c != "first_seen"]
    # texts are grouped by their digests, so that a key is never a second copy of a long text
    ks = [F.sha2(k, 256) if isinstance(df.select(k).schema[0].dataType, StringType) else k for k in (F.col(k) if isinstance(k, str) else k for k in keys)]
    order = [*prefer, *[-F.col(s) for s in seq]]
    best = F.max_by(F.struct(*fields), F.struct(*[p.alias(f"p{i}") for i, p in enumerate(order)]))
    place = [F.col(s).alias(s.rpartition(".")[2]) for s in seq]
    grouped = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(ks)]).agg(best.alias("__row"), F.min(F.struct(*place)).alias("__first"))
    first = F.col(f"__first.{seq[0].rpartition('.')[2]}") if len(seq) == 1 else F.col("__first")
    return grouped.select("__row.*", first.alias("first_seen"))


def order_of(df: DataFrame) -> tuple[str, ...]:
    """The columns that order df: first_seen, or its fields, where an earlier step left it; else file_ord, if there, and seq."""
    if "first_seen" in df.columns:
        kind = df.schema["first_seen"].dataType
        return tuple(f"first_seen.{f.name}" for f in kind) if isinstance(kind, StructType) else ("first_seen",)
    return ("file_ord", "seq") if "file_ord" in df.columns else ("seq",)


def keep_first(df: DataFrame, keys: Sequence[Column | str], seq: Sequence[str] | None = None) -> DataFrame:
    return keep_best(df, keys, [], seq)


def fetch_key() -> Column:
    """The address, or company, position and location where there is none."""
    return F.when(F.col("url") != "", F.col("url")).otherwise(F.concat_ws("|", "company", "position", "location"))


def merge_key() -> Column:
    return F.when(F.col("url") != "", F.col("url")).otherwise(posting_key("company", "position"))


def merge_sources(df: DataFrame, seq: Sequence[str] | None = None) -> DataFrame:
    """Across sources: a description before none, easy application, then the longer description."""
    n = F.length("description")
    return keep_best(df, [merge_key()], [(n > 0).cast("int"), F.col("easy_apply").cast("int"), n], seq)


def best_scored(df: DataFrame, seq: Sequence[str] | None = None) -> DataFrame:
    """Among scored rows of one company and position: score, longer description, easy application."""
    prefer = [F.col("matching_score"), F.length("description"), F.col("easy_apply").cast("int")]
    return keep_best(df, [posting_key("company", "position")], prefer, seq)


def last_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key, for lookup tables."""
    row = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.col(seq)).alias("__row")
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(row).select("__row.*")


def union_all(*sources: DataFrame) -> DataFrame:
    """All rows in order of source, then of each source's own seq, as a new seq pair (file_ord, seq)."""
    tagged = [s.withColumn("file_ord", F.lit(k)) for k, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def limit_per(df: DataFrame, key: str, n: int, seq: str = "seq") -> DataFrame:
    """The first n rows of each key."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(seq)))
    return ranked.where(F.col("__n") <= n).drop("__n")


def or_else(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """df, or fallback if df has no row; decided inside the plan, without an action."""
    some = df.limit(1).agg((F.count(F.lit(1)) > 0).alias("__some"))
    backup = fallback.crossJoin(F.broadcast(some)).where("NOT __some").drop("__some")  # a single row
    return df.unionByName(backup)
