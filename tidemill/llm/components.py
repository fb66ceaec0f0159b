"""Connected components of an edge table by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, read_scratch, write_scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the same within a component.

    Each round hooks every node to its least neighbour, follows that pointer once more, renames the
    edges by it and drops those that became loops. What is left halves at least in nodes, so there
    are logarithmically many rounds; a node with very many edges loses them in the first. Tables of a
    finished round are deleted.

    Defined cases: loops and repeated edges count for nothing, so a node with loops only is left out; edges
    with a null end are ignored; other columns are ignored; no edges give an empty table.
    """
    spark = edges.sparkSession
    named = edges.select("a", "b")
    left_at = write_scratch(named.where("a <> b").distinct(), "edges")
    left, names_at, names = read_scratch(left_at, named), None, None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        first_at = write_scratch(hook, "hooks")
        hook = read_scratch(first_at, hook)
        jump = hook.select(F.col("node").alias("to"), F.col("to").alias("root"))
        hook = hook.join(jump, "to").select("node", "root")
        hook_at = write_scratch(hook, "hooks")
        hook = read_scratch(hook_at, hook)
        renamed = (
            left.join(hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(hook.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        )
        next_at = write_scratch(renamed.distinct(), "edges")
        if names is None:
            names, names_at = hook, hook_at
            discard(spark, first_at, left_at)
        else:
            later = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            names = names.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            before, names_at = names_at, write_scratch(names, "names")
            names = read_scratch(names_at, names)
            discard(spark, before, first_at, hook_at, left_at)
        left, left_at = read_scratch(next_at, named), next_at
    if names is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names
