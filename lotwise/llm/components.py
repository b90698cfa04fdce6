"""Connected components of a graph given as edges, by alternating large-star and small-star steps (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import Scratch

#: A table of at most so many rows has no key so frequent that its rows must not meet in one task.
FREQUENT = 1_000


def with_totals(rows: DataFrame, key: str, n_rows: int, where: str | None = None, into: tuple[Scratch, str] | None = None, **totals: Column) -> DataFrame:
    """rows with aggregates of their key's group, of groups for which `where` holds; a frequent key's rows are not gathered in one task.

    The totals are written (into a named table, or else a folder of their own), so that rows and totals meet in a plain join
    of two shuffles, whose large partitions Spark splits. Nothing is broadcast but what Spark itself finds small.
    """
    found = rows.groupBy(key).agg(*(c.alias(name) for name, c in totals.items()))
    found = found if where is None else found.where(where)
    if n_rows > FREQUENT:
        scratch, name = into or (Scratch(rows.sparkSession, "totals"), "totals")
        found = scratch.save(found, name)
    return rows.join(found, key)


def components(edges: DataFrame, scratch: Scratch, label: str, most_rounds: int = 50) -> DataFrame:
    """(node, root) of every node that edges (a, b: long) name; root is the smallest node of its component.

    Each step links a node's neighbours to the smallest of them, so the number of edges never grows, and ends when no
    edge changes. Tables are written after each round; no node's neighbours are ever gathered in one place.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    mark = _mark(now)
    for k in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = with_totals(both, "a", 2 * mark[0], into=(scratch, f"{label}-least-{k}"), m=F.min("b")).select("a", "b", F.least("a", "m").alias("m"))
        large = scratch.save(least.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{label}-large-{k}")
        down = with_totals(large, "a", mark[0], into=(scratch, f"{label}-down-{k}"), m=F.min("b"))
        small = down.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        after = scratch.save(small, f"{label}-{k}")
        seen = _mark(after)
        scratch.drop(f"{label}-{k - 1}", *(f"{label}-{name}-{k}" for name in ("large", "least", "down")))
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
