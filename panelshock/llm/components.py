"""Connected components of a table of links by alternating large and small stars.

Each round is two aggregations and joins by node, written to the shared folder; no node's
neighbours are ever gathered in one place, and a hub is a skewed join key that the adaptive
planner splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshock.llm.workspace import Workspace


def connected(links: DataFrame, work: Workspace, label: str) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the smallest node that
    links reach. NULL ends and loops are no links; repeated links count once. An empty table
    gives an empty one."""
    a, b = F.col("a"), F.col("b")
    pairs = links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges = work.table(pairs, f"{label}-0")
    state, turn = _state(edges), 0
    while state[0]:
        turn += 1
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("root"))
        large = (
            both.join(least, "hi")
            .where(F.col("lo") > F.col("hi"))
            .select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
            .where("hi != lo")
            .distinct()
        )
        large = work.table(large, f"{label}-{turn}-large")
        roots = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = (
            roots.select("hi", F.col("root").alias("lo"))
            .unionByName(
                large.join(roots, "hi").where(F.col("lo") != F.col("root")).select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
            )
            .distinct()
        )
        work.drop(f"{label}-{turn - 1}")
        edges = work.table(small, f"{label}-{turn}")
        work.drop(f"{label}-{turn}-large")
        now = _state(edges)
        if now == state:
            break
        state = now
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    digest = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(digest), F.sum(digest % 1_000_003)).first())
