"""Further edges added to components that are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..scratch import settled


def joined(found: DataFrame, edges: DataFrame, used: list[str] | None = None) -> DataFrame:
    """Components (node, component) after further edges, of which only those between components matter."""
    at = found.select(F.col("node").alias("a"), F.col("component").alias("x"))
    to = found.select(F.col("node").alias("b"), F.col("component").alias("y"))
    moved = edges.join(at, "a", "left").join(to, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    merged = components(moved, used)
    old = found.join(
        merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left"
    ).select("node", F.coalesce("to", "component").alias("component"))
    return settled(old.unionByName(merged.join(found, "node", "left_anti").select("node", "component")), "components", used)
