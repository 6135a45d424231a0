"""Connected components by contraction, with every step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, settled

BY_NUMBER = 2


def components(edges: DataFrame, used: list[str] | None = None, by_sorting: bool = False) -> DataFrame:
    """node and component (the least node of it) for the nodes of edges (a, b).

    Written nodes that compress well, such as places in pictures, look small to Spark, which then sends them all through the
    driver; `by_sorting` asks for joins that don't.

    In each round every node joins the first of itself and its neighbours; edges move to what their ends
    joined and vanish inside one node. In the first rounds nodes are ordered by their numbers, which
    ends the stars that star-shaped comparison makes; then by a hash that is new in each round, by which a
    constant share of nodes is expected to go each time, chains included. A hub's neighbours meet in
    partial minima.
    """
    with Scratch(edges.sparkSession) as scratch:
        return settled(contracted(edges, scratch, by_sorting), "components", used)


def contracted(edges: DataFrame, scratch: Scratch, by_sorting: bool = False) -> DataFrame:
    side = lambda rows: rows.hint("merge") if by_sorting else rows
    left = scratch.settled(edges.select(*ordered(F.col("a"), F.col("b"))).where("a < b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        turn = F.lit(len(steps))
        order = lambda c: F.struct((F.xxhash64(c, turn) if len(steps) >= BY_NUMBER else F.lit(0).cast("long")).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = scratch.settled(
            ends.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least("m", order("a"))["v"].alias("to")),
            "step",
        )
        moved = left.join(side(step.withColumnRenamed("to", "x")), "a").select("b", "x").join(
            side(step.select(F.col("a").alias("b"), F.col("to").alias("y"))), "b"
        )
        left = scratch.settled(moved.where("x <> y").select(*ordered(F.col("x"), F.col("y"))).distinct(), "edges")
        steps.append(step)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    at = steps[0].select(F.col("a").alias("node"), "to")
    for step in steps[1:]:
        at = at.join(
            side(step.select(F.col("a").alias("to"), F.col("to").alias("then"))), "to", "left"
        ).select("node", F.coalesce("then", "to").alias("to"))
    least = at.groupBy("to").agg(F.min("node").alias("component"))
    return at.join(side(least), "to").select("node", "component")


def ordered(a: Column, b: Column) -> list[Column]:
    """The lesser as a, the greater as b."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
