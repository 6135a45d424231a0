"""Grids found in pictures by sums over areas, and regions of marked cells with their holes.

For grids a picture is one row, its pixels row after row. For regions it is a table of cells, so a picture may be
larger than any row: cells become runs along a line, runs that touch on neighbouring lines are edges, and labels are the components.
Written runs compress to a few bytes each, so joins between them are asked for by sorting: Spark would send them through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import Scratch, settled
from .graph import components

INNER = (0.3, 0.7)  # the part of a cell, along a side, that is looked at
STRETCH = 64  # places of a line within which runs are held against each other
FLAT = 4096  # pictures that are scored at once
NOISE = 1e-9  # places are looked at again whose contrasts differ by less than this share of all that was summed up


def summed_areas(pictures: np.ndarray) -> np.ndarray:
    """Sums of all pixels above and left of each corner, of pictures (n, height, width)."""
    sums = np.zeros((len(pictures), pictures.shape[1] + 1, pictures.shape[2] + 1))
    np.cumsum(np.cumsum(pictures, axis=1), axis=2, out=sums[:, 1:, 1:])
    return sums


def sides(start: float, size: float, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last edge of what is looked at of each cell along a side, in whole pixels."""
    at = start + np.arange(cells) * size
    first = np.floor(at + INNER[0] * size + 0.5).astype(int)
    return first, np.maximum(first + 1, np.floor(at + INNER[1] * size + 0.5).astype(int))


def contrast(sums: np.ndarray, y: float, x: float, size: float, cells: int = 8) -> np.ndarray | None:
    """How much lighter the cells of the first cell's colour are than the others, of each picture; None where the grid doesn't fit in."""
    if min(y, x) < 0 or y + cells * size > sums.shape[1] - 1 or x + cells * size > sums.shape[2] - 1:
        return None
    (top, bottom), (left, right) = sides(y, size, cells), sides(x, size, cells)
    if bottom[-1] >= sums.shape[1] or right[-1] >= sums.shape[2]:
        return None
    corner = lambda a, b: sums[:, a[:, None], b[None, :]]
    area = (bottom - top)[:, None] * (right - left)[None, :]
    means = (corner(bottom, right) - corner(top, right) - corner(bottom, left) + corner(top, left)) / area
    light = np.add.outer(np.arange(cells), np.arange(cells)) % 2 == 0
    return means[:, light].mean(1) - means[:, ~light].mean(1)


def own_contrast(pictures: np.ndarray, y: float, x: float, size: float, cells: int = 8) -> np.ndarray:
    """`contrast` from nothing but the pixels of the cells, added cell after cell: equal pixels give equal contrasts."""
    (top, bottom), (left, right) = sides(y, size, cells), sides(x, size, cells)
    edges = lambda first, last: np.stack([first, last], 1).ravel()[:-1]
    lines = np.add.reduceat(pictures[:, : bottom[-1]], edges(top, bottom), axis=1)[:, ::2]
    sums = np.add.reduceat(lines[:, :, : right[-1]], edges(left, right), axis=2)[:, :, ::2]
    means = sums / ((bottom - top)[:, None] * (right - left)[None, :])
    total = np.zeros(len(pictures))
    for r in range(cells):
        for c in range(cells):
            total += means[:, r, c] if (r + c) % 2 == 0 else -means[:, r, c]
    return total / (cells * cells / 2)


def grid_offsets(rows: DataFrame, key: str, pixels: str, width: str, places: list[tuple[float, float, float]]) -> DataFrame:
    """key, y, x, size and score of the grid of eight by eight cells with the most contrast among the places; of equal ones the first.

    Summed areas tell which places come close to the best; these are held against each other by their own pixels, as the
    rounding of large sums would choose among equal ones.
    Nulls where no place fits, and where pixels are null, hold a null or do not fill lines of the width.
    """
    kind = dict(rows.dtypes)[key]
    whole = F.col(width).cast("int")
    good = F.forall(pixels, lambda x: x.isNotNull()) & (whole > 0) & (F.size(pixels) > 0) & (F.size(pixels) % whole == 0)
    given = rows.select(key, F.when(good, F.col(pixels).cast("array<double>")).alias("__p"), whole.alias("__w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, FLAT):
                batch = whole_batch.slice(start, FLAT)
                n = batch.num_rows
                found, score = np.full((n, 3), np.nan), np.full(n, -np.inf)
                counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
                widths = pc.fill_null(batch.column(2), 0).to_numpy(zero_copy_only=False)
                for count, w in set(zip(counts[counts > 0].tolist(), widths[counts > 0].tolist(), strict=True)):
                    at = np.flatnonzero((counts == count) & (widths == w))
                    values = pc.list_flatten(batch.column(1).take(pa.array(at))).to_numpy(zero_copy_only=False)
                    pictures = values.reshape(len(at), count // w, w)
                    sums = summed_areas(pictures)
                    held = [(place, c) for place in places if (c := contrast(sums, *place)) is not None]
                    if not held:
                        continue
                    most = np.fmax.reduce([c for _, c in held])
                    least = most - NOISE * summed_areas(np.abs(pictures))[:, -1, -1]
                    for place, c in held:
                        near = np.flatnonzero(c >= least)
                        if len(near):
                            own = own_contrast(pictures[near], *place)
                            better = own > score[at[near]]
                            found[at[near[better]]], score[at[near[better]]] = place, own[better]
                none = ~np.isfinite(score)
                columns = [pa.array(c, pa.float64(), mask=none) for c in (*found.T, score)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "y", "x", "size", "score"])

    return given.mapInArrow(run, f"`{key}` {kind}, y double, x double, size double, score double")


def runs(cells: DataFrame, picture: str, mark: Column) -> DataFrame:
    """picture, y, x0, x1 of each run of marked cells along a line. Cells: picture, y, x."""
    line = W.partitionBy(picture, "y").orderBy("x")
    marked = cells.where(mark).select(picture, "y", "x").distinct()
    numbered = marked.withColumn("__run", F.col("x") - F.row_number().over(line))
    return numbered.groupBy(picture, "y", "__run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("__run")


def labelled(lines: DataFrame, picture: str, scratch: Scratch, corners: bool = False) -> DataFrame:
    """Runs with `root`, the first run of their region: runs on neighbouring lines meet where they share a place, with `corners` also aslant."""
    node = F.struct(picture, "y", "x0")
    lines = scratch.settled(lines.withColumn("node", node), "runs")
    reach = int(corners)
    stretch = lambda low, high: F.explode(F.sequence(F.floor(low / STRETCH), F.floor(high / STRETCH))).alias("at")
    upper = lines.select(picture, (F.col("y") + 1).alias("y"), "x0", "x1", F.col("node").alias("a"), stretch(F.col("x0") - reach, F.col("x1") + reach))
    lower = lines.select(picture, "y", F.col("x0").alias("l0"), F.col("x1").alias("l1"), F.col("node").alias("b"), stretch(F.col("x0"), F.col("x1")))
    meet = (F.col("x0") - reach <= F.col("l1")) & (F.col("l0") <= F.col("x1") + reach)
    edges = upper.join(lower.hint("merge"), [picture, "y", "at"]).where(meet).select("a", "b")
    found = components(edges, scratch.paths, by_sorting=True)
    return lines.join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component", "node")


def regions(cells: DataFrame, picture: str, mark: Column, corners: bool = False) -> DataFrame:
    """picture, region (y and x of its first cell), area and box of each connected region of marked cells."""
    with Scratch(cells.sparkSession) as scratch:
        named = labelled(runs(cells, picture, mark), picture, scratch, corners)
        sized = named.groupBy("root").agg(
            F.sum(F.col("x1") - F.col("x0") + 1).alias("area"),
            *(f(c).alias(n) for f, c, n in ((F.min, "y", "top"), (F.max, "y", "bottom"), (F.min, "x0", "left"), (F.max, "x1", "right"))),
        )
        return settled(sized.select(f"root.{picture}", F.col("root.y").alias("y"), F.col("root.x0").alias("x"), "area", "top", "bottom", "left", "right"), "regions")


def without_specks(cells: DataFrame, picture: str, mark: Column, least: int, sliver: int) -> DataFrame:
    """The marked cells (picture, y, x) of regions of so many cells at least; regions at the picture's edge must be broader than `sliver`, both ways."""
    with Scratch(cells.sparkSession) as scratch:
        size = scratch.settled(cells.groupBy(picture).agg(F.max("y").alias("h"), F.max("x").alias("w")), "sizes")
        named = scratch.settled(labelled(runs(cells, picture, mark), picture, scratch), "labelled")
        box = named.groupBy(picture, "root").agg(
            F.sum(F.col("x1") - F.col("x0") + 1).alias("area"),
            *(f(c).alias(n) for f, c, n in ((F.min, "y", "top"), (F.max, "y", "bottom"), (F.min, "x0", "left"), (F.max, "x1", "right"))),
        ).join(size.hint("merge"), picture)
        edge = (F.col("top") == 0) | (F.col("left") == 0) | (F.col("bottom") == F.col("h")) | (F.col("right") == F.col("w"))
        thin = F.least(F.col("bottom") - F.col("top"), F.col("right") - F.col("left")) + 1 <= sliver
        kept = box.where((F.col("area") >= least) & ~(edge & thin)).select("root")
        return settled(named.join(kept.hint("merge"), "root", "left_semi").select(picture, "y", F.explode(F.sequence("x0", "x1")).alias("x")), "cleaned")


def holes(cells: DataFrame, picture: str, mark: Column) -> DataFrame:
    """The cells (picture, y, x) that are not marked and that marked ones shut off from the picture's edge."""
    with Scratch(cells.sparkSession) as scratch:
        size = scratch.settled(cells.groupBy(picture).agg(F.max("y").alias("h"), F.max("x").alias("w")), "sizes")
        named = scratch.settled(labelled(runs(cells, picture, ~mark), picture, scratch), "labelled")
        edge = (F.col("y") == 0) | (F.col("x0") == 0) | (F.col("y") == F.col("h")) | (F.col("x1") == F.col("w"))
        shut = named.join(size.hint("merge"), picture).groupBy("root").agg(F.max(edge).alias("open")).where("not open").select("root")
        return settled(named.join(shut.hint("merge"), "root", "left_semi").select(picture, "y", F.explode(F.sequence("x0", "x1")).alias("x")), "holes")
