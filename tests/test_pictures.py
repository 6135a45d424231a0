"""Regions, holes and grids against plain loops; one picture has over 100,000 cells."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from quernstone.operators import pictures as P
from tests.duck import same


def flood(marked, corners=False):
    """Regions as sets of cells, one cell after another."""
    left, out = set(marked), []
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    while left:
        todo, own = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            own.add((y, x))
            for a, b in steps:
                if (y + a, x + b) in left:
                    left.remove((y + a, x + b))
                    todo.append((y + a, x + b))
        out.append(own)
    return out


def shown(own):
    ys, xs = [y for y, _ in own], [x for _, x in own]
    return (*min(own), len(own), min(ys), max(ys), min(xs), max(xs))


@pytest.mark.parametrize("height, width, share, corners", [(300, 360, 0.55, False), (60, 90, 0.4, True)])
def test_regions_and_holes_of_large_pictures(spark, height, width, share, corners):
    rng = random.Random(height)
    marked = {(y, x) for y in range(height) for x in range(width) if rng.random() < share}
    table = spark.range(height * width).select(F.lit("p").alias("pic"), F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    on = spark.createDataFrame(list(marked), "y long, x long").withColumn("on", F.lit(True))
    cells = table.join(on, ["y", "x"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    found = P.regions(cells, "pic", F.col("on"), corners)
    assert Counter(tuple(r)[1:] for r in found.collect()) == Counter(map(shown, flood(marked, corners)))
    if not corners:
        rest = {(y, x) for y in range(height) for x in range(width)} - marked
        shut = [own for own in flood(rest) if min(min(y, height - 1 - y, x, width - 1 - x) for y, x in own) > 0]
        assert {(r.y, r.x) for r in P.holes(cells, "pic", F.col("on")).collect()} == set().union(*shut)


def test_empty_pictures(spark):
    cells = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 0), ("b", 0, 0, None)], "pic string, y int, x int, v int")
    assert [tuple(r) for r in P.regions(cells, "pic", F.col("v") > 0).collect()] == [("a", 0, 0, 1, 0, 0, 0, 0)]
    assert P.regions(cells.where("false"), "pic", F.col("v") > 0).count() == 0
    assert P.holes(cells.where("false"), "pic", F.col("v") > 0).count() == 0
    assert P.without_specks(cells, "pic", F.col("v") > 0, 1, 0).count() == 1


def test_grids_are_found(spark):
    rng = np.random.default_rng(4)
    rows, truth = [], {}
    for n in range(30):
        y, x, size = rng.integers(0, 8), rng.integers(0, 8), rng.choice([5.0, 5.5])
        picture = rng.normal(0, 8, (60, 64))
        for r in range(8):
            for c in range(8):
                if (r + c) % 2 == 0:
                    picture[int(y + r * size) : int(y + (r + 1) * size), int(x + c * size) : int(x + (c + 1) * size)] += 100
        rows.append((n, picture.ravel().tolist(), 64))
        truth[n] = (y, x, size)
    rows += [(98, [1.0, 2.0, 3.0], 2), (99, None, 3), (100, [], 3), (101, [1.0, None], 2), (102, [0.0] * 9, 3)]
    places = [(float(y), float(x), s) for s in (5.0, 5.5) for y in range(12) for x in range(12)]
    table = spark.createDataFrame(rows, "n int, p array<double>, w int")
    found = {r.n: (r.y, r.x, r.size) for r in P.grid_offsets(table, "n", "p", "w", places).collect()}
    assert all(found[n] == (None, None, None) for n in range(98, 103))
    assert sum(max(abs(a - b) for a, b in zip(found[n], truth[n], strict=True)) <= 2 for n in truth) == 30  # the middles of cells stay on their cells


def test_equal_places_are_told_apart_by_their_order(spark):
    """The same noise under every place, so that only the order of the places is left to choose by."""
    rng = np.random.default_rng(7)
    board = np.kron(np.add.outer(np.arange(9), np.arange(9)) % 2, np.ones((3, 3)))
    rows = []
    for n in range(300):
        tile = rng.normal(0, 3, (3, 3))
        rows.append((n, (np.tile(tile, (9, 9)) + 100.0 * (board == 0)).ravel().tolist(), 27))
    places = [(float(y), float(x), 3.0) for y, x in ((0, 0), (1, 1), (3, 3))]
    frame = spark.createDataFrame(rows, "n int, p array<double>, w int")
    assert {(r.y, r.x) for r in P.grid_offsets(frame, "n", "p", "w", [places[0], places[2]]).collect()} == {(0.0, 0.0)}
    assert {(r.y, r.x) for r in P.grid_offsets(frame, "n", "p", "w", [places[2], places[0]]).collect()} == {(3.0, 3.0)}


def test_vectors_that_lack_numbers(spark, tmp_path):
    from quernstone.plans import pictures as Q

    rng = np.random.default_rng(3)
    vectors = [rng.normal(0, 0.1, 64).tolist() for _ in range(40)]
    vectors[3][5] = vectors[4][60] = None
    vectors[7], vectors[8], vectors[9] = None, vectors[9][:40], [None] * 64
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").coalesce(1)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    same(Q.grid_offsets(spark, str(tmp_path)), con, Q.SQL["grid_offsets"])


def test_areas_are_those_of_slices():
    picture = np.random.default_rng(1).random((1, 30, 34))
    sums = P.summed_areas(picture)
    got = P.contrast(sums, 2, 3, 3.4)[0]
    total = {0: [], 1: []}
    for r in range(8):
        for c in range(8):
            (t, b), (le, ri) = ([e[i] for e in P.sides(s, 3.4, 8)] for s, i in ((2, r), (3, c)))
            total[(r + c) % 2].append(picture[0, t:b, le:ri].mean())
    assert abs(got - (np.mean(total[0]) - np.mean(total[1]))) < 1e-9
    assert P.contrast(sums, 7, 3, 3.0) is None and P.contrast(sums, -1, 0, 2.0) is None


def test_places_are_not_sent_to_the_driver(spark):
    from quernstone.operators.graph import contracted
    from quernstone.scratch import Scratch

    edges = spark.range(200).select(F.struct(F.lit(1).alias("p"), F.col("id").alias("x")).alias("a"), F.struct(F.lit(1).alias("p"), (F.col("id") + 1).alias("x")).alias("b"))
    with Scratch(spark) as scratch:
        found = contracted(edges, scratch, by_sorting=True)
        assert found.select("component").distinct().count() == 1
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
