"""Vectors held against class means, templates and a stated set of queries; exact quantiles; trees walked by joins.

Means and templates are few (one for each class and colour): up to MOST_CLASSES of them travel as one array with
each row, in which the nearest is found in place. More of them, and nearest rows of a query set of any size, are
compared block by block, each block of queries with each block of rows in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import Scratch, settled
from .ranking import numbered, same_keys

MOST_CLASSES = 2_000
BLOCK = 4096  # vectors of a block


def distance(a: Column, b: Column) -> Column:
    """Squared distance of two vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def class_means(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """The mean vector of each class, summed by component: parts meet before the shuffle."""
    places = rows.select(group, F.posexplode(vector).alias("at", "x"))
    parts = places.groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"])
    return parts.groupBy(group).agg(in_order.alias("mean"), F.max("n").alias("size"))


def nearest_class(rows: DataFrame, means: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """The nearest class, and by how much nearer than the second: (d2 - d1) / d2."""
    few = means.select(group, "mean").limit(MOST_CLASSES + 1).count() <= MOST_CLASSES
    if few:
        every = means.agg(F.collect_list(F.struct(F.col(group).alias("c"), "mean")).alias("__means"))
        held = rows.select(key, vector).crossJoin(F.broadcast(every))
        far = F.transform("__means", lambda m: F.struct(distance(F.col(vector), m["mean"]).alias("d"), m["c"].alias("c")))
        best = held.select(key, F.slice(F.array_sort(far), 1, 2).alias("two"))
    else:
        near = nearest_rows(
            rows.select(key, vector),
            means.select(F.col(group).alias("__c"), F.col("mean").alias(vector)),
            key,
            vector,
            2,
            row_key="__c",
        )
        best = near.groupBy(F.col("q_key").alias(key)).agg(
            F.array_sort(F.collect_list(F.struct("d", F.col("__c").alias("c")))).alias("two")
        )
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    margin = (second["d"] - first["d"]) / F.greatest(second["d"], F.lit(1e-9))
    return best.select(key, first["c"].alias("nearest"), F.round(margin, 6).alias("margin"))


def templates(rows: DataFrame, group: str, shade: str, vector: str, share: float = 0.9) -> DataFrame:
    """The mean vector of each class and colour, of the members whose distance from the class mean is within the share's rank.

    The rank is the nearest one (a member's own distance, not a point between two), found by Spark's mergeable sketch.
    """
    means = class_means(rows, group, vector).select(group, "mean")
    far = rows.join(means, group).withColumn("__d", distance(F.col(vector), F.col("mean"))).drop("mean")
    most = far.groupBy(group).agg(F.percentile_approx("__d", share, 100_000).alias("__most"))
    kept = far.join(most, group).where(F.col("__d") <= F.col("__most"))
    both = F.struct(F.col(group).alias("c"), F.col(shade).alias("s"))
    return class_means(kept.withColumn("__both", both), "__both", vector).select(
        F.col("__both.c").alias(group), F.col("__both.s").alias(shade), "mean", "size"
    )


def shifted(vector: Column, by: int) -> Column:
    """The vector moved on by so many places; what comes in at an end repeats the end."""
    n = F.size(vector)
    return F.transform(vector, lambda x, i: F.get(vector, F.greatest(F.lit(0), F.least(n - 1, i - by))))


def match_templates(rows: DataFrame, found: DataFrame, key: str, vector: str, group: str, shade: str, most_shift: int = 4) -> DataFrame:
    """The nearest template of the row's colour, each held to the row in all its shifts, with its distance and the margin to the next.

    Templates are written once. Up to MOST_CLASSES of them travel as one row for each colour, which meets the rows where they
    lie; more of them, each in all its shifts, are compared block by block.
    """
    moves = range(-most_shift, most_shift + 1)
    found = settled(found.select(shade, group, "mean"), "templates")
    if found.count() > MOST_CLASSES:
        every = found.select(shade, F.col(group).alias("__c"), F.posexplode(F.array(*(shifted(F.col("mean"), m) for m in moves))).alias("__m", vector))
        placed = settled(numbered(every, [], [shade, "__c", "__m"], "__t"), "shifts").select("__t", "__c", shade, vector)
        asked = rows.select(key, shade, vector).withColumn("__c", F.lit(None).cast(dict(placed.dtypes)["__c"]))
        near = nearest_rows(asked, placed, key, vector, len(moves) + 1, alike=(shade,), carry=("__c",), row_key="__t")
        each = near.groupBy(F.col("q_key").alias(key), "__c").agg(F.min("d").alias("d"))
        best = each.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", F.col("__c").alias("c")))), 1, 2).alias("two"))
    else:
        in_all = found.select(
            shade,
            F.struct(F.col(group).alias("c"), F.array(*(shifted(F.col("mean"), m) for m in moves)).alias("shifts")).alias("t")
        )
        banks = in_all.groupBy(shade).agg(F.collect_list("t").alias("bank"))
        near = lambda t: F.array_min(F.transform(t["shifts"], lambda m: distance(F.col(vector), m)))
        far = F.transform("bank", lambda t: F.struct(near(t).alias("d"), t["c"].alias("c")))
        best = rows.select(key, shade, vector).join(F.broadcast(banks), shade).select(key, F.slice(F.array_sort(far), 1, 2).alias("two"))
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    margin = (second["d"] - first["d"]) / F.greatest(second["d"], F.lit(1e-9))
    return best.select(key, first["c"].alias("nearest"), first["d"].alias("d"), margin.alias("margin"))


def nearest_rows(
    queries: DataFrame, rows: DataFrame, key: str, vector: str, most: int, apart: tuple[str, ...] = (), alike: tuple[str, ...] = (), carry: tuple[str, ...] = (), row_key: str = ""
) -> DataFrame:
    """The `most` nearest rows of each query, exactly, with n (1: nearest) and d.

    Columns of `apart` must differ between query and row, those of `alike` must be equal. Queries and rows are dealt
    into blocks, each pair of which meets in one task and keeps its best; only those are compared further.
    """
    row_key = row_key or key
    more = list(dict.fromkeys([*apart, *alike, *carry]))
    more = [c for c in more if c not in (key, row_key)]
    whole = {n: int(f.count()) for n, f in (("q", queries), ("r", rows))}
    parts = {n: max(1, -(-count // BLOCK)) for n, count in whole.items()}
    kinds = dict(rows.dtypes)
    ids = {"q": dict(queries.dtypes)[key], "r": kinds[row_key]}

    def dealt(frame: DataFrame, own: str, other: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64(name), F.lit(parts[own])).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.lit(parts[other] - 1))).alias(other)
        return frame.select(
            F.lit(own).alias("side"),
            *(F.when(F.lit(own == side), F.col(name)).cast(kind).alias(f"{side}_id") for side, kind in ids.items()),
            F.transform(vector, lambda x: x.cast("double")).alias("v"),
            *more,
            block,
            copies,
        )

    met = dealt(queries, "q", "r", key).unionByName(dealt(rows, "r", "q", row_key))
    fields = [f"q_{c}" for c in more] + more
    schema = f"q_key {dict(queries.dtypes)[key]}, {row_key} {kinds[row_key]}, " + "".join(
        f"{f} {kinds[f.removeprefix('q_')]}, " for f in fields
    ) + "d double"

    def compare(table: pa.Table) -> pa.Table:
        sides = [table.filter(pa.compute.equal(table["side"], s)) for s in ("q", "r")]
        (q_ids, r_ids), (q, r) = ([t[i].to_numpy() for t, i in zip(sides, ("q_id", "r_id"), strict=True)], [np.array(t["v"].to_pylist(), np.float64) for t in sides])
        values = [{c: t[c].to_numpy() for c in more} | {key: own, row_key: own} for t, own in zip(sides, (q_ids, r_ids), strict=True)]
        took: list[np.ndarray] = []
        of: list[np.ndarray] = []
        far: list[np.ndarray] = []
        for i in range(len(q_ids)):
            ok = np.ones(len(r_ids), bool)
            for c in apart:
                ok &= values[1][c] != values[0][c][i]
            for c in alike:
                ok &= values[1][c] == values[0][c][i]
            at = np.flatnonzero(ok)
            d = ((r[at] - q[i]) ** 2).sum(1) if len(at) else np.empty(0)
            best = np.lexsort((r_ids[at], d))[:most]
            took.append(at[best])
            of.append(np.full(len(best), i))
            far.append(d[best])
        took_all, of_all, far_all = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (took, of, far))
        take = lambda t, name, at: t[name].take(pa.array(at, pa.int64()))
        columns = [take(sides[0], "q_id", of_all), take(sides[1], "r_id", took_all)]
        columns += [take(sides[0], c, of_all) for c in more] + [take(sides[1], c, took_all) for c in more]
        return pa.table([*columns, pa.array(far_all, pa.float64())], names=["q_key", row_key, *fields, "d"])

    by_block = met.groupBy("q", "r").applyInArrow(compare, schema)
    ranked = by_block.withColumn("n", F.row_number().over(W.partitionBy("q_key").orderBy("d", row_key)))  # `most` rows for each block of rows
    return ranked.where(F.col("n") <= most)


def exact_quantiles(rows: DataFrame, value: str, shares: dict[str, float], groups: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles of a column, in each group, between two neighbours where the place is no whole number. Nulls don't count.

    Equal values are counted first. The different ones are written in order in many parts; counts of the parts tell in which one,
    and running sums there where, a rank is. So no task holds more than a part, however large a group is and however
    often a value comes.
    """
    spark = rows.sparkSession
    keys = list(groups)
    with Scratch(spark) as scratch:
        parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        given = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
        counted = given.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
        dealt = scratch.settled(counted.repartitionByRange(parts, *keys, "__v").withColumn("__part", F.spark_partition_id()), "ordered")
        sizes = dealt.groupBy(*keys, "__part").agg(F.sum("__c").alias("size"))
        by = W.partitionBy(*keys).orderBy("__part")  # a row for each part
        sizes = sizes.withColumn("before", F.sum("size").over(by) - F.col("size"))
        sizes = scratch.settled(sizes.withColumn("n", F.sum("size").over(W.partitionBy(*keys))), "sizes")
        place = lambda p: p * (F.col("n") - 1)
        held = [f(place(p)) for p in shares.values() for f in (F.floor, F.ceil)]
        inside = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("size"))
        wanted = sizes.where(sum((inside(r).cast("int") for r in held), F.lit(0)) > 0)
        found = dealt.alias("d").join(wanted.alias("w"), same_keys("d", "w", [*keys, "__part"])).select(
            *(F.col(f"d.{k}").alias(k) for k in [*keys, "__part"]), "__v", "__c", "before", "n"
        )
        upto = F.sum("__c").over(W.partitionBy(*keys, "__part").orderBy("__v"))
        ranked = found.withColumn("upto", F.col("before") + upto).withColumn("first", F.col("upto") - F.col("__c"))
        out = []
        for name, p in shares.items():
            at = lambda f: (f(place(p)) >= F.col("first")) & (f(place(p)) < F.col("upto"))  # noqa: B023, E731
            low, high = (F.max(F.when(at(f), F.col("__v"))) for f in (F.floor, F.ceil))
            out.append((low + (high - low) * F.max(place(p) - F.floor(place(p)))).alias(name))
        return settled(ranked.groupBy(*keys).agg(*out, F.max("n").alias("n")), "quantiles")


def vote(neighbours: DataFrame, label: str, majority: int) -> DataFrame:
    """Queries whose neighbours agree on another label than their own."""
    counts = neighbours.groupBy("q_key", f"q_{label}", label).agg(F.count("*").alias("votes"))
    top = counts.groupBy("q_key", f"q_{label}").agg(F.max(F.struct("votes", (-F.col(label)).alias("o"))).alias("x"))
    other = (F.col("x.votes") >= majority) & (-F.col("x.o") != F.col(f"q_{label}"))
    return top.where(other).select("q_key", F.col(f"q_{label}").alias("was"), (-F.col("x.o")).alias("becomes"), "x.votes")


def path_to_root(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Each node with its root and depth, by pointer doubling until no node moves; each round is written to the shared folder.

    A root has no parent. Nodes on or under a cycle, or under a parent that is no node, have a null root and depth.
    """
    with Scratch(nodes.sparkSession) as scratch:
        way = F.when(F.col(parent).isNull(), 0).otherwise(1)
        at = scratch.settled(
            nodes.select(
                F.col(node).alias("node"),
                F.coalesce(parent, node).alias("up"),
                way.alias("depth"),
                F.col(parent).isNotNull().alias("open"),
            ),
            "ways",
        )
        most, steps = at.count(), 1
        while steps < most and not at.where("open").isEmpty():  # a way of as many steps as there are nodes runs in a cycle
            up = at.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("open").alias("open2"))
            moved = at.where("open").join(up, "up", "left").select(
                "node",
                F.col("up2").alias("up"),
                (F.col("depth") + F.col("more")).alias("depth"),
                F.coalesce("open2", F.lit(False)).alias("open"),
            )
            at, steps = scratch.settled(at.where("not open").unionByName(moved), "ways"), 2 * steps
        known = ~F.col("open")
        return settled(
            at.select(F.col("node").alias(node), F.when(known, F.col("up")).alias("root"), F.when(known, F.col("depth")).alias("depth")),
            "roots",
        )


def first_children(nodes: DataFrame, node: str, parent: str, main: Column) -> DataFrame:
    """The child that goes on with the main line, for each node that has one: the least marked child."""
    return nodes.where(main & F.col(parent).isNotNull()).groupBy(parent).agg(F.min(node).alias("next"))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def with_all(numbers: Column, one: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of each number and one value, which is worked out once for the row."""
    return F.zip_with(numbers, F.array_repeat(one, F.size(numbers)), f)


def z_scores(vector: Column, least: float = 1e-6) -> Column:
    """The vector with mean 0 and deviation 1."""
    numbers, n = F.transform(vector, lambda x: x.cast("double")), F.size(vector)
    apart = with_all(numbers, total(numbers) / n, lambda x, mean: x - mean)
    return with_all(apart, F.sqrt(total(F.transform(apart, lambda x: x * x)) / n), lambda x, spread: x / (spread + least))


def stretched(cells: Column, background: Column, share: float = 0.02, least: float = 30.0) -> Column:
    """Cells between their dark end (a low quantile) and the background, as numbers from 0 to 1."""
    numbers = F.transform(cells, lambda x: x.cast("double"))
    at = share * (F.size(cells) - 1)
    low, high = (F.get(F.array_sort(numbers), f(at).cast("int")) for f in (F.floor, F.ceil))
    dark = low + (high - low) * (at - F.floor(at))
    above = with_all(numbers, dark, lambda x, d: (x - d) / F.greatest(background - d, F.lit(least)))
    return F.transform(above, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def centre_of_mass(ink: Column, width: int) -> tuple[Column, Column]:
    """Row and column of the centre of mass of a picture, row after row."""
    weigh = lambda place: total(F.transform(ink, lambda x, i: x * place(i))) / total(ink)
    return weigh(lambda i: F.floor(i / width)), weigh(lambda i: i % width)


def centred(ink: Column, width: int) -> Column:
    """The picture moved so that its centre of mass is its middle, drawn anew between its cells; nothing comes in from outside."""

    def drawn(held: Column) -> Column:
        height = F.size(ink) / width
        cell = lambda y, x: F.when((y >= 0) & (y < height) & (x >= 0) & (x < width), F.get(ink, (y * width + x).cast("int"))).otherwise(0.0)

        def at(i: Column) -> Column:
            y = F.floor(i / width) + held["y"] - (height - 1) / 2
            x = i % width + held["x"] - (width - 1) / 2
            top, left = F.floor(y), F.floor(x)
            down, right = y - top, x - left
            upper = cell(top, left) * (1 - right) + cell(top, left + 1) * right
            return upper * (1 - down) + (cell(top + 1, left) * (1 - right) + cell(top + 1, left + 1) * right) * down

        return F.transform(F.sequence(F.lit(0), F.size(ink) - 1), at)

    y, x = centre_of_mass(ink, width)
    return F.get(F.transform(F.array(F.struct(y.alias("y"), x.alias("x"))), drawn), F.lit(0))


def board_quality(matched: DataFrame, board: str) -> DataFrame:
    """The worst and the summed distance of each board's cells from their templates, and its least margin."""
    worst, summed = F.round(F.max("d"), 5).alias("worst"), F.round(F.sum("d"), 4).alias("total")
    return matched.groupBy(board).agg(worst, summed, F.round(F.min("margin"), 3).alias("least_margin"))


def telling_places(means: DataFrame, group: str, one: object, other: object, most: int) -> DataFrame:
    """The places at which one mean exceeds the other most, of equals the first."""
    both = means.agg(*(F.max(F.when(F.col(group) == g, F.col("mean"))).alias(n) for g, n in ((one, "a"), (other, "b"))))
    far = F.transform(F.zip_with("a", "b", lambda x, y: x - y), lambda d, i: F.struct((-d).alias("o"), i.alias("at")))
    return both.select(F.transform(F.slice(F.array_sort(far), 1, most), lambda x: x["at"]).alias("places"))


def dense_there(rows: DataFrame, places: DataFrame, vector: str, threshold: float) -> DataFrame:
    """Rows with `density`, their mean at the places, and whether it is over the threshold."""
    there = F.transform("places", lambda i: F.get(vector, i).cast("double"))
    held = rows.crossJoin(F.broadcast(places)).withColumn("density", total(there) / F.size("places"))
    return held.withColumn("dense", F.col("density") > threshold).drop("places")


def frames_of_ten(shapes: DataFrame, page: str, order: list[str]) -> DataFrame:
    """Boards drawn as ten shapes in a row: thin, eight tall ones, thin, all between the same edges and downwards. Rows: page, x0, x1, y0, y1.

    A thin shape that ends one board doesn't begin another.
    """
    by = W.partitionBy(page).orderBy(*order)
    ahead = by.rowsBetween(0, 9)
    inner = by.rowsBetween(1, 8)
    height = F.col("y1") - F.col("y0")
    rows = shapes.withColumn("at", F.row_number().over(by)).withColumn("h", height).withColumn(
        "down", F.coalesce(F.col("y0") > F.lag("y0").over(by), F.lit(False))
    )
    near = lambda x: (F.max(x).over(ahead) - F.col(x) < 1.5) & (F.col(x) - F.min(x).over(ahead) < 1.5)
    tall = (F.min("h").over(inner) > 8) & (F.max("h").over(inner) < 25) & (F.count("*").over(ahead) == 10)
    thin = (F.col("h") < 2) & (F.lead("h", 9).over(by) < 2)
    falls = F.min(F.col("down").cast("int")).over(by.rowsBetween(1, 9)) == 1
    rows = rows.withColumn("starts", tall & thin & near("x0") & near("x1") & falls).withColumn("bottom", F.lead("y1", 9).over(by))
    starts = rows.where("starts")
    chained = F.coalesce(F.col("at") - F.lag("at").over(W.partitionBy(page).orderBy("at")) == 9, F.lit(False))
    chain = W.partitionBy(page).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = starts.withColumn("chained", chained).withColumn("chain", F.sum((~F.col("chained")).cast("int")).over(chain))
    turn = F.row_number().over(W.partitionBy(page, "chain").orderBy("at"))
    return numbered.withColumn("turn", turn).where("turn % 2 = 1").select(page, "x0", F.col("y0").alias("top"), "x1", "bottom")
