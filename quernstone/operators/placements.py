"""Placements held against known ones, labels of their cells mended by what they cost, and men won along a line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.board import COSTS, WORTH
from ..scratch import Scratch, settled
from ..streaming.activity import written

STRIPS = 4
CROWD = 200  # known placements that one key may have before it is made longer
FEW = 8  # unusual men up to which placements meet by what is left without some of them
LEVELS = 3  # times a key is made longer: 16, 28, 37 cells
SIDES = {"K": "k", "Q": "q", "R": "r", "B": "b", "N": "n", "P": "p"}


def strips(men: Column) -> Column:
    """Every fourth cell, from the first, the second and so on: each with the cells that are left."""
    place = lambda x, i: i % STRIPS
    return F.transform(
        F.sequence(F.lit(0), F.lit(STRIPS - 1)),
        lambda m: F.struct(
            m.cast("string").alias("strip"),
            F.array_join(F.filter(men, lambda x, i: place(x, i) == m), "").alias("own"),
            F.array_join(F.filter(men, lambda x, i: place(x, i) != m), "").alias("rest"),
        ),
    )


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (id, path, own, rest) with each strip of the rest put to their keys."""
    apart = rows.select("id", F.col("path").alias("p"), F.col("own").alias("o"), F.split("rest", "").alias("men"))
    more = apart.select("id", "p", "o", F.inline(strips(F.col("men"))))
    return more.select("id", F.concat("p", "strip").alias("path"), F.concat("o", F.lit("/"), "own").alias("own"), "rest")


def usual_men(placements: DataFrame) -> list[str]:
    """The commonest man of each of the 64 cells of rows (rest)."""
    men = placements.select(F.posexplode(F.split("rest", "")).alias("at", "man")).groupBy("at", "man").count()
    return [r.man for r in men.groupBy("at").agg(F.max_by("man", F.struct("count", "man")).alias("man")).orderBy("at").collect()]


def unusual(cells: Column, usual: list[str]) -> Column:
    """The cells whose men are not the usual ones, in order: each as a text of its place and man, and as one of its place alone.

    Places begin with different characters in the two, so texts put together stay apart.
    """
    plain = F.array(*map(F.lit, usual))
    both = lambda x, i: F.struct(F.concat(F.char(F.lit(128) + i), x).alias("man"), F.char(F.lit(192) + i).alias("mark"))
    return F.filter(F.transform(F.split(cells, ""), lambda x, i: F.when(x != F.get(plain, i), both(x, i))), lambda x: x.isNotNull())


def lessened(odd: Column, most: int) -> Column:
    """Each way to leave out some of the unusual men and to mark the places of others, `most` at most: the text of it, both counts."""

    def step(ways: Column, x: Column) -> Column:
        free = F.filter(ways, lambda w: w["gone"] + w["marked"] < most)
        way = lambda text, gone, marked: F.struct(text.alias("text"), gone.alias("gone"), marked.alias("marked"))
        return F.concat(
            F.transform(ways, lambda w: way(F.concat(w["text"], x["man"]), w["gone"], w["marked"])),
            F.transform(free, lambda w: way(w["text"], w["gone"] + 1, w["marked"])),
            F.transform(free, lambda w: way(F.concat(w["text"], x["mark"]), w["gone"], w["marked"] + 1)),
        )

    return F.aggregate(odd, F.array(F.struct(F.lit("").alias("text"), F.lit(0).alias("gone"), F.lit(0).alias("marked"))), step)


def near_by_few_men(found: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """f, node and d: the nearest of `known` (id, odd) to each of `found` (id, odd) by `most` cells or fewer; ties to the greatest id.

    Where two placements differ, one has an unusual man and the other the usual one, or both have unusual ones. With the
    former left out and the places of the latter marked, both are the same text. One known placement is kept for each text,
    the one with the fewest men left out: what another needs beyond it is the same for all, so no text has many.
    """
    f = found.select(F.col("id").alias("f"), F.inline(lessened(F.col("odd"), most))).select("f", "text", (F.col("gone") + F.col("marked")).alias("own"))
    ways = known.select("id", F.inline(lessened(F.col("odd"), most)))
    k = ways.groupBy("text").agg(F.min(F.struct("gone", (-F.col("id")).alias("id"))).alias("k"))
    d = F.col("own") + F.col("k.gone")
    return f.join(k, "text").where(d <= most).groupBy("f").agg(F.min(F.struct(d.alias("d"), F.col("k.id").alias("id"))).alias("m")).select(
        "f", (-F.col("m.id")).alias("node"), F.col("m.d").alias("d")
    )


def near_placements(found: DataFrame, known: DataFrame, key: str, node: str, cells: str, most: int = 3) -> DataFrame:
    """key, node and d: the known placement of 64 cells with the fewest other cells, `most` (three at most) or fewer; ties to the greatest node.

    Four strips of cells, and at most three differ: one strip is equal, and placements meet by it. Where many known
    placements share a strip, most have the same men (none) on most cells: found ones with few other men meet known ones by
    what is left without some of those (`near_by_few_men`). For the others, a strip that many share is put to one of the
    four strips of what is left, of which again one is equal, and so on. What still has many is dealt: its known placements
    in blocks, the found ones to each. Equal placements meet once, on either side.
    """
    if not 0 <= most < STRIPS:
        raise ValueError(f"of {STRIPS} strips one is equal where fewer than {STRIPS} cells differ")
    with Scratch(found.sparkSession) as scratch:
        usable = F.length(cells) == 64
        start = lambda rows: scratch.settled(keyed(rows.selectExpr("id", "'' as path", "'' as own", "rest")), "strips")
        crowds = lambda rows: scratch.settled(rows.groupBy("path", "own").count().where(F.col("count") > CROWD), "crowded")
        one = known.where(usable & F.col(node).isNotNull()).groupBy(F.col(cells).alias("rest")).agg(F.max(node).alias("id"))
        latest = scratch.settled(one, "known")
        asked = scratch.settled(found.where(usable).select(F.col(cells).alias("rest")).distinct().withColumn("id", F.monotonically_increasing_id()), "found")
        every, sides = [], [asked, start(latest)]
        crowded = crowds(sides[1])
        if not crowded.isEmpty():
            usual = usual_men(latest.join(sides[1].join(crowded, ["path", "own"], "left_semi").select("id").distinct(), "id", "left_semi"))
            f, k = (scratch.settled(s.withColumn("odd", unusual(F.col("rest"), usual)), "unusual") for s in (asked, latest))
            n = F.size("odd")
            every.append(near_by_few_men(f.where(n <= FEW), k.where(n <= FEW + most), most))
            sides = [f.where(n > FEW), start(k.where(n > FEW - most))]
            crowded = crowds(sides[1])
        sides[0] = start(sides[0])
        for level in range(LEVELS + 1):
            last = level == LEVELS
            few = [s if last else s.join(crowded, ["path", "own"], "left_anti") for s in sides]
            blocks = F.coalesce(F.ceil(F.col("count") / CROWD), F.lit(1)) if last else F.lit(1)
            dealt = [s.join(crowded, ["path", "own"], "left") if last else s for s in few]
            f = dealt[0].select("path", "own", F.col("id").alias("f"), F.col("rest").alias("fr"), F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block"))
            k = dealt[1].select("path", "own", F.col("id").alias("node"), F.col("rest").alias("kr"), F.pmod(F.xxhash64("id"), blocks.cast("long")).alias("block"))
            d = F.size(F.filter(F.zip_with(F.split("fr", ""), F.split("kr", ""), lambda a, b: a != b), lambda x: x))
            every.append(f.join(k, ["path", "own", "block"]).select("f", "node", d.alias("d")).where(F.col("d") <= most))
            if last or crowded.isEmpty():
                break
            sides = [scratch.settled(keyed(s.join(crowded, ["path", "own"], "left_semi")), "strips") for s in sides]
            crowded = crowds(sides[1])
        near = reduce(DataFrame.unionByName, every).groupBy(F.col("f").alias("id")).agg(F.min(F.struct("d", (-F.col("node")).alias("node"))).alias("m"))
        best = scratch.settled(near.join(asked, "id").select(F.col("rest").alias("f"), (-F.col("m.node")).alias(node), F.col("m.d").alias("d")), "nearest")
        rows = found.select(F.col(key), F.col(cells).alias("f"))
        return settled(rows.join(best, "f", "left").select(key, node, "d"), "placed")


def side_cost(kings: Column, queens: Column, pawns: Column, men: Column) -> Column:
    """What one side's numbers of men cost: kings, pawns, men, queens beyond lost pawns."""
    over = lambda n: F.greatest(F.lit(0), n)
    return (
        COSTS["king"] * F.abs(kings - 1)
        + COSTS["pawns"] * over(pawns - 8)
        + COSTS["men"] * over(men - 16)
        + COSTS["queens"] * over(queens - 1 - over(8 - pawns))
    )


def label_moves(parts: DataFrame, labels: DataFrame, small: int) -> DataFrame:
    """cluster, label and delta: the change of every cluster's label that lowers the cost of all boards most, if one does.

    A label turns to the other colour or, in a cluster of fewer than `small` cells, to X, which is no man. Boards have
    64 cells, so what a board has is counted in a window over it.
    """
    named = parts.join(labels, "cluster").where(F.upper("label").isin(*SIDES)).select(
        "board", "cluster", "n", "outer", "size", "label", F.upper("label").alias("kind"), (F.col("label") == F.upper("label")).alias("white")
    )
    kinds = ("K", "Q", "P")
    parted = named.select("*", *(F.when(F.col("kind") == k, F.col("n")).otherwise(0).alias(k) for k in kinds), F.col("n").alias("M"))
    names = (*kinds, "M")
    both = parted.select("*", *(F.sum(k).over(W.partitionBy("board")).alias(f"all{k}") for k in names))
    held = both.select("*", *(F.sum(k).over(W.partitionBy("board", "white")).alias(f"own{k}") for k in names))
    own, part = [F.col(f"own{k}") for k in names], [F.col(k) for k in names]
    other = [F.col(f"all{k}") - F.col(f"own{k}") for k in names]
    less = side_cost(*(o - p for o, p in zip(own, part, strict=True))) - side_cost(*own)
    more = side_cost(*(o + p for o, p in zip(other, part, strict=True))) - side_cost(*other)
    held = held.select("cluster", "size", "label", "white", less.alias("less"), more.alias("more"), F.when(F.col("kind") == "P", COSTS["outer"] * F.col("outer")).otherwise(0).alias("outer"))
    turned = F.when(F.col("white"), F.lower("label")).otherwise(F.upper("label"))
    ways = F.array(
        F.struct(F.lit(0).alias("way"), turned.alias("to"), (F.col("less") + F.col("more")).alias("delta")),
        F.struct(F.lit(1).alias("way"), F.lit("X").alias("to"), (F.col("less") - F.col("outer")).alias("delta")),
    )
    each = held.select("cluster", "size", F.inline(ways)).groupBy("cluster", "way", "to", "size").agg(F.sum("delta").alias("delta"))
    better = each.where((F.col("delta") < 0) & ((F.col("way") == 0) | (F.col("size") < small)))
    return better.groupBy("cluster").agg(F.min(F.struct("delta", "way", "to")).alias("m")).select(
        "cluster", F.col("m.to").alias("to"), F.col("m.delta").alias("delta")
    )


def search_labels(cells: DataFrame, labels: DataFrame, sweeps: int = 12, small: int = 8, folder: str = "") -> DataFrame:
    """Labels (cluster, label) after so many sweeps at most, each of which lowers what all boards' breaches of the rules cost.

    Cells: board, square (0 to 63), cluster. In a sweep one aggregation gives the change of cost for each cluster and each
    other label. A cluster takes its best one if on all its boards none does better: such clusters share no board, so their
    changes add up, and the best of all is among them. Each sweep's labels are written; with a folder given, a search that
    was cut off goes on after the last sweep that is complete there.
    """
    spark = cells.sparkSession
    with Scratch(spark) as scratch:
        outer = F.when((F.col("square") < 8) | (F.col("square") >= 56), 1).otherwise(0)
        counted = cells.groupBy("board", "cluster").agg(F.count("*").alias("n"), F.sum(outer).alias("outer"))
        sizes = counted.groupBy("cluster").agg(F.sum("n").alias("size"))
        parts = scratch.settled(counted.join(sizes, "cluster"), "parts")
        now = scratch.settled(labels.select("cluster", "label"), "labels")
        for sweep in range(sweeps):
            path = f"{folder.rstrip('/')}/sweep={sweep}"
            if folder and written(spark, f"{path}/_SUCCESS"):
                now = spark.read.schema(now.schema).parquet(path)
                continue
            moves = scratch.settled(label_moves(parts, now, small), "moves")
            if moves.isEmpty():
                break
            rank = F.struct("delta", "cluster")
            met = parts.select("board", "cluster").join(moves, "cluster")
            first = met.withColumn("first", F.min(rank).over(W.partitionBy("board")) == rank)
            taken = first.groupBy("cluster").agg(F.min("first").alias("all"), F.first("to").alias("to")).where("all")
            after = now.join(taken, "cluster", "left").select("cluster", F.coalesce("to", "label").alias("label"))
            if folder:
                after.write.mode("overwrite").parquet(path)
                now = spark.read.schema(now.schema).parquet(path)
            else:
                now = scratch.settled(after, "labels")
        return settled(now, "searched")


def square(name: Column) -> Column:
    """e4 as a number, from a8 (0) along the ranks to h1 (63)."""
    return (8 - F.substring(name, 2, 1).cast("int")) * 8 + F.ascii(name) - ord("a")


def pushed(cells: Column, move: Column) -> Column:
    """The array of cells after a move like e2e4 or e7e8q, which is not judged: a pawn takes in passing where it goes aslant to an empty cell."""
    start, end = square(F.substring(move, 1, 2)), square(F.substring(move, 3, 2))
    said = F.struct(start.alias("a"), end.alias("b"), F.get(cells, start).alias("man"), F.substring(move, 5, 1).alias("new"), (F.get(cells, end) == ".").alias("free"))

    def after(m: Column) -> Column:
        man = F.when(m["new"] == "", m["man"]).when(F.upper(m["man"]) == m["man"], F.upper(m["new"])).otherwise(F.lower(m["new"]))
        passing = (F.upper(m["man"]) == "P") & m["free"] & ((m["a"] - m["b"]) % 8 != 0)
        behind = F.floor(m["a"] / 8) * 8 + m["b"] % 8
        return F.transform(
            cells, lambda x, i: F.when(i == m["b"], man).when((i == m["a"]) | (passing & (i == behind)), F.lit(".")).otherwise(x)
        )

    return F.element_at(F.transform(F.array(said), after), 1)


def balance(cells: Column) -> Column:
    """White's men less Black's, by worth, of an array of cells."""
    worth = F.create_map(*(F.lit(x) for k, n in WORTH.items() for x in (k, -n, k.upper(), n)))
    return F.aggregate(cells, F.lit(0), lambda s, x: s + F.coalesce(F.element_at(worth, x), F.lit(0)))


def line_gain(cells: Column, white: Column, line: Column, plies: int = 3) -> Column:
    """Men won, by worth, for the side to move within the first plies of a line; null without one. No legality is asked for."""
    start = F.split(cells, "")
    end = F.aggregate(F.slice(line, 1, plies), start, lambda c, move: pushed(c, move))
    change = balance(end) - balance(start)
    return F.when(F.size(line) > 0, F.when(white, change).otherwise(-change))
