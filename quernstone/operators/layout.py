"""Paragraphs and headings from lines of a page by where they stand and how they are set.

Lines: doc, page, column, y0, y1, x0, style, text. A page is the unit of work; only one row for each page goes over a whole
document, to carry paragraphs from page to page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SCALE = 1000  # places in thousandths of a point, so that frames have whole bounds
ALIKE, LEFT_OF, RIGHT_OF = 2.0, 20.0, 1.0  # an edge is where two lines begin less than ALIKE apart, at most so far left or right
INDENT, GAP, HEADING_GAP = 5.0, 9.0, 30.0


def with_edges(lines: DataFrame) -> DataFrame:
    """Lines with `edge`, the leftmost frequent start near theirs in their column; their own start if there is none."""
    at = F.round(F.col("x0") * SCALE).cast("long")
    column = W.partitionBy("doc", "page", "column").orderBy("__x")
    near = column.rangeBetween(1 - int(ALIKE * SCALE), int(ALIKE * SCALE) - 1)
    edges = column.rangeBetween(-int(LEFT_OF * SCALE), int(RIGHT_OF * SCALE))
    often = lines.withColumn("__x", at).withColumn("__often", F.count("*").over(near) >= 2)
    left = F.min(F.when(F.col("__often"), F.col("__x"))).over(edges)
    return often.withColumn("edge", F.coalesce(left, F.col("__x")) / SCALE).drop("__x", "__often")


def glued(lines: Column) -> Column:
    """Lines as one text: a word parted by a hyphen is joined, other lines meet with a space."""

    def step(held: Column, line: Column) -> Column:
        parted = held.rlike(r"\p{Ll}-$") & line.rlike(r"^\p{Ll}")
        joined = F.when(parted, F.concat(F.regexp_replace(held, "-$", ""), line)).otherwise(F.concat(held, F.lit(" "), line))
        return F.when(held == "", line).otherwise(joined)

    return F.aggregate(lines, F.lit(""), step)


def flow(lines: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """doc, page, n, kind and text of each paragraph and heading, n counting within the page on which it begins.

    `kinds` tells what styles are: a heading's name, `text`, or empty for what is not in the flow, which counts for edges only;
    styles that are not in it are text. A line begins a paragraph after a heading, where it is indented, or after a gap; a
    paragraph may go on on the next page. Headings of one kind close to each other are one.
    """
    named = F.coalesce(*(F.when(F.col("style") == s, F.lit(k)) for s, k in kinds.items()), F.lit("text"))
    page = W.partitionBy("doc", "page").orderBy("column", "y0", "x0", "text")
    # all windows over a page, and the counts of pages, share this one deal of the lines; the join below would ask for pages on one side only
    known = lines.where("doc is not null and page is not null").select("doc", "page", "column", "y0", "y1", "x0", "style", "text")
    dealt = known.repartition("doc", "page")
    rows = with_edges(dealt).withColumn("kind", named).where("kind <> ''").select(
        "doc", "page", "column", "y0", "y1", "x0", "text", "edge", "kind",
        F.lag("kind").over(page).alias("before"),
        F.lag("y0").over(page).alias("top"),
        F.lag("y1").over(page).alias("bottom"),
        F.row_number().over(page).alias("at"),
    )
    close = (F.col("before") == F.col("kind")) & (F.abs(F.col("y0") - F.col("top")) < HEADING_GAP)
    set_off = (F.col("x0") - F.col("edge") > INDENT) | F.coalesce(F.col("y0") - F.col("bottom") > GAP, F.lit(False))
    begins = F.when(F.col("kind") != "text", ~F.coalesce(close, F.lit(False))).when(F.col("before").isNull(), None).otherwise((F.col("before") != "text") | set_off)
    rows = rows.select("doc", "page", "at", "kind", begins.cast("int").alias("begins"), set_off.alias("off"), F.trim("text").alias("text"))
    # the first line of a page goes on with the page before unless that ends in a heading or the line is set off
    pages = rows.groupBy("doc", "page").agg(
        F.max_by("kind", "at").alias("last"), F.sum(F.coalesce("begins", F.lit(0))).alias("begun"), F.max(F.when(F.col("begins").isNull(), F.col("off"))).alias("off")
    )
    in_order = W.partitionBy("doc").orderBy("page")
    follows = F.coalesce(F.lag("last").over(in_order) != "text", F.lit(True))
    top = F.when(F.col("off").isNotNull(), follows | F.col("off")).otherwise(False).cast("int")
    pages = pages.select("doc", "page", "begun", top.alias("first"))
    most = F.col("begun") + F.col("first")
    owner = F.last(F.when(most > 0, F.struct("page", most.alias("n"))), ignorenulls=True).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(pages.select("doc", "page", "first", owner.alias("owner")).hint("merge"), ["doc", "page"])
    so_far = W.partitionBy("doc", "page").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("n", F.sum(F.coalesce("begins", "first")).over(so_far))
    own = F.when(F.col("n") > 0, F.struct("page", "n")).otherwise(F.col("owner"))
    # what a page has of a paragraph moves as one row
    parts = rows.groupBy("doc", "page", "n", own.alias("own")).agg(F.sort_array(F.collect_list(F.struct("at", "kind", "text"))).alias("l"))
    whole = parts.groupBy("doc", "own").agg(F.sort_array(F.collect_list(F.struct("page", "l"))).alias("l"))
    whole = whole.withColumn("l", F.flatten(F.transform("l", lambda x: x["l"])))
    texts = F.transform("l", lambda x: x["text"])
    return whole.select("doc", "own.page", "own.n", F.element_at("l", 1)["kind"].alias("kind"), glued(texts).alias("text"))
