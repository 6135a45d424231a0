"""Text that carries structure: paragraphs, markers, spans, labels, and rules on single strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranking import numbered


def fill_forward(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Each row with the last value that is not null, its own included."""
    return rows.withColumn(
        name,
        F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)),
    )


def glue(rows: DataFrame, key: str, order: str, starts: Column, text: str) -> DataFrame:
    """Paragraphs from pieces: a piece that starts none goes on the one before; a hyphen at a piece's end is dropped with the gap."""
    by = W.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("first", starts | (F.row_number().over(by) == 1)).withColumn(
        "part", F.sum(F.col("first").cast("int")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    joined = numbered.groupBy(key, "part").agg(F.array_join(in_order, "\n").alias("joined"), F.count("*").alias("pieces"))
    whole = F.translate(F.replace("joined", F.lit("-\n"), F.lit("")), "\n", " ").alias("text")
    return joined.select(key, F.col("part").cast("long").alias("part"), whole, "pieces")


def spans(segments: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Where each segment starts and ends in the joined text."""
    by = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return segments.withColumn("end_at", F.sum(F.length(text)).over(by)).withColumn("start_at", F.col("end_at") - F.length(text))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


BLOCK = 256  # pieces of a text that are put together before they join the rest


def folded(pieces: Column, step: Callable[[Column, Column], tuple[Column, Column]], backwards: bool = False) -> Column:
    """What `step` says of each piece, joined: it gets the depth so far and the piece, and gives the depth after it and a text.

    Pieces go by blocks, so that a long text's many pieces are not copied again with each of them.
    """
    held = lambda depth, out: F.struct(depth.cast("int").alias("depth"), out.alias("out"))
    joined = lambda out, more: F.concat(more, out) if backwards else F.concat(out, more)
    places = lambda p: F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))
    blocks = let(F.reverse(pieces) if backwards else pieces, lambda p: F.transform(places(p), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK))))

    def within(acc: Column, piece: Column) -> Column:
        depth, said = step(acc["depth"], piece)
        return held(depth, joined(acc["out"], said))

    def over(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, held(acc["depth"], F.lit("")), within)
        return let(inner, lambda x: held(x["depth"], joined(acc["out"], x["out"])))

    return F.aggregate(blocks, held(F.lit(0), F.lit("")), over, lambda acc: acc["out"])


def strip_brackets(text: Column) -> Column:
    """The text outside round and square brackets, however deep; a closing bracket without an opening one is dropped.

    The text is cut at brackets; each piece is kept or not by the depth that the brackets before it leave.
    """

    def step(depth: Column, piece: Column) -> tuple[Column, Column]:
        opens, closes = piece.isin("(", "["), piece.isin(")", "]")
        after = F.when(opens, depth + 1).when(closes, F.greatest(F.lit(0), depth - 1)).otherwise(depth)
        return after, F.when(opens | closes | (depth > 0), "").otherwise(piece)

    return folded(F.split(text, r"(?<=[()\[\]])|(?=[()\[\]])"), step)


def strip_pairs(text: Column, instead: str = " ") -> Column:
    """The text with `instead` for each outermost pair of round brackets and all in it; a bracket without its match stays.

    From the end on, each closing bracket waits for an opening one, which is marked; then what is inside marked ones goes.
    A piece is an opening bracket with the text after it, a run of closing ones, or a text. Marks part the pieces, too, so
    that what the first fold gives is cut without looking for brackets again.
    """
    mark, plain = "\u0001", "t"
    begins = lambda piece, bracket: F.startswith(piece, F.lit(bracket))
    marked = F.replace(F.replace(text, F.lit(mark), F.lit(" ")), F.lit("("), F.lit(f"{mark}("))

    def matched(waiting: Column, piece: Column) -> tuple[Column, Column]:
        ends, opens = begins(piece, ")"), begins(piece, "(") & (waiting > 0)
        after = F.when(ends, waiting + F.length(piece)).when(opens, waiting - 1).otherwise(waiting)
        return after, F.concat(F.when(ends | opens, mark).otherwise(mark + plain), piece)

    def outside(depth: Column, piece: Column) -> tuple[Column, Column]:
        opens, ends, more = begins(piece, "("), begins(piece, ")"), F.length(piece) - depth
        after = F.when(opens, depth + 1).when(ends, F.greatest(F.lit(0), -more)).otherwise(depth)
        left = F.concat(F.when(depth > 0, instead).otherwise(""), F.repeat(F.lit(")"), more))
        said = F.when(opens, "").when(ends, F.when(more >= 0, left).otherwise(""))
        return after, said.when(depth > 0, "").otherwise(F.substring(piece, 2, 2**31 - 1))

    found = folded(F.split(F.regexp_replace(marked, r"\)+", f"{mark}$0{mark}"), mark), matched, backwards=True)
    return folded(F.split(found, mark), outside)


def label_key(label: Column) -> Column:
    """The numbers in a label, for sorting 3-12 after 3-4."""
    return F.transform(F.regexp_extract_all(label, F.lit(r"(\d+)")), lambda x: x.cast("int"))


def reading_order(rows: DataFrame, page: str, x: Column, y: str, middle: Column) -> DataFrame:
    """The place of each item on a page of two columns, of any length: the left one first, downwards in each."""
    placed = numbered(rows, [page], [(x > middle).cast("int"), y], "place")
    return placed.withColumn("place", (F.col("place") + 1).cast("int"))


def base_seconds(control: Column) -> Column:
    """Seconds of a time control: before the plus, after the last slash; null for none, dashes and question marks."""
    first = F.split_part(control, F.lit("+"), F.lit(1))
    return F.when(F.coalesce(control, F.lit("")).isin("", "-", "?"), None).otherwise(F.element_at(F.split(first, "/"), -1).try_cast("int"))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def content_id(start: Column, moves: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of start, bar and moves."""
    return F.substring(F.sha1(F.concat(F.coalesce(start, F.lit("")), F.lit("|"), moves).cast("binary")), 1, 16)


def fallback_id(text: Column) -> Column:
    """An id where no digest is at hand: 33 times the number so far and the next letter, in 32 bits, from 5381 on. For ASCII texts."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    step = lambda h, c: F.pmod(h * 33 + F.ascii(c), F.lit(1 << 32))
    return F.concat(F.lit("h"), F.lower(F.hex(F.aggregate(letters, F.lit(5381).cast("long"), step))))


#: Signs of an evaluation, and marks that belong to the move before.
SIGNS = r"\+−|−\+|\+-|-\+|[±∓⩲⩱=÷©ƒ‚„∞]"
MARKS = r"[\s!?+#.,;:]*"


def comment_spans(text: Column, moves: Column) -> Column:
    """For each move (start, end: offsets from 0) where its comment begins and ends, and the evaluation sign before it.

    Marks after a move don't belong to its comment, nor does a sign within the next ten letters.
    """

    def span(move: Column, i: Column) -> Column:
        ends = F.coalesce(F.get(moves, i + 1)["start"], F.length(text))
        head = F.substring(text, move["end"] + 1, F.lit(10))
        signed = F.regexp_extract(head, f"^{MARKS}(?:{SIGNS})", 0)
        skipped = F.when(signed != "", signed).otherwise(F.regexp_extract(head, f"^{MARKS}", 0))
        sign = F.translate(F.regexp_extract(head, f"^{MARKS}({SIGNS})", 1), "-", "−")
        begins = F.least(move["end"] + F.length(skipped), ends)
        return F.struct(begins.cast("int").alias("begins"), ends.cast("int").alias("ends"), sign.alias("sign"))

    return F.transform(moves, span)


def clean_title(title: Column) -> Column:
    """Without a number in brackets and a year at the end, spaces put in order."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"\(\d+\)", ""), r"[ ,]*\b\d{4}$", ""), r" +", " "))


def before_and_after(text: Column, at: Column, before: int = 140, after: int = 160) -> tuple[Column, Column]:
    """The last fragment of a sentence before a place (from 1), and what follows it."""
    from_at = F.greatest(F.lit(1), at - before)
    left = F.substring(text, from_at, at - from_at)
    return F.element_at(F.split(left, r"[.!?] "), -1), F.substring(text, at, F.lit(after))
