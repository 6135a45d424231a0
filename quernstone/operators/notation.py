"""Notation in prose: clean-up of printed moves, answers by number, engine lines, candidate moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Printed signs and the letters they stand for.
FIGURES = "♔♕♖♗♘♚♛♜♝♞–—−"
LETTERS = "KQRBNKQRBN---"
#: Cyrillic letters that look like files.
LOOKALIKES = (("а", "a"), ("с", "c"), ("е", "e"))
CYRILLIC = "А-Яа-яЁё"
#: What speaks for a candidate move and against it.
PER_PLY, PER_PLACE = 1.5, 2
MARKED = {"!!": 34, "!": 26, "?": -60}
FLAGGED = {"mates": 12, "doubted": -32, "praised": 12, "won": 12}
#: Fixed value: hundredths of a pawn below which two moves are equals.
TIE = 30
#: A move as prose has it: a piece, a way, a square; castling; a pawn's two files.
PROSE_MOVE = r"(?:[KQRBN]?[a-h]?[1-8]?[-:x]?[a-h][1-8](?:=?[QRBN])?|0-0-0|0-0|[a-h][a-h])[+#]*[!?]*"


#: Rules of one spelling, in the order in which they apply: what is looked for, and what stands there instead.
SPELLING = (
    (r"(?<=\d)[\s.]*\.\.\.\s*", "..."),  # three dots follow their number at once, and the move them
    (r"(?<=\d\.)\s+(?=[KQRBNa-h])", ""),  # one dot, too, where a move follows and no other word
    (r"(?<=[KQRBN]|[KQRBN][a-h1-8]|[a-h][1-8]|\b[a-h])\s*:\s*(?=[a-h][1-8])", "x"),  # what takes, and the square on which it does
    (r"0(?=-0)|(?<=0-)0", "O"),  # castling is written in letters
)


def plain_notation(text: Column) -> Column:
    """Moves in one spelling."""
    for looked_for, instead in SPELLING:
        text = F.regexp_replace(text, looked_for, instead)
    return text


def plain_figures(text: Column) -> Column:
    """Printed pieces as letters, all dashes as hyphens."""
    return F.translate(text, FIGURES, LETTERS)


def latin_squares(text: Column) -> Column:
    """Cyrillic lookalikes in squares become Latin; words are left alone."""
    before, after = rf"(?<![{CYRILLIC}])", rf"(?=[1-8](?![{CYRILLIC}]))"
    out = text
    for cyrillic, latin in LOOKALIKES:
        out = F.regexp_replace(out, rf"{before}([асеbвh]?){cyrillic}{after}", f"$1{latin}")
    for cyrillic, latin in LOOKALIKES:
        out = F.regexp_replace(out, rf"{before}{cyrillic}(?=[ace][1-8](?![{CYRILLIC}]))", latin)
    return out


def answers_by_number(text: Column) -> Column:
    """Answers (n, answer) of a text: a number on a line of its own, or before a move number, begins the answer of that number."""
    begins = r"(?m)^[ \t]*(\d+)\.[ \t]*(?:\r?\n|(?=\d+\.))"
    numbers = F.regexp_extract_all(text, F.lit(begins), F.lit(1))
    bodies = F.slice(F.split(F.concat(F.lit("\n"), text), begins), 2, F.greatest(F.size(numbers), F.lit(1)))
    tidy = F.transform(bodies, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.arrays_zip(F.transform(numbers, lambda x: x.cast("int")).alias("n"), tidy.alias("answer"))


def lead_bold(line: Column) -> Column:
    """The chain of moves that a paragraph begins with, marked as the main line."""
    chain = rf"^((?:\s*(?:\d{{1,3}}\.(?:\.\.)?)?\s*{PROSE_MOVE}\s*)*(?:\s*(?:\d{{1,3}}\.(?:\.\.)?)?\s*{PROSE_MOVE}))"
    return F.regexp_replace(line, chain, "**$1**")


def is_line_of_squares(token: Column) -> Column:
    """Whether a token like a2-g8 names a diagonal or a file: no pawn's step leads from one square to the other.

    A pawn steps one or two ranks straight on, or one aslant.
    """
    names = F.split(F.trim(token), "-")
    file_of, rank_of = (lambda i: F.ascii(F.get(names, F.lit(i)))), (lambda i: F.substring(F.get(names, F.lit(i)), 2, 1).try_cast("int"))
    aside, on = F.abs(file_of(0) - file_of(1)), F.abs(rank_of(0) - rank_of(1))
    step = ((aside == 0) & on.isin(1, 2)) | ((aside == 1) & (on == 1))
    return token.rlike(r"^\s*[a-h][1-8]-[a-h][1-8]\s*$") & ~F.coalesce(step, F.lit(False))


def engine_lines(rows: DataFrame, line: str, order: str, keys: list[str]) -> DataFrame:
    """keys, rank, depth, kind, score and moves from an engine's output: the deepest line of each rank, of equal depths the later.

    Lines with bounds, without moves or without a score don't count.
    """
    text = F.col(line)
    number = lambda name, default: F.coalesce(F.regexp_extract(text, rf" {name} (\d+)", 1).try_cast("int"), F.lit(default))
    found = rows.where(F.startswith(text, F.lit("info")) & F.contains(text, F.lit(" pv ")) & ~text.rlike(" (?:upper|lower)bound"))
    found = found.select(
        *keys,
        order,
        number("multipv", 1).alias("rank"),
        number("depth", 0).alias("depth"),
        F.regexp_extract(text, r" score (cp|mate) -?\d+", 1).alias("kind"),
        F.regexp_extract(text, r" score (?:cp|mate) (-?\d+)", 1).try_cast("int").alias("score"),
        F.split(F.trim(F.regexp_extract(text, r" pv (.*)$", 1)), r"\s+").alias("moves"),
    ).where("kind <> '' and moves[0] <> ''")
    deepest = found.groupBy(*keys, "rank").agg(F.max_by(F.struct("depth", "kind", "score", "moves"), F.struct("depth", order)).alias("x"))
    return deepest.select(*keys, "rank", "x.*")


def twins(lines: DataFrame, keys: list[str], tie: int = TIE) -> DataFrame:
    """Positions whose two best lines (rank, cp, moves) begin otherwise and are less than `tie` apart."""
    both = lines.groupBy(*keys).agg(*(F.max(F.when(F.col("rank") == r, F.struct("cp", "moves"))).alias(f"r{r}") for r in (1, 2)))
    gap = F.col("r1.cp") - F.col("r2.cp")
    found = both.select(*keys, F.get("r1.moves", F.lit(0)).alias("best"), F.get("r2.moves", F.lit(0)).alias("twin"), gap.alias("gap"))
    return found.where((F.col("best") != F.col("twin")) & (F.col("gap") < tie))


def agreement(answers: DataFrame, engine: DataFrame, key: str, move: str, best: str) -> DataFrame:
    """Each answered item with whether its first move is the engine's, by the squares alone."""
    same = F.coalesce(F.substring(move, 1, 4) == F.substring(best, 1, 4), F.lit(False))
    return answers.where(F.col(move).isNotNull()).join(engine, key, "left").select(key, move, best, same.alias("agrees"))


def without_marks(move: Column) -> Column:
    return F.regexp_replace(move, r"[!?]+$", "")


def suspicious(items: DataFrame, chosen: str, candidates: str) -> DataFrame:
    """Items whose candidates include moves marked with !, of which the chosen one is none."""
    praised = F.transform(F.filter(candidates, lambda c: F.contains(c, F.lit("!"))), without_marks)
    return items.where(F.col(chosen).isNotNull() & (F.size(praised) > 0) & ~F.array_contains(praised, without_marks(F.col(chosen))))


def best_candidate(candidates: DataFrame, key: str, order: str) -> DataFrame:
    """The candidate with the highest score, of equals the first. Rows: key, order (from 0), plies, marks, mates, doubted, praised, won."""
    has = lambda mark: F.contains("marks", F.lit(mark))
    points = PER_PLY * F.col("plies") + PER_PLACE * F.col(order)
    points = points + F.when(has("!!"), MARKED["!!"]).when(has("!"), MARKED["!"]).otherwise(0) + F.when(has("?"), MARKED["?"]).otherwise(0)
    for flag, worth in FLAGGED.items():
        points = points + F.when(F.col(flag), worth).otherwise(0)
    best = F.max(F.struct(points.cast("double").alias("points"), (-F.col(order)).alias("at")))
    found = candidates.where("plies > 0").groupBy(key).agg(best.alias("x"))
    return found.select(key, (-F.col("x.at")).alias(order), "x.points")


def label_gaps(rows: DataFrame, group: str, order: str, chapter: str, number: str) -> DataFrame:
    """Missing numbers between two known ones of a chapter are filled in where as many are missing as the numbers leave room for."""
    by = W.partitionBy(group).orderBy(order)
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(1, W.unboundedFollowing)
    known = F.when(F.col(number).isNotNull(), F.struct(F.col(chapter).alias("c"), F.col(number).alias("n"), F.col("__at").alias("at")))
    placed = rows.withColumn("__at", F.row_number().over(by))
    placed = placed.withColumn(
        "__p", F.last(known, ignorenulls=True).over(before)
    ).withColumn("__n", F.first(known, ignorenulls=True).over(after))
    fits = (F.col("__p.c") == F.col("__n.c")) & (F.col("__n.n") - F.col("__p.n") == F.col("__n.at") - F.col("__p.at"))
    filled = F.when(F.coalesce(fits, F.lit(False)), F.col("__p.n") + F.col("__at") - F.col("__p.at"))
    return placed.withColumn("filled", F.coalesce(number, filled)).drop("__at", "__p", "__n")


def after_references(items: DataFrame, page: str, order: str, kind: str, label: str) -> DataFrame:
    """Items with `place`: a labelled diagram stands right after the first reference to it on its page, and past game headers there.

    Only diagrams that are on the page once move; what moves behind one reference keeps its order.
    """
    is_ref, is_diagram = F.col(kind) == "ref", F.col(kind) == "diag"
    refs = items.where(is_ref).groupBy(page, label).agg(F.min(order).alias("ref_at"))
    by = W.partitionBy(page).orderBy(order)
    onward = by.rowsBetween(1, W.unboundedFollowing)
    other = F.when((F.col(kind) != "game") & ~is_diagram, F.col(order))
    marked = items.withColumn("next_other", F.min(other).over(onward))
    ends = marked.where(is_ref).select(page, F.col(order).alias("ref_at"), "next_other")
    moved = items.join(refs, [page, label], "left").join(ends, [page, "ref_at"], "left")
    games = items.where(F.col(kind) == "game").select(F.col(page).alias("g_page"), F.col(order).alias("g_at"))
    behind = (F.col("g_page") == F.col(page)) & (F.col("g_at") > F.col("ref_at")) & (
        F.col("g_at") < F.coalesce("next_other", F.lit(1 << 40))
    )
    passed = moved.where(
        is_diagram & F.col("ref_at").isNotNull()
    ).join(games, behind, "left").groupBy(page, order).agg(F.max("g_at").alias("past"))
    keyed = moved.join(passed, [page, order], "left")
    at = F.when(is_diagram & F.col("ref_at").isNotNull(), F.coalesce("past", "ref_at") + 0.5).otherwise(F.col(order).cast("double"))
    return keyed.withColumn("place", F.row_number().over(W.partitionBy(page).orderBy(at, order))).select(*items.columns, "place")


def chapter_modes(blocks: DataFrame, doc: str, order: str, kind: str, modes: dict[str, str], first: str) -> DataFrame:
    """Each block with the mode that the last marker before it set; markers themselves have the mode they set."""
    names = F.create_map(*(F.lit(x) for pair in modes.items() for x in pair))
    by = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return blocks.withColumn("mode", F.coalesce(F.last(F.try_element_at(names, F.col(kind)), ignorenulls=True).over(by), F.lit(first)))


def rehomed(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Roots (root, placement, side) that no node has as parent, and the first node of that placement and side, else of that placement.

    Rows of nodes: node, parent, placement, side. A root that nothing fits keeps its place.
    """
    lonely = roots.join(nodes.select(F.col("parent").alias("root")).distinct(), "root", "left_anti")
    exact = nodes.groupBy("placement", "side").agg(F.min("node").alias("same"))
    loose = nodes.groupBy("placement").agg(F.min("node").alias("near"))
    found = lonely.join(exact, ["placement", "side"], "left").join(loose, "placement", "left")
    return found.select("root", F.coalesce("same", "near", "root").alias("home"))
