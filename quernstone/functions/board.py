"""Board strings: placements of 64 cells, row by row from the eighth rank, and rules that need no move generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Worth of the men.
WORTH = {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9}
#: What a breach of the rules costs.
COSTS = {"king": 10, "pawns": 3, "outer": 4, "men": 2, "queens": 2}


def placement(fen: Column) -> Column:
    return F.split_part(fen, F.lit(" "), F.lit(1))


def position_key(fen: Column) -> Column:
    """Placement, side, castling and en passant: what makes two positions equal."""
    return F.substring_index(fen, " ", 4)


def expand(rows: Column) -> Column:
    """Runs of empty cells written as points, without the bars between rows: 64 letters."""
    out = F.replace(rows, F.lit("/"), F.lit(""))
    for n in range(8, 0, -1):
        out = F.replace(out, F.lit(str(n)), F.lit("." * n))
    return out


def compress(cells: Column) -> Column:
    """64 letters as rows with runs of points counted."""
    rows = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(cells, i * 8 + 1, F.lit(8))), "/")
    for n in range(8, 0, -1):
        rows = F.replace(rows, F.lit("." * n), F.lit(str(n)))
    return rows


def men(cells: Column, letter: str) -> Column:
    return F.length(cells) - F.length(F.replace(cells, F.lit(letter), F.lit("")))


def material(cells: Column) -> Column:
    """White's men less Black's, by worth."""
    return sum((worth * (men(cells, k.upper()) - men(cells, k)) for k, worth in WORTH.items()), F.lit(0))


def violations(cells: Column) -> Column:
    """What is wrong with a placement: kings, pawns, men, pawns on the outer ranks."""
    outer = F.concat(F.substring(cells, 1, 8), F.substring(cells, 57, 8))
    sides = [("white", "K", "P", "[A-Z]"), ("black", "k", "p", "[a-z]")]
    found = [F.when(F.length(cells) != 64, "size"), F.when(outer.rlike("[pP]"), "pawn rank")]
    for name, king, pawn, any_man in sides:
        found += [
            F.when(men(cells, king) != 1, f"{name} king"),
            F.when(men(cells, pawn) > 8, f"{name} pawns"),
            F.when(F.regexp_count(cells, F.lit(any_man)) > 16, f"{name} men"),
        ]
    return F.array_compact(F.array(*found))


def castling(cells: Column) -> Column:
    """Rights that the kings' and rooks' places allow, a dash for none."""
    at = lambda square, man: F.substring(cells, square, 1) == man
    rights = [(61, "K", 64, "R", "K"), (61, "K", 57, "R", "Q"), (5, "k", 8, "r", "k"), (5, "k", 1, "r", "q")]
    out = F.concat(*(F.when(at(k, king) & at(r, rook), right).otherwise("") for k, king, r, rook, right in rights))
    return F.when(out == "", "-").otherwise(out)


def rotate(cells: Column) -> Column:
    return F.reverse(cells)


def differing(a: Column, b: Column) -> Column:
    """On how many cells two placements differ."""
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(64)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))


def too_little(cells: Column) -> Column:
    """Neither side can mate: only kings, or one minor piece beside them."""
    rest = F.regexp_replace(cells, "[.kK]", "")
    return (rest == "") | rest.isin("n", "N", "b", "B")


def phase(cells: Column) -> Column:
    """Endgame when little but pawns is left, by what the pieces are worth."""
    side = lambda letters: sum((WORTH[x.lower()] * men(cells, x) for x in letters), F.lit(0))
    white, black, queens = side("NBRQ"), side("nbrq"), men(cells, "q") + men(cells, "Q")
    return F.when(((queens == 0) & (white <= 13) & (black <= 13)) | (white + black <= 16), "endgame").otherwise("middlegame")


def opposite_bishops(cells: Column) -> Column:
    """Each side has one bishop, on squares of different colours."""
    shade = lambda letter: (F.instr(cells, letter) - 1 + F.floor((F.instr(cells, letter) - 1) / 8)) % 2
    return (men(cells, "B") == 1) & (men(cells, "b") == 1) & (shade("B") != shade("b"))


def passed_pawn(cells: Column) -> Column:
    """White has a pawn with no black pawn ahead on its file or those beside it."""
    squares = F.sequence(F.lit(0), F.lit(63))
    at = lambda i: F.substring(cells, i + 1, F.lit(1))
    black = F.filter(squares, lambda j: at(j) == "p")
    return F.exists(
        F.filter(squares, lambda i: at(i) == "P"),
        lambda i: ~F.exists(black, lambda j: (F.floor(j / 8) < F.floor(i / 8)) & (F.abs(j % 8 - i % 8) <= 1)),
    )


def breach_cost(cells: Column) -> Column:
    """A weighted count of what breaks the rules: kings, pawns, pawns on the outer ranks, men, queens beyond lost pawns."""
    outer = F.concat(F.substring(cells, 1, 8), F.substring(cells, 57, 8))
    cost = COSTS["outer"] * F.regexp_count(outer, F.lit("[pP]"))
    over = lambda n: F.greatest(F.lit(0), n)
    for king, queen, pawn, any_man in (("K", "Q", "P", "[KQRBNP]"), ("k", "q", "p", "[kqrbnp]")):
        lost = over(8 - men(cells, pawn))
        cost = cost + COSTS["king"] * F.abs(men(cells, king) - 1) + COSTS["pawns"] * over(men(cells, pawn) - 8)
        cost = cost + COSTS["men"] * over(F.regexp_count(cells, F.lit(any_man)) - 16) + COSTS["queens"] * over(men(cells, queen) - 1 - lost)
    return cost
