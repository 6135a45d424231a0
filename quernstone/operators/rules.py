"""Rules on lines, clocks, answers and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranking import numbered, same_keys

#: Seconds below which a game is fast; small and decisive evaluations; half moves of the fifty-move rule.
FAST, SMALL, DECISIVE, FIFTY_MOVES = 600, 150, 300, 100


def weighted_pick(rows: DataFrame, key: str, weight: Column, order: str, u: Column) -> DataFrame:
    """One row of each key, drawn by weight: the greatest log-weight plus Gumbel noise made from u in (0, 1)."""
    noisy = rows.withColumn("__g", weight - F.log(-F.log(u)))
    return noisy.groupBy(key).agg(F.max_by(order, F.struct("__g", order)).alias("picked"))


def even_sample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most so many rows of each key, evenly spaced over its order, first and last among them. Keys may be of any size."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("__n"))
    ranked = numbered(rows, [key], [order], "__r").alias("r").join(sizes.alias("s"), same_keys("r", "s", [key])).select("r.*", "__n")
    slot = lambda r: F.floor(r * (most - 1) / (F.col("__n") - 1))
    keep = (F.col("__n") <= most) | (F.col("__r") == 0) | (slot(F.col("__r")) > slot(F.col("__r") - 1))
    return ranked.where(keep).drop("__r", "__n")


def match_by_place(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str) -> DataFrame:
    """The n-th of the left with the n-th of the right in each group, of any size; what has no partner is kept and shows it."""
    a, b = (numbered(rows, [group], [order], "place").withColumn("place", (F.col("place") + 1).cast("int")) for rows, order in ((left, left_order), (right, right_order)))
    return a.join(b, [group, "place"], "full")


def aligned_boards(slots: DataFrame, diagrams: DataFrame, book: str, slot_order: str, order: str, continued: str) -> DataFrame:
    """The n-th diagram of a book with its n-th slot; a slot that is `continued` from a page before uses up a diagram and has no board."""
    met = match_by_place(slots, diagrams, book, slot_order, order)
    return met.where(F.col(slot_order).isNotNull() & F.col(order).isNotNull() & ~F.col(continued)).drop(continued)


def terminal_value(moves_left: Column, in_check: Column, white_to_move: Column) -> Column:
    """A position without moves: a mate is plus or minus 10000 for White, a stalemate 0; null if it goes on."""
    return F.when(moves_left > 0, None).when(~in_check, 0).when(white_to_move, -10000).otherwise(10000)


def accepts(played: Column, best: Column, answer: Column, best_cp: Column, cp: Column, most: int = 50) -> Column:
    """Whether an answer to one's own mistake is taken: not the mistake again; the best move, or one that loses little."""
    clamp = lambda x: F.greatest(F.lit(-1000), F.least(F.lit(1000), x))
    return F.when(answer == played, False).when(answer == best, True).otherwise(clamp(best_cp) - clamp(cp) <= most)


def trade_penalty(first: Column, second: Column, taken: Column) -> Column:
    """For a capture that is taken back at once: more for a queen."""
    back = F.coalesce(F.substring(second, 3, 2) == F.substring(first, 3, 2), F.lit(False))
    return F.when(~back | (taken == "."), 0).when(F.lower(taken) == "q", 45).otherwise(22)


def aligned(k: Column, hero_to_move: Column) -> Column:
    """A point is moved on by a ply where the opponent is to move."""
    return F.when(hero_to_move, k).otherwise(k + 1)


def trimmed(moves: Column) -> Column:
    """A solution cut: before the first reply that was free to choose, ending on the solver's move, quiet moves at the end dropped.

    Moves are structs (san, free, loud) from the solver's first on; a line that ends in mate stays whole.
    """
    last = F.element_at(moves, -1)
    cut = F.array_min(F.filter(F.transform(moves, lambda m, i: F.when((i % 2 == 1) & m["free"], i)), lambda i: i.isNotNull()))
    kept = F.slice(moves, F.lit(1), F.coalesce(cut, F.size(moves)))
    odd = F.when(F.size(kept) % 2 == 0, F.slice(kept, F.lit(1), F.greatest(F.lit(0), F.size(kept) - 1))).otherwise(kept)
    loud = F.array_max(F.transform(odd, lambda m, i: F.when((i % 2 == 0) & (m["loud"] | (i == 0)), i)))
    return F.when(F.endswith(last["san"], F.lit("#")), moves).otherwise(F.slice(odd, F.lit(1), F.coalesce(loud, F.lit(-1)) + 1))


def clocks(rows: DataFrame, game: str, order: str, at: str, start: int, increment: int) -> DataFrame:
    """Seconds left of each mover after each ply; a mover's first move is free. Rows: game, order, mover, at."""
    by = W.partitionBy(game).orderBy(order)
    own = W.partitionBy(game, "mover").orderBy(order)
    spent = F.when(F.row_number().over(own) == 1, 0).otherwise(F.col(at) - F.coalesce(F.lag(at).over(by), F.col(at)))
    used = rows.withColumn("spent", spent)
    return used.withColumn(
        "left",
        start + increment * F.row_number().over(own) - F.sum("spent").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)),
    )


def oriented(cluster: Column, exceptions: dict[int, str], known: int) -> Column:
    """White or Black below by cluster number, with named exceptions; an unknown cluster stops the job."""
    named = F.create_map(*(x for k, v in exceptions.items() for x in (F.lit(k), F.lit(v))))
    return F.when(cluster >= known, F.raise_error(F.lit("unknown cluster"))).otherwise(
        F.coalesce(F.try_element_at(named, cluster), F.when(cluster % 2 == 0, "w").otherwise("b"))
    )


def ago(now: Column, then: Column) -> Column:
    """Whole days between two times in milliseconds."""
    return F.floor((now - then) / 86_400_000)


def wanted_refresh(now: Column, fetched: Column, least_ms: int = 900_000) -> Column:
    """Whether data is old enough to be fetched again."""
    return fetched.isNull() | (now - fetched >= least_ms)


def mixed_fen(text: Column) -> Column:
    """A position from text or an address: the placement found, missing fields filled in."""
    plain = F.replace(F.try_url_decode(F.replace(text, F.lit("+"), F.lit(" "))), F.lit("_"), F.lit(" "))
    placement = F.regexp_extract(plain, r"((?:[1-8pnbrqkPNBRQK]{1,8}/){7}[1-8pnbrqkPNBRQK]{1,8})", 1)
    rest = F.regexp_extract(plain, r"(?:[1-8pnbrqkPNBRQK]{1,8}/){7}[1-8pnbrqkPNBRQK]{1,8}((?: [^ /]+)*)", 1)
    fields = F.filter(F.split(F.trim(rest), " "), lambda x: x != "")
    filled = lambda i, default: F.coalesce(F.get(fields, F.lit(i)), F.lit(default))
    return F.when(
        placement != "",
        F.concat_ws(" ", placement, filled(0, "w"), filled(1, "-"), filled(2, "-"), filled(3, "0"), filled(4, "1")),
    )


def own_reason(me: str, white: str, black: str, variant: str, base: Column, plies: Column, least: int) -> Column:
    """Why a game is not looked at when one's own games are wanted, whatever their result: the first rule that holds, null if none."""
    same = lambda c: F.coalesce(F.lower(c) == me.lower(), F.lit(False))
    odd = F.coalesce((F.col(variant) != "") & ~F.contains(F.lower(variant), F.lit("standard")), F.lit(False))
    found = F.when(~same(white) & ~same(black), "not one's own").when(odd, "other rules")
    return found.when(F.coalesce(base < FAST, F.lit(False)), "fast").when(plies < 2 * least, "short")


def missed(mine: Column, result: Column, hero_white: Column, tags: Column) -> tuple[Column, Column]:
    """Whether the hero of an own game did not win it, and the tags with one that says so."""
    won = F.when(hero_white, result == "1-0").otherwise(result == "0-1")
    lost_it = mine & ~F.coalesce(won, F.lit(False))
    return lost_it, F.when(lost_it, F.concat(tags, F.array(F.lit("missed")))).otherwise(tags)


def sections_of(moves: Column, mates: Column, black: Column) -> Column:
    """All sections that an exercise belongs to, by what it is like; they overlap."""
    own = F.floor((moves + 1) / 2)
    rules = (("mate", mates), ("one", own == 1), ("two", own == 2), ("three", own == 3), ("long", own >= 4), ("black", black))
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))


def little_advantage(mate: Column, cp: Column, limit: int = SMALL) -> Column:
    """No mate, and an evaluation that is known and small."""
    return mate.isNull() & F.coalesce(cp < limit, F.lit(False))


def parted(rows: DataFrame, accepted: Column) -> tuple[DataFrame, DataFrame]:
    """The accepted rows and the others; a rule that gives null accepts nothing."""
    rule = F.coalesce(accepted, F.lit(False))
    return rows.where(rule), rows.where(~rule)


def last_symbols(plies: Column, mate: Column, cp: Column, limit: int = DECISIVE) -> Column:
    """A symbol for each ply: what the evaluation says at the last one, nothing before."""
    symbol = F.when(mate.isNotNull(), "#").when(cp >= limit, "+−").when(cp <= -limit, "−+").otherwise("")
    return F.transform(F.sequence(F.lit(1), plies), lambda i: F.when(i == plies, symbol).otherwise(""))


def place_counts(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """How many the left and the right have in each group, and whether the counts differ."""
    a, b = (x.groupBy(group).agg(F.count("*").alias(n)) for x, n in ((left, "left_n"), (right, "right_n")))
    met = a.join(b, group, "full").select(group, *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("left_n", "right_n")))
    return met.withColumn("mismatch", F.col("left_n") != F.col("right_n"))


def match_by_label_or_place(boards: DataFrame, tags: DataFrame, group: str, board: str, tag: str, label: str) -> DataFrame:
    """Tags with boards: by the order of their labels in groups where all tags have one and counts agree, else by place.

    A label is a column of numbers, null where it could not be read.
    """
    by = W.partitionBy(group)
    a = boards.withColumn("place", F.row_number().over(by.orderBy(board)))
    sizes = boards.groupBy(group).agg(F.count("*").alias("boards"))
    b = tags.withColumn(
        "all_read", F.bool_and(F.col(label).isNotNull()).over(by)
    ).withColumn("tags", F.count("*").over(by)).join(sizes, group, "left")
    by_label, by_place = (F.row_number().over(by.orderBy(*o)) for o in ((label, tag), (tag,)))
    named = F.col("all_read") & F.coalesce(F.col("tags") == F.col("boards"), F.lit(False))
    return b.withColumn(
        "place", F.when(named, by_label).otherwise(by_place)
    ).join(a, [group, "place"], "left").select(group, tag, board, named.alias("by_label"))


def game_ends(plies: DataFrame, game: str, order: str) -> DataFrame:
    """The first ply at which a game ends, and why. Rows: position, clock (half moves), moves_left, in_check, too_little.

    The rules stand in order: mate, stalemate, third repetition, fifty moves, too little material.
    """
    seen = F.count("*").over(W.partitionBy(game, "position").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = plies.withColumn("__seen", seen)
    stuck = F.col("moves_left") == 0
    why = F.when(stuck & F.col("in_check"), "mate").when(stuck, "stalemate").when(F.col("__seen") >= 3, "repetition")
    why = why.when(F.col("clock") >= FIFTY_MOVES, "fifty moves").when(F.col("too_little"), "material")
    return rows.withColumn("why", why).where("why is not null").groupBy(game).agg(
        F.min(F.struct(F.col(order).alias("at"), "why")).alias("x")
    ).select(game, "x.*")


def export_rows(positions: DataFrame, kept: DataFrame, margins: DataFrame, key: str) -> DataFrame:
    """Positions for export: whether they repeat something kept elsewhere, and the least margin of their cells."""
    least = margins.groupBy(key).agg(F.round(F.min("margin"), 3).alias("minmargin"))
    new = kept.select(key).distinct().withColumn("__new", F.lit(True))
    return positions.join(new, key, "left").join(least, key, "left").withColumn("dup", F.col("__new").isNull()).drop("__new")


def filled(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing fields get their defaults, columns that are not there at all too."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(name, F.lit(value)) if name in rows.columns else F.lit(value))
    return rows
