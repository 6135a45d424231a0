"""Game records as text: splitting, headers, moves with evaluations, addresses, and payloads of play sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import let, strip_pairs

#: Fixed values of the format: a move, a header's line, an evaluation in a comment, and the digits that numbers of moves begin with.
MOVE = r"^(?:O-O-O|O-O|0-0-0|0-0|[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?)[+#]?[!?]{0,2}$"
HEADER = r'(?m)^\s*\[\s*([A-Za-z0-9_]+)\s+"([^"]*)"\s*\]\s*$'
EVALUATION = r"\[%eval\s+(#?-?[\d.]+)"
NUMBER = r"^\d+\.+"
#: What a game's text is made of, after its headers: comments in braces, comments to the end of a line, glyphs, words.
PIECE = r"\{[^}]*\}?|;[^\n]*|\$\d+|[^\s{};$]+"
FIRST_HEADER = r'(?m)(?=^[ \t]*\[Event[ \t"])'
MATE = 10_000


def split_games(raw: Column) -> Column:
    """The games of a file, each from its event header on, which may be indented; what has neither a header nor a numbered move is none."""
    parts = F.transform(F.split(F.translate(raw, "\r", ""), FIRST_HEADER), lambda x: F.btrim(x, F.lit(" \n\t\f\u000b")))
    return F.filter(parts, lambda x: F.contains(x, F.lit("[")) | x.rlike(r"\d\."))


def headers(raw: Column) -> Column:
    """Header names to values; of repeated names the last."""
    found = F.struct(*(F.regexp_extract_all(raw, F.lit(HEADER), F.lit(i)).alias(name) for i, name in enumerate(("names", "values"), 1)))

    def last(x: Column) -> Column:
        one_each = F.array_distinct(x["names"])
        place = lambda k: F.size(x["names"]) - F.array_position(F.reverse(x["names"]), k).cast("int")
        return F.map_from_arrays(one_each, F.transform(one_each, lambda k: F.get(x["values"], place(k))))

    return let(found, last)


def said(raw: Column) -> Column:
    """What a game says in its main line, in order: structs of a move (without its number and marks) or a comment; the other is null.

    Variations go first: brackets count wherever they stand, in comments too.
    """
    body = strip_pairs(F.regexp_replace(raw, r"(?m)^[ \t]*\[[^\]\n]*\][ \t]*$", " "))
    words = F.transform(F.regexp_extract_all(body, F.lit(f"({PIECE})"), F.lit(1)), lambda t: F.regexp_replace(t, NUMBER, ""))
    kinds = F.transform(
        words,
        lambda t: F.struct(
            F.when(t.rlike(MOVE), F.rtrim(t, F.lit("!?"))).alias("move"), F.when(F.startswith(t, F.lit("{")), t).alias("note")
        ),
    )
    return F.filter(kinds, lambda x: x["move"].isNotNull() | x["note"].isNotNull())


def moves_of(things: Column) -> Column:
    """The moves, in order and without marks, of what a game says."""
    return F.filter(F.transform(things, lambda x: x["move"]), lambda m: m.isNotNull())


def moves(raw: Column) -> Column:
    """The moves in order, without marks."""
    return moves_of(said(raw))


def evaluations_of(things: Column) -> Column:
    """Moves made so far to the evaluation noted there, of what a game says.

    Evaluations are put together with a mark for each move and cut at the marks, so no list is copied with each note.
    """
    move, end = "\u0001", "\u0002"
    mate = lambda e: F.replace(e, F.lit("#"), F.lit("")).try_cast("int")
    of_mate = lambda e: F.when(mate(e) > 0, MATE - mate(e)).otherwise(-MATE - mate(e))
    value = lambda e: F.when(F.startswith(e, F.lit("#")), of_mate(e)).otherwise(F.floor(F.round(e.try_cast("double") * 100, 6) + 0.5).cast("int"))
    noted = F.transform(things, lambda x: F.when(x["move"].isNotNull(), move).otherwise(F.concat(F.regexp_extract(x["note"], EVALUATION, 1), F.lit(end))))
    after = lambda part, n: F.filter(F.split(part, end), lambda e: (e != "") & (n > 0))
    each = F.transform(F.split(F.array_join(noted, ""), move), lambda part, n: F.transform(after(part, n), lambda e: F.struct(n.alias("at"), value(e).alias("cp"))))
    return F.flatten(each)


def evaluations(raw: Column) -> Column:
    """Moves made so far to the evaluation noted there, in hundredths; a mate in n is 10000 - n. Notes before the first move don't count."""
    return evaluations_of(said(raw))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files as rows (path, value), bytes that are no UTF-8 replaced."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("value"))


def read_games(files: DataFrame, text: str = "value") -> DataFrame:
    """One row for each game of files read as whole texts: headers, moves, evaluations."""
    games = files.select(F.explode(split_games(F.col(text))).alias("raw"))
    raw, things = F.col("raw"), F.col("said")
    once = games.select("raw", headers(raw).alias("headers"), said(raw).alias("said"))
    return once.select("raw", "headers", moves_of(things).alias("moves"), evaluations_of(things).alias("evals"))


def source_of(address: Column, strict: bool = False) -> Column:
    """What an address of a play site names: study, chapter or game. Another one is unknown, or stops the job if `strict`."""
    known = F.when(address.rlike(r"/study/\w{8}/\w{8}"), "chapter").when(address.rlike(r"/study/\w{8}"), "study")
    known = known.when(address.rlike(r"^https?://[^/]+/\w{8}(\w{4})?([/?#]|$)"), "game")
    return known.otherwise(F.raise_error(F.concat(F.lit("no game or study: "), address)) if strict else F.lit("unknown"))


def newest_games(games: DataFrame, at: str, order: str, budget: int, wanted: Column) -> DataFrame:
    """The newest wanted games, month by month, as many as the budget allows."""
    month = F.date_trunc("month", at)
    return games.where(wanted).orderBy(F.desc(month), F.desc(at), F.desc(order)).limit(budget)


GAMES = "struct<games:array<struct<white:struct<username:string,rating:int>,black:struct<username:string,rating:int>,end_time:bigint,time_class:string>>>"
ACTIVITY = "array<struct<interval:struct<start:bigint>,games:map<string,struct<win:int,loss:int,draw:int,rp:struct<after:int>>>,puzzles:struct<score:struct<win:int,loss:int,draw:int>>>>"


def games_by_day(payload: DataFrame, column: str, user: str) -> DataFrame:
    """Games and last rating of each day and class from archives of games: all are counted, three classes are rated."""
    rows = payload.select(F.posexplode(F.from_json(column, GAMES)["games"]).alias("at", "g"))
    own = F.when(F.lower("g.white.username") == user.lower(), F.col("g.white.rating")).otherwise(F.col("g.black.rating"))
    rows = rows.select(
        F.to_date(F.timestamp_seconds("g.end_time")).alias("day"),
        F.col("g.time_class").alias("control"),
        own.alias("rating"),
        "at",
        F.col("g.end_time").alias("t"),
    )
    rated = F.when(F.col("control").isin("rapid", "blitz", "bullet"), F.col("rating"))
    return rows.groupBy("day", "control").agg(F.count("*").alias("games"), F.max_by(rated, F.struct("t", "at")).alias("rating"))


def activity_by_day(payload: DataFrame, column: str) -> DataFrame:
    """Games of all kinds, puzzles and ratings of each day from activity intervals."""
    rows = payload.select(F.explode(F.from_json(column, ACTIVITY)).alias("a")).select(
        F.to_date(F.timestamp_millis("a.interval.start")).alias("day"), "a.games", "a.puzzles.score"
    )
    total = lambda s: F.coalesce(s["win"], F.lit(0)) + F.coalesce(s["loss"], F.lit(0)) + F.coalesce(s["draw"], F.lit(0))
    kinds = rows.select("day", total(F.col("score")).alias("puzzles"), F.explode_outer("games").alias("control", "g"))
    return kinds.groupBy("day").agg(
        F.sum(F.coalesce(total(F.col("g")), F.lit(0))).alias("games"),
        F.max("puzzles").alias("puzzles"),
        F.max(F.when(F.col("control") == "blitz", F.col("g.rp.after"))).alias("blitz"),
    )
