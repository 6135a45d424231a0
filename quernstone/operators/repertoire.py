"""Lines of a repertoire: comments that hang on moves, folders down to lines, and drills of one's own mistakes.

A line has a group, its moves `sans` and its comments `notes`, by ply: -1 stands before the first move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import win_chance

LOSS = 4.0  # points of winning chance from which on an answer is a mistake again


def places(sans: Column) -> Column:
    """Each ply from -1 on with the digest of the moves up to it, by which lines know that they share it."""
    start = F.sha2(F.lit(""), 256)
    first = F.struct(start.alias("h"), F.array(F.struct(F.lit(-1).alias("ply"), start.alias("place"))).alias("out"))

    def step(held: Column, san: Column) -> Column:
        now = F.sha2(F.concat(held["h"], F.lit("/"), F.coalesce(san, F.lit(""))), 256)
        return F.struct(now.alias("h"), F.array_append(held["out"], F.struct((F.size(held["out"]) - 1).alias("ply"), now.alias("place"))).alias("out"))

    return F.aggregate(F.coalesce(sans, F.array().cast("array<string>")), first, step, lambda held: held["out"])


def laid_out(lines: DataFrame) -> DataFrame:
    return lines.select("group", "line", F.inline(places(F.col("sans"))))


def place_of(ply: Column) -> Column:
    """The place of a ply of the row's line, null if the line has no such ply."""
    return F.get(places(F.col("sans")), (ply + 1).cast("int"))["place"]


def noted(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """line, ply and note of all lines that run through the places of notes: group, place, note."""
    return laid_out(lines).join(notes.hint("merge"), ["group", "place"]).select("line", "ply", "note")


def with_notes(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """Lines whose notes at the plies of changes (line, ply, note) are those; an empty or null one takes the note away.

    Moves, places and notes of many lines compress so well that Spark takes them for small and sends them all through the
    driver, so joins with all lines are asked for by sorting, here and where changes are made.
    """
    own = changes.groupBy("line").agg(F.map_from_entries(F.collect_list(F.struct("ply", F.coalesce("note", F.lit("")).alias("note")))).alias("__new"))
    held = lines.join(own.hint("merge"), "line", "left")
    none = F.create_map().cast("map<int,string>")
    new, old = F.coalesce("__new", none), F.coalesce(F.col("notes").cast("map<int,string>"), none)
    kept = F.map_filter(old, lambda ply, note: ~F.map_contains_key(new, ply))
    said = F.map_filter(F.map_concat(kept, new), lambda ply, note: note != "")
    return held.withColumn("notes", said).select(*lines.columns)


def shared_notes(lines: DataFrame) -> DataFrame:
    """Lines as they are read in: a comment goes to all lines of its group that run through its move; of several the least line's."""
    said = lines.select("group", "line", "sans", F.explode("notes").alias("ply", "note")).where("note <> ''")
    placed = said.select("group", "line", "note", place_of(F.col("ply")).alias("place")).where("place is not null")
    first = placed.groupBy("group", "place").agg(F.min_by("note", "line").alias("note"))
    return with_notes(lines, noted(lines, first))


def edited_notes(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines after edits (line, ply, note, at): each goes to all lines of the group that run through its move, the latest one last.

    Only edited comments move. Edits meet by group and place before lines do, so a place has one row however many lines share it.
    """
    met = edits.join(lines.select("group", "line", "sans").hint("merge"), "line")
    placed = met.select("group", "line", "at", "note", place_of(F.col("ply")).alias("place")).where("place is not null")
    last = placed.groupBy("group", "place").agg(F.max_by(F.struct("note"), F.struct("at", "line"))["note"].alias("note"))
    return with_notes(lines, noted(lines, last))


def shown_notes(sans: Column, notes: Column, first: Column) -> Column:
    """For each of one's own moves, from ply `first` on, the comments on what was played since one's last move: never the move's own, or a later one."""
    own = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(sans) - 1)), lambda k: (k >= first) & ((k - first) % 2 == 0) & (k < F.size(sans)))
    before = lambda k: F.sequence(F.greatest(F.lit(-1), k - 2), k - 1)
    said = lambda k: F.filter(F.transform(before(k), lambda j: F.element_at(notes, j)), lambda x: x.isNotNull())
    return F.transform(own, lambda k: F.struct(k.alias("ply"), said(k).alias("notes")))


def hierarchy(folders: DataFrame, openings: DataFrame, lines: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """level, folder, opening, group, lines and due: folders, their openings, their groups, each with what is below.

    Folders: folder, the list that keeps empty ones. Openings: opening, folder (null: in none). Lines: opening, group, due.
    Renames: folder, name; a folder renamed to one that is there becomes part of it.
    """
    if renames is not None:
        new = renames.groupBy("folder").agg(F.max("name").alias("__name"))
        called = lambda rows: rows.join(new, "folder", "left").withColumn("folder", F.coalesce("__name", "folder")).drop("__name")
        folders, openings = called(folders.select("folder")), called(openings)
    placed = openings.select("opening", F.coalesce("folder", F.lit("")).alias("folder")).join(lines, "opening", "left")
    counts = placed.rollup("folder", "opening", "group").agg(
        F.count("group").alias("lines"), F.coalesce(F.count_if("due"), F.lit(0)).alias("due"), F.grouping_id().alias("__g")
    ).where("__g < 7 and (__g > 0 or group is not null)")
    level = F.when(F.col("__g") == 0, "group").when(F.col("__g") == 1, "opening").otherwise("folder")
    named = counts.select(level.alias("level"), "folder", "opening", "group", "lines", "due")
    empty = folders.select("folder").where("folder <> ''").distinct().join(named.where("level = 'folder'"), "folder", "left_anti")
    nothing = [F.lit(None).cast("string").alias("opening"), F.lit(None).cast(dict(named.dtypes)["group"]).alias("group")]
    zeros = [F.lit(0).cast("long").alias(c) for c in ("lines", "due")]
    return named.unionByName(empty.select(F.lit("folder").alias("level"), "folder", *nothing, *zeros))


def mends(played: Column, best: Column, answer: Column, mates: Column, best_cp: Column, cp: Column) -> Column:
    """Whether an answer mends one's own mistake: the engine's move or a mate does, the mistake doesn't, another one if it loses little chance."""
    loss = win_chance(best_cp) - win_chance(cp)
    return F.when((answer == best) | mates, True).when(answer == played, False).otherwise(best_cp.isNotNull() & cp.isNotNull() & (loss < LOSS))


def drill_counts(attempts: DataFrame) -> DataFrame:
    """user, day, drills (mistakes looked at) and fixed (mended at the first attempt) from attempts: user, day, mistake, at, mended."""
    each = attempts.groupBy("user", "day", "mistake").agg(F.min_by("mended", "at").alias("mended"))
    return each.groupBy("user", "day").agg(F.count("*").alias("drills"), F.count_if("mended").alias("fixed"))
