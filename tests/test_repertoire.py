"""Comments on moves, folders, drills and page flow on small cases."""

from datetime import date

from pyspark.sql import functions as F

from quernstone.operators import layout as Y
from quernstone.operators import repertoire as R

LINES = "`group` int, line int, sans array<string>, notes map<int,string>, extra string"


def notes(rows):
    return {r.line: dict(r.notes) for r in rows.collect()}


def test_comments_hang_on_moves(spark):
    rows = [
        (1, 1, ["e4", "e5", "Nf3"], {-1: "open", 1: "reply"}, "x"),
        (1, 2, ["e4", "e5", "Bc4"], {2: "bishop"}, "y"),
        (1, 3, ["d4"], None, "z"),
        (2, 4, ["e4", "e5"], {}, "x"),
        (1, 5, None, None, ""),
    ]
    lines = spark.createDataFrame(rows, LINES)
    shared = R.shared_notes(lines)
    assert notes(shared) == {1: {-1: "open", 1: "reply"}, 2: {-1: "open", 1: "reply", 2: "bishop"}, 3: {-1: "open"}, 4: {}, 5: {-1: "open"}}
    assert shared.columns == lines.columns
    edits = spark.createDataFrame([(1, 1, "better", 5), (2, 1, "worse", 4), (1, -1, None, 6), (9, 0, "no line", 1), (3, 7, "no ply", 1)], "line int, ply int, note string, at int")
    assert notes(R.edited_notes(shared, edits)) == {1: {1: "better"}, 2: {1: "better", 2: "bishop"}, 3: {}, 4: {}, 5: {}}
    assert notes(R.edited_notes(lines, edits.where("false")))[1] == {-1: "open", 1: "reply"}


def test_lines_are_not_sent_to_the_driver(spark):
    n = F.col("id")
    moves = F.array(F.lit("e4"), (n % 3).cast("string"))
    lines = spark.range(300).select((n % 5).alias("group"), n.alias("line"), moves.alias("sans"), F.when(n % 4 == 0, F.create_map(F.lit(1), F.lit("on"))).alias("notes"))
    edits = lines.where("line % 7 = 0").select("line", F.lit(0).alias("ply"), F.lit("new").alias("note"), F.col("line").alias("at"))
    for found in (R.shared_notes(lines), R.edited_notes(lines, edits)):
        assert found.count() == 300
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_comments_are_shown_after_their_moves(spark):
    rows = [(1, 1, list("abcde"), {-1: "s", 0: "A", 1: "B", 2: "C", 3: "D", 4: "E"}, ""), (1, 2, [], {-1: "s"}, "")]
    frame = spark.createDataFrame(rows, LINES)
    for first, wanted in ((0, [(0, ["s"]), (2, ["A", "B"]), (4, ["C", "D"])]), (1, [(1, ["s", "A"]), (3, ["B", "C"])])):
        found = frame.select("line", R.shown_notes(F.col("sans"), F.col("notes"), F.lit(first)).alias("k")).collect()
        assert {r.line: [(x.ply, x.notes) for x in r.k] for r in found} == {1: wanted, 2: []}


def test_folders(spark):
    folders = spark.createDataFrame([("A",), ("A",), ("Empty",), ("Old",), (None,)], "folder string")
    openings = spark.createDataFrame([("o1", "A"), ("o2", "Old"), ("o3", None), ("o4", "New")], "opening string, folder string")
    lines = spark.createDataFrame([("o1", "g", True), ("o1", "g", False), ("o1", "h", None), ("o2", "g", True), ("lost", "g", True)], "opening string, `group` string, due boolean")
    renames = spark.createDataFrame([("Old", "New")], "folder string, name string")
    found = {(r.level, r.folder, r.opening, r.group): (r.lines, r.due) for r in R.hierarchy(folders, openings, lines, renames).collect()}
    assert found == {
        ("folder", "A", None, None): (3, 1), ("folder", "New", None, None): (1, 1), ("folder", "", None, None): (0, 0), ("folder", "Empty", None, None): (0, 0),
        ("opening", "A", "o1", None): (3, 1), ("opening", "New", "o2", None): (1, 1), ("opening", "", "o3", None): (0, 0), ("opening", "New", "o4", None): (0, 0),
        ("group", "A", "o1", "g"): (2, 1), ("group", "A", "o1", "h"): (1, 0), ("group", "New", "o2", "g"): (1, 1),
    }


def test_drills(spark):
    rows = [("e4", "d4", "d4", False, 0, -999), ("e4", "d4", "e4", False, 0, 0), ("e4", "d4", "c4", False, 100, 60), ("e4", "d4", "c4", False, 100, 50), ("e4", "d4", "a4", True, 0, None), ("e4", "d4", "a4", False, 0, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, played string, best string, answer string, mates boolean, b int, c int")
    got = frame.select("i", R.mends(*map(F.col, ("played", "best", "answer", "mates", "b", "c"))).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [True, False, True, False, True, False]
    day = date(2024, 1, 1)
    attempts = spark.createDataFrame([("u", day, 1, 1, False), ("u", day, 1, 2, True), ("u", day, 2, 3, True), ("v", day, 1, 1, None)], "user string, day date, mistake int, at int, mended boolean")
    assert sorted(map(tuple, R.drill_counts(attempts).collect())) == [("u", day, 2, 1), ("v", day, 1, 0)]


def test_lines_become_paragraphs(spark):
    body, place = "Body", lambda page, y, x, style, text: ("d", page, 0, float(y), float(y) + 10, float(x), style, text)
    rows = [
        place(1, 0, 50, "Title", "A long"), place(1, 20, 50, "Title", "title"), place(1, 90, 50, "Title", "Another"),
        place(1, 110, 62, body, "First paragraph with a bro-"), place(1, 122, 50.5, body, "ken word and a Two-"), place(1, 134, 49.5, body, "Word,"),
        place(1, 166, 50, body, "set off by a gap"), place(1, 178, 50, body, "goes on"),
        place(2, 0, 50, body, "on the next page"), place(2, 12, 50, body, "to its end."), place(2, 24, 60, body, "Indented."), place(2, 36, 50, "Folio", "2"),
        place(3, 0, 50, body, "Goes on, too,"), place(3, 12, 50, body, "here."),
        place(4, 0, 50, "Title", "Last"), place(5, 0, 50, body, "After a heading."),
    ]
    lines = spark.createDataFrame(rows, "doc string, page int, column int, y0 double, y1 double, x0 double, style string, text string")
    found = Y.flow(lines, {"Title": "head", "Folio": ""}).orderBy("page", "n").collect()
    assert [(r.kind, r.text) for r in found] == [
        ("head", "A long title"), ("head", "Another"), ("text", "First paragraph with a broken word and a Two- Word,"), ("text", "set off by a gap goes on on the next page to its end."),
        ("text", "Indented. Goes on, too, here."), ("head", "Last"), ("text", "After a heading."),
    ]
    assert Y.flow(lines.where("false"), {"Title": "head"}).count() == 0


def test_lines_of_pages_are_dealt_once(spark):
    from quernstone.plans import repertoire as Q

    found = Q.page_flow(spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Exchange hashpartitioning")]
    assert len(dealt) == 4 and plan.count("ReusedExchange") == 1
