"""Operators on small frames: ties, gaps, nulls and empty inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import board as B
from quernstone.operators import activity as A
from quernstone.operators import library as L
from quernstone.operators import match as M
from quernstone.operators import merge as G
from quernstone.operators import notation as N
from quernstone.operators import points as P
from quernstone.operators import text as T
from quernstone.sources import games as S


def days(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("day", F.col("day").cast("date"))


def test_carry_forward_keeps_leading_gaps(spark):
    rows = days(
        spark,
        [(1, "2024-01-01", None), (1, "2024-01-02", 5.0), (1, "2024-01-03", None), (2, "2024-01-01", None)],
        "u int, day string, v double",
    )
    got = {(r.u, r.day.day): (r.v, r.real) for r in A.carry_forward(rows, "u", "day", "v").collect()}
    assert got == {(1, 1): (None, False), (1, 2): (5.0, True), (1, 3): (5.0, False), (2, 1): (None, False)}


def test_streak_ends_today_or_yesterday(spark):
    rows = days(
        spark,
        [("a", "2024-03-01"), ("a", "2024-02-29"), ("a", "2024-02-28"), ("b", "2024-02-29"), ("c", "2024-02-20"), ("c", "2024-02-20")],
        "user_id string, day string",
    )
    assert {r.user_id: (r.streak, r.longest) for r in A.live_streaks(rows).collect()} == {"a": (3, 3), "b": (1, 1), "c": (0, 1)}
    assert A.live_streaks(rows.where("false")).count() == 0


def test_latest_merge_prefers_local_on_ties(spark):
    local, cloud = spark.createDataFrame([(1, 5, "l"), (2, 1, "l")], "k int, t int, v string"), spark.createDataFrame(
        [(1, 5, "c"), (2, 9, "c"), (3, 0, "c")], "k int, t int, v string"
    )
    assert {r.k: r.v for r in G.merge_latest(local, cloud, ["k"], F.col("t"), ["t", "v"]).collect()} == {1: "l", 2: "c", 3: "c"}


def test_override_takes_whole_values(spark):
    local, cloud = spark.createDataFrame([(1, None, 2)], "k int, a int, b int"), spark.createDataFrame(
        [(1, 7, 8), (2, 7, 8)], "k int, a int, b int"
    )
    assert {r.k: (r.a, r.b) for r in G.merge_override(local, cloud, ["k"], ["a", "b"]).collect()} == {1: (None, 2), 2: (7, 8)}


def test_except_falls_back_to_all(spark):
    pool = spark.createDataFrame([(1,), (2,)], "k int")
    assert G.except_or_all(pool, pool, "k").count() == 2
    assert [r.k for r in G.except_or_all(pool, pool.where("k = 1"), "k").collect()] == [2]


def loop_point(ev, gain, hero_white, white_starts):
    """The rule as a plain loop."""
    pov = [None if e is None else e if hero_white else -e for e in ev]
    mine = lambda i: ((i % 2 == 0) == white_starts) == hero_white
    least = lambda xs: min((x for x in xs if x is not None), default=None)
    first = next((i for i in range(len(ev)) if mine(i) and pov[i] is not None and pov[i] >= 200 and least(pov[i : i + 7]) >= 150), None)
    if first is None:
        return None, "none", False
    if pov[first] >= 700:
        return first, "jump", False
    k = next(
        (
            i for i in range(first, min(first + 12, len(ev))) if mine(i) and pov[i] is not None and 150 <= pov[i] < 700 and not (
                gain[i] is not None and gain[i] >= 2
            )
        ),
        None,
    )
    if k is None:
        return first, "tactic", False
    if len(ev) - 1 - k < 20:
        return k, "short", False
    return k, "ok", least(pov[k:]) < 80


def test_advantage_point_is_the_loop(spark):
    rng, rows, expected = random.Random(8), [], {}
    for game in range(120):
        white, starts, value, ev, gain = rng.random() < 0.5, rng.random() < 0.5, 0, [], []
        for _ in range(rng.randint(1, 70)):
            value += rng.randint(-90, 110) * (1 if white else -1)
            ev.append(None if rng.random() < 0.05 else value * (4 if game % 9 == 0 else 1))
            gain.append(rng.choice([None, 0, 3] if game % 5 else [3]))
        expected[game] = loop_point(ev, gain, white, starts)
        rows += [(game, i, e, white, starts, g) for i, (e, g) in enumerate(zip(ev, gain, strict=True))]
    frame = spark.createDataFrame(rows, "game int, i int, ev int, hero_white boolean, white_starts boolean, gain int")
    assert {r.game: (r.k, r.verdict, r.swing) for r in P.advantage_points(frame).collect()} == expected
    assert {v for _, v, _ in expected.values()} == {"none", "jump", "tactic", "short", "ok"}


def test_board_strings_round_trip(spark):
    rng = random.Random(9)
    boards = ["".join(rng.choices(".pnbrqkPNBRQK", weights=[20] + [1] * 12, k=64)) for _ in range(200)]
    frame = spark.createDataFrame([(b,) for b in boards], "cells string")
    assert [r.x for r in frame.select(B.expand(B.compress(F.col("cells"))).alias("x")).collect()] == boards


def test_brackets_of_any_depth(spark):
    frame = spark.createDataFrame([("a (b [c] (d)) e ] f",), ("",), (None,)], "t string")
    assert [r.x for r in frame.select(T.strip_brackets(F.col("t")).alias("x")).collect()] == ["a  e  f", "", None]


@pytest.mark.parametrize("block", [3, 4096])
def test_nearest_rows_are_the_brute_force_ones(spark, block, monkeypatch):
    rng = random.Random(10)
    vectors = [(i, [float(rng.randint(0, 9)) for _ in range(4)]) for i in range(80)]
    frame = spark.createDataFrame(vectors, "k int, v array<double>")
    monkeypatch.setattr(M, "BLOCK", block)
    near = M.nearest_rows(frame.where("k % 20 = 0"), frame, "k", "v", 3, apart=("k",))
    got = {}
    for r in near.collect():
        got.setdefault(r.q_key, []).append((r.n, r.k))
    for q in range(0, 80, 20):
        best = sorted((sum((a - b) ** 2 for a, b in zip(vectors[q][1], v, strict=True)), k) for k, v in vectors if k != q)[:3]
        assert [k for _, k in sorted(got[q])] == [k for _, k in best]


def test_exact_quantiles_are_numpys(spark):
    import numpy as np

    rng = random.Random(11)
    rows = [(rng.choice("abc"), rng.choice([None, *range(30)])) for _ in range(400)] + [("d", 7), ("e", None)]
    frame = spark.createDataFrame(rows, "g string, v int")
    got = {r.g: (r.low, r.mid, r.n) for r in M.exact_quantiles(frame, "v", {"low": 0.13, "mid": 0.5}, ("g",)).collect()}
    for g in "abcd":
        values = [v for k, v in rows if k == g and v is not None]
        assert np.allclose(got[g], (np.quantile(values, 0.13), np.quantile(values, 0.5), len(values)))
    assert "e" not in got
    assert np.isclose(M.exact_quantiles(frame, "v", {"m": 0.9}).first().m, np.quantile([v for _, v in rows if v is not None], 0.9))


def test_many_classes_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(12)
    rows = spark.createDataFrame([(i, [rng.random() for _ in range(3)]) for i in range(50)], "k int, v array<double>")
    means = spark.createDataFrame([(c, [rng.random() for _ in range(3)]) for c in range(9)], "c int, mean array<double>")
    few = {r.k: (r.nearest, r.margin) for r in M.nearest_class(rows, means, "k", "v", "c").collect()}
    monkeypatch.setattr(M, "MOST_CLASSES", 4)
    monkeypatch.setattr(M, "BLOCK", 20)
    assert {r.k: (r.nearest, r.margin) for r in M.nearest_class(rows, means, "k", "v", "c").collect()} == few


def test_frames_that_share_a_thin_shape(spark):
    shapes = [(1, 0.0, 100.0, 12.0 * k, 12.0 * k + (1 if k % 9 == 0 else 10)) for k in range(28)]
    found = M.frames_of_ten(spark.createDataFrame(shapes, "page int, x0 double, x1 double, y0 double, y1 double"), "page", ["y0"])
    assert sorted(r.top for r in found.collect()) == [0.0, 216.0]


def test_notation(spark):
    one = lambda f, text: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one(N.plain_notation, "12 . ... Nf3 13. e4 d5 : e4") == "12...Nf3 13.e4 d5xe4"
    assert [tuple(a) for a in one(N.answers_by_number, "1.\n1.e4 e5\n 2.Nf3\n2. 4.d4\n")] == [(1, "1.e4 e5 2.Nf3"), (2, "4.d4")]
    assert one(N.lead_bold, "12.Nf3 Nc6 is best") == "**12.Nf3 Nc6** is best" and one(N.lead_bold, "No move") == "No move"
    assert one(N.answers_by_number, None) is None and one(N.plain_notation, "") == ""


def test_files_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.pgn").write_bytes(b'[Event "\xff"]\n\n1. e4 e5 1-0\n')
    (tmp_path / "b.pgn").write_bytes(b'1. d4 *\n\n  [Event "x"]\n1. c4 (1. f4 ; c5) c5 ; Nf3\n0-0 *')
    rows = S.read_games(S.read_files(spark, str(tmp_path))).collect()
    assert sorted(
        (r.headers.get("Event"), tuple(r.moves)) for r in rows if r.headers
    ) == [("x", ("c4", "c5", "0-0")), ("\ufffd", ("e4", "e5"))]
    assert [r.moves for r in rows if not r.headers] == [["d4"]]


def test_new_items_are_those_without_attempts(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    tries = spark.createDataFrame(
        [(1, False, True, True, 0, 5), (2, True, True, True, 0, 9)],
        "k int, rev boolean, win boolean, fair boolean, mistakes int, t int",
    )
    assert {
        r.k: (r.status, r.last_try) for r in L.statuses(items, tries, "k").collect()
    } == {1: ("clean", 5), 2: ("new", 9), 3: ("new", None)}


def test_quantiles_of_one_value_many_times(spark):
    frame = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = M.exact_quantiles(frame, "v", {"low": 0.2, "high": 0.95}).first()
    values = [5.0 if i % 10 < 9 else float(i) for i in range(20_000)]
    assert (got.low, got.n) == (5.0, 20_000) and np.isclose(got.high, np.quantile(values, 0.95))


def test_many_templates_are_matched_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, i % 2, rng.random(9).tolist()) for i in range(80)], "k int, s int, v array<double>")
    found = spark.createDataFrame([(c, c % 2, rng.random(9).tolist()) for c in range(11)], "g int, s int, mean array<double>")
    shown = lambda: sorted((r.k, r.nearest, round(r.d, 9), round(r.margin, 9)) for r in M.match_templates(rows, found, "k", "v", "g", "s", 2).collect())
    few = shown()
    monkeypatch.setattr(M, "MOST_CLASSES", 3)
    assert len(few) == 80 and shown() == few


def test_brackets_of_long_texts_go_as_in_a_plain_loop(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("()[]ab ", k=k)) for k in (0, 1, 5, 40, 40, 600, 3000)] + ["(" * 2000 + ")" * 1999, "x(y)" * 9000]

    def outside(text):
        depth, out = 0, []
        for c in text:
            depth = depth + 1 if c in "([" else max(0, depth - 1) if c in ")]" else depth
            out.append("" if depth or c in "()[]" else c)
        return "".join(out)

    def pairs(text):
        waiting, match = [], {}
        for i, c in enumerate(text):
            if c == "(":
                waiting.append(i)
            elif c == ")" and waiting:
                match[waiting.pop()] = i
        out, i = [], 0
        while i < len(text):
            out.append(" " if i in match else text[i])
            i = match.get(i, i) + 1
        return "".join(out)

    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = frame.select("t", T.strip_brackets(F.col("t")).alias("a"), T.strip_pairs(F.col("t")).alias("b")).collect()
    assert all(r.a == outside(r.t) and r.b == pairs(r.t) for r in found) and len(found) == len(texts)


def test_variations_of_any_depth(spark):
    deep = "1. e4 " + "(1. d4 {[%eval 0.10]} " * 12 + ")" * 12 + " e5 {[%eval 0.35]} 2. Nf3 {:( here} Nc6"
    row = S.read_games(spark.createDataFrame([(f'[Event "x"]\n\n{deep}',)], "value string")).first()
    assert row.moves == ["e4", "e5", "Nf3", "Nc6"] and [(e["at"], e["cp"]) for e in row.evals] == [(2, 35)]
    texts = ["a (b (c) d", "a) (b) c", "((a)(b)) c", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in frame.select(T.strip_pairs(F.col("t")).alias("x")).collect()] == ["a (b   d", "a)   c", "  c", "", None]


def test_a_game_is_read_once_in_few_pieces(spark, monkeypatch):
    """One pass finds what a game says, for moves and evaluations alike; a fold's piece is no single bracket (F9)."""
    sizes, fold = [], T.folded
    monkeypatch.setattr(T, "folded", lambda pieces, step, **more: sizes.append(pieces) or fold(pieces, step, **more))
    text = "{[%eval 1]} 1. e4 {[%eval 0.5]} {no} {[%eval #-3]} e5 {[%eval .]} {[%eval 1.2.3]} " + "(a {[%eval 9]} " * 50 + "))) x" + ")" * 47 + " 2. Nf3 {[%eval #2]}"
    frame = spark.createDataFrame([(text,), (None,)], "value string")
    games = S.read_games(frame)
    (row,) = games.collect()
    assert row.moves == ["e4", "e5", "Nf3"]
    assert [(e["at"], e["cp"]) for e in row.evals] == [(1, 50), (1, -9997), (2, None), (2, None), (3, 9998)]
    bare = spark.createDataFrame([(None,)], "value string").select(S.moves(F.col("value")).alias("m"), S.evaluations(F.col("value")).alias("e")).first()
    assert (bare.m, bare.e) == (None, None)
    assert games._jdf.queryExecution().optimizedPlan().toString().count(S.PIECE) == 1
    sizes.clear()
    T.strip_pairs(F.col("value"))
    assert frame.limit(1).select(F.size(sizes[0])).first()[0] < 70


def test_path_to_root_of_any_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(100)]
    odd = [(200, 201), (201, 200), (202, 200), (210, 210), (220, 999), (221, 220), (300, None)]
    frame = spark.createDataFrame(chain + odd, "k long, up long")
    got = {r.k: (r.root, r.depth) for r in M.path_to_root(frame, "k", "up").collect()}
    lost = dict.fromkeys((200, 201, 202, 210, 220, 221), (None, None))
    assert got == {i: (0, i) for i in range(100)} | lost | {300: (300, 0)}
    assert M.path_to_root(
        frame.where("k = 210"), "k", "up"
    ).collect() == [(210, None, None)] and M.path_to_root(frame.where("false"), "k", "up").count() == 0


def test_empty_frames(spark):
    none = spark.createDataFrame([], "game int, i int, ev int, hero_white boolean, white_starts boolean, gain int")
    assert P.advantage_points(none).count() == 0 and P.game_summaries(P.move_losses(none)).count() == 0


def test_scratch_tables_go_when_they_are_released(spark):
    import os

    from quernstone import scratch

    kept = scratch.settled(spark.range(3), "kept")
    path = scratch.WRITTEN[spark.sparkContext.applicationId][-1]
    with scratch.Scratch(spark) as own:
        own.settled(spark.range(3), "own")
        inside = own.paths[0]
        assert os.path.isdir(inside)
    assert kept.count() == 3 and not os.path.isdir(inside)
    scratch.release(spark)
    assert not os.path.isdir(path)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from quernstone import scratch

    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_tables_are_numbered_over_their_pieces(spark, tmp_path):
    """Parts of one brand on both sides of a thousand are one table; the SQL numbers whole brands."""
    import duckdb

    from quernstone.plans import games as Q
    from tests.duck import same

    parts = spark.range(4000).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit(" name "), F.col("id").cast("string")).alias("p_name"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("Brand#"), F.col("id") % 3)).alias("p_brand")
    )
    parts.where("p_partkey > 1500 or p_partkey % 3 = 1").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    found = Q.markdown_table(spark, str(tmp_path))
    same(found, con, Q.SQL["markdown_table"])
    assert found.columns == ["p_brand", "n", "cells"] and found.where("p_brand = 'Brand#1'").agg(F.max("n")).first()[0] == 1333
