"""Chat windows against plain loops: long conversations in blocks, control strings, ties and nulls."""

import random
import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from quernstone.llm import chat_windows as cw

SCHEMA = "conv_id long, turn long, role string, text string, block int, t string"
SAID = ["", None, "a", "### user: no", "####", "</turn>\n", "\\", "\\b\\h\\l\\c", "ends with \\", "one two three four five", "é 🙂, 漢字!", "x " * 30]


def pieces(role, text):
    coded = lambda x: re.sub("#(?=##)", r"\\h", x.replace("\\", "\\b")).replace("</turn>", "\\l/turn>")
    head = f"### {coded(role).replace(':', chr(92) + 'c')}: "
    body = coded(text)
    return head, body, head + body + "</turn>\n"


def plain_windows(rows, budget, history, history_tokens, block):
    """(conversation, windows): text, turns, context, targets, one turn after another."""
    talks = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        talks[conv].append(((turn is not None, turn or 0), role or "", *pieces(role or "", text or "")))
    for conv, said in talks.items():
        said.sort(key=lambda x: (x[0], x[1], x[4]))
        count = lambda piece: sum(c == "_" for c in re.sub(r"[^\W_]+|[^\w\x20\x09-\x0D]", "_", piece))
        tokens = [count(piece) for *_, piece in said]
        led = said[0][1] == "system"
        room = budget - history_tokens - (tokens[0] if led else 0)
        starts = [0]
        for i in range(1, len(said)):
            allowed = budget if starts[-1] == 0 else room
            if i % block == 0 or sum(tokens[starts[-1] : i + 1]) > allowed:
                starts.append(i)
        out = []
        for f, u in zip(starts, [*starts[1:], len(said)], strict=True):
            since = f
            while since > led and f - since < history and sum(tokens[since - 1 : f]) <= history_tokens:
                since -= 1
            shown = ([0] if led and f else []) + list(range(since, u))
            text, targets = "", []
            for i in shown:
                _, role, head, body, piece = said[i]
                if i >= f and role == "assistant":
                    targets.append((len(text) + len(head), len(body)))
                text += piece
            out.append((text, len(shown), len(shown) - (u - f), sum(tokens[i] for i in shown), targets))
        yield conv, out


def talk(rng, conv, n, led):
    rows = [(conv, -1, "system", "You help. ### </turn>")] if led else []
    return rows + [(conv, i, rng.choice(["user", "assistant", "a: b", None]), rng.choice(SAID)) for i in range(n)]


@pytest.mark.parametrize("budget, history, history_tokens, block", [(60, 2, 20, 256), (60, 3, 30, 7), (5, 1, 2, 4), (200, 0, 0, 5)])
def test_windows_are_those_of_plain_loops(spark, budget, history, history_tokens, block):
    rng = random.Random(budget + block)
    rows = [r for conv in range(12) for r in talk(rng, conv, rng.choice([1, 3, 9, 40, 50]), conv % 2)]
    rows += talk(rng, None, 9, True) + [(50, None, "assistant", "first"), (50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (51, 1, "system", "x")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    found = defaultdict(list)
    made = cw.format_windows(table, budget, history, history_tokens, block)
    for r in sorted(made.collect(), key=lambda r: (r.block, r.window)):
        found[r.conv_id].append((r.text, r.n_turns, r.n_context, r.n_tokens, [tuple(x) for x in r.targets]))
    assert dict(found) == dict(plain_windows(rows, budget, history, history_tokens, block))
    back = cw.read_back(made).collect()
    for r in back:
        said = sorted(((t is not None, t or 0), ro or "", pieces(ro or "", te or "")[2], te or "") for c, t, ro, te in rows if c == r.conv_id)
        assert r.n_turns == len(said) and r.formatted_chars == sum(len(w[0]) for w in found[r.conv_id])
        assert r.loss_chars == sum(len(te) for _, ro, _, te in said if ro == "assistant")
    assert len(back) == len(found)


def test_texts_and_roles_come_back(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["\\", "#", "</turn>", "\n", "b", "h", "l", "c", ":", " ", "é"], k=rng.randrange(12))) for _ in range(600)]
    table = spark.createDataFrame([(i, i, "assistant" if i % 2 else t, t, 0, "") for i, t in enumerate(texts)], SCHEMA)
    windows = cw.format_windows(table)
    turns = windows.select("conv_id", cw.turns_read(F.col("text"), F.col("n_context"), F.col("n_turns")).alias("x")).collect()
    assert {r.conv_id: [tuple(x) for x in r.x] for r in turns} == {i: [("assistant" if i % 2 else t, t)] for i, t in enumerate(texts)}
    under = windows.select("conv_id", cw.read(F.substr("text", F.col("targets")[0]["start"] + 1, F.col("targets")[0]["length"])).alias("x"))
    assert {r.conv_id: r.x for r in under.where("conv_id % 2 = 1").collect()} == {i: t for i, t in enumerate(texts) if i % 2}


def test_empty_tables_and_very_long_turns(spark):
    table = spark.createDataFrame([(1, 0, "user", "w " * 200_000, 0, ""), (1, 1, "assistant", "#" * 50_000, 0, "")], SCHEMA)
    assert cw.format_windows(table.where("false")).count() == 0
    rows = cw.format_windows(table).orderBy("window").collect()
    assert [(r.n_turns, r.n_context) for r in rows] == [(1, 0), (1, 0)]
    back = cw.read_back(cw.format_windows(table)).collect()[0]
    assert back.loss_chars == 50_000


def test_no_python_runs(spark):
    table = spark.createDataFrame([(1, 0, "user", "x", 0, "")], SCHEMA)
    plan = cw.read_back(cw.format_windows(table))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
