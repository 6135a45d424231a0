"""Near placements, searched labels and gains along lines against plain loops."""

import random

import pytest

from pyspark.sql import functions as F

from quernstone.operators import placements as P

MEN = "KQRBNPkqrbnp"


def board(rng, men):
    cells = ["."] * 64
    for i in rng.sample(range(64), men):
        cells[i] = rng.choice(MEN)
    return "".join(cells)


@pytest.mark.parametrize("crowd", [2, 200])
def test_near_placements(spark, monkeypatch, crowd):
    monkeypatch.setattr(P, "CROWD", crowd)
    rng = random.Random(crowd)
    known = [(i, board(rng, rng.choice([0, 2, 3, 5, 30]))) for i in range(120)]
    known += [(i + 500, known[i % 7][1]) for i in range(20)] + [(900, None), (901, "short"), (None, known[0][1])]
    found = []
    for n in range(200):
        cells = list(known[n % 120][1])
        for i in rng.sample(range(64), n % 6):
            cells[i] = rng.choice(MEN + ".")
        found.append((n, "".join(cells)))
    found += [(300, None), (301, "x"), (302, found[3][1]), (302, found[3][1])]
    wanted = []
    for n, cells in found:
        near = [(sum(a != b for a, b in zip(cells, own, strict=True)), -node) for node, own in known if node is not None and own and cells and len(own) == len(cells) == 64]
        best = min((x for x in near if x[0] <= 3), default=None)
        wanted.append((n, *((-best[1], best[0]) if best else (None, None))))
    frames = [spark.createDataFrame(rows, f"{k} int, cells string") for rows, k in ((found, "n"), (known, "node"))]
    assert sorted(map(tuple, P.near_placements(*frames, "n", "node", "cells").collect()), key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("most", [0, 2, 3])
def test_few_men_meet_without_crowds(spark, monkeypatch, most):
    """Boards that share nearly all of their cells: what is compared grows with their number, not with its square (F6)."""
    monkeypatch.setattr(P, "CROWD", 10)
    written, settle = [], P.Scratch.settled
    monkeypatch.setattr(P.Scratch, "settled", lambda self, df, name: written.append((name, settle(self, df, name))) or written[-1][1])
    counts = lambda: sum(df.count() for name, df in written if name == "strips")
    monkeypatch.setattr(P, "settled", lambda df, name, real=P.settled: rows.append(counts()) or real(df, name))
    rng, rows = random.Random(most), []

    def few(cells, changes):
        for i in rng.sample(range(64), changes):
            cells[i] = rng.choice("QqN.\u0085\u00c5")
        return "".join(cells)

    usual = ["."] * 60 + ["K"] * 4
    known = [(i, few(list(usual), rng.randrange(5))) for i in range(300)]
    found = [(n, few(list(known[n % 300][1]), rng.randrange(5))) for n in range(300)]
    wanted = []
    for n, cells in found:
        near = min((sum(a != b for a, b in zip(cells, own, strict=True)), -node) for node, own in known)
        wanted.append((n, -near[1], near[0]) if near[0] <= most else (n, None, None))
    frames = [spark.createDataFrame(rows, f"{k} int, cells string") for rows, k in ((found, "n"), (known, "node"))]
    assert sorted(map(tuple, P.near_placements(*frames, "n", "node", "cells", most).collect()), key=repr) == sorted(wanted, key=repr)
    assert {d for _, _, d in wanted} > set(range(most + 1)) or most == 3
    assert rows[0] <= 2 * P.STRIPS * len(known)


def cost(cells):
    total = 0
    for king, queen, pawn, men in (("K", "Q", "P", "KQRBNP"), ("k", "q", "p", "kqrbnp")):
        n = {m: sum(x == m for x in cells.values()) for m in men}
        total += 10 * abs(n[king] - 1) + 3 * max(n[pawn] - 8, 0) + 2 * max(sum(n.values()) - 16, 0)
        total += 2 * max(n[queen] - 1 - max(8 - n[pawn], 0), 0)
    return total + 4 * sum(x in "Pp" for i, x in cells.items() if i < 8 or i >= 56)


def plain_search(cells, labels, sweeps, small):
    """The same sweeps one cluster after another, each change costed on whole boards."""
    boards, size = {}, {}
    for b, i, c in cells:
        boards.setdefault(b, {})[i] = c
        size[c] = size.get(c, 0) + 1
    on = {c: {b for b, own in boards.items() if c in own.values()} for c in labels}
    costs = lambda names, some: sum(cost({i: names[c] for i, c in boards[b].items()}) for b in some)
    totals = [costs(labels, boards)]
    for _ in range(sweeps):
        better = {}
        for c, old in labels.items():
            if old == "X" or c not in size:
                continue
            for way, new in enumerate([old.swapcase(), "X"][: 2 if size[c] < small else 1]):
                change = costs(labels | {c: new}, on[c]) - costs(labels, on[c])
                if change < 0:
                    better[c] = min(better.get(c, (0, 0, "")), (change, way, new))
        taken = [c for c in better if all((better[c][0], c) <= (better[d][0], d) for d in better if on[c] & on[d])]
        if not taken:
            break
        labels = labels | {c: better[c][2] for c in taken}
        totals.append(costs(labels, boards))
    return labels, totals


def test_labels_are_searched_like_a_plain_loop(spark, tmp_path):
    rng = random.Random(8)
    cells, truth = [], {}
    for b in range(200):
        men = "Kk" + "".join(rng.sample("QRRBBNNqrrbbnn", rng.randrange(12))) + "PPPPpppp"
        for i, man in zip(rng.sample(range(8, 56), len(men)), men, strict=True):
            c = ord(man) * 100 + rng.randrange(12) + b // 20 * 20_000
            truth[c] = man
            cells.append((b, i, c))
    labels = {c: m.swapcase() if rng.random() < 0.06 else m for c, m in truth.items()}
    wanted, totals = plain_search(cells, labels, 4, 8)
    assert totals[-1] < totals[0] / 2 and all(a > b for a, b in zip(totals, totals[1:], strict=False))
    given = spark.createDataFrame(cells, "board int, square int, cluster int")
    named = spark.createDataFrame(list(labels.items()), "cluster int, label string")
    folder = str(tmp_path / "search")
    P.search_labels(given, named, 2, folder=folder)  # cut off after two sweeps
    found = P.search_labels(given, named, 4, folder=folder)
    assert {r.cluster: r.label for r in found.collect()} == wanted


def test_gains(spark):
    cells = "....k..." + "P......." + "." * 16 + "..pP...." + "." * 16 + "....K..."
    assert len(cells) == 64
    rows = [(["a7a8q"], 8), (["d4c3"], 1), ([], None), (["e1e2", "c4c3"], 0), (["d4d5", "a7b8", "d5d6"], 0)]
    rows += [(["a7e8"], 0), (["d4c4"], 1), (["e1c4", "e8d4", "c4d4"], 0)]
    frame = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(rows)], "n int, line array<string>").withColumn("cells", F.lit(cells))
    found = frame.select("n", P.line_gain(F.col("cells"), F.lit(True), F.col("line")).alias("g"), P.line_gain(F.col("cells"), F.lit(False), F.col("line")).alias("h"))
    assert {r.n: r.g for r in found.collect()} == {i: g for i, (_, g) in enumerate(rows)}
    assert all(r.h == (None if r.g is None else -r.g) for r in found.collect())
    passing = frame.limit(1).select(F.array_join(P.pushed(F.split(F.translate("cells", "p", "."), ""), F.lit("d4c5")), "").alias("c")).first().c
    assert passing.count("P") == 2 and passing[26] == "P"
