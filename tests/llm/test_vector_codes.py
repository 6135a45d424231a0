"""Vector codes against plain integer loops, on ties, repeats, odd vectors and few rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from quernstone.llm import vector_codes as vc

SCHEMA = "vec_id long, label int, embedding array<float>, code string, error int"


def plain_codes(rows, parts, entries, rounds):
    """Codes, errors and codebooks, one vector and one component after another."""
    kept = [(i, lab, v) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    firsts = sorted((i, v) for i, _, v in kept if i is not None)
    dims = len(firsts[0][1]) if firsts else 0
    if not dims or dims % parts:
        return Counter((i, lab, None, None) for i, lab, _ in kept), [[] for _ in range(parts)]
    d = dims // parts
    cut = lambda v: [[math.floor(1024 * float(np.float32(x))) for x in v[p * d : p * d + d]] for p in range(parts)]
    fits = [(i, lab, cut(v)) for i, lab, v in kept if len(v) == dims]
    books = [[cut(v)[p] for _, v in [x for x in firsts if len(x[1]) == dims][:entries]] for p in range(parts)]

    def assign(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, c, strict=True)) for c in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, _, v in fits:
                members.setdefault(assign(v[p], books[p])[0], []).append(v[p])
            books[p] = [[sum(c) // len(c) for c in zip(*members[e], strict=True)] if e in members else old for e, old in enumerate(books[p])]
    out = Counter((i, lab, None, None) for i, lab, v in kept if len(v) != dims)
    for i, lab, v in fits:
        found = [assign(part, books[p]) for p, part in enumerate(v)]
        out[i, lab, "".join(f"{e:02x}" for e, _ in found), sum(far for _, far in found)] += 1
    return out, books


@pytest.mark.parametrize("n, entries, far", [(3, 256, 1), (300, 16, 1), (300, 256, 40), (40, 4, 3000)])
def test_codes_are_those_of_plain_loops(spark, n, entries, far):
    rng = random.Random(n + entries)
    coarse = lambda: [rng.randint(-8, 8) * far / 16 for _ in range(8)]  # many ties
    rows = [(i * 7 % n, rng.choice([None, 1, 2]), coarse()) for i in range(n)]
    rows += [(n + 1, 1, None), (n + 2, 1, [None] * 8), (n + 3, 2, [float("nan")] + [0.0] * 7), (n + 4, 2, [float("-inf")] * 8)]
    rows += [(n + 5, 3, [1.0] * 4), (n + 6, 3, []), (None, 3, coarse()), rows[0], (rows[1][0], 9, coarse())]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(3)
    codes, books = vc.compress(table, "vec_id", "label", "embedding", entries=entries, rounds=3)
    wanted, plain = plain_codes(rows, 4, entries, 3)
    assert Counter(map(tuple, codes.collect())) == wanted
    assert books.tolist() == plain
    assert vc.books_digest(books) == vc.books_digest(np.array(plain))
    sums = Counter()
    for (_, lab, _, error), times in wanted.items():
        sums[lab] += times * (error or 0)
    assert {r.label: r.label_error for r in vc.with_label_errors(codes, "label").collect()} == dict(sums)


def test_a_code_stands_for_its_entries(spark):
    table = spark.createDataFrame([(i, 0, [i / 4, -i / 2, 0.25, 1.0], "", 0) for i in range(9)], SCHEMA)
    codes, books = vc.compress(table, "vec_id", "label", "embedding")  # an entry for each vector
    back = codes.select("vec_id", vc.decoded(F.col("code"), books).alias("v"), "error").collect()
    assert {r.vec_id: r.v for r in back} == {i: [i / 4, -i / 2, 0.25, 1.0] for i in range(9)} and not any(r.error for r in back)


def test_tables_without_vectors(spark):
    table = spark.createDataFrame([(1, 1, [1.0, 2.0], "", 0)], SCHEMA)
    codes, books = vc.compress(table.where("false"), "vec_id", "label", "embedding")
    assert codes.count() == 0 and books.size == 0
    odd, _ = vc.compress(table, "vec_id", "label", "embedding")  # two components, four parts
    assert [tuple(r) for r in odd.collect()] == [(1, 1, None, None)]


def test_huge_components_are_held(spark):
    table = spark.createDataFrame([(i, 0, [s * 3e38] * 4, "", 0) for i, s in enumerate([1, -1])], SCHEMA)
    codes, books = vc.compress(table, "vec_id", "label", "embedding", entries=1, rounds=0)
    most = math.isqrt(2**60 // 4)
    assert books.ravel().tolist() == [most] * 4
    assert sorted(r.error for r in codes.collect()) == [0, 4 * (2 * most) ** 2]
