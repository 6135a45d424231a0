"""Row numbers within groups, on hot groups, ties, nulls and empty tables."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quernstone.operators.ranking import numbered

SCHEMA = "g string, v int, __n int"


def test_numbers_are_those_of_sorted_groups(spark):
    rng = random.Random(3)
    rows = [("hot", 5, 0)] * 300 + [(rng.choice(["hot", "a", None]), rng.choice([None, *range(9)]), i) for i in range(900)]
    given = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = numbered(given, ["g"], ["v", -F.col("__n")], "at", parts=7)
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    wanted = Counter()
    for own in groups.values():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, -r[2]))
        wanted.update((*r, at) for at, r in enumerate(own))
    assert Counter(map(tuple, found.collect())) == wanted
    assert found.columns == ["g", "v", "__n", "at"]


def test_one_row_many_times_is_dealt_over_parts(spark):
    given = spark.createDataFrame([("x", 1, 1)] * 2000, SCHEMA).repartition(4)
    found = numbered(given, [], ["v"], parts=8)
    assert sorted(r.n for r in found.collect()) == list(range(2000))
    assert numbered(given.where("false"), ["g"], ["v"]).count() == 0
