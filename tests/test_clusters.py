"""Clusters: rows are with the nearest of the centres, one cluster is split alone, densities are those of the groups found."""

from collections import Counter

import numpy as np

from quernstone.operators import ml
from quernstone.plans import queries

FOLDER = "/root/testdata/sf0.01"


def test_rows_are_with_the_nearest_centre(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    centres = np.array(ml.fitted(rows, "embedding", 12, 1).clusterCenters())
    nearest = {i: int(((centres - v) ** 2).sum(1).argmin()) for i, v in vectors.items()}
    found = {r.vec_id: r.cluster for r in ml.clusters(rows, "embedding", 12).collect()}
    assert len({(nearest[i], found[i]) for i in vectors}) == 12 == len(set(found.values()))
    sizes = Counter(found.values())
    assert [sizes[k] for k in range(12)] == sorted(sizes.values(), reverse=True)
    cost = sum(((centres[nearest[i]] - v) ** 2).sum() for i, v in vectors.items())
    whole = np.array(list(vectors.values()))
    assert cost < ((whole - whole.mean(0)) ** 2).sum()


def test_one_cluster_is_split_alone(spark):
    before, after = ({r.vec_id: r.cluster for r in queries()[q](spark, FOLDER).collect()} for q in ("kmeans_assign", "split_cluster"))
    assert before.keys() == after.keys() and all(after[i] == c for i, c in before.items() if c)
    assert {after[i] for i, c in before.items() if not c} == {0, 12, 13}


def test_densities_of_groups_that_are_found(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    rows = queries()["dense_groups"](spark, FOLDER).collect()
    means = [np.mean([vectors[r.vec_id] for r in rows if r.cluster == k], axis=0) for k in (0, 1)]
    places = np.argsort(-(means[0] - means[1]), kind="stable")[:10]
    assert len(rows) == len(vectors)
    assert all(abs(r.density - vectors[r.vec_id][places].mean()) < 1e-4 and r.dense == (vectors[r.vec_id][places].mean() > 0) for r in rows)
