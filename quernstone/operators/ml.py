"""Clusters and principal components by Spark's own estimators."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project(rows: DataFrame, vector: str, size: int, every: int, key: str) -> DataFrame:
    """Adds `projected`: the first components, fitted on every n-th row by hash of the key."""
    ready = rows.withColumn("__v", array_to_vector(vector))
    model = PCA(k=size, inputCol="__v", outputCol="__p").fit(ready.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0))
    return model.transform(ready).withColumn("projected", vector_to_array("__p")).drop("__v", "__p")


def fitted(rows: DataFrame, vector: str, size: int, seed: int) -> KMeansModel:
    return KMeans(k=size, seed=seed, featuresCol="__v", predictionCol="__c", maxIter=10).fit(rows.select(array_to_vector(vector).alias("__v")))


def clusters(rows: DataFrame, vector: str, size: int, seed: int = 1) -> DataFrame:
    """Adds `cluster`: more clusters than classes, to be named afterwards; numbered by size, the largest first."""
    found = fitted(rows, vector, size, seed).transform(rows.withColumn("__v", array_to_vector(vector)))
    order = found.groupBy("__c").agg(F.count("*").alias("n")).select(
        "__c", F.array_sort(F.array(F.struct((-F.col("n")).alias("n"), "__c")))[0].alias("o")
    )
    ranked = order.agg(F.array_sort(F.collect_list("o")).alias("os")).select(F.posexplode("os").alias("cluster", "o")).select("cluster", F.col("o.__c").alias("__c"))  # k rows
    return found.join(F.broadcast(ranked), "__c").drop("__v", "__c")


def split_cluster(found: DataFrame, vector: str, cluster: int, size: int, seed: int = 1) -> DataFrame:
    """The rows of `clusters` with one mixed cluster put into clusters of its own, numbered on from the greatest number, the largest keeping the old one."""
    mixed = found.where(F.col("cluster") == cluster)
    last = found.agg(F.max("cluster")).first()[0]
    parts = clusters(mixed.drop("cluster"), vector, size, seed)
    number = F.when(F.col("cluster") == 0, F.lit(cluster)).otherwise(F.col("cluster") + last)
    return found.where(F.col("cluster") != cluster).unionByName(parts.withColumn("cluster", number).select(*found.columns))
