"""The newest rows within a budget from a table that is laid out by month: months are read from the newest on until the budget is met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch


def months_of(spark: SparkSession, folder: str, month: str) -> list[str]:
    """The months that a folder has, the newest first. Folders are named month=2024-01."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [x.getPath().getName() for x in found if x.isDirectory()]
    return sorted((n.partition("=")[2] for n in names if n.startswith(f"{month}=")), reverse=True)


def write_by_month(rows: DataFrame, at: str, month: str, folder: str) -> None:
    """Rows laid out by month, a few files for each; rows without a time are in the month 0000-00, the last to be read."""
    named = rows.withColumn(month, F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("0000-00")))
    named.repartition(month, F.pmod(F.xxhash64(*rows.columns), F.lit(4))).write.partitionBy(month).parquet(folder)


def newest_within(
    spark: SparkSession, folder: str, month: str, order: list[str], most: int, wanted: Column | None = None, who: DataFrame | None = None
) -> DataFrame:
    """The `most` newest wanted rows, or those of each row of `who` (keys that the table has too).

    A month is looked at in the columns of keys and filter alone, and only its counts for those who lack rows are kept; the
    search ends with the month in which nobody lacks any. The result is one plan over the months read. `order` is from
    the newest down: of equal months the greater values first.
    """
    keys = list(who.columns) if who is not None else []
    at = lambda m: spark.read.option("basePath", folder).parquet(*(f"{folder}/{month}={x}" for x in m)).where(wanted if wanted is not None else F.lit(True))
    lacking, read = most, []
    with Scratch(spark) as scratch:
        left = scratch.settled(who.distinct().withColumn("__left", F.lit(most).cast("long")), "lacking") if who is not None else None
        for name in months_of(spark, folder, month):
            if lacking <= 0 if left is None else left.isEmpty():
                break
            read.append(name)
            if left is None:
                lacking -= at([name]).limit(lacking).count()
            else:
                more = at([name]).groupBy(*keys).agg(F.count("*").alias("__n"))
                rest = (F.col("__left") - F.coalesce("__n", F.lit(0))).alias("__left")
                left = scratch.settled(left.join(more, keys, "left").select(*keys, rest).where("__left > 0"), "lacking")
    if not read:
        return at(months_of(spark, folder, month)[:1]).limit(0)
    rows, newest = at(read), [F.desc(month), *(F.desc(c) for c in order)]
    if who is None:
        return rows.orderBy(*newest).limit(most)
    ranked = rows.join(who.distinct(), keys, "left_semi").withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*newest)))
    return ranked.where(F.col("__n") <= most).drop("__n")
