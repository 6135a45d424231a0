"""Readers of the tables that queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their calendar day."""
    return table(spark, folder, "events").withColumn("day", F.to_date("ts"))


def last_day(frame: DataFrame, day: str = "day") -> DataFrame:
    """One row: the greatest day, which stands for today."""
    return frame.agg(F.max(day).alias("today"))


def with_today(frame: DataFrame, day: str = "day") -> DataFrame:
    """Every row with the greatest day; the one-row side is broadcast."""
    return frame.crossJoin(F.broadcast(last_day(frame, day)))


def js_round(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + F.lit(0.5)).cast("long")
