"""One way to open a session for tests, benches and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def open_session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with UTC, AQE and Arrow; on a cluster the caller's own session is used instead."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "6g"),
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quernstone")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
