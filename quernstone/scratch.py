"""Tables in the folder that all executors share, from which later steps restart."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables written by this process that nothing has deleted yet, by application.
WRITTEN: dict[str, list[str]] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where none is set on a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-quernstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame, name: str, used: list[str] | None = None) -> DataFrame:
    """df written once to the shared folder and read again: later steps restart from here, not from the input."""
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    (WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []) if used is None else used).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_until_release(spark: SparkSession, path: str) -> str:
    """A folder that a job writes by itself, named here so that `release` deletes it, too."""
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


class Scratch:
    """Tables that an operator writes for itself and deletes once its own result is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def settled(self, df: DataFrame, name: str) -> DataFrame:
        return settled(df, name, self.paths)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.paths)


def delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        folder.getFileSystem(conf).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Deletes what operators wrote for the results they returned; to be called when those results are stored elsewhere.

    A result that is a written table, or reads one, is gone then.
    """
    delete(spark, WRITTEN.pop(spark.sparkContext.applicationId, []))
