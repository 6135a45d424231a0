"""Streams of progress: what grew since the last snapshot, quiet periods, daily windows, resumable jobs.

Functions take and return DataFrames, so each runs on a stream and, where it keeps no state, on a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIELDS = ("solved", "stars", "errs")


class Growth(StatefulProcessor):
    """Keeps each key's last snapshot and gives what the next one has more. A snapshot that is no newer than the last changes nothing."""

    def __init__(self, key: str, fields: tuple[str, ...]):
        self.key, self.fields = key, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", ", ".join(f"{n} long" for n in ("at", *self.fields)))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        if not self.last.exists() or self.last.get()[0] < initialState["at"]:
            self.last.update((initialState["at"], *(initialState[f] for f in self.fields)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before = tuple(self.last.get()) if self.last.exists() else None
        for now in sorted((row["at"], *(row[f] for f in self.fields)) for row in rows):  # those of one key in one batch
            if before is not None and now[0] <= before[0]:
                continue
            change = [max(0, b - a) for a, b in zip(before or now, now, strict=True)][1:]
            if any(change):
                yield Row(**dict(zip((self.key, "at", *self.fields), (key[0], now[0], *change), strict=True)))
            before = now
        if before is not None:
            self.last.update(before)


def keep_state(spark: SparkSession) -> None:
    """State stores in RocksDB, which `grown` needs; to be set before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def grown(snapshots: DataFrame, key: str = "user_id", fields: tuple[str, ...] = FIELDS, baseline: DataFrame | None = None) -> DataFrame:
    """Of a stream of snapshots: key, at and what each field grew by since the key's last snapshot.

    What a key had before the stream began comes from `baseline` (key, at, fields), the initial state; without one there, a
    key's first snapshot is its baseline. Columns key, at and fields are longs.
    """
    names = [key, "at", *fields]
    first = baseline.select(*names).groupBy(key) if baseline is not None else None
    return snapshots.select(*names).groupBy(key).transformWithState(
        Growth(key, fields), ", ".join(f"{n} long" for n in names), "append", "None", first
    )


def settled_writes(
    writes: DataFrame, key: str, at: str, value: str, quiet: str = "1500 milliseconds", late: str = "10 seconds"
) -> DataFrame:
    """The last write of each burst: a burst ends when the key is quiet for so long."""
    rows = writes.withWatermark(at, late) if writes.isStreaming else writes
    bursts = rows.groupBy(key, F.session_window(at, quiet).alias("w")).agg(
        F.max_by(value, F.struct(at, value)).alias(value), F.count("*").alias("writes")
    )
    return bursts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), value, "writes")


def per_day(rows: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Counts by day and keys."""
    rows = rows.withWatermark(at, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(at, "1 day").alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.to_date("w.start").alias("day"), *keys, "n"
    )


def growth(snapshots: DataFrame, key: str = "user_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """What `grown` gives, for a table of snapshots: the same rows by a window instead of kept state."""
    by = W.partitionBy(key).orderBy("at")
    change = [F.greatest(F.lit(0), F.col(f) - F.lag(f).over(by)).cast("long").alias(f) for f in fields]
    first = F.row_number().over(by) == 1
    rows = snapshots.select(key, "at", *change, first.alias("__first"))
    return rows.where(~F.col("__first") & (F.greatest(*fields, F.lit(0)) > 0)).drop("__first")


def written(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def resumable(done: str, key: str, work: Callable[[DataFrame], DataFrame], rows_in_file: int = 0) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: works on what earlier batches lack and writes it as the batch's own part of `done`.

    With a number of rows, a part's files hold so many at most, in order of the key, each file's keys after those of the one before.
    A log of keys lies beside the results, by batch too, so no batch reads results; a batch that comes again writes
    its part anew and adds nothing.
    """
    log = f"{done.rstrip('/')}-keys"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        todo = batch.dropDuplicates([key])
        if written(spark, log):
            kind = todo.schema[key].dataType.simpleString()
            earlier = spark.read.schema(f"`{key}` {kind}, batch long").parquet(log).where(F.col("batch") < batch_id)
            todo = todo.join(earlier.select(key), key, "left_anti")
        todo.select(key).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        mine = spark.read.parquet(f"{log}/batch={batch_id}")
        found = work(batch.dropDuplicates([key]).join(mine, key, "left_semi"))
        if rows_in_file:
            found = found.repartitionByRange(key).sortWithinPartitions(key)
        found.write.mode("overwrite").option("maxRecordsPerFile", rows_in_file).parquet(f"{done}/batch={batch_id}")

    return run


def outbox(folder: str, key: str, at: str, send: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands writes on to `send`, one push at a time, and keeps them until a push has gone through.

    A batch's writes, the last of each key, are stored first (`pending`). Then all that no push has taken yet is claimed,
    of each key the last, and sent in one push; when that is done, the push's number is stored (`sent`) and stands for
    all batches up to it. If sending fails the claim is void: the error is logged (`errors`), the stream goes on and the next
    push takes the same writes again, or newer ones of their keys. A push that was sent but not stored as sent comes again
    with equal or newer rows, so `send` has to put rows by key.
    """
    top = folder.rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = lambda rows: rows.groupBy(key).agg(F.max_by(F.struct("*"), at).alias("__w")).select("__w.*")
        last(batch).write.mode("overwrite").parquet(f"{top}/pending/batch={batch_id}")
        claimed = last(unsent(spark, top)).select(*batch.columns)
        if claimed.isEmpty():
            return
        try:
            send(claimed, batch_id)
        except Exception as cause:  # noqa: BLE001  whatever the other side says, the writes stay
            told = spark.createDataFrame([(batch_id, str(cause)[:1000])], "push long, error string")
            told.write.mode("overwrite").parquet(f"{top}/errors/push={batch_id}")
            return
        spark.range(batch_id, batch_id + 1).withColumnRenamed("id", "upto").coalesce(1).write.mode("overwrite").parquet(f"{top}/sent/push={batch_id}")

    return run


def unsent(spark: SparkSession, folder: str) -> DataFrame:
    """The stored writes that no push has taken."""
    top = folder.rstrip("/")
    rows = spark.read.parquet(f"{top}/pending")
    upto = spark.read.parquet(f"{top}/sent").agg(F.max("upto")).first()[0] if written(spark, f"{top}/sent") else -1
    return rows.where(F.col("batch") > upto)
