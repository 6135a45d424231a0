"""Row numbers within groups of any size: no group is ordered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import settled

#: The lower bits of monotonically_increasing_id, a row's place in its partition.
PLACE = (1 << 33) - 1


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Equal keys of two aliased frames, nulls equal to each other."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def numbered(rows: DataFrame, groups: list[str], order: list[str | Column], name: str = "n", parts: int = 0) -> DataFrame:
    """The rows with their number from 0 on in the rising order of their group; without groups, of the whole table.

    Rows are written in order in many parts of even size, a group over as many as it fills. Places in a part, and counts of the
    parts before it, give the number. Equal rows are told apart by their place in the input, so not even copies of one row meet
    in one task; the input should be a scan or a written table, whose rows a repeated task gives in the same order.
    """
    parts = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranks = [f"__o{i}" for i in range(len(order))]
    keyed = rows.withColumns({r: F.col(o) if isinstance(o, str) else o for r, o in zip(ranks, order, strict=True)})
    keyed = keyed.withColumn("__row", F.monotonically_increasing_id())
    by = [*(F.col(g) for g in groups), *(F.col(r) for r in ranks), F.col("__row")]
    dealt = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(*ranks, "__row").withColumns(
        {"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(PLACE)}
    )
    dealt = settled(dealt, "dealt")
    sizes = dealt.groupBy(*groups, "__part").agg(F.count("*").alias("__size"), F.min("__at").alias("__first"))
    earlier = F.sum("__size").over(W.partitionBy(*groups).orderBy("__part")) - F.col("__size")  # a row for each part
    starts = settled(sizes.select(*groups, "__part", (earlier - F.col("__first")).alias("__by")), "starts")
    met = dealt.alias("r").join(starts.alias("s"), same_keys("r", "s", [*groups, "__part"]))
    return met.select(*(F.col(f"r.{c}").alias(c) for c in rows.columns), (F.col("r.__at") + F.col("s.__by")).alias(name))
