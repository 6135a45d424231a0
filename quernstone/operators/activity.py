"""Daily activity: spines, carry-forward, streaks, heatmaps and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import js_round, with_today


def day_spine(rows: DataFrame, days: int) -> DataFrame:
    """Every row with each of the last `days` days up to its `today`."""
    return rows.withColumn("day", F.explode(F.sequence(F.date_sub("today", days - 1), F.col("today")))).drop("today")


def week_spine(today: DataFrame, weeks: int = 18) -> DataFrame:
    """Whole weeks, Monday first, up to the Sunday of this week; days after today are marked."""
    sunday = F.date_add(F.date_trunc("week", "today").cast("date"), 6)
    return today.select(
        "today", F.explode(F.sequence(F.date_sub(sunday, 7 * weeks - 1), sunday)).alias("day")
    ).withColumn("future", F.col("day") > F.col("today"))


def last_values(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The value of the last row of each group, and the number of rows."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("value"), F.count("*").alias("n"))


def carry_forward(filled: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Gaps take the last value before them inside the range shown; `real` tells own values from carried ones."""
    before = W.partitionBy(key).orderBy(day).rowsBetween(W.unboundedPreceding, W.currentRow)
    return filled.withColumn("real", F.col(value).isNotNull()).withColumn(value, F.last(value, ignorenulls=True).over(before))


def live_streaks(active: DataFrame, key: str = "user_id", day: str = "day") -> DataFrame:
    """Length of the run of active days that ends today or yesterday; zero for keys whose run is over. Rows: distinct key and day."""
    numbered = with_today(active.select(key, day).distinct(), day).withColumn(
        "island", F.date_sub(day, F.row_number().over(W.partitionBy(key).orderBy(day)))
    )
    runs = numbered.groupBy(key, "island").agg(F.count("*").alias("n"), F.max(day).alias("last"), F.first("today").alias("today"))
    return runs.groupBy(key).agg(
        F.max(F.when(F.datediff("today", "last") <= 1, F.col("n")).otherwise(0)).alias("streak"),
        F.max("n").alias("longest"),
    )


def intensity(total: Column, top: Column) -> Column:
    """Five levels of a day's total against the larger of 4 and the peak."""
    share = total / F.greatest(F.lit(4), top)
    return F.when(share > 0.66, 4).when(share > 0.38, 3).when(share > 0.15, 2).when(share > 0, 1).otherwise(0)


def heatmap(totals: DataFrame, today: DataFrame, weeks: int = 18) -> DataFrame:
    """Day, total, level and future flag of the weeks shown. Rows of totals: day, total."""
    shown = week_spine(today, weeks).join(totals, "day", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    peak = shown.agg(F.max("total").alias("peak"))
    return shown.crossJoin(F.broadcast(peak)).select("day", "total", "future", intensity(F.col("total"), F.col("peak")).alias("level"))


def peak_day(totals: DataFrame) -> DataFrame:
    """The day of the highest total, the first of equals."""
    return totals.agg(F.max(F.struct("total", (-F.unix_date("day")).alias("o"), "day")).alias("x")).select("x.day", "x.total")


def best_delta(daily: DataFrame, key: str, series: str, value: str, order: Column) -> DataFrame:
    """Per key, the change from the day before of the largest size; of equals the earlier series. Rows: key, series, day, value."""
    change = daily.withColumn("before", F.lag(value).over(W.partitionBy(key, series).orderBy("day"))).withColumn(
        "day_before", F.lag("day").over(W.partitionBy(key, series).orderBy("day"))
    )
    latest = with_today(change).where((F.col("day") == F.col("today")) & (F.datediff("day", "day_before") == 1))
    delta = F.col(value) - F.col("before")
    return latest.groupBy(key).agg(
        F.max_by(F.struct(F.col(series).alias("series"), delta.alias("delta")), F.struct(F.abs(delta), -order)).alias("x")
    ).select(key, "x.series", "x.delta")


def drill_box(daily: DataFrame, key: str) -> DataFrame:
    """Drills, fixed, days with drills and the share fixed, rounded half up. Rows: key, drills, fixed per day."""
    sums = daily.groupBy(key).agg(
        F.sum("drills").alias("drills"), F.sum("fixed").alias("fixed"), F.count_if(F.col("drills") > 0).alias("days")
    )
    return sums.withColumn(
        "pct",
        F.when(F.col("drills") > 0, js_round(100 * F.col("fixed") / F.col("drills"))).otherwise(F.lit(0).cast("long")),
    )


def section_progress(items: DataFrame, done: DataFrame, key: str, section: str, top: int = 10) -> DataFrame:
    """Sections that were touched, by share done: the first `top`. Rows: items (key, section), done (key)."""
    marked = items.select(key, section).join(done.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    counted = marked.groupBy(section).agg(F.count("*").alias("n"), F.count("hit").alias("done")).where("done > 0")
    return counted.withColumn("pct", js_round(100 * F.col("done") / F.col("n"))).orderBy(F.desc("pct"), section).limit(top)


def totals(items: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """Solved, all, stars and the most stars there could be. Rows: items (key), progress (key, stars)."""
    seen = progress.groupBy(key).agg(F.max("stars").alias("stars"))
    joined = items.select(key).distinct().join(seen, key, "left")
    return joined.agg(
        F.count("stars").alias("solved"),
        F.count("*").alias("n_all"),
        F.coalesce(F.sum("stars"), F.lit(0)).cast("long").alias("stars"),
        (3 * F.count("*")).alias("max_stars"),
    )


def axis_step(span: Column, marks: int = 4) -> Column:
    """The least of 1, 2, 2.5, 5 and 10 times a power of ten that gives at most so many steps over the span."""
    raw = F.greatest(span, F.lit(1.0)) / marks
    ten = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / ten
    return F.greatest(
        F.lit(1.0),
        ten * F.when(part <= 1, 1.0).when(part <= 2, 2.0).when(part <= 2.5, 2.5).when(part <= 5, 5.0).otherwise(10.0),
    )
