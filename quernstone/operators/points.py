"""The first stable advantage in a series of evaluations, mistakes, and runs of conditions.

A series is rows (game, i, ev): the evaluation from White's side after i plies, null if unknown. All windows of an
operator share one partitioning, so a game's rows are dealt out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scores import clamp


def hero_view(series: DataFrame) -> DataFrame:
    """Adds pov (the hero's evaluation) and mine (the hero is to move). Rows also have hero_white, white_starts."""
    white_moves = (F.col("i") % 2 == 0) == F.col("white_starts")
    return series.withColumn(
        "pov", F.when(F.col("hero_white"), F.col("ev")).otherwise(-F.col("ev"))
    ).withColumn("mine", white_moves == F.col("hero_white"))


#: The defaults are fixed values: hundredths of a pawn, plies, and men's worth.
def advantage_points(
    series: DataFrame,
    thresh: int = 200,
    stable: int = 6,
    jump: int = 700,
    low: int = 150,
    look: int = 12,
    rest: int = 20,
    swing: int = 80,
    gain: int = 2,
) -> DataFrame:
    """game, k, verdict, swing: where a stable advantage can first be played for, or why nowhere.

    Verdicts: none (no stable advantage), jump (it came at once and is decisive), tactic (no quiet moment near),
    short (too few plies left), ok. `gain` is the material that the next plies win, null if unknown.
    """
    of_game = W.partitionBy("game")
    by_ply = of_game.orderBy("i")
    ahead, so_far = by_ply.rowsBetween(0, stable), by_ply.rowsBetween(W.unboundedPreceding, 0)
    from_the_end = of_game.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    rows = hero_view(series).withColumn("worst", F.min("pov").over(from_the_end)).withColumn("held", F.min("pov").over(ahead))
    starts = F.col("mine") & (F.col("pov") >= thresh) & (F.col("held") >= 0.75 * thresh)
    rows = rows.withColumn("first", F.min(F.when(starts, F.col("i"))).over(so_far))  # null before it
    near = (F.col("i") >= F.col("first")) & (F.col("i") < F.col("first") + look)
    calm = (F.col("pov") >= low) & (F.col("pov") < jump) & ~F.coalesce(F.col("gain") >= gain, F.lit(False))
    found = rows.groupBy("game").agg(
        F.count("*").alias("n"),
        F.min("first").alias("first"),
        F.max(F.when(F.col("i") == F.col("first"), F.col("pov"))).alias("at_first"),
        F.min(F.when(F.col("mine") & near & calm, F.struct("i", "worst"))).alias("point"),
    )
    verdict = F.when(F.col("first").isNull(), "none").when(F.col("at_first") >= jump, "jump").when(F.col("point").isNull(), "tactic").when(
        F.col("n") - 1 - F.col("point.i") < rest, "short"
    ).otherwise("ok")
    out = found.withColumn("verdict", verdict)
    return out.select(
        "game",
        F.when(F.col("verdict").isin("jump", "tactic"), F.col("first")).when(F.col("verdict") != "none", F.col("point.i")).alias("k"),
        "verdict",
        F.coalesce((F.col("verdict") == "ok") & (F.col("point.worst") < swing), F.lit(False)).alias("swing"),
    )


def move_losses(series: DataFrame, mistake: int = 100, gift: int = 200, lost: int = 500, won: int = 800) -> DataFrame:
    """Each move with what it lost for the hero, and whether it was a mistake or the opponent's gift."""
    rows = hero_view(series).withColumn(
        "after", F.lead("pov").over(W.partitionBy("game").orderBy("i"))
    ).where("after is not null and pov is not null")
    change = clamp(F.col("pov"), -1000, 1000) - clamp(F.col("after"), -1000, 1000)
    rows = rows.withColumn("loss", F.when(F.col("mine"), F.greatest(F.lit(0), change)))
    return rows.withColumn(
        "mistake", F.coalesce((F.col("loss") >= mistake) & (F.col("after") < lost), F.lit(False))
    ).withColumn("gift", ~F.col("mine") & (-change >= gift) & (F.col("pov") < won))


def game_summaries(losses: DataFrame) -> DataFrame:
    """Per game: moves, mistakes, gifts, fair, mean loss rounded half up."""
    out = losses.groupBy("game").agg(
        F.count_if("mine").alias("moves"),
        F.count_if("mistake").alias("mistakes"),
        F.count_if("gift").alias("gifts"),
        F.sum("loss").alias("loss"),
    )
    return out.select(
        "game",
        "moves",
        "mistakes",
        "gifts",
        (F.col("gifts") == 0).alias("fair"),
        F.coalesce(F.floor(F.col("loss") / F.col("moves") + 0.5).cast("long"), F.lit(0).cast("long")).alias("avg_loss"),
    )


def worst_mistakes(losses: DataFrame, best: str, most: int = 3) -> DataFrame:
    """The largest losses of each game; of those, the ones with a known better move."""
    ranked = losses.where("mistake").withColumn("rank", F.row_number().over(W.partitionBy("game").orderBy(F.desc("loss"), "i")))
    return ranked.where((F.col("rank") <= most) & F.col(best).isNotNull()).select("game", "i", "loss", "rank", best)


def binned(rows: DataFrame, value: Column, bins: list[tuple[int, int]]) -> DataFrame:
    """How many values fall into each bin, empty bins too. Few fixed bins: the count is one pass without a join."""
    counts = rows.agg(*(F.count_if(value.between(a, b)).alias(f"b{k}") for k, (a, b) in enumerate(bins)))
    return counts.select(
        F.explode(
            F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(f"b{k}").alias("n")) for k, (a, b) in enumerate(bins)))
        ).alias("x")
    ).select("x.*")


def repetitions(rows: DataFrame, game: str, order: list[str], position: str, times: int = 3) -> DataFrame:
    """The first row of each game at which some position has come so many times."""
    counted = rows.withColumn(
        "seen",
        F.count("*").over(W.partitionBy(game, position).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)),
    ).where(F.col("seen") == times)
    return counted.groupBy(game).agg(F.min(F.struct(*order, position)).alias("x")).select(game, "x.*")


def runs(rows: DataFrame, key: str, order: list[str], holds: Column) -> DataFrame:
    """Rows with the length, so far, of the run of rows for which the condition holds; it starts again after each break."""
    by = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = rows.withColumn("holds", F.coalesce(holds, F.lit(False))).withColumn("part", F.sum((~F.col("holds")).cast("int")).over(by))
    inside = W.partitionBy(key, "part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return marked.withColumn("run", F.sum(F.col("holds").cast("int")).over(inside)).drop("part", "holds")


def gap_groups(rows: DataFrame, key: str, value: str, gap: int) -> DataFrame:
    """Numbers no further apart than the gap from the one before are one group: its first, last and size."""
    by = W.partitionBy(key).orderBy(value)
    marked = rows.withColumn("new", (F.col(value) - F.lag(value).over(by) > gap).cast("int"))
    numbered = marked.withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy(key, "part").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).drop("part")
