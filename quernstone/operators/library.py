"""Library of items and attempts: status, next item, pages, profiles, ranks and spaced repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import settled

from ..functions.scores import INTERVALS
from ..sources.tables import js_round

#: From which rating a rank holds.
RANKS = (
    (0, "none"),
    (1300, "third"),
    (1450, "second"),
    (1650, "first"),
    (2000, "candidate"),
    (2200, "master"),
    (2400, "international master"),
    (2500, "grandmaster"),
)


def statuses(items: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """Items with status (new, clean, won, fail) and last_try. Rows of attempts: key, rev, win, fair, mistakes, t; reviews don't count for the status."""
    own = ~F.col("rev")
    clean = own & F.col("win") & F.col("fair") & (F.col("mistakes") <= 1)
    tried = attempts.groupBy(key).agg(
        F.bool_or(own).alias("tried"),
        F.bool_or(own & F.col("win")).alias("won"),
        F.bool_or(clean).alias("clean"),
        F.max("t").alias("last_try"),
    )
    status = F.when(
        F.coalesce("clean", F.lit(False)), "clean"
    ).when(F.coalesce("won", F.lit(False)), "won").when(F.coalesce("tried", F.lit(False)), "fail").otherwise("new")
    return items.join(tried, key, "left").withColumn("status", status).drop("tried", "won", "clean")


def in_scope(items: DataFrame, collection: Column, tag: str, texts: list[str], part: str) -> DataFrame:
    """Items of a collection with a tag, whose texts together hold the part, in any case."""
    return items.where(
        collection & F.array_contains("tags", tag) & F.contains(F.lower(F.concat_ws(" ", *texts)), F.lit(part.strip().lower()))
    )


def next_item(items: DataFrame, now: Column, order: str, day: int) -> DataFrame:
    """The one item to play: a failure over a day old, the oldest first; then a new one; then the oldest won, failed, any."""
    since = F.coalesce("last_try", F.lit(0))
    prio = F.when(
        (F.col("status") == "fail") & (now - since > day), 1
    ).when(F.col("status") == "new", 2).when(F.col("status") == "won", 3).when(F.col("status") == "fail", 4).otherwise(5)
    rank = F.struct(prio.alias("prio"), F.when(prio == 2, F.lit(0)).otherwise(since).alias("since"), F.col(order).alias("o"))
    return items.agg(
        F.min(F.struct(rank.alias("rank"), F.struct(*items.columns).alias("item"))).alias("x")
    ).select("x.item.*", F.col("x.rank.prio").alias("prio"))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """One page of the ordered rows; a number beyond the last page means the last. Rows are worked out once; of the sort only the pages up to it are kept."""
    rows = settled(rows, "paged")
    count = rows.count()
    number = max(0, min(number, (count - 1) // size))
    return rows.orderBy(*order).offset(number * size).limit(size)


def tag_counts(items: DataFrame, tags: Column, position: str) -> DataFrame:
    """How often each tag comes, most first, of equals the one seen first."""
    found = items.select(F.explode(tags).alias("tag"), position)
    return found.groupBy("tag").agg(F.count("*").alias("n"), F.min(position).alias("first")).orderBy(F.desc("n"), "first", "tag")


def collection_progress(items: DataFrame, collection: str) -> DataFrame:
    """Items and realised ones of each collection, and of all."""
    done = F.count_if(F.col("status").isin("clean", "won"))
    return items.rollup(collection).agg(F.count("*").alias("n"), done.alias("done"), F.grouping(collection).alias("all_rows")).select(
        F.when(F.col("all_rows") == 1, "all").otherwise(F.col(collection)).alias(collection), "n", "done"
    )


def profile(attempts: DataFrame) -> DataFrame:
    """Shares of wins and clean wins in percent, mean loss in pawns, mistakes a game."""
    rows = attempts.where("not rev and not stopped")
    clean = F.col("win") & F.col("fair") & (F.col("mistakes") <= 1)
    sums = rows.agg(
        F.count("*").alias("n"),
        F.count_if("win").alias("wins"),
        F.count_if(clean).alias("clean"),
        F.sum("loss").alias("loss"),
        F.sum("mistakes").alias("mistakes"),
    )
    return sums.select(
        "n",
        js_round(100 * F.col("wins") / F.col("n")).alias("win_pct"),
        js_round(100 * F.col("clean") / F.col("n")).alias("clean_pct"),
        F.round(F.col("loss") / F.col("n") / 100, 2).alias("mean_loss"),
        F.round(F.col("mistakes") / F.col("n"), 1).alias("mistakes_each"),
    )


def profile_by(attempts: DataFrame, items: DataFrame, key: str, keys: Column) -> DataFrame:
    """Attempts, wins and clean wins by each of the keys an item has; attempts without their item are left out."""
    clean = F.col("win") & F.col("fair") & (F.col("mistakes") <= 1)
    joined = attempts.where("not rev").join(items, key).select(F.explode(keys).alias("by"), "win", clean.alias("clean"))
    return joined.groupBy("by").agg(F.count("*").alias("n"), F.count_if("win").alias("wins"), F.count_if("clean").alias("clean"))


def rank_of(rating: Column) -> Column:
    """The highest rank whose rating is reached; eight fixed steps, so no join."""
    out = F.lit(RANKS[0][1])
    for least, name in RANKS[1:]:
        out = F.when(rating >= least, name).otherwise(out)
    return out


def card_schedule(reviews: DataFrame, card: str, order: list[str]) -> DataFrame:
    """Step, repetitions, failures and due day of each card after its reviews (order, day, good).

    The step is the successes since the last failure, seven at most, so no review needs the one before.
    """
    by = W.partitionBy(card).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    marked = reviews.withColumn("fails_after", F.coalesce(F.sum((~F.col("good")).cast("int")).over(by), F.lit(0)))
    folded = marked.groupBy(card).agg(
        F.least(F.lit(len(INTERVALS)), F.count_if(F.col("good") & (F.col("fails_after") == 0))).cast("int").alias("step"),
        F.count("*").alias("reps"),
        F.count_if(~F.col("good")).alias("fails"),
        F.max_by("day", F.struct(*order)).alias("last"),
    )
    wait = F.when(F.col("step") == 0, 1).otherwise(F.element_at(F.array(*map(F.lit, INTERVALS)), F.greatest(F.col("step"), F.lit(1))))
    return folded.withColumn("due", F.date_add("last", wait))


def due_cards(cards: DataFrame, today: Column) -> DataFrame:
    return cards.where(F.col("due") <= today)


def adapted_rating(
    attempts: DataFrame,
    player: str,
    order: list[Column],
    start: int = 1500,
    step: int = 50,
    low: int = 800,
    high: int = 2800,
    last: int = 400,
) -> DataFrame:
    """The rating after each player's last attempts (win, clean), a step up or down each, within bounds.

    History is capped at `last` attempts, as the log is, so what is folded for a player is bounded.
    """
    numbered = attempts.withColumn("__n", F.row_number().over(W.partitionBy(player).orderBy(*order))).where(F.col("__n") <= last)
    moves = numbered.groupBy(player).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("__n"), F.when(F.col("clean"), step).when(~F.col("win"), -step).otherwise(0).alias("d"))),
            asc=False,
        ).alias("moves")
    )
    folded = F.aggregate("moves", F.lit(start), lambda e, m: F.when((m["d"] > 0) & (e >= high), e).when((m["d"] < 0) & (e <= low), e).otherwise(e + m["d"]))
    return moves.select(player, folded.alias("rating"), F.size("moves").alias("n"))
