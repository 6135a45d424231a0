"""Library queries: parts stand for items, their lines for attempts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import library as L
from ..sources.tables import events, table


def attempts(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"),
        (F.col("l_linestatus") == "F").alias("rev"),
        (F.col("l_returnflag") != "N").alias("win"),
        (F.col("l_discount") < 0.05).alias("fair"),
        (F.col("l_quantity") % 4).cast("int").alias("mistakes"),
        F.unix_date(F.to_date("l_shipdate")).alias("t"),
        F.col("l_quantity").cast("long").alias("loss"),
        (F.col("l_linenumber") == 7).alias("stopped"),
    )


def items(spark, sf):
    return table(spark, sf, "part").withColumn("tags", F.split("p_type", " "))


def library(spark, sf):
    return L.statuses(items(spark, sf), attempts(spark, sf), "p_partkey")


def library_status(spark, sf):
    return library(spark, sf).select("p_partkey", "status", F.col("last_try").cast("long").alias("last_try"))


def library_scope(spark, sf):
    return L.in_scope(
        library(spark, sf), F.col("p_size") < 40, "MEDIUM", ["p_name", "p_brand"], " 1 "
    ).select("p_partkey", "p_name", "status")


def next_item(spark, sf):
    return L.next_item(
        library(spark, sf).select("p_partkey", "status", "last_try"), F.lit(10_000), "p_partkey", 1
    ).select("p_partkey", "status", F.col("prio").cast("long").alias("prio"))


def page_of_library(spark, sf):
    rows = library(spark, sf).select("p_partkey", "status", F.round("p_retailprice", 2).alias("price"))
    return L.page(rows, [F.desc("price"), F.col("p_partkey")], 3)


def tag_counts(spark, sf):
    return L.tag_counts(items(spark, sf), F.col("tags"), "p_partkey")


def collection_progress(spark, sf):
    return L.collection_progress(library(spark, sf), "p_brand")


def profile_summary(spark, sf):
    return L.profile(attempts(spark, sf))


def profile_by_tag(spark, sf):
    return L.profile_by(attempts(spark, sf), items(spark, sf).select("p_partkey", "tags"), "p_partkey", F.col("tags"))


def last_attempts(spark, sf):
    rows = events(spark, sf).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    return rows.where("n <= 8").select("user_id", "n", "event_id", "event_type")


def rank_asof(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", L.rank_of(F.col("c_acctbal") / 3).alias("rank"))


def reviews(spark, sf):
    return events(spark, sf).select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("card"),
        "ts",
        "event_id",
        "day",
        (F.col("value") < 60).alias("good"),
    )


def srs_schedule(spark, sf):
    return L.card_schedule(reviews(spark, sf), "card", ["ts", "event_id"])


def due_cards(spark, sf):
    return L.due_cards(srs_schedule(spark, sf), F.lit("2024-01-31").cast("date")).select("card", "due")


def adapted_rating(spark, sf):
    rows = events(spark, sf).select("user_id", "ts", "event_id", (F.col("value") < 40).alias("clean"), (F.col("value") < 60).alias("win"))
    return L.adapted_rating(rows, "user_id", [F.desc("ts"), F.desc("event_id")])


QUERIES = {
    f.__name__: f for f in (
        library_status,
        library_scope,
        next_item,
        page_of_library,
        tag_counts,
        collection_progress,
        profile_summary,
        profile_by_tag,
        last_attempts,
        rank_asof,
        srs_schedule,
        due_cards,
        adapted_rating,
    )
}

ATT = """with a as (select l_partkey as p_partkey, l_linestatus = 'F' as rev, l_returnflag <> 'N' as win, l_discount < 0.05 as fair,
    cast(l_quantity % 4 as int) as mistakes,
    cast(l_shipdate as date) - date '1970-01-01' as t, cast(l_quantity as bigint) as loss, l_linenumber = 7 as stopped from lineitem)"""
LIB = f"""{ATT}, g as (select p_partkey, bool_or(not rev) as tried, bool_or(not rev and win) as won,
    bool_or(not rev and win and fair and mistakes <= 1) as clean, max(t) as last_try from a group by 1),
  lib as (select part.*, case when clean then 'clean' when won then 'won' when tried then 'fail' else 'new' end as status,
    last_try from part left join g using (p_partkey))"""
CARDS = """with r as (select user_id || '-' || event_type as card, ts, event_id, cast(ts as date) as day, value < 60 as good from events),
  m as (select *, coalesce(sum(case when good then 0 else 1 end) over (partition by card order by ts,
    event_id rows between 1 following and unbounded following), 0) as fails_after from r),
  f as (select card, cast(least(7, count(*) filter (good and fails_after = 0)) as int) as step, count(*) as reps,
    count(*) filter (not good) as fails, arg_max(day, (ts, event_id)) as last from m group by card),
  c as (select *, last + case when step = 0 then 1 else [1, 3, 7, 16, 35, 70, 140][step] end as due from f)"""
SQL = {
    "library_status": f"{LIB} select p_partkey, status, last_try from lib",
    "library_scope": f"""{LIB} select p_partkey, p_name, status from lib where p_size < 40 and list_contains(string_split(p_type, ' '),
        'MEDIUM') and contains(lower(p_name || ' ' || p_brand), '1')""",
    "next_item": f"""{LIB}, q as (select p_partkey, status, coalesce(last_try, 0) as since,
        case when status = 'fail' and 10000 - coalesce(last_try, 0) > 1 then 1 when status = 'new' then 2 when status = 'won' then 3
        when status = 'fail' then 4 else 5 end as prio from lib)
        select p_partkey, status, prio from q order by prio, case when prio = 2 then 0 else since end, p_partkey limit 1""",
    "page_of_library": f"""{LIB} select p_partkey, status, round(p_retailprice, 2) as price from lib order by price desc,
        p_partkey limit 50 offset least(3, (select (count(*) - 1) // 50 from part)) * 50""",
    "tag_counts": """select tag, count(*) as n, min(p_partkey) as first from (select unnest(string_split(p_type, ' ')) as tag,
        p_partkey from part) group by tag""",
    "collection_progress": f"""{LIB} select case when grouping(p_brand) = 1 then 'all' else p_brand end as p_brand, count(*) as n,
        count(*) filter (status in ('clean', 'won')) as done from lib group by rollup (p_brand)""",
    "profile_summary": f"""{ATT}, s as (select count(*) as n, count(*) filter (win) as w,
        count(*) filter (win and fair and mistakes <= 1) as c, sum(loss) as l, sum(mistakes) as m from a where not rev and not stopped)
        select n, cast(floor(100.0 * w / n + 0.5) as bigint) as win_pct, cast(floor(100.0 * c / n + 0.5) as bigint) as clean_pct,
        round(l / n / 100, 2) as mean_loss, round(m / n, 1) as mistakes_each from s""",
    "profile_by_tag": f"""{ATT} select tag as "by", count(*) as n, count(*) filter (win) as wins,
        count(*) filter (win and fair and mistakes <= 1) as clean from a join (select p_partkey, unnest(string_split(p_type,
        ' ')) as tag from part) using (p_partkey) where not rev group by tag""",
    "last_attempts": """select user_id, n, event_id, event_type from (select *, row_number() over (partition by user_id order by ts
        desc, event_id desc) as n from events) where n <= 8""",
    "rank_asof": """with r(e, name) as (values (0, 'none'), (1300, 'third'), (1450, 'second'), (1650, 'first'), (2000, 'candidate'),
        (2200, 'master'), (2400, 'international master'), (2500, 'grandmaster'))
        select c_custkey, coalesce((select name from r where e <= c_acctbal / 3 order by e desc limit 1), 'none') as rank from customer""",
    "srs_schedule": f"{CARDS} select card, step, reps, fails, last, cast(due as date) as due from c",
    "due_cards": f"{CARDS} select card, cast(due as date) as due from c where due <= date '2024-01-31'",
    "adapted_rating": """with n as (select user_id, case when value < 40 then 50 when value >= 60 then -50 else 0 end as d,
        row_number() over (partition by user_id order by ts desc, event_id desc) as k from events),
        m as (select user_id, list(d order by k desc) as ds from n where k <= 400 group by 1)
        select user_id, cast(list_reduce(list_prepend(1500, ds), lambda e, d: case when d > 0 and e >= 2800 then e when d < 0 and e <=
        800 then e else e + d end) as int) as rating, len(ds) as n from m""",
}
