"""Queries over daily activity, with the SQL they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import activity as A
from ..scratch import kept_until_release, scratch_folder
from ..sources.tables import events, js_round, last_day, table
from ..streaming import activity as S

DAYS = 30


def daily_counts(spark, sf):
    out = events(spark, sf).groupBy("user_id", "day", "event_type").agg(
        F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value")
    )
    return out


def daily_window(spark, sf):
    rows = events(spark, sf).groupBy(
        F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type"
    ).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return rows.select(F.to_date("w.start").alias("day"), "event_type", "n", "users")


def daily_locf(spark, sf):
    rows = events(spark, sf)
    users = rows.select("user_id").distinct().crossJoin(F.broadcast(last_day(rows)))
    last = A.last_values(rows, ["user_id", "day"], ["ts", "event_id"], "value").drop("n")
    filled = A.day_spine(users, DAYS).join(last, ["user_id", "day"], "left")
    return A.carry_forward(filled, "user_id", "day", "value").select("user_id", "day", "value", "real")


def streak(spark, sf):
    return A.live_streaks(events(spark, sf))


def day_totals(spark, sf):
    return events(spark, sf).groupBy("day").agg(F.count("*").alias("total"))


def heatmap(spark, sf):
    rows = events(spark, sf)
    return A.heatmap(day_totals(spark, sf), last_day(rows))


def peak_day(spark, sf):
    return A.peak_day(day_totals(spark, sf))


def best_delta(spark, sf):
    last = A.last_values(events(spark, sf), ["user_id", "event_type", "day"], ["ts", "event_id"], "value")
    order = F.array_position(F.array(*(F.lit(x) for x in ("click", "view", "purchase", "login", "logout", "signup"))), F.col("event_type"))
    out = A.best_delta(last, "user_id", "event_type", "value", order)
    return out.select("user_id", "series", F.round("delta", 4).alias("delta"))


def drill_box(spark, sf):
    daily = events(spark, sf).groupBy("user_id", "day").agg(
        F.count_if(F.col("event_type") == "click").alias("drills"),
        F.count_if(F.col("event_type") == "purchase").alias("fixed"),
    )
    return A.drill_box(daily, "user_id")


def totals(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    stars = lines.select(
        F.col("l_partkey").alias("p_partkey"),
        F.least(F.lit(3), F.floor(F.col("l_quantity") / 15)).cast("int").alias("stars"),
    )
    return A.totals(table(spark, sf, "part"), stars, "p_partkey")


def sections(spark, sf):
    done = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return A.section_progress(table(spark, sf, "part"), done, "p_partkey", "p_brand")


def axis_ticks(spark, sf):
    spans = events(spark, sf).groupBy("event_type").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi")
    ).withColumn("step", A.axis_step(F.col("hi") - F.col("lo")))
    ticks = spans.select(
        "event_type",
        "step",
        F.explode(F.sequence(F.floor(F.col("lo") / F.col("step")), F.ceil(F.col("hi") / F.col("step")))).alias("k"),
    )
    return ticks.select("event_type", (F.col("k") * F.col("step")).alias("tick"))


def today_override(spark, sf):
    """The last value of today's events beats the user's overall mean, which beats the value stored the day before."""
    rows = events(spark, sf)
    today = F.broadcast(last_day(rows))
    last = A.last_values(rows, ["user_id", "day"], ["ts", "event_id"], "value").crossJoin(today)
    per_user = last.groupBy("user_id").agg(
        F.max(F.when(F.col("day") == F.col("today"), F.col("value"))).alias("own"),
        F.max(F.when(F.datediff("today", "day") == 1, F.col("value"))).alias("stored"),
    )
    profile = rows.where("event_type = 'login'").groupBy("user_id").agg(F.max("value").alias("profile"))
    return per_user.join(profile, "user_id", "left").select(
        "user_id",
        F.coalesce("own", "profile", "stored").alias("rating"),
        js_round(F.coalesce("own", "profile", "stored")).alias("shown"),
    )


def snapshots(spark, sf):
    """Each user's running counts at the end of each day."""
    daily = events(spark, sf).groupBy("user_id", "day").agg(
        *(F.count_if(F.col("event_type") == t).alias(n) for n, t in (("solved", "click"), ("stars", "view"), ("errs", "purchase")))
    )
    so_far = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    fall = F.when(F.dayofmonth("day") == 15, 2).otherwise(0)  # a count that falls is no activity
    return daily.select(
        "user_id",
        F.unix_date("day").alias("at"),
        *((F.sum(f).over(so_far) - fall).alias(f) for f in ("solved", "stars", "errs"))
    )


def progress_growth(spark, sf):
    return S.growth(snapshots(spark, sf))


def write_bursts(spark, sf):
    """The last event of each burst: bursts end after six quiet hours."""
    rows = events(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id")
    return S.settled_writes(rows, "user_id", "at", "event_id", "6 hours").select("user_id", "event_id", "writes")


def resumed_job(spark, sf):
    """Orders in three batches, of which the second repeats keys and the third is the second again."""
    done = kept_until_release(spark, f"{scratch_folder(spark)}/job-{uuid.uuid4().hex}")
    kept_until_release(spark, f"{done}-keys")
    step = S.resumable(done, "o_orderkey", lambda rows: rows.select("o_orderkey", (F.col("o_orderkey") * 2).alias("value")))
    orders = table(spark, sf, "orders").select("o_orderkey")
    for batch, rows in ((0, "o_orderkey % 5 < 3"), (1, "o_orderkey % 5 >= 2"), (1, "o_orderkey % 5 >= 2")):
        step(orders.where(rows), batch)
    return spark.read.parquet(done).select("o_orderkey", "value", F.col("batch").cast("int").alias("batch"))


def pushed_writes(spark, sf):
    """What the other side has of each user after three batches of events, of whose pushes the first two fail half done."""
    top = kept_until_release(spark, f"{scratch_folder(spark)}/outbox-{uuid.uuid4().hex}")

    def send(rows, push):
        rows.where(F.lit(push == 2) | (F.col("user_id") % 2 == 0)).write.mode("overwrite").parquet(f"{top}/cloud/push={push}")
        if push < 2:
            raise ConnectionError("no answer")

    rows = events(spark, sf).select("user_id", "event_id", "event_type")
    step = S.outbox(f"{top}/box", "user_id", "event_id", send)
    for batch in range(3):
        step(rows.where((F.col("event_id") / 7).cast("long") % 3 == batch), batch)
    newest = F.max_by(F.struct("event_id", "event_type"), F.struct("push", "event_id")).alias("w")
    there = spark.read.parquet(f"{top}/cloud").groupBy("user_id").agg(newest)
    return there.select("user_id", "w.*").crossJoin(F.broadcast(S.unsent(spark, f"{top}/box").agg(F.count("*").alias("left"))))


QUERIES = {
    f.__name__: f for f in (
        pushed_writes,
        daily_counts,
        daily_window,
        daily_locf,
        streak,
        heatmap,
        peak_day,
        best_delta,
        drill_box,
        totals,
        sections,
        axis_ticks,
        today_override,
        progress_growth,
        write_bursts,
        resumed_job,
    )
}

E = "with e as (select *, cast(ts as date) as day from events)"
SQL = {
    "pushed_writes": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, 0::bigint as \"left\" from events group by 1",
    "daily_counts": f"{E} select user_id, day, event_type, count(*) as n, arg_max(value, (ts, event_id)) as last_value from e group by all",
    "daily_window": f"{E} select day, event_type, count(*) as n, count(distinct user_id) as users from e group by all",
    "daily_locf": f"""{E}, t as (select max(day) as today from e),
        spine as (select cast(today - cast(i as int) as date) as day from t, range(0, 30) r(i)),
        l as (select user_id, day, arg_max(value, (ts, event_id)) as v from e group by all),
        g as (select u.user_id, spine.day, l.v from (select distinct user_id from e) u cross join spine left join l on l.user_id =
        u.user_id and l.day = spine.day)
        select user_id, day, last_value(v ignore nulls) over (partition by user_id order by day rows between unbounded preceding and
        current row) as value, v is not null as real from g""",
    "streak": f"""{E}, d as (select distinct user_id, day, (select max(day) from e) as today from e),
        n as (select *, day - cast(row_number() over (partition by user_id order by day) as int) as island from d),
        r as (select user_id, island, count(*) as n, max(day) as last, max(today) as today from n group by all)
        select user_id, max(case when today - last <= 1 then n else 0 end) as streak, max(n) as longest from r group by user_id""",
    "heatmap": f"""{E}, t as (select max(day) as today from e), s as (select today, cast(date_trunc('week',
        today) as date) + 6 as sunday from t),
        spine as (select today, cast(sunday - cast(i as int) as date) as day from s, range(0, 126) r(i)),
        d as (select spine.day, spine.day > today as future, coalesce(c.total, 0) as total from spine left join (select day,
        count(*) as total from e group by day) c on c.day = spine.day),
        p as (select greatest(4, max(total)) as top from d)
        select day, total, future, case when total / top > .66 then 4 when total / top > .38 then 3 when total / top > .15 then 2 when
        total > 0 then 1 else 0 end as level from d, p""",
    "peak_day": f"{E}, d as (select day, count(*) as total from e group by day) select day, total from d order by total desc, day limit 1",
    "best_delta": f"""{E}, l as (select user_id, event_type, day, arg_max(value, (ts, event_id)) as v from e group by all),
        c as (select a.user_id, a.event_type, a.v - b.v as delta, coalesce(list_position(['click', 'view', 'purchase', 'login',
        'logout', 'signup'], a.event_type), 0) as o
          from l a join l b on a.user_id = b.user_id and a.event_type = b.event_type and b.day = a.day - 1 where a.day = (select
        max(day) from e)),
        r as (select *, row_number() over (partition by user_id order by abs(delta) desc, o) as k from c)
        select user_id, event_type as series, round(delta, 4) as delta from r where k = 1""",
    "drill_box": f"""{E}, d as (select user_id, day, count(*) filter (event_type = 'click') as drills,
        count(*) filter (event_type = 'purchase') as fixed from e group by all)
        select user_id, cast(sum(drills) as bigint) as drills, cast(sum(fixed) as bigint) as fixed, count(*) filter (drills > 0) as days,
          cast(case when sum(drills) > 0 then floor(100.0 * sum(fixed) / sum(drills) + 0.5) else 0 end as bigint) as pct from d group by
        user_id""",
    "totals": """with s as (select l_partkey, max(least(3, floor(l_quantity / 15))) as stars from lineitem where l_returnflag = 'R'
        group by 1)
        select count(stars) as solved, count(*) as n_all, cast(coalesce(sum(stars), 0) as bigint) as stars,
        3 * count(*) as max_stars from (select distinct p_partkey from part) p left join s on l_partkey = p_partkey""",
    "sections": """with d as (select distinct l_partkey from lineitem where l_quantity >= 49), c as (select p_brand, count(*) as n,
        count(l_partkey) as done from part left join d on l_partkey = p_partkey group by 1)
        select p_brand, n, done, cast(floor(100.0 * done / n + 0.5) as bigint) as pct from c where done > 0 order by pct desc,
        p_brand limit 10""",
    "axis_ticks": """with s as (select event_type, min(value) as lo, max(value) as hi from events group by 1), r as (select *,
        greatest(hi - lo, 1.0) / 4 as raw from s),
        t as (select *, pow(10.0, floor(log10(raw))) as ten from r), u as (select *, greatest(1.0,
        ten * case when raw / ten <= 1 then 1.0 when raw / ten <= 2 then 2.0 when raw / ten <= 2.5 then 2.5 when raw / ten <= 5 then 5.0
        else 10.0 end) as step from t)
        select event_type, k * step as tick from (select event_type, step, unnest(range(cast(floor(lo / step) as bigint),
        cast(ceil(hi / step) as bigint) + 1)) as k from u)""",
    "today_override": f"""{E}, t as (select max(day) as today from e), l as (select user_id, day, arg_max(value, (ts,
        event_id)) as v from e group by all),
        p as (select user_id, max(case when day = today then v end) as own, max(case when today - day = 1 then v end) as stored from l,
        t group by 1),
        q as (select user_id, max(value) as profile from e where event_type = 'login' group by 1)
        select p.user_id, coalesce(own, profile, stored) as rating, cast(floor(coalesce(own, profile,
        stored) + 0.5) as bigint) as shown from p left join q using (user_id)""",
    "progress_growth": f"""{E}, d as (select user_id, day, count(*) filter (event_type = 'click') as c,
        count(*) filter (event_type = 'view') as v, count(*) filter (event_type = 'purchase') as p from e group by all),
        s as (select user_id, day, case when dayofmonth(day) = 15 then 2 else 0 end as f, sum(c) over w as c, sum(v) over w as v,
        sum(p) over w as p from d window w as (partition by user_id order by day rows unbounded preceding)),
        g as (select user_id, day - date '1970-01-01' as "at", cast(greatest(0, c - f - lag(c - f) over o) as bigint) as solved,
        cast(greatest(0, v - f - lag(v - f) over o) as bigint) as stars,
          cast(greatest(0, p - f - lag(p - f) over o) as bigint) as errs, row_number() over o as k from s window o as (partition by
        user_id order by day))
        select user_id, "at", solved, stars, errs from g where k > 1 and greatest(solved, stars, errs) > 0""",
    "write_bursts": """with r as (select *, case when ts - lag(ts) over (partition by user_id order by ts,
        event_id) < interval 6 hours then 0 else 1 end as new from events),
        g as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as part from r) select
        user_id, arg_max(event_id, (ts, event_id)) as event_id, count(*) as writes from g group by user_id, part""",
    "resumed_job": "select o_orderkey, o_orderkey * 2 as value, case when o_orderkey % 5 < 3 then 0 else 1 end as batch from orders",
}
