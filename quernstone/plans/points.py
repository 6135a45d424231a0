"""Queries over evaluation series: a user's events in time stand for a game, a moving mean for the evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scores import NODES, TOLERANCE, at_rating, evaluation_text, win_chance
from ..operators import points as P
from ..sources.tables import events, table


def series(spark, sf):
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    near = order.rowsBetween(-30, 0)
    rows = events(spark, sf).withColumn("v", F.round(F.col("value") * 100).cast("long") - 5000)
    ev = F.floor(F.sum("v").over(near) * 40 / 3000).cast("int")
    return rows.select(
        F.col("user_id").alias("game"),
        (F.row_number().over(order) - 1).alias("i"),
        F.when(F.col("event_type") != "error", ev).alias("ev"),
        (F.col("user_id") % 2 == 0).alias("hero_white"),
        (F.col("user_id") % 3 != 0).alias("white_starts"),
        F.when(F.col("event_id") % 5 == 0, 3).when(F.col("event_id") % 5 == 1, 0).alias("gain"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("best"),
    )


def advantage_point(spark, sf):
    return P.advantage_points(series(spark, sf))


def advantage_histogram(spark, sf):
    return advantage_point(spark, sf).groupBy("verdict", "swing").agg(F.count("*").alias("n"))


def mistakes(spark, sf):
    return P.game_summaries(P.move_losses(series(spark, sf)))


def top3_mistakes(spark, sf):
    return P.worst_mistakes(P.move_losses(series(spark, sf)), "best")


def mistake_bins(spark, sf):
    losses = P.move_losses(series(spark, sf)).where("mistake")
    return P.binned(losses, F.floor(F.col("i") / 2) + 1, [(1, 5), (6, 10), (11, 20), (21, 999)])


def threefold(spark, sf):
    rows = events(spark, sf).select(
        "user_id",
        "ts",
        "event_id",
        F.concat_ws("/", "event_type", (F.col("event_id") % 7).cast("string")).alias("position"),
    )
    return P.repetitions(rows, "user_id", ["ts", "event_id"], "position").select("user_id", "event_id", "position")


def resign_runs(spark, sf):
    out = P.runs(series(spark, sf), "game", ["i"], F.col("ev") <= -100)
    return out.where("run = 3").groupBy("game").agg(F.min("i").alias("resigned_at"))


def longest_run(spark, sf):
    return P.runs(series(spark, sf), "game", ["i"], F.col("ev") > 0).groupBy("game").agg(F.max("run").alias("longest"))


def gap_groups(spark, sf):
    rows = events(spark, sf).select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")).distinct()
    return P.gap_groups(rows, "user_id", "at", 6 * 3600)


def win_chances(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.round("c_acctbal").cast("int").alias("cp"))
    return rows.select(
        "c_custkey",
        F.round(win_chance(F.col("cp")), 6).alias("chance"),
        evaluation_text(F.when(F.col("c_custkey") % 10 == 0, (F.col("c_custkey") % 19 - 9).cast("int")), F.col("cp")).alias("shown"),
    )


def elo_interp(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 3).cast("int").alias("elo"))
    return rows.select(
        "c_custkey",
        F.round(at_rating(F.col("elo"), TOLERANCE), 6).alias("tolerance"),
        F.round(at_rating(F.col("elo"), NODES, True), 2).alias("nodes"),
    )


QUERIES = {
    f.__name__: f for f in (
        advantage_point,
        advantage_histogram,
        mistakes,
        top3_mistakes,
        mistake_bins,
        threefold,
        resign_runs,
        longest_run,
        gap_groups,
        win_chances,
        elo_interp,
    )
}

SERIES = """with o as (select *, cast(round(value * 100) as bigint) - 5000 as v from events),
  s as (select user_id as game, row_number() over w - 1 as i, event_id, event_type,
    cast(floor(sum(v) over (partition by user_id order by ts, event_id rows between 30 preceding and current row) * 40 / 3000) as int)
        as ev0
    from o window w as (partition by user_id order by ts, event_id)),
  h as (select game, i, case when event_type <> 'error' then ev0 end as ev, game % 2 = 0 as hero_white, game % 3 <> 0 as white_starts,
    case event_id % 5 when 0 then 3 when 1 then 0 end as gain, case when event_type <> 'view' then event_type end as best from s),
  p as (select *, case when hero_white then ev else -ev end as pov, (((i % 2 = 0) = white_starts) = hero_white) as mine from h)"""
POINTS = f"""{SERIES}, f as (select *, min(pov) over (partition by game order by i rows between current row and 6 following) as held,
    min(pov) over (partition by game order by i rows between current row and unbounded following) as worst,
        count(*) over (partition by game) as n from p),
  g as (select game, any_value(n) as n, min(i) filter (mine and pov >= 200 and held >= 150) as first from f group by game),
  q as (select f.game, min(f.i) as k from f join g using (game) where mine and f.i >= g.first and f.i < g.first + 12 and pov >= 150 and
    pov < 700 and not coalesce(gain >= 2, false) group by 1),
  r as (select g.game, g.first, q.k, g.n, a.pov as at_first, b.worst from g left join q using (game) left join f a on a.game = g.game
    and a.i = g.first left join f b on b.game = g.game and b.i = q.k),
  v as (select *, case when first is null then 'none' when at_first >= 700 then 'jump' when k is null then 'tactic' when n - 1 - k < 20
    then 'short' else 'ok' end as verdict from r),
  points as (select game, case when verdict in ('jump', 'tactic') then first when verdict <> 'none' then k end as k, verdict,
    coalesce(verdict = 'ok' and worst < 80, false) as swing from v)"""
LOSSES = f"""{SERIES}, a as (select *, lead(pov) over (partition by game order by i) as after from p), c as (select *, greatest(-1000,
    least(1000, pov)) - greatest(-1000, least(1000, after)) as change from a where after is not null and pov is not null),
  l as (select *, case when mine then greatest(0, change) end as loss, coalesce(mine and change >= 100 and after < 500,
    false) as mistake, not mine and -change >= 200 and pov < 800 as gift from c)"""
SQL = {
    "advantage_point": f"{POINTS} select * from points",
    "advantage_histogram": f"{POINTS} select verdict, swing, count(*) as n from points group by all",
    "mistakes": f"""{LOSSES} select game, count(*) filter (mine) as moves, count(*) filter (mistake) as mistakes,
        count(*) filter (gift) as gifts, count(*) filter (gift) = 0 as fair, coalesce(cast(floor(sum(loss) / nullif(count(*) filter
        (mine), 0) + 0.5) as bigint), 0) as avg_loss from l group by game""",
    "top3_mistakes": f"""{LOSSES}, r as (select *, row_number() over (partition by game order by loss desc,
        i) as rank from l where mistake) select game, i, loss, rank, best from r where rank <= 3 and best is not null""",
    "mistake_bins": f"""{LOSSES} select low, high, count(l.game) as n from (values (1, 5), (6, 10), (11, 20), (21, 999)) b(low,
        high) left join l on mistake and i // 2 + 1 between low and high group by all""",
    "threefold": """with r as (select user_id, ts, event_id, event_type || '/' || (event_id % 7) as position from events),
        c as (select *, row_number() over (partition by user_id, position order by ts, event_id) as seen from r),
        k as (select *, row_number() over (partition by user_id order by ts, event_id) as n from c where seen = 3) select user_id,
        event_id, position from k where n = 1""",
    "resign_runs": f"""{SERIES}, m as (select *, sum(case when coalesce(ev <= -100,
        false) then 0 else 1 end) over (partition by game order by i) as part from p),
        c as (select *, sum(case when coalesce(ev <= -100, false) then 1 else 0 end) over (partition by game,
        part order by i) as run from m) select game, min(i) as resigned_at from c where run = 3 group by game""",
    "longest_run": f"""{SERIES}, m as (select *, sum(case when coalesce(ev > 0, false) then 0 else 1 end) over (partition by game order
        by i) as part from p),
        c as (select *, sum(case when coalesce(ev > 0, false) then 1 else 0 end) over (partition by game,
        part order by i) as run from m) select game, cast(max(run) as bigint) as longest from c group by game""",
    "gap_groups": """with r as (select distinct user_id, cast(floor(epoch(ts)) as bigint) as x from events), m as (select *,
        case when x - lag(x) over (partition by user_id order by x) > 21600 then 1 else 0 end as new from r),
        g as (select *, sum(new) over (partition by user_id order by x) as part from m) select user_id, min(x) as low, max(x) as high,
        count(*) as n from g group by user_id, part""",
    "win_chances": """with r as (select c_custkey, cast(round(c_acctbal) as int) as cp,
        case when c_custkey % 10 = 0 then cast(c_custkey % 19 - 9 as int) end as mate from customer)
        select c_custkey, round(50 + 50 * (2 / (1 + exp(-0.00368208 * greatest(-1600, least(1600, cp)))) - 1), 6) as chance,
        case when mate is not null then case when mate < 0 then '−#' else '#' end || abs(mate) else case when cp < 0 then '−' else '+'
        end || cast(floor(abs(cp) / 100) as int) || '.' || lpad(cast(abs(cp) % 100 as varchar), 2, '0') end as shown from r""",
    "elo_interp": """with k(i, e, t, n) as (values (1, 800, 130, 500), (2, 1200, 95, 2000), (3, 1600, 62, 8000), (4, 2000, 38, 40000),
        (5, 2400, 20, 200000), (6, 2800, 8, 1500000)),
        s as (select a.e as lo, b.e as hi, a.t as t0, b.t as t1, a.n as n0, b.n as n1 from k a join k b on b.i = a.i + 1),
        c as (select c_custkey, greatest(800, least(2800, cast(floor(c_acctbal / 3) as int))) as r from customer)
        select c_custkey, round(t0 + (r - lo) / (hi - lo) * (t1 - t0), 6) as tolerance,
        round(exp(ln(n0) + (r - lo) / (hi - lo) * (ln(n1) - ln(n0))), 2) as nodes from c join s on (r > lo and r <= hi) or (r = 800 and
        lo = 800)""",
}
