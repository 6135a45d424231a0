"""Queries over rules on lines, clocks, answers and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources.tables import events, table


def weighted_pick(spark, sf):
    """The noise is made of the line's own number, so that SQL can make it too."""
    rows = table(spark, sf, "part").select(
        "p_brand",
        "p_partkey",
        (-F.col("p_size") / 9.0).alias("w"),
        ((F.col("p_partkey") * 7919 % 9973 + 0.5) / 9973).alias("u"),
    )
    return R.weighted_pick(rows, "p_brand", F.col("w"), "p_partkey", F.col("u"))


def even_sample(spark, sf):
    return R.even_sample(table(spark, sf, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 9)


def match_by_place(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    suppliers = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return R.match_by_place(customers, suppliers, "nation", "c_custkey", "s_suppkey")


def aligned_boards(spark, sf):
    """Orders as slots of twenty books, each ninth one continued, and customers as the books' diagrams."""
    slots = table(spark, sf, "orders").select((F.col("o_orderkey") % 20).alias("book"), "o_orderkey", (F.col("o_orderkey") % 9 == 0).alias("continued"))
    diagrams = table(spark, sf, "customer").select((F.col("c_custkey") % 20).alias("book"), "c_custkey")
    return R.aligned_boards(slots, diagrams, "book", "o_orderkey", "c_custkey", "continued")


def lines(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.floor("c_acctbal").cast("int").alias("cp"), (F.col("c_custkey") % 3).cast("int").alias("k")
    )


def terminal_values(spark, sf):
    return lines(spark, sf).select(
        "c_custkey", R.terminal_value(F.col("k"), F.col("cp") > 4000, F.col("c_custkey") % 2 == 0).alias("value")
    )


def answers(spark, sf):
    move = lambda n: F.concat(F.lit("m"), (F.col("c_custkey") % n).cast("string"))
    return lines(spark, sf).select(
        "c_custkey",
        R.accepts(move(3), move(4), move(5), F.col("cp"), F.col("cp") - F.col("c_custkey") % 90).alias("taken"),
    )


def trade_penalties(spark, sf):
    rows = lines(spark, sf)
    second = F.when(F.col("k") > 0, F.concat(F.lit("a1"), F.when(F.col("c_custkey") % 2 == 0, "e4").otherwise("d5")))
    return rows.select(
        "c_custkey",
        R.trade_penalty(
            F.lit("d2e4"),
            second,
            F.element_at(F.array(F.lit("q"), F.lit("."), F.lit("N")), (F.col("c_custkey") % 3 + 1).cast("int")),
        ).alias("penalty"),
    )


def line_trim(spark, sf):
    moves = F.transform(
        F.sequence(F.lit(0), (F.col("c_custkey") % 7).cast("int")),
        lambda i: F.struct(
            F.concat(
                F.lit("m"),
                i.cast("string"),
                F.when((F.col("c_custkey") % 11 == 0) & (i == F.col("c_custkey") % 7), "#").otherwise(""),
            ).alias("san"),
            ((F.col("c_custkey") + i) % 5 == 0).alias("free"),
            ((F.col("c_custkey") + i) % 3 == 0).alias("loud"),
        ),
    )
    return lines(spark, sf).select("c_custkey", F.array_join(F.transform(R.trimmed(moves), lambda m: m["san"]), " ").alias("line"))


def clock_left(spark, sf):
    rows = events(spark, sf).select(
        "user_id",
        F.struct("ts", "event_id").alias("o"),
        "event_id",
        (F.col("event_id") % 2).alias("mover"),
        F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("at"),
    )
    return R.clocks(rows, "user_id", "o", "at", 600, 5).select("user_id", "event_id", "spent", "left")


def orientations(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.oriented(F.col("p_size"), {3: "w", 8: "b"}, 1000).alias("side"))


def freshness(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    now = F.lit(1_706_745_600_000)
    return events(spark, sf).groupBy("user_id").agg(F.max(ms).alias("last")).select(
        "user_id",
        R.ago(now, F.col("last")).alias("days"),
        R.wanted_refresh(now, F.col("last"), 86_400_000).alias("stale"),
    )


def position_text(spark, sf):
    """A rook ending for each supplier as an address, as a placement, with the side to move, or not at all."""
    k = F.col("s_suppkey")
    white = F.concat(F.lit("4k3/8/8/8/8/8/8/4K"), F.when(k % 3 == 0, "R1").when(k % 3 == 1, "1R").otherwise("2"))
    shapes = F.array(
        F.concat(F.lit("https://x.example/"), white, F.lit("_w_K_-_0_"), (k % 50).cast("string")),
        white,
        F.concat(F.lit("see "), white, F.lit(" b")),
        F.concat(F.lit("no board "), k.cast("string")),
    )
    return table(spark, sf, "supplier").select("s_suppkey", R.mixed_fen(F.element_at(shapes, (k % 4 + 1).cast("int"))).alias("fen"))


def coach_points(spark, sf):
    """Customers as points of a game: those where the opponent is to move go on by a ply."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", R.aligned(k % 60, k % 2 == F.floor(k / 7) % 2).alias("k"))


QUERIES = {
    f.__name__: f for f in (
        weighted_pick,
        even_sample,
        match_by_place,
        aligned_boards,
        terminal_values,
        answers,
        trade_penalties,
        line_trim,
        clock_left,
        orientations,
        freshness,
        position_text,
        coach_points,
    )
}

L = "with l as (select c_custkey, cast(floor(c_acctbal) as int) as cp, c_custkey % 3 as k from customer)"
SQL = {
    "weighted_pick": """with g as (select p_brand, p_partkey, -p_size / 9.0 - ln(-ln((p_partkey * 7919 % 9973 + 0.5) / 9973)) as g from
        part) select p_brand, arg_max(p_partkey, (g, p_partkey)) as picked from g group by 1""",
    "even_sample": """with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) - 1 as r,
        count(*) over (partition by p_brand) as n from part)
        select p_brand, p_partkey from r where n <= 9 or r = 0 or r * 8 // (n - 1) > floor((r - 1) * 8 / (n - 1))""",
    "aligned_boards": """with a as (select o_orderkey % 20 as book, o_orderkey, row_number() over (partition by o_orderkey % 20 order by o_orderkey) as place
        from orders), b as (select c_custkey % 20 as book, c_custkey, row_number() over (partition by c_custkey % 20 order by c_custkey) as place from customer)
        select book, place, o_orderkey, c_custkey from a join b using (book, place) where o_orderkey % 9 <> 0""",
    "match_by_place": """with a as (select c_nationkey as nation, c_custkey, row_number() over (partition by c_nationkey order by
        c_custkey) as place from customer), b as (select s_nationkey as nation, s_suppkey,
        row_number() over (partition by s_nationkey order by s_suppkey) as place from supplier)
        select nation, place, c_custkey, s_suppkey from a full join b using (nation, place)""",
    "terminal_values": f"""{L} select c_custkey, case when k > 0 then null when not cp > 4000 then 0 when c_custkey % 2 = 0 then -10000
        else 10000 end as value from l""",
    "answers": f"""{L} select c_custkey, case when c_custkey % 5 = c_custkey % 3 then false when c_custkey % 5 = c_custkey % 4 then true
        else greatest(-1000, least(1000, cp)) - greatest(-1000, least(1000, cp - c_custkey % 90)) <= 50 end as taken from l""",
    "trade_penalties": f"""{L} select c_custkey, case when k = 0 or c_custkey % 2 = 1 or c_custkey % 3 = 1 then 0 when c_custkey % 3 = 0
        then 45 else 22 end as penalty from l""",
    "line_trim": """with recursive p as (select c_custkey, c_custkey % 7 as n, c_custkey % 11 = 0 as mate from customer),
        m as (select c_custkey, n, mate, unnest(range(0, n + 1)) as i from p),
        c as (select c_custkey, any_value(n) as n, any_value(mate) as mate, min(i) filter (i % 2 = 1 and (c_custkey + i) % 5 = 0) as cut
        from m group by 1),
        k as (select *, coalesce(cut, n + 1) - case when coalesce(cut, n + 1) % 2 = 0 then 1 else 0 end as size from c),
        d as (select k.c_custkey, k.n, k.mate, max(i) filter (i < size and i % 2 = 0 and ((m.c_custkey + i) % 3 = 0 or i = 0)) as last
        from k join m using (c_custkey) group by all)
        select d.c_custkey, coalesce(string_agg('m' || i || case when d.mate and i = d.n then '#' else '' end,
        ' ' order by i) filter (d.mate or i <= d.last), '') as line from d join m using (c_custkey) group by all""",
    "clock_left": """with e as (select user_id, event_id, ts, event_id % 2 as mover, cast(floor(epoch(ts)) as bigint) as x from events),
        s as (select *, row_number() over (partition by user_id, mover order by ts, event_id) as n,
        x - coalesce(lag(x) over (partition by user_id order by ts, event_id), x) as d from e), t as (select *,
        case when n = 1 then 0 else d end as spent from s)
        select user_id, event_id, spent, cast(600 + 5 * n - sum(spent) over (partition by user_id, mover order by ts,
        event_id rows unbounded preceding) as bigint) as "left" from t""",
    "orientations": """select p_partkey, case p_size when 3 then 'w' when 8 then 'b' else case when p_size % 2 = 0 then 'w' else 'b' end
        end as side from part""",
    "freshness": """with m as (select user_id, max(epoch_ms(ts)) as last from events group by 1) select user_id,
        (1706745600000 - last) // 86400000 as days, 1706745600000 - last >= 86400000 as stale from m""",
    "position_text": """with p as (select s_suppkey, '4k3/8/8/8/8/8/8/4K' || ['R1', '1R', '2'][s_suppkey % 3 + 1] as w from supplier)
        select s_suppkey, case s_suppkey % 4 when 0 then w || ' w K - 0 ' || (s_suppkey % 50) when 1 then w || ' w - - 0 1' when 2 then
        w || ' b - - 0 1' end as fen from p""",
    "coach_points": "select c_custkey, c_custkey % 60 + case when c_custkey % 2 = c_custkey // 7 % 2 then 0 else 1 end as k from customer",
}
