"""Merge queries: the even and odd halves of a table stand for the local and the cloud snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge as M
from ..sources.tables import events, table


def snapshots(spark, sf):
    rows = events(spark, sf)
    fields = [F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "view", "purchase")]
    return [rows.where(F.col("event_id") % 2 == k).groupBy("user_id", "day").agg(*fields) for k in (0, 1)]


def stats_merge(spark, sf):
    return M.merge_greatest(*snapshots(spark, sf), ["user_id", "day"], ["click", "view", "purchase"])


def progress_merge(spark, sf):
    """Solved is or, stars and errors are maxima; part numbers stand for puzzles, brands for books."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    flags = [
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("solved"),
        F.max((F.col("l_quantity") % 4).cast("int")).alias("stars"),
        F.count_if(F.col("l_discount") > 0.08).alias("errs"),
    ]
    sides = [
        lines.where(F.col("l_orderkey") % 2 == k).groupBy(
            F.col("p_brand").alias("book"), F.col("p_partkey").alias("n")
        ).agg(*flags) for k in (0, 1)
    ]
    return M.merge_greatest(*sides, ["book", "n"], ["solved", "stars", "errs"])


def override_merge(spark, sf):
    return M.merge_override(*snapshots(spark, sf), ["user_id", "day"], ["click", "view", "purchase"])


def touches(spark, sf):
    rows = events(spark, sf).select(
        "user_id",
        "event_type",
        F.dayofmonth("day").alias("last"),
        F.col("event_id"),
        F.round("value", 2).alias("value"),
    )
    return [
        M.keep_latest(
            rows.where(F.col("event_id") % 2 == k), ["user_id", "event_type"], [F.desc("last"), F.desc("event_id")], 1
        ).drop("event_id") for k in (0, 1)
    ]


def latest_merge(spark, sf):
    return M.merge_latest(*touches(spark, sf), ["user_id", "event_type"], F.col("last"), ["last", "value"])


def nested_merge(spark, sf):
    return M.merge_nested(*touches(spark, sf), "user_id", "event_type", "last", ["value"])


def progress_diff(spark, sf):
    rows = events(spark, sf)
    fields = [F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "view")]
    before = rows.where(F.dayofmonth("day") <= 15).groupBy("user_id").agg(*fields)
    after = rows.where(F.dayofmonth("day") > 12).groupBy("user_id").agg(*fields)
    return M.positive_changes(before, after, ["user_id"], ["click", "view"])


def ordered_union(spark, sf):
    local = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("ord"))
    cloud = table(spark, sf, "part").select(F.concat(F.lit(" "), F.col("p_brand")).alias("name"), F.col("p_partkey").alias("ord"))
    return M.ordered_union(local, cloud, "name", "ord")


def halves(spark, sf):
    """Odd keys and every fourth one are stored, even ones come in: together they are all orders, and some are in both."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return o.where("o_orderkey % 2 = 1 or o_orderkey % 4 = 0"), o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("U"))


def upsert_latest(spark, sf):
    return M.upsert(*halves(spark, sf), ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice"])


def insert_if_absent(spark, sf):
    return M.insert_if_absent(*halves(spark, sf), ["o_orderkey"])


def cap_history(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("o_day"))
    return M.keep_latest(rows, ["o_custkey"], [F.desc("o_day"), F.desc("o_orderkey")], 4)


def drop_sources(spark, sf):
    rows = events(spark, sf).select("user_id", "day", "event_type").distinct()
    return M.drop_sources(rows, "event_type", ["click", "view"]).groupBy("user_id", "day").agg(F.count("*").alias("kept"))


def publish_renumber(spark, sf):
    rows = table(spark, sf, "part").where("p_size > 10").select("p_brand", "p_partkey")
    return M.renumber(rows, "p_brand", ["p_partkey"])


def anti_join_resume(spark, sf):
    o, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left_anti").select("o_orderkey", "o_custkey")


def tiered_lookup(spark, sf):
    value = lambda flag: table(spark, sf, "lineitem").where(f"l_returnflag = '{flag}'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("q"))
    return M.tiered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", [("local", value("R")), ("cloud", value("A"))], "q")


def dedup_exact(spark, sf):
    """Texts are told apart by digest and length, so that no text is shuffled."""
    rows = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("digest"), F.length("text").alias("size"))
    return M.keep_first(rows, ["digest", "size"], "doc_id").select("doc_id", "copies")


def except_fallback(spark, sf):
    pool = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    skip = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return M.except_or_all(pool, skip, "c_custkey")


def zip_prefix(spark, sf):
    """Two users' days of events as moves: the type of the n-th event of each even user and of the next one."""
    rows = M.renumber(events(spark, sf).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])
    one = rows.where("user_id % 2 = 0").select("user_id", "n", "event_type")
    other = rows.where("user_id % 2 = 1").select((F.col("user_id") - 1).alias("user_id"), "n", "event_type")
    return M.zip_prefix(one, other, "user_id", "n", "event_type")


def override_cells(spark, sf):
    cells = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    fixes = table(spark, sf, "supplier").where("s_acctbal < 0").select("s_suppkey", F.lit(-1).alias("s_nationkey"))
    return M.override_cells(cells, fixes, ["s_suppkey"], "s_nationkey")


def completeness(spark, sf):
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    segments = F.broadcast(customers.select("c_mktsegment").distinct())
    expected = table(spark, sf, "nation").select("n_name").crossJoin(segments)
    return M.missing_keys(expected, customers.where("c_acctbal > 8000"), ["n_name", "c_mktsegment"])


def reading_merge(spark, sf):
    """What users read on two devices: the last value of each type as a map, and the place read last."""
    sides = []
    for k in (0, 1):
        rows = M.keep_latest(events(spark, sf).where(F.col("event_id") % 2 == k), ["user_id", "event_type"], [F.desc("event_id")], 1)
        done = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", (F.col("event_id") % 100).cast("int").alias("v")))))
        newest = F.max_by(
            F.struct(F.col("event_type").alias("place"), F.dayofmonth("day").alias("t")),
            F.struct(F.dayofmonth("day"), "event_id"),
        )
        sides.append(rows.groupBy("user_id").agg(done.alias("done"), newest.alias("x")).select("user_id", "done", "x.place", "x.t"))
    merged = M.merge_readings(*sides, "user_id", ["done"], "place", "t")
    flat = F.array_join(
        F.transform(F.array_sort(F.map_entries("done")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))),
        ",",
    )
    return merged.select("user_id", flat.alias("done"), "place", "t")


def snapshot_merge(spark, sf):
    """Entities of two snapshots by their own rules: days by maxima, settings of the device, names by union; one has no rows, one is on one side only."""
    local_days, cloud_days = snapshots(spark, sf)
    names = lambda t, c, o: table(spark, sf, t).select(F.col(c).alias("name"), F.col(o).alias("ord"))
    settings = table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("v"), "n_nationkey")
    own, other = (
        M.keep_latest(settings.where(f"n_nationkey % 2 = {i}"), ["k"], [F.desc("n_nationkey")], 1).select("k", "v") for i in (0, 1)
    )
    local = {"days": local_days, "names": names("customer", "c_mktsegment", "c_custkey"), "settings": own, "notes": own.limit(0)}
    cloud = {"days": cloud_days, "settings": other, "notes": other.limit(0)}
    rules = {
        "days": lambda a, b: M.merge_greatest(a, b, ["user_id", "day"], ["click", "view", "purchase"]),
        "names": lambda a, b: M.ordered_union(a, b, "name", "ord"),
        "settings": lambda a, b: M.merge_override(a, b, ["k"], ["v"]),
        "notes": lambda a, b: M.merge_override(a, b, ["k"], ["v"]),
        "reps": lambda a, b: M.merge_override(a, b, ["k"], ["v"]),
    }
    merged = M.merge_entities(local, cloud, rules)
    keys = {
        "days": F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")),
        "names": F.col("name"),
        "settings": F.col("v"),
    }
    parts = [frame.select(F.lit(name).alias("entity"), keys[name].alias("item")) for name, frame in merged.items()]
    return reduce(DataFrame.unionByName, parts)


def placement_dedup(spark, sf):
    """Suppliers come in, parts are stored; sizes and numbers stand for placements (a stored one is even), parity for the side to move."""
    incoming = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("n"),
        (F.col("s_suppkey") % 70).cast("int").alias("pl"),
        (F.col("s_suppkey") % 3 % 2).alias("side"),
    )
    stored = table(spark, sf, "part").select(
        F.col("p_partkey").alias("n"), (F.col("p_size") * 2).alias("pl"), (F.col("p_partkey") % 2).alias("side")
    )
    return M.dedup_by_place(incoming, stored, "pl", "n", "side")


def seed_union(spark, sf):
    """Suppliers as the seed set, customers as what was added: of equal numbers the seed's stays."""
    seed = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    added = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return M.suppressed([seed, added], "id")


QUERIES = {
    f.__name__: f for f in (
        reading_merge,
        snapshot_merge,
        placement_dedup,
        seed_union,
        stats_merge,
        progress_merge,
        override_merge,
        latest_merge,
        nested_merge,
        progress_diff,
        ordered_union,
        upsert_latest,
        insert_if_absent,
        cap_history,
        drop_sources,
        publish_renumber,
        anti_join_resume,
        tiered_lookup,
        dedup_exact,
        except_fallback,
        zip_prefix,
        override_cells,
        completeness,
    )
}

E = "with e as (select *, cast(ts as date) as day from events)"
SNAP = f"""{E}, s as (select event_id % 2 as src, user_id, day, count(*) filter (event_type = 'click') as click,
    count(*) filter (event_type = 'view') as view,
    count(*) filter (event_type = 'purchase') as purchase from e group by all)"""
TOUCH = f"""{E}, k as (select event_id % 2 as src, user_id, event_type, day_of_month as last, value,
    row_number() over (partition by event_id % 2, user_id, event_type order by day_of_month desc, event_id desc) as n
    from (select *, dayofmonth(day) as day_of_month from e)), t as (select src, user_id, event_type, cast(last as int) as last,
        round(value, 2) as value from k where n = 1)"""
HALVES = """with a as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey % 2 = 1 or o_orderkey % 4
    = 0),
    b as (select o_orderkey, o_custkey, 'U' as o_orderstatus, o_totalprice from orders where o_orderkey % 2 = 0)"""
SQL = {
    "reading_merge": f"""{E}, k as (select *, event_id % 2 as src, row_number() over (partition by event_id % 2, user_id,
        event_type order by event_id desc) as n from e), l as (select * from k where n = 1),
        m as (select user_id, event_type, arg_min(event_id % 100, src) as v from l group by all), j as (select user_id,
        string_agg(event_type || '=' || v, ',' order by event_type) as done from m group by 1),
        p as (select user_id, event_type as place, cast(dayofmonth(day) as int) as t,
        row_number() over (partition by user_id order by dayofmonth(day) desc, src, event_id desc) as r from l)
        select user_id, done, place, t from j join p using (user_id) where r = 1""",
    "snapshot_merge": f"""{SNAP}, s2 as (select user_id, day from s group by all having greatest(max(click), max(view), max(purchase)) > 0),
        n as (select n_regionkey, n_nationkey % 2 as src, arg_max(n_name, n_nationkey) as v from nation group by all)
        select 'days' as entity, user_id || '/' || day as item from s2 union all select distinct 'names',
        trim(c_mktsegment) from customer where trim(c_mktsegment) <> ''
        union all select 'settings', arg_min(v, src) from n group by n_regionkey""",
    "placement_dedup": """with i as (select s_suppkey as n, s_suppkey % 70 as pl, s_suppkey % 3 % 2 as side from supplier),
        s as (select p_size * 2 as pl, min(p_partkey) as n, arg_min(p_partkey % 2, p_partkey) as side from part group by 1),
        f as (select pl, min(n) as first from i group by 1)
        select i.n, case when s.n is not null then 'stored' when first < i.n then 'incoming' else 'new' end as repeats,
        case when s.n is not null then s.n when first < i.n then first end as other, coalesce(s.side <> i.side, false) as clash
        from i left join s using (pl) join f using (pl)""",
    "seed_union": """select s_suppkey as id, 0 as src, s_name as name from supplier union all select c_custkey, 1,
        c_name from customer where c_custkey not in (select s_suppkey from supplier)""",
    "stats_merge": f"""{SNAP} select user_id, day, max(click) as click, max(view) as view,
        max(purchase) as purchase from s group by all having greatest(max(click), max(view), max(purchase)) > 0""",
    "progress_merge": """with s as (select l_orderkey % 2 as src, p_brand as book, p_partkey as n,
        max(case when l_returnflag = 'R' then 1 else 0 end) as solved, max(cast(l_quantity % 4 as int)) as stars,
        count(*) filter (l_discount > 0.08) as errs from lineitem join part on l_partkey = p_partkey group by all)
        select book, n, max(solved) as solved, max(stars) as stars, max(errs) as errs from s group by book,
        n having greatest(max(solved), max(stars), max(errs)) > 0""",
    "override_merge": f"""{SNAP} select user_id, day, arg_min(click, src) as click, arg_min(view, src) as view, arg_min(purchase,
        src) as purchase from s group by user_id, day""",
    "latest_merge": f"""{TOUCH} select user_id, event_type, cast(src as int) as src, last, value from (select *,
        row_number() over (partition by user_id, event_type order by last desc, src) as k from t) where k = 1""",
    "nested_merge": f"""{TOUCH}, c as (select *, row_number() over (partition by user_id, event_type order by last desc, src) as k from t),
        p as (select user_id, src, max(last) as m from t group by all), b as (select user_id, src as base,
        row_number() over (partition by user_id order by m desc, src) as k from p)
        select c.user_id, event_type, cast(src as int) as src, last, value, cast(base as int) as base from c join b on b.user_id =
        c.user_id and b.k = 1 where c.k = 1""",
    "progress_diff": f"""{E}, b as (select user_id, count(*) filter (event_type = 'click') as click,
        count(*) filter (event_type = 'view') as view from e where dayofmonth(day) <= 15 group by 1),
        a as (select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view from e
        where dayofmonth(day) > 12 group by 1)
        select a.user_id, greatest(0, a.click - coalesce(b.click, 0)) as click, greatest(0, a.view - coalesce(b.view,
        0)) as view from a left join b using (user_id)""",
    "ordered_union": """with u as (select trim(c_mktsegment) as name, 0 as src, c_custkey as ord from customer union all select trim(' '
        || p_brand), 1, p_partkey from part), r as (select *, row_number() over (partition by name order by src,
        ord) as k from u where name <> '')
        select name, src, ord from r where k = 1""",
    "upsert_latest": f"{HALVES} select * from b union all select * from a where o_orderkey not in (select o_orderkey from b)",
    "insert_if_absent": f"{HALVES} select * from a union all select * from b where o_orderkey not in (select o_orderkey from a)",
    "cap_history": """select o_custkey, o_orderkey, o_day from (select o_custkey, o_orderkey, cast(o_orderdate as date) as o_day,
        row_number() over (partition by o_custkey order by cast(o_orderdate as date) desc,
        o_orderkey desc) as n from orders) where n <= 4""",
    "drop_sources": f"""{E} select user_id, day, count(*) as kept from (select distinct user_id, day,
        event_type from e) where event_type not in ('click', 'view') group by all""",
    "publish_renumber": """select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as n from part where
        p_size > 10""",
    "anti_join_resume": """select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where
        l_returnflag = 'R')""",
    "tiered_lookup": """with r as (select l_orderkey, max(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1),
        a as (select l_orderkey, max(l_quantity) as q from lineitem where l_returnflag = 'A' group by 1)
        select o_orderkey, coalesce(r.q, a.q) as q, case when r.q is not null then 'local' when a.q is not null then 'cloud' else
        'compute' end as tier from orders left join r on r.l_orderkey = o_orderkey left join a on a.l_orderkey = o_orderkey""",
    "dedup_exact": "select min(doc_id) as doc_id, count(*) as copies from documents group by text",
    "except_fallback": """with p as (select c_custkey from customer where c_mktsegment = 'BUILDING'),
        l as (select * from p where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F'))
        select * from l union all select * from p where not exists (select 1 from l)""",
    "zip_prefix": """with r as (select user_id, event_type, row_number() over (partition by user_id order by ts,
        event_id) as n from events),
        j as (select coalesce(x.user_id, y.user_id - 1) as user_id, coalesce(x.n, y.n) as n, x.event_type as a, y.event_type as b
          from (select * from r where user_id % 2 = 0) x full join (select * from r where user_id % 2 = 1) y on x.user_id = y.user_id -
        1 and x.n = y.n)
        select user_id, n, a, b, min(a is not distinct from b) over (partition by user_id order by n rows between unbounded preceding
        and current row) as same from j""",
    "override_cells": """select s_suppkey, case when s_acctbal < 0 then -1 else s_nationkey end as s_nationkey,
        s_acctbal < 0 as fixed from supplier""",
    "completeness": """with f as (select distinct n_name, c_mktsegment from customer join nation on c_nationkey = n_nationkey where
        c_acctbal > 8000), g as (select n_name, c_mktsegment from nation, (select distinct c_mktsegment from customer join nation on
        c_nationkey = n_nationkey))
        select n_name, c_mktsegment, 'absent' as problem from (select * from g except select * from f) union all select n_name,
        c_mktsegment, 'unexpected' from (select * from f except select * from g)""",
}
