"""Queries over placements: near ones, labels mended by their cost, men won along lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.board import COSTS
from ..operators import placements as P
from ..scratch import Scratch
from ..sources.tables import table
from .match import BOARDS, boards

SWEEPS = 6


def near_placements(spark, sf):
    """Boards of customers, copies of a supplier's with up to five cells changed, against those of all suppliers."""
    n, size = F.col("c_custkey"), F.lit(table(spark, sf, "supplier").count())
    put = lambda cells, k: F.overlay(cells, F.lit("q"), ((n * 31 + k * 13) % 64 + 1).cast("int"), F.lit(1))
    changed = F.aggregate(F.slice(F.array(*map(F.lit, range(1, 6))), F.lit(1), (n % 6).cast("int")), F.col("cells"), put)
    with Scratch(spark) as scratch:
        known = scratch.settled(boards(spark, sf).select(F.col("id").alias("node"), "cells"), "boards")
        copies = table(spark, sf, "customer").select(n, (n % size).alias("node"))
        found = scratch.settled(copies.join(known, "node").select(n, changed.alias("cells")), "copies")
        return P.near_placements(found, known, "c_custkey", "node", "cells")


def clusters(spark, sf):
    """Cells of all boards in clusters of one man each, each within 8 boards; labels of every 31st cluster have the other colour."""
    cells = boards(spark, sf).select(F.col("id").alias("board"), F.posexplode(F.split("cells", "")).alias("square", "man")).where("man <> '.'")
    cells = cells.withColumn("cluster", F.floor(F.col("board") / 8) * 1000 + F.ascii("man") * 8 + (F.col("board") * 3 + F.col("square")) % 8)
    seen = cells.groupBy("cluster").agg(F.min("man").alias("man"))
    turned = F.when(F.col("man") == F.upper("man"), F.lower("man")).otherwise(F.upper("man"))
    return cells.select("board", "square", "cluster"), seen.select("cluster", F.when(F.col("cluster") % 31 == 3, turned).otherwise(F.col("man")).alias("label"))


def searched_labels(spark, sf):
    cells, labels = clusters(spark, sf)
    return P.search_labels(cells, labels, SWEEPS)


def line_gains(spark, sf):
    """Lines of up to four moves by a rule of the board's number, promotions included."""
    n = F.col("id")
    name = lambda i: F.concat(F.char(F.lit(97) + i % 8), (F.lit(8) - F.floor(i / 8)).cast("string"))
    moves = [F.concat(name((n * 7 + k * 11) % 64), name((n * 13 + k * 29) % 64), F.when((n + k) % 5 == 0, "q").otherwise("")) for k in range(4)]
    line = F.slice(F.array(*moves), F.lit(1), (n % 5).cast("int"))
    return boards(spark, sf).select("id", P.line_gain(F.col("cells"), n % 2 == 0, line).alias("gain"))


QUERIES = {f.__name__: f for f in (near_placements, searched_labels, line_gains)}


def _cost(k, q, p, m):
    over = "greatest(0, {})".format
    return (
        f"({COSTS['king']} * abs({k} - 1) + {COSTS['pawns']} * {over(f'{p} - 8')} + {COSTS['men']} * {over(f'{m} - 16')}"
        f" + {COSTS['queens']} * {over(f'{q} - 1 - {over(f'8 - {p}')}')})"
    )


def _sweep(i):
    """One sweep in SQL: what each board has, what each change would cost, which clusters take theirs."""
    has = ", ".join(
        f"coalesce(sum(n) filter (white = {w} and {'true' if k == 'M' else f"kind = '{k}'"}) over (partition by board), 0) as {s}{k}"
        for w, s in (("true", "w"), ("false", "b"))
        for k in "KQPM"
    )
    own = {k: f"(case when white then w{k} else b{k} end)" for k in "KQPM"}
    other = {k: f"(case when white then b{k} else w{k} end)" for k in "KQPM"}
    part = {k: "n" if k == "M" else f"(case when kind = '{k}' then n else 0 end)" for k in "KQPM"}
    less = f"{_cost(*(f'({own[k]} - {part[k]})' for k in 'KQPM'))} - {_cost(*own.values())}"
    more = f"{_cost(*(f'({other[k]} + {part[k]})' for k in 'KQPM'))} - {_cost(*other.values())}"
    return f"""
n{i} as (select board, cluster, n, outr, size, label, upper(label) as kind, label = upper(label) as white from p join l{i} using (cluster) where label <> 'X'),
h{i} as (select *, {has} from n{i}),
d{i} as (select cluster, label, size, sum({less} + {more}) as flip, sum({less} - case when kind = 'P' then {COSTS['outer']} * outr else 0 end) as none from h{i} group by all),
w{i} as (select cluster, case when label = upper(label) then lower(label) else upper(label) end as new, flip as delta, 0 as way from d{i} where flip < 0
  union all select cluster, 'X', none, 1 from d{i} where none < 0 and size < 8),
m{i} as (select * from w{i} qualify row_number() over (partition by cluster order by delta, way) = 1),
f{i} as (select cluster, new, row_number() over (partition by board order by delta, cluster) = 1 as best from p join m{i} using (cluster)),
t{i} as (select cluster, any_value(new) as new from f{i} group by cluster having bool_and(best)),
l{i + 1} as materialized (select cluster, coalesce(new, label) as label from l{i} left join t{i} using (cluster)),"""


_WORTH = "(case lower({0}) when 'p' then 1 when 'n' then 3 when 'b' then 3 when 'r' then 5 when 'q' then 9 else 0 end * case when {0} = upper({0}) then 1 else -1 end)"
_SUM = "list_sum(list_transform({0}, lambda x: " + _WORTH.format("x") + "))"


def _push(k):
    """The cells after one more move."""
    a, b, new = f"(id * 7 + {k} * 11) % 64", f"(id * 13 + {k} * 29) % 64", f"(id + {k}) % 5 = 0"
    man = f"(c[{a} + 1])"
    put = f"case when {new} then case when {man} = upper({man}) then 'Q' else 'q' end else {man} end"
    passing = f"upper({man}) = 'P' and c[{b} + 1] = '.' and ({a} - {b}) % 8 <> 0 and i - 1 = (({a}) // 8) * 8 + {b} % 8"
    return f"""c{k + 1} as (select id, line, s, case when line > {k} then list_transform(c, lambda x, i: case when i - 1 = {b} then {put}
  when i - 1 = {a} or ({passing}) then '.' else x end) else c end as c from c{k}),"""


SQL = {
    "near_placements": f"""{BOARDS}, s as (select count(*) as size from supplier), f as (select c_custkey, array_to_string(list_transform(range(0, 64),
        lambda i: case when len(list_filter(range(1, 6), lambda k: k <= c_custkey % 6 and i = (c_custkey * 31 + k * 13) % 64)) > 0 then 'q' else
        substr(b.cells, cast(i + 1 as int), 1) end), '') as cells from customer, s join b on b.id = c_custkey % s.size),
        d as (select c_custkey, id, hamming(f.cells, b.cells) as d from f, b), r as (select * from d where d <= 3
        qualify row_number() over (partition by c_custkey order by d, id desc) = 1)
        select c_custkey, r.id as node, cast(r.d as int) as d from f left join r using (c_custkey)""",
    "searched_labels": f"""{BOARDS}, c as (select id as board, i as square, substr(cells, cast(i + 1 as int), 1) as man from b, range(0, 64) t(i)),
        k as (select *, board // 8 * 1000 + ascii(man) * 8 + (board * 3 + square) % 8 as cluster from c where man <> '.'),
        p as materialized (select board, cluster, count(*) as n, count(*) filter (square < 8 or square >= 56) as outr, sum(count(*)) over (partition
        by cluster) as size from k group by board, cluster),
        l0 as (select cluster, case when cluster % 31 <> 3 then min(man) when min(man) = upper(min(man)) then lower(min(man)) else upper(min(man)) end
        as label from k group by cluster),{"".join(map(_sweep, range(SWEEPS)))}
        z as (select 1) select cluster, label from l{SWEEPS}""",
    "line_gains": f"""{BOARDS}, c0 as (select id, (id % 5)::int as line, string_split(cells, '') as s, string_split(cells, '') as c from b),
        {_push(0)} {_push(1)} {_push(2)} e as (select 1)
        select id, case when line > 0 then ({_SUM.format("c")} - {_SUM.format("s")})::int * case when id % 2 = 0 then 1 else -1 end end as gain from c3""",
}
