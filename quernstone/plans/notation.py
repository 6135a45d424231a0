"""Queries over printed notation, engine lines, labels and references, whose texts follow from the tables' rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import fold_mate
from ..operators import notation as N
from ..operators import rules as R
from ..sources.tables import events, table


def pick(n, *values):
    """One of the values by number."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))


def ordered(key, *order):
    return W.partitionBy(key).orderBy(*order)


def text_of(n):
    return n.cast("string")


def plain_notation(spark, sf):
    k = F.col("c_custkey")
    gaps = pick(k, " . ... Nf3 then", " ... e5", "... Kd7", ". Rd4", ".  then", ". O-O")
    printed = F.concat(text_of(k % 50 + 1), gaps, pick(k, " R1:d4", " e4 : d5", " c:d5", " Nc: d5", " 0-0-0 0-0", " at 5: f"))
    return table(spark, sf, "customer").select("c_custkey", N.plain_notation(printed).alias("moves"))


def plain_figures(spark, sf):
    k = F.col("p_partkey")
    printed = F.concat(
        F.substring(F.lit(N.FIGURES), (k % 14 + 1).cast("int"), F.lit(1)),
        F.lit("f3 "),
        F.substring(F.lit(N.FIGURES), (k % 5 + 10).cast("int"), F.lit(1)),
        "p_brand",
    )
    return table(spark, sf, "part").select("p_partkey", N.plain_figures(printed).alias("moves"))


def latin_squares(spark, sf):
    k = F.col("p_partkey")
    shapes = pick(k, "Kс", "ас", "слово с", "все", "N", "есf")
    return table(spark, sf, "part").select("p_partkey", N.latin_squares(F.concat(shapes, text_of(k % 8 + 1), F.lit(" x"))).alias("moves"))


def answers_by_number(spark, sf):
    """A page of answers for each brand and thousand of numbers: the number on a line of its own, or before the first move."""
    k = F.col("p_partkey")
    own_line = F.concat(F.lit("\n "), text_of(k), F.lit(". \n 1.e4  e5\n2."), text_of(k % 9), F.lit("f3"))
    in_line = F.concat(F.lit("\n"), text_of(k), F.lit(". 4.d4 \n d5 "), text_of(k % 7))
    entry = F.struct(k.alias("k"), F.when(k % 2 == 0, own_line).otherwise(in_line).alias("t"))
    page = F.concat(F.lit("Answers"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), ""))
    pages = table(spark, sf, "part").groupBy("p_brand", F.floor(k / 1000)).agg(page.alias("page"))
    return pages.select("p_brand", F.explode(N.answers_by_number(F.col("page"))).alias("a")).select("p_brand", "a.n", "a.answer")


def lead_bold(spark, sf):
    k = F.col("p_partkey")
    begin = pick(k, "12.Nf3 Nc6 13.e4", "0-0", "Now", "7...Bxc3+! 8.bc")
    return table(spark, sf, "part").select("p_partkey", N.lead_bold(F.concat(begin, F.lit(" Then "), "p_brand")).alias("line"))


def lines_of_squares(spark, sf):
    k = F.col("c_custkey")
    square = lambda a, b: F.concat(F.chr(F.lit(97) + a % 8), text_of(b % 8 + 1))
    token = F.concat(square(k, F.floor(k / 8)), F.lit("-"), square(F.floor(k / 3), F.floor(k / 5)))
    return table(spark, sf, "customer").select("c_custkey", token.alias("token"), N.is_line_of_squares(token).alias("is_line"))


def engine_output(spark, sf):
    """Events as an engine's lines: users are positions."""
    n = F.col("event_id")
    score = F.when(
        n % 7 == 0, F.concat(F.lit(" score mate "), text_of(n % 5 - 2))
    ).otherwise(F.concat(F.lit(" score cp "), text_of(n % 300 - 100)))
    bound = F.when(n % 13 == 0, F.lit(" lowerbound")).otherwise(F.lit(""))
    moves = F.when(n % 17 == 0, F.lit("")).otherwise(F.concat(F.lit(" nodes 9 pv "), pick(n, "e2e4", "d2d4", "g1f3"), F.lit(" e7e5")))
    line = F.concat(F.lit("info depth "), text_of(n % 20), F.lit(" seldepth 3 multipv "), text_of(n % 3 + 1), score, bound, moves)
    return events(spark, sf).select(
        "user_id", n.alias("seq"), F.when(n % 19 == 0, F.lit("bestmove e2e4 pv x")).otherwise(line).alias("line")
    )


def engine_lines(spark, sf):
    found = N.engine_lines(engine_output(spark, sf), "line", "seq", ["user_id"])
    cp = fold_mate(F.col("kind"), F.col("score"))
    return found.select("user_id", "rank", "depth", cp.alias("cp"), F.array_join("moves", " ").alias("moves"))


def twin_moves(spark, sf):
    found = N.engine_lines(engine_output(spark, sf), "line", "seq", ["user_id"])
    return N.twins(found.withColumn("cp", fold_mate(F.col("kind"), F.col("score"))), ["user_id"])


def played(spark, sf):
    k = F.col("p_partkey")
    move = F.when(k % 10 != 0, F.concat(pick(k, "e2e4", "d2d4", "a7a8"), F.when(k % 4 == 0, F.lit("q")).otherwise(F.lit(""))))
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", move.alias("move"))
    best = F.when(k % 6 != 0, F.concat(pick(F.floor(k / 2), "e2e4", "d2d4", "a7a8"), F.lit("q")))
    engine = rows.select("p_partkey", best.alias("best"))
    return rows, engine


def engine_agreement(spark, sf):
    """How often the first move of an answer is the engine's, by brand."""
    rows, engine = played(spark, sf)
    met = N.agreement(rows, engine, "p_partkey", "move", "best").join(rows.select("p_partkey", "p_brand"), "p_partkey")
    return met.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if("agrees").alias("agreed"))


def suspicious_choices(spark, sf):
    k = F.col("p_partkey")
    marked = F.array(
        F.concat(pick(k, "Nf3", "e4"), pick(k, "", "!", "?")),
        F.concat(pick(k, "Qd5", "Rc1", "O-O"), pick(F.floor(k / 2), "", "!!", "!")),
    )
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.when(k % 9 != 0, pick(F.floor(k / 3), "Nf3!", "e4", "Qd5", "Rc1?")).alias("chosen"),
        marked.alias("candidates"),
    )
    return N.suspicious(rows, "chosen", "candidates").select("p_partkey", "chosen")


def best_candidates(spark, sf):
    k = F.col("l_partkey")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item"),
        (
            F.row_number().over(ordered("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")) - 1
        ).alias("at"),
        (k % 6).alias("plies"),
        pick(k, "", "!", "?", "!!", "!?").alias("marks"),
        *((k % m == 0).alias(flag) for m, flag in ((7, "mates"), (5, "doubted"), (4, "praised"), (3, "won"))),
    )
    return N.best_candidate(rows, "item", "at")


def label_gaps(spark, sf):
    """Suppliers of a nation as diagrams, numbered in chapters of ten; the number of every third can't be read."""
    at = F.row_number().over(ordered("s_nationkey", "s_suppkey"))
    rows = table(spark, sf, "supplier").select(
        "s_nationkey",
        "s_suppkey",
        F.floor((at - 1) / 10).alias("chapter"),
        ((at - 1) % 10 + 1 + F.when(at % 11 == 0, 1).otherwise(0)).alias("n"),
    )
    read = rows.withColumn("number", F.when(F.col("s_suppkey") % 3 != 0, F.col("n")))
    return N.label_gaps(read, "s_nationkey", "s_suppkey", "chapter", "number").select("s_suppkey", "number", "filled")


def after_references(spark, sf):
    """Customers of a nation as a page's items: diagrams, references to them, game headers and paragraphs."""
    k = F.col("c_custkey")
    kind = pick(k, "diag", "p", "ref", "game", "game", "p", "p")
    label = F.when(kind.isin("diag", "ref"), F.floor(k / 14))
    rows = table(spark, sf, "customer").select(
        (F.col("c_nationkey") * 100 + F.floor(k / 70) % 100).alias("page"),
        k.alias("at"),
        kind.alias("kind"),
        label.alias("label"),
    )
    one_each = rows.dropDuplicates(["page", "kind", "label", "at"])
    return N.after_references(one_each, "page", "at", "kind", "label").select("page", "at", "place")


def chapter_modes(spark, sf):
    turns = table(spark, sf, "conversations").where(
        "conv_id is not null and turn is not null"
    ).select("conv_id", "turn", "role").distinct().dropDuplicates(["conv_id", "turn"])
    marked = turns.withColumn("kind", F.when(F.col("turn") % 4 == 0, "exercises").when(F.col("turn") % 7 == 3, "solutions").otherwise("p"))
    return N.chapter_modes(
        marked, "conv_id", "turn", "kind", {"exercises": "ex", "solutions": "sol"}, "intro"
    ).select("conv_id", "turn", "mode")


def rehomed_roots(spark, sf):
    """Customers as nodes; suppliers as roots, of which the odd ones have children."""
    k = F.col("c_custkey")
    parent = F.when(k % 5 == 0, -(2 * F.floor(k / 10) + 1))
    nodes = table(spark, sf, "customer").select(
        k.alias("node"), parent.alias("parent"), (k % 37).alias("placement"), pick(k, "w", "b").alias("side")
    )
    s = F.col("s_suppkey")
    roots = table(spark, sf, "supplier").select(
        (-s).alias("root"), (s % 53).alias("placement"), pick(F.floor(s / 2), "w", "b").alias("side")
    )
    return N.rehomed(roots, nodes)


def own_games(spark, sf):
    """Why orders, as games, are not looked at when those of one customer are wanted."""
    k = F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("U"), text_of(k % 3)).alias("white"),
        F.concat(F.lit("u"), text_of(F.col("o_orderkey") % 4)).alias("black"),
        pick(F.col("o_orderkey"), "", "Standard", "Chess960", "From standard").alias("variant"),
        (k % 1300).alias("base"),
        (F.col("o_totalprice") / 2000).cast("int").alias("plies"),
    )
    why = R.own_reason("u0", "white", "black", "variant", F.col("base"), F.col("plies"), 20)
    return rows.select(F.coalesce(why, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def missed_wins(spark, sf):
    result = F.element_at(
        F.create_map(F.lit("F"), F.lit("1-0"), F.lit("O"), F.lit("0-1"), F.lit("P"), F.lit("1/2-1/2")),
        F.col("o_orderstatus"),
    )
    k = F.col("o_orderkey")
    flag, tags = R.missed(k % 3 != 0, result, k % 2 == 0, F.split("o_orderpriority", "-"))
    return table(spark, sf, "orders").select("o_orderkey", flag.alias("missed"), F.array_join(tags, ",").alias("tags"))


def overlapping_sections(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", F.explode(R.sections_of(k % 9 + 1, k % 4 == 0, k % 3 == 0)).alias("section"))
    return rows.groupBy("section").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def small_advantages(spark, sf):
    mate, cp = F.when(F.col("c_custkey") % 7 == 0, 3), F.when(F.col("c_custkey") % 5 != 0, F.floor(F.col("c_acctbal") / 10))
    accepted, other = R.parted(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey", mate.alias("mate"), cp.alias("cp")),
        R.little_advantage(F.col("mate"), F.col("cp")),
    )
    return accepted.select("c_custkey", F.lit(True).alias("small")).unionByName(other.select("c_custkey", F.lit(False).alias("small")))


def last_symbols(spark, sf):
    mate, cp = F.when(F.col("c_custkey") % 7 == 0, 3), F.floor(F.col("c_acctbal") / 10)
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.array_join(R.last_symbols((F.col("c_custkey") % 5 + 1).cast("int"), mate, cp), ",").alias("symbols"),
    )


def place_counts(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return R.place_counts(customers, suppliers, "nation")


def label_or_place(spark, sf):
    """Tags are a nation's suppliers, boards as many of its customers as that, one fewer in odd nations; labels run backwards."""
    tags = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nation"),
        "s_suppkey",
        F.when(F.col("s_nationkey") % 3 != 0, -F.col("s_suppkey")).alias("label"),
    )
    counts = tags.groupBy("nation").agg(F.count("*").alias("n"))
    at = F.row_number().over(ordered("c_nationkey", "c_custkey"))
    customers = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation"), "c_custkey", at.alias("at")
    ).join(counts, "nation")
    boards = customers.where(F.col("at") <= F.col("n") - F.col("nation") % 2).select("nation", "c_custkey")
    return R.match_by_label_or_place(boards, tags, "nation", "c_custkey", "s_suppkey", "label")


def game_ends(spark, sf):
    n = F.col("event_id")
    plies = events(spark, sf).select(
        "user_id",
        F.row_number().over(ordered("user_id", "ts", "event_id")).alias("ply"),
        (n % 40).alias("position"),
        (n % 130).alias("clock"),
        (n % 50).alias("moves_left"),
        (n % 3 == 0).alias("in_check"),
        (n % 90 == 7).alias("too_little"),
    )
    return R.game_ends(plies, "user_id", "ply")


def export_rows(spark, sf):
    positions = table(spark, sf, "part").select("p_partkey", "p_brand")
    kept = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    margins = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_discount") * 7).alias("margin"))
    return R.export_rows(positions, kept, margins, "p_partkey")


def default_fields(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 20, F.col("p_size")).alias("size"))
    return R.filled(rows, {"size": 0, "theme": "dark"})


QUERIES = {
    f.__name__: f
    for f in (
        *(plain_notation, plain_figures, latin_squares, answers_by_number, lead_bold, lines_of_squares, engine_lines, twin_moves),
        *(engine_agreement, suspicious_choices, best_candidates, label_gaps, after_references, chapter_modes, rehomed_roots),
        *(own_games, missed_wins, overlapping_sections, small_advantages, last_symbols, place_counts, label_or_place, game_ends),
        *(export_rows, default_fields),
    )
}

LINES = """with l as (select user_id, event_id as seq, event_id % 3 + 1 as rank, event_id % 20 as depth,
      case when event_id % 7 = 0 then case when event_id % 5 - 2 > 0 then 10000 - (event_id % 5 - 2) else -10000 - (event_id % 5 - 2)
        end else event_id % 300 - 100 end as cp,
      ['e2e4', 'd2d4', 'g1f3'][event_id % 3 + 1] || ' e7e5' as moves from events where event_id % 13 <> 0 and event_id % 17 <> 0 and
        event_id % 19 <> 0),
    d as (select *, row_number() over (partition by user_id, rank order by depth desc, seq desc) as k from l)"""
SQL = {
    "plain_notation": """select c_custkey, (c_custkey % 50 + 1) || ['...Nf3 then', '...e5', '...Kd7', '.Rd4', '.  then',
        '. O-O'][c_custkey % 6 + 1]
        || [' R1xd4', ' e4xd5', ' cxd5', ' Ncxd5', ' O-O-O O-O', ' at 5: f'][c_custkey % 6 + 1] as moves from customer""",
    "plain_figures": """with s as (select '♔♕♖♗♘♚♛♜♝♞–—−' as f, 'KQRBNKQRBN---' as l) select p_partkey, translate(substr(f,
        p_partkey % 14 + 1, 1) || 'f3 ' || substr(f, p_partkey % 5 + 10, 1) || p_brand, f, l) as moves from part, s""",
    "latin_squares": """select p_partkey, ['Kc', 'ac', 'слово c', 'все', 'N', 'есf'][p_partkey % 6 + 1] || (p_partkey % 8 + 1) || ' x'
        as moves from part""",
    "answers_by_number": """select p_brand, cast(p_partkey as int) as n, case when p_partkey % 2 = 0 then '1.e4 e5 2.' || (p_partkey %
        9) || 'f3' else '4.d4 d5 ' || (p_partkey % 7) end as answer from part""",
    "lead_bold": """select p_partkey, ['**12.Nf3 Nc6 13.e4**', '**0-0**', 'Now', '**7...Bxc3+! 8.bc**'][p_partkey % 4 + 1] || ' Then '
        || p_brand as line from part""",
    "lines_of_squares": """with s as (select c_custkey, c_custkey % 8 as f1, c_custkey // 8 % 8 + 1 as r1, c_custkey // 3 % 8 as f2,
        c_custkey // 5 % 8 + 1 as r2 from customer)
        select c_custkey, chr(cast(97 + f1 as int)) || r1 || '-' || chr(cast(97 + f2 as int)) || r2 as token,
          abs(f1 - f2) > 1 or abs(r1 - r2) > 2 or r1 = r2 or (abs(f1 - f2) = 1 and abs(r1 - r2) <> 1) as is_line from s""",
    "engine_lines": f"{LINES} select user_id, rank, depth, cp, moves from d where k = 1",
    "twin_moves": f"""{LINES} select a.user_id, split_part(a.moves, ' ', 1) as best, split_part(b.moves, ' ', 1) as twin, a.cp - b.cp as gap
        from (select * from d where k = 1 and rank = 1) a join (select * from d where k = 1 and rank = 2) b using (user_id) where best
        <> twin and gap < 30""",
    "engine_agreement": """with m as (select p_brand, ['e2e4', 'd2d4', 'a7a8'][p_partkey % 3 + 1] as move,
        case when p_partkey % 6 <> 0 then ['e2e4', 'd2d4', 'a7a8'][p_partkey // 2 % 3 + 1] end as best from part where p_partkey % 10 <>
        0)
        select p_brand, count(*) as n, count(*) filter (move = best) as agreed from m group by 1""",
    "suspicious_choices": """with c as (select p_partkey, ['Nf3!', 'e4', 'Qd5', 'Rc1?'][p_partkey // 3 % 4 + 1] as chosen, [['Nf3',
        'e4'][p_partkey % 2 + 1], ['Qd5', 'Rc1', 'O-O'][p_partkey % 3 + 1]] as moves,
          [p_partkey % 3 = 1, p_partkey // 2 % 3 > 0] as praised from part where p_partkey % 9 <> 0)
        select p_partkey, chosen from c where (praised[1] or praised[2]) and not (praised[1] and moves[1] = rtrim(chosen,
        '!?')) and not (praised[2] and moves[2] = rtrim(chosen, '!?'))""",
    "best_candidates": """with c as (select l_orderkey as item, row_number() over (partition by l_orderkey order by l_linenumber,
        l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as "at", l_partkey as k, l_partkey % 6 as plies from lineitem),
        s as (select item, "at", 1.5 * plies + 2 * "at" + [0, 26, 0, 34, 26][k % 5 + 1] - case when k % 5 in (2,
        4) then 60 else 0 end + case when k % 7 = 0 then 12 else 0 end - case when k % 5 = 0 then 32 else 0 end
          + case when k % 4 = 0 then 12 else 0 end + case when k % 3 = 0 then 12 else 0 end as points,
        row_number() over (partition by item order by points desc, "at") as r from c where plies > 0)
        select item, "at", cast(points as double) as points from s where r = 1""",
    "label_gaps": """with a as (select s_nationkey as g, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) as
        "at" from supplier),
        r as (select *, ("at" - 1) // 10 as c, case when s_suppkey % 3 <> 0 then ("at" - 1) % 10 + 1 + case when "at" % 11 = 0 then 1
        else 0 end end as n from a),
        w as (select *, last_value(case when n is not null then [c, n, "at"] end ignore nulls) over (partition by g order by "at" rows
        between unbounded preceding and 1 preceding) as p,
          first_value(case when n is not null then [c, n, "at"] end ignore nulls) over (partition by g order by "at" rows between 1
        following and unbounded following) as q from r)
        select s_suppkey, cast(n as int) as number, coalesce(n, case when p[1] = q[1] and q[2] - p[2] = q[3] - p[3] then p[2] + "at" -
        p[3] end) as filled from w""",
    "after_references": """with i as (select c_nationkey * 100 + c_custkey // 70 % 100 as page, c_custkey as "at", ['diag', 'p', 'ref',
        'game', 'game', 'p', 'p'][c_custkey % 7 + 1] as kind, case when c_custkey % 7 in (0,
        2) then c_custkey // 14 end as label from customer),
        r as (select page, label, min("at") as ref_at from i where kind = 'ref' group by all), d as (select i.*,
        case when kind = 'diag' then ref_at end as ref_at from i left join r using (page, label)),
        n as (select d.*, (select min(o."at") from i o where o.page = d.page and o."at" > d.ref_at and o.kind not in ('game',
        'diag')) as stop from d),
        p as (select n.*, (select max(o."at") from i o where o.page = n.page and o.kind = 'game' and o."at" > n.ref_at and o."at" <
        coalesce(n.stop, 1000000000000)) as past from n)
        select page, "at", row_number() over (partition by page order by case when ref_at is not null then coalesce(past,
        ref_at) + 0.5 else "at" end, "at") as place from p""",
    "chapter_modes": """with t as (select distinct conv_id, turn from conversations where conv_id is not null and turn is not null)
        select conv_id, turn, coalesce(last_value(case when turn % 4 = 0 then 'ex' when turn % 7 = 3 then 'sol' end ignore nulls) over
        (partition by conv_id order by turn rows between unbounded preceding and current row), 'intro') as mode from t""",
    "rehomed_roots": """with n as (select c_custkey as node, case when c_custkey % 5 = 0 then -(2 * (c_custkey // 10) + 1) end as
        parent, c_custkey % 37 as pl, ['w', 'b'][c_custkey % 2 + 1] as side from customer),
        r as (select -s_suppkey as root, s_suppkey % 53 as pl, ['w', 'b'][s_suppkey // 2 % 2 + 1] as side from supplier)
        select root, coalesce((select min(node) from n where n.pl = r.pl and n.side = r.side),
        (select min(node) from n where n.pl = r.pl), root) as home from r where root not in (select parent from n where parent is not
        null)""",
    "own_games": """select case when 'u' || (o_custkey % 3) <> 'u0' and 'u' || (o_orderkey % 4) <> 'u0' then 'not one''s own' when
        o_orderkey % 4 = 2 then 'other rules' when o_custkey % 1300 < 600 then 'fast'
        when cast(trunc(o_totalprice / 2000) as int) < 40 then 'short' else 'kept' end as reason, count(*) as n from orders group by 1""",
    "missed_wins": """with o as (select *, o_orderkey % 3 <> 0 and not (case when o_orderkey % 2 = 0 then o_orderstatus = 'F' else
        o_orderstatus = 'O' end) as missed from orders)
        select o_orderkey, missed, replace(o_orderpriority, '-', ',') || case when missed then ',missed' else '' end as tags from o""",
    "overlapping_sections": """with p as (select p_partkey, (p_partkey % 9 + 2) // 2 as own from part),
        s as (select p_partkey, unnest(list_filter([case when p_partkey % 4 = 0 then 'mate' end,
        case own when 1 then 'one' when 2 then 'two' when 3 then 'three' else 'long' end, case when p_partkey % 3 = 0 then 'black' end],
        lambda x: x is not null)) as section from p)
        select section, count(*) as n, min(p_partkey) as first from s group by 1""",
    "small_advantages": """select c_custkey, c_custkey % 7 <> 0 and c_custkey % 5 <> 0 and floor(c_acctbal / 10) < 150 as small from
        customer""",
    "last_symbols": """select c_custkey, repeat(',', cast(c_custkey % 5 as int)) || case when c_custkey % 7 = 0 then '#' when
        floor(c_acctbal / 10) >= 300 then '+−' when floor(c_acctbal / 10) <= -300 then '−+' else '' end as symbols from customer""",
    "place_counts": """with a as (select c_nationkey as nation, count(*) as left_n from customer group by 1),
        b as (select s_nationkey as nation, count(*) as right_n from supplier group by 1)
        select nation, coalesce(left_n, 0) as left_n, coalesce(right_n, 0) as right_n, coalesce(left_n, 0) <> coalesce(right_n,
        0) as mismatch from a full join b using (nation)""",
    "label_or_place": """with t as (select s_nationkey as nation, s_suppkey, count(*) over (partition by s_nationkey) as n from supplier),
        c as (select c_nationkey as nation, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as place from
        customer),
        b as (select c.* from c join (select distinct nation, n from t) x using (nation) where place <= n - nation % 2),
        k as (select nation, count(*) as m from b group by 1),
        p as (select t.*, nation % 3 <> 0 and coalesce(m = n, false) as by_label from t left join k using (nation)),
        q as (select *, row_number() over (partition by nation order by case when by_label then -s_suppkey else s_suppkey end) as place
        from p)
        select nation, s_suppkey, c_custkey, by_label from q left join b using (nation, place)""",
    "game_ends": """with p as (select user_id, event_id as e, row_number() over (partition by user_id order by ts, event_id) as "at",
        count(*) over (partition by user_id, event_id % 40 order by ts, event_id rows unbounded preceding) as seen from events),
        w as (select *, case when e % 50 = 0 and e % 3 = 0 then 'mate' when e % 50 = 0 then 'stalemate' when seen >= 3 then 'repetition'
        when e % 130 >= 100 then 'fifty moves' when e % 90 = 7 then 'material' end as why from p)
        select user_id, min("at") as "at", arg_min(why, "at") as why from w where why is not null group by 1""",
    "export_rows": """with m as (select l_partkey, round(min(l_discount * 7), 3) as minmargin from lineitem group by 1)
        select p_partkey, p_brand, minmargin, p_partkey not in (select l_partkey from lineitem where l_quantity > 40) as dup from part
        left join m on l_partkey = p_partkey""",
    "default_fields": "select p_partkey, case when p_size > 20 then p_size else 0 end as size, 'dark' as theme from part",
}
