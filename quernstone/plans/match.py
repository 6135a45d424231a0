"""Queries over vectors, boards and trees."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import board as B
from ..operators import match as M
from ..sources.tables import events, table


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def class_means(spark, sf):
    means = M.class_means(vectors(spark, sf), "label", "embedding")
    return means.select(
        "label",
        F.round(F.element_at("mean", 1), 6).alias("first"),
        F.round(F.element_at("mean", -1), 6).alias("last"),
        F.size("mean").alias("dims"),
    )


def template_margin(spark, sf):
    rows = vectors(spark, sf)
    return M.nearest_class(rows, M.class_means(rows, "label", "embedding"), "vec_id", "embedding", "label")


def margin_percentiles(spark, sf):
    """Least, first percentile and median of the margins."""
    found = template_margin(spark, sf)
    shares = M.exact_quantiles(found, "margin", {"least": 0.0, "p1": 0.01, "median": 0.5})
    return shares.select(*(F.round(c, 6).alias(c) for c in ("least", "p1", "median")), "n")


def stated(rows):
    return rows.where("vec_id % 20 = 0")


def nn_leave_group_out(spark, sf):
    """Nearest row of another group (tens of ids) for the stated queries."""
    rows = vectors(spark, sf).withColumn("page", F.floor(F.col("vec_id") / 10))
    near = M.nearest_rows(stated(rows), rows, "vec_id", "embedding", 1, apart=("page",), carry=("label",))
    return near.select("q_key", "vec_id", (F.col("q_label") == F.col("label")).alias("right"), F.round("d", 5).alias("d"))


def knn_relabel(spark, sf):
    rows = vectors(spark, sf)
    near = M.nearest_rows(stated(rows), rows, "vec_id", "embedding", 7, apart=("vec_id",), carry=("label",))
    return M.vote(near, "label", 2)


def shaded(spark, sf):
    """Vectors with a colour, that of their number."""
    return vectors(spark, sf).withColumn("shade", (F.col("vec_id") % 2).cast("int"))


def knn_majority(spark, sf):
    """Rows of which five of the seven nearest of their colour have another label, which tells the sign of the first number here."""
    rows = shaded(spark, sf).withColumn("label", (F.element_at("embedding", 1) > 0).cast("int"))
    near = M.nearest_rows(stated(rows), rows, "vec_id", "embedding", 7, apart=("vec_id",), alike=("shade",), carry=("label",))
    return M.vote(near, "label", 5)


def template_means(spark, sf):
    """Templates by class and colour, of the members within nine tenths of the distances."""
    found = M.templates(shaded(spark, sf), "label", "shade", "embedding")
    return found.select(
        "label",
        "shade",
        "size",
        F.round(F.element_at("mean", 1), 6).alias("first"),
        F.round(F.element_at("mean", -1), 6).alias("last"),
    )


def matched(spark, sf):
    rows = shaded(spark, sf)
    return M.match_templates(rows, M.templates(rows, "label", "shade", "embedding"), "vec_id", "embedding", "label", "shade", 1)


def shift_match(spark, sf):
    return matched(spark, sf).select("vec_id", "nearest", F.round("margin", 5).alias("margin"))


def board_quality(spark, sf):
    """Eight vectors in a row stand for a board."""
    return M.board_quality(matched(spark, sf).withColumn("board", F.floor(F.col("vec_id") / 8)), "board")


def needs_eyes(spark, sf):
    """Cells whose margin is so small that somebody should look."""
    return matched(spark, sf).where("margin < 0.05").select("vec_id", "nearest")


def z_scores(spark, sf):
    z = M.z_scores(F.col("embedding"))
    return vectors(spark, sf).select("vec_id", F.round(F.element_at(z, 1), 5).alias("first"), F.round(F.element_at(z, -1), 5).alias("last"))


def ink_centres(spark, sf):
    """A vector as a picture of 8 by 8: stretched, and where its ink is."""
    cells = F.transform("embedding", lambda x: x.cast("double") * 400)
    rows = vectors(spark, sf).withColumn("ink", F.transform(M.stretched(cells, F.lit(100.0)), lambda x: 1.001 - x))
    y, x = M.centre_of_mass(F.col("ink"), 8)
    return rows.select("vec_id", F.round(y, 4).alias("y"), F.round(x, 4).alias("x"))


def centred_ink(spark, sf):
    """The same pictures drawn anew around their centres of mass: two cells of each, and all ink."""
    cells = F.transform("embedding", lambda x: x.cast("double") * 400)
    rows = vectors(spark, sf).withColumn("ink", F.transform(M.stretched(cells, F.lit(100.0)), lambda x: 1.001 - x))
    drawn = rows.select("vec_id", M.centred(F.col("ink"), 8).alias("p"))
    return drawn.select("vec_id", F.round(F.get("p", F.lit(0)), 4).alias("first"), F.round(F.get("p", F.lit(27)), 4).alias("inner"), F.round(M.total(F.col("p")), 3).alias("ink"))


def telling_places(spark, sf):
    """Rows of labels 0 and 1 by their density where the two means differ most."""
    rows = vectors(spark, sf).where("label in (0, 1)")
    places = M.telling_places(M.class_means(rows, "label", "embedding"), "label", 0, 1, 10)
    return M.dense_there(rows, places, "embedding", 0.0).select("vec_id", F.round("density", 5).alias("density"), "dense")


def drawn_frames(spark, sf):
    """Ten shapes from each supplier: thin, eight tall ones, thin; every fifth supplier's are spoiled by one that is too wide."""
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    thin, key = F.col("k").isin(0, 9), F.col("s_suppkey")
    y0 = key * 1000 + F.col("k") * 12
    shapes = rows.select(
        F.col("s_nationkey").alias("page"),
        F.when((key % 5 == 0) & (F.col("k") == 4), 20.0).otherwise(10.0).alias("x0"),
        F.lit(200.0).alias("x1"),
        y0.cast("double").alias("y0"),
        (y0 + F.when(thin, 1).otherwise(10)).cast("double").alias("y1"),
    )
    return M.frames_of_ten(shapes, "page", ["y0"])


def cell_background(spark, sf):
    """Median price by brand and parity of size, which stand for board and square colour."""
    rows = table(spark, sf, "part").select("p_brand", (F.col("p_size") % 2).alias("shade"), "p_retailprice")
    found = M.exact_quantiles(rows, "p_retailprice", {"background": 0.5}, ("p_brand", "shade"))
    return found.select("p_brand", "shade", F.round("background", 4).alias("background"))


def bimodal_threshold(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    middle = M.exact_quantiles(rows, "c_acctbal", {"m": 0.5}).select("m")
    return rows.crossJoin(F.broadcast(middle)).groupBy(
        (F.col("c_acctbal") > 1.4 * F.col("m")).alias("black_moves")
    ).agg(F.count("*").alias("n"))


def two_dim_prefix(spark, sf):
    """Sums over all cells above and to the left, of a grid of nations by segment."""
    grid = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    across = W.partitionBy("c_nationkey").orderBy("c_mktsegment").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("c_mktsegment").orderBy("c_nationkey").rowsBetween(W.unboundedPreceding, 0)
    return grid.withColumn("row_sum", F.sum("n").over(across)).withColumn("area", F.sum("row_sum").over(down)).select(
        "c_nationkey", "c_mktsegment", "area"
    )


#: What may stand on a cell of the boards made here.
MEN_ON_BOARDS = "KQRBNPkqrbnp" + "." * 17


def boards(spark, sf):
    """A board for each supplier, cells by a rule of its number and the cell's; two of seven have one king each in their corners, rooks beside them."""
    n = F.col("s_suppkey")
    men = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")),
        lambda i: F.substring(F.lit(MEN_ON_BOARDS), ((n * 7919 + i * 104729 + (i * i * n) % 97) % 29 + 1).cast("int"), F.lit(1)),
    )
    few = F.transform(men, lambda m, i: F.when(i == 60, "K").when(i == 4, "k").when(i.isin(0, 7), "r").when(i.isin(56, 63), "R").when((i + n) % 11 == 0, F.translate(m, "KkPp", "....")).otherwise("."))
    cells = F.array_join(F.when(n % 7 < 2, few).otherwise(men), "")
    dealt = table(spark, sf, "supplier").select(n).repartition(spark.sparkContext.defaultParallelism)  # a board takes half a millisecond, its number a byte
    made = dealt.select(n.alias("id"), F.concat(B.compress(cells), F.lit(" w - - 0 1")).alias("fen"))
    return made.withColumn("cells", B.expand(B.placement(F.col("fen"))))


def fen_codec(spark, sf):
    c = F.col("cells")
    return boards(spark, sf).select(
        "id",
        "cells",
        B.compress(c).alias("rows"),
        B.compress(B.rotate(c)).alias("turned"),
        B.position_key(F.col("fen")).alias("key"),
    )


def fen_sanity(spark, sf):
    return boards(spark, sf).select(
        "id",
        F.array_join(B.violations(F.col("cells")), ", ").alias("wrong"),
        B.too_little(F.col("cells")).alias("too_little"),
    )


def board_tags(spark, sf):
    c = F.col("cells")
    first = boards(spark, sf).where("id = 1").select(F.col("cells").alias("start"))
    tags = [
        B.material(c).cast("long").alias("balance"),
        B.castling(c).alias("rights"),
        B.phase(c).alias("phase"),
        B.opposite_bishops(c).alias("opposite"),
    ]
    tags += [B.passed_pawn(c).alias("passed"), B.differing(c, F.col("start")).alias("moved")]
    return boards(spark, sf).crossJoin(F.broadcast(first)).select("id", *tags)


def violation_cost(spark, sf):
    """What all boards' breaches of the rules cost together, and those of each parity."""
    costs = boards(spark, sf).select((F.col("id") % 2).alias("half"), B.breach_cost(F.col("cells")).alias("cost"))
    return costs.groupBy("half").agg(F.count("*").alias("boards"), F.sum("cost").alias("cost"))


def tree(spark, sf):
    """Orders as a tree: number n hangs on n div 2, within parts of a thousand."""
    o = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    return o.withColumn("parent", F.when(F.col("node") % 1000 > 1, F.col("node") - F.ceil(F.col("node") % 1000 / 2)))


def path_to_root(spark, sf):
    rows = tree(spark, sf)
    known = rows.select(F.col("node").alias("parent")).distinct()
    linked = rows.join(known, "parent", "left_semi").unionByName(rows.where("parent is null"))
    rest = rows.join(known, "parent", "left_anti").where("parent is not null").withColumn("parent", F.lit(None).cast("long"))
    return M.path_to_root(linked.unionByName(rest), "node", "parent")


def main_line(spark, sf):
    return M.first_children(tree(spark, sf), "node", "parent", F.col("node") % 3 != 0)


def deepest_eval(spark, sf):
    """The deepest line of each position and rank; of equal depths the later one. Users stand for positions."""
    rows = events(spark, sf).select(
        "user_id", "event_type", "event_id", F.floor("value").alias("depth"), F.round("value", 2).alias("score")
    )
    return rows.groupBy("user_id", "event_type").agg(
        F.max_by("score", F.struct("depth", "event_id")).alias("score"), F.max("depth").alias("depth")
    )


QUERIES = {
    f.__name__: f
    for f in (
        *(class_means, template_margin, margin_percentiles, nn_leave_group_out, knn_relabel, knn_majority, template_means, shift_match),
        *(
            board_quality,
            needs_eyes,
            z_scores,
            ink_centres,
            centred_ink,
            telling_places,
            drawn_frames,
            cell_background,
            bimodal_threshold,
            two_dim_prefix,
        ),
        *(fen_codec, fen_sanity, board_tags, violation_cost, path_to_root, main_line, deepest_eval),
    )
}

MEANS = """with x as (select label, unnest(embedding) as v, unnest(range(1, 65)) as i from embeddings),
    p as (select label, i, avg(cast(v as double)) as v from x group by all), m as (select label,
        list(v order by i) as mean from p group by label)"""
DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (cast(z[1] as double) - cast(z[2] as double)) * (cast(z[1] as double) - cast(z[2] as double))))"
MARGIN = f"""{MEANS}, d as (select vec_id, m.label, {DIST.format(a="embedding", b="mean")} as d from embeddings, m), r as (select *,
    row_number() over (partition by vec_id order by d, label) as k from d),
    g as (select a.vec_id, a.label as nearest, round((b.d - a.d) / greatest(b.d, 1e-9),
        6) as margin from r a join r b on a.vec_id = b.vec_id and a.k = 1 and b.k = 2)"""
NEAR = f"with d as (select q.vec_id as q_key, q.label as q_label, e.vec_id, e.label, {DIST.format(a='q.embedding', b='e.embedding')} as d from embeddings q, embeddings e where q.vec_id % 20 = 0 and"
TEMPLATES = f"""{MEANS}, fd as (select vec_id, e.label, embedding, vec_id % 2 as shade,
    {DIST.format(a="embedding", b="mean")} as d from embeddings e join m using (label)), ft as (select label, quantile_disc(d,
    0.9) as t from fd group by 1),
    fk as (select fd.* from fd join ft using (label) where d <= t), fx as (select label, shade, unnest(embedding) as v, unnest(range(1,
        65)) as i from fk), fp as (select label, shade, i, avg(cast(v as double)) as v, count(*) as n from fx group by all),
    tm as (select label, cast(shade as int) as shade, list(v order by i) as mean, max(n) as size from fp group by all)"""
SHIFTED = f"""{TEMPLATES}, sh as (select label, shade, s, list_transform(range(1, 65), lambda i: mean[cast(greatest(1, least(64,
    i - s)) as int)]) as mean from tm, (values (-1), (0), (1)) t(s)),
    sd as (select vec_id, sh.label, min({DIST.format(a="embedding", b="mean")}) as d from embeddings e join sh on sh.shade = e.vec_id %
        2 group by all),
    sr as (select *, row_number() over (partition by vec_id order by d, label) as k from sd), g as (select a.vec_id, a.label, a.d,
        b.d as d2 from sr a join sr b on a.vec_id = b.vec_id and a.k = 1 and b.k = 2)"""
TREE = "with t as (select c_custkey as node, case when c_custkey % 1000 > 1 then c_custkey - cast(ceil(c_custkey % 1000 / 2) as bigint) end as parent from customer)"


RULE = "substr('KQRBNPkqrbnp.................', cast((s_suppkey * 7919 + i * 104729 + (i * i * s_suppkey) % 97) % 29 + 1 as int), 1)"
FEW = f"""case when i = 60 then 'K' when i = 4 then 'k' when i in (0, 7) then 'r' when i in (56,
    63) then 'R' when (i + s_suppkey) % 11 = 0 then translate({RULE}, 'KkPp', '....') else '.' end"""
SHORT = "{0}"
for _n in range(8, 0, -1):
    SHORT = f"replace({SHORT}, '{'.' * _n}', '{_n}')"
ROWS = "array_to_string(list_transform(range(0, 8), lambda r: " + SHORT.format("substr({0}, cast(r * 8 + 1 as int), 8)") + "), '/')"
BOARDS = f"""with b as (select s_suppkey as id, array_to_string(list_transform(range(0, 64),
    lambda i: case when s_suppkey % 7 < 2 then {FEW} else {RULE} end), '') as cells from supplier)"""
MEN = "(length(cells) - length(replace(cells, '{0}', '')))"
SQL = {
    "class_means": f"{MEANS} select label, round(mean[1], 6) as first, round(mean[-1], 6) as last, len(mean) as dims from m",
    "template_margin": f"{MARGIN} select * from g",
    "margin_percentiles": f"""{MARGIN} select round(min(margin), 6) as least, round(quantile_cont(margin, 0.01), 6) as p1,
        round(quantile_cont(margin, 0.5), 6) as median, count(*) as n from g""",
    "knn_majority": f"""with v as (select vec_id, embedding, case when embedding[1] > 0 then 1 else 0 end as label from embeddings),
        d as (select q.vec_id as q_key, q.label as q_label, e.vec_id, e.label, {DIST.format(a="q.embedding", b="e.embedding")} as d
          from v q, v e where q.vec_id % 20 = 0 and q.vec_id <> e.vec_id and q.vec_id % 2 = e.vec_id % 2),
        r as (select *, row_number() over (partition by q_key order by d, vec_id) as k from d),
        c as (select q_key, q_label, label, count(*) as votes from r where k <= 7 group by all),
        t as (select *, row_number() over (partition by q_key order by votes desc, label) as k from c)
        select q_key, q_label as was, label as becomes, votes from t where k = 1 and votes >= 5 and label <> q_label""",
    "template_means": f"{TEMPLATES} select label, shade, size, round(mean[1], 6) as first, round(mean[-1], 6) as last from tm",
    "shift_match": f"{SHIFTED} select vec_id, label as nearest, round((d2 - d) / greatest(d2, 1e-9), 5) as margin from g",
    "board_quality": f"""{SHIFTED} select vec_id // 8 as board, round(max(d), 5) as worst, round(sum(d), 4) as total,
        round(min((d2 - d) / greatest(d2, 1e-9)), 3) as least_margin from g group by 1""",
    "needs_eyes": f"{SHIFTED} select vec_id, label as nearest from g where (d2 - d) / greatest(d2, 1e-9) < 0.05",
    "z_scores": """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
        m as (select *, list_avg(e) as mean, list_stddev_pop(e) as s from v)
        select vec_id, round((e[1] - mean) / (s + 1e-6), 5) as first, round((e[-1] - mean) / (s + 1e-6), 5) as last from m""",
    "ink_centres": """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * 400) as c from embeddings),
        l as (select *, list_aggregate(c, 'quantile_cont', 0.02) as low from v),
        k as (select vec_id, list_transform(c, lambda x: 1.001 - greatest(0, least(1, (x - low) / greatest(100 - low, 30)))) as ink from l)
        select vec_id, round(list_sum(list_transform(ink, lambda x, i: x * ((i - 1) // 8))) / list_sum(ink), 4) as y,
        round(list_sum(list_transform(ink, lambda x, i: x * ((i - 1) % 8))) / list_sum(ink), 4) as x from k""",
    "centred_ink": """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * 400) as c from embeddings),
        l as (select *, list_aggregate(c, 'quantile_cont', 0.02) as low from v),
        k as (select vec_id, list_transform(c, lambda x: 1.001 - greatest(0, least(1, (x - low) / greatest(100 - low, 30)))) as ink from l),
        m as (select *, list_sum(list_transform(ink, lambda x, i: x * ((i - 1) // 8))) / list_sum(ink) - 3.5 as dy,
        list_sum(list_transform(ink, lambda x, i: x * ((i - 1) % 8))) / list_sum(ink) - 3.5 as dx from k),
        s as (select vec_id, i, ink, i // 8 + dy as y, i % 8 + dx as x from m, range(0, 64) t(i)),
        w as (select vec_id, i, sum(case when floor(y) + a between 0 and 7 and floor(x) + b between 0 and 7 then ink[((floor(y) + a) * 8 + floor(x) + b + 1)::int] else 0 end
        * (case when a = 1 then y - floor(y) else 1 - y + floor(y) end) * (case when b = 1 then x - floor(x) else 1 - x + floor(x) end)) as p
        from s, range(0, 2) ta(a), range(0, 2) tb(b) group by all)
        select vec_id, round(max(p) filter (i = 0), 4) as first, round(max(p) filter (i = 27), 4) as inner, round(sum(p), 3) as ink from w group by 1""",
    "telling_places": f"""{MEANS}, f as (select i, a.v - b.v as d from (select * from p where label = 0) a join (select * from p where
        label = 1) b using (i)), t as (select list(i order by d desc, i) as js from (select * from f order by d desc, i limit 10))
        select vec_id, round(list_sum(list_transform(js, lambda j: cast(embedding[j] as double))) / 10, 5) as density,
        list_sum(list_transform(js, lambda j: cast(embedding[j] as double))) / 10 > 0 as dense from embeddings, t where label in (0,
        1)""",
    "drawn_frames": """select s_nationkey as page, 10.0::double as x0, s_suppkey * 1000.0::double as top, 200.0::double as x1,
        s_suppkey * 1000 + 109.0::double as bottom from supplier where s_suppkey % 5 <> 0""",
    "violation_cost": f"""{BOARDS}, m as (select id,
        {", ".join(f"{MEN.format(x)} as {n}" for x, n in zip("KQRBNPkqrbnp", "wk wq wr wb wn wp bk bq br bb bn bp".split()))},
        length(regexp_replace(substr(cells, 1, 8) || substr(cells, 57, 8), '[^pP]', '', 'g')) as outer_pawns from b)
        select id % 2 as half, count(*) as boards, cast(sum(10 * (abs(wk - 1) + abs(bk - 1)) + 3 * (greatest(wp - 8,
        0) + greatest(bp - 8, 0)) + 4 * outer_pawns + 2 * (greatest(wk + wq + wr + wb + wn + wp - 16,
        0) + greatest(bk + bq + br + bb + bn + bp - 16, 0))
          + 2 * (greatest(wq - 1 - greatest(8 - wp, 0), 0) + greatest(bq - 1 - greatest(8 - bp, 0),
        0))) as bigint) as cost from m group by 1""",
    "nn_leave_group_out": f"""{NEAR} q.vec_id // 10 <> e.vec_id // 10),
        r as (select *, row_number() over (partition by q_key order by d, vec_id) as k from d)
        select q_key, vec_id, q_label = label as "right", round(d, 5) as d from r where k = 1""",
    "knn_relabel": f"""{NEAR} q.vec_id <> e.vec_id), r as (select *, row_number() over (partition by q_key order by d,
        vec_id) as k from d), c as (select q_key, q_label, label, count(*) as votes from r where k <= 7 group by all),
        t as (select *, row_number() over (partition by q_key order by votes desc, label) as k from c) select q_key, q_label as was,
        label as becomes, votes from t where k = 1 and votes >= 2 and label <> q_label""",
    "cell_background": "select p_brand, p_size % 2 as shade, round(median(p_retailprice), 4) as background from part group by all",
    "bimodal_threshold": """select c_acctbal > 1.4 * (select median(c_acctbal) from customer) as black_moves,
        count(*) as n from customer group by 1""",
    "two_dim_prefix": """with g as (select c_nationkey, c_mktsegment, count(*) as n from customer group by all), r as (select *,
        sum(n) over (partition by c_nationkey order by c_mktsegment rows unbounded preceding) as s from g)
        select c_nationkey, c_mktsegment, cast(sum(s) over (partition by c_mktsegment order by c_nationkey rows unbounded preceding) as
        bigint) as area from r""",
    "fen_codec": f"""{BOARDS} select id, cells, {ROWS.format("cells")} as rows, reverse({ROWS.format("cells")}) as turned,
        {ROWS.format("cells")} || ' w - -' as key from b""",
    "fen_sanity": f"""{BOARDS} select id, array_to_string(list_filter([case when length(cells) <> 64 then 'size' end,
        case when regexp_matches(substr(cells, 1, 8) || substr(cells, 57, 8), '[pP]') then 'pawn rank' end,
        case when {MEN.format('K')} <> 1 then 'white king' end, case when {MEN.format('P')} > 8 then 'white pawns' end,
        case when length(regexp_replace(cells, '[^A-Z]', '', 'g')) > 16 then 'white men' end,
        case when {MEN.format('k')} <> 1 then 'black king' end, case when {MEN.format('p')} > 8 then 'black pawns' end,
        case when length(regexp_replace(cells, '[^a-z]', '', 'g')) > 16 then 'black men' end], lambda x: x is not null), ', ') as wrong,
        regexp_replace(cells, '[.kK]', '', 'g') in ('', 'n', 'N', 'b', 'B') as too_little from b""",
    "board_tags": f"""{BOARDS}, sq as (select id, i, substr(cells, i + 1, 1) as m from b, range(0, 64) r(i)),
        w as (select distinct x.id from sq x where x.m = 'P' and not exists (select 1 from sq y where y.id = x.id and y.m = 'p' and y.i
        // 8 < x.i // 8 and abs(y.i % 8 - x.i % 8) <= 1)),
        v as (select *, 3 * ({MEN.format('N')} + {MEN.format('B')}) + 5 * {MEN.format('R')} + 9 * {MEN.format('Q')} as wp,
        3 * ({MEN.format('n')} + {MEN.format('b')}) + 5 * {MEN.format('r')} + 9 * {MEN.format('q')} as bp, instr(cells, 'B') - 1 as bw,
        instr(cells, 'b') - 1 as bb from b)
        select v.id, wp - bp + {MEN.format('P')} - {MEN.format('p')} as balance,
          coalesce(nullif(case when substr(cells, 61, 1) = 'K' and substr(cells, 64,
        1) = 'R' then 'K' else '' end || case when substr(cells, 61, 1) = 'K' and substr(cells, 57, 1) = 'R' then 'Q' else '' end ||
            case when substr(cells, 5, 1) = 'k' and substr(cells, 8, 1) = 'r' then 'k' else '' end || case when substr(cells, 5,
        1) = 'k' and substr(cells, 1, 1) = 'r' then 'q' else '' end, ''), '-') as rights,
          case when ({MEN.format('q')} + {MEN.format('Q')} = 0 and wp <= 13 and bp <= 13) or wp + bp <= 16 then 'endgame' else
        'middlegame' end as phase,
          {MEN.format('B')} = 1 and {MEN.format('b')} = 1 and (bw + bw // 8) % 2 <> (bb + bb // 8) % 2 as opposite,
        w.id is not null as passed,
          (select count(*) from sq, sq t where sq.id = v.id and t.id = 1 and t.i = sq.i and t.m <> sq.m) as moved from v left join w on
        w.id = v.id""",
    "path_to_root": """with recursive t as (select c_custkey as node, case when c_custkey % 1000 > 1 then c_custkey -
        cast(ceil(c_custkey % 1000 / 2) as bigint) end as p from customer),
        u as (select node, case when p in (select node from t) then p end as parent from t),
        r(node, root, depth) as (select node, node, 0 from u where parent is null union all select u.node, r.root,
        r.depth + 1 from u join r on u.parent = r.node) select * from r""",
    "main_line": f"{TREE} select parent, min(node) as next from t where node % 3 <> 0 and parent is not null group by parent",
    "deepest_eval": """select user_id, event_type, arg_max(round(value, 2), (floor(value), event_id)) as score,
        cast(max(floor(value)) as bigint) as depth from events group by all""",
}
