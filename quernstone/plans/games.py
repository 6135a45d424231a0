"""Queries over game records, transcripts and payloads, whose texts are made from the tables' rows; and over clusters.

The texts are written here by rules of the row alone, so SQL gives what has to be read back without reading anything.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import match, ml
from ..scratch import kept_until_release, scratch_folder, settled
from ..sources import games as G
from ..sources import months as L
from ..sources import pages as P
from ..sources.tables import events, table

SANS = ("e4", "Nf3", "O-O", "Bxc6+", "exd5", "R1d2", "Qh5#", "a8=Q")


def games(spark, sf):
    """A game for each user and day: its text, with comments, variations 0 to 40 deep, line comments and indented headers."""
    n = F.col("event_id")
    by = W.partitionBy("user_id", "day").orderBy("ts", "event_id")
    i = F.row_number().over(by) - 1
    move = F.concat(
        F.floor(i / 2).cast("string"),
        F.when(i % 2 == 0, F.lit(". ")).otherwise(F.lit("... ")),
        F.element_at(F.array(*map(F.lit, SANS)), (n % 8 + 1).cast("int")),
    )
    mark = F.when(n % 5 == 0, F.lit("!?")).when(n % 6 == 0, F.lit(" $5")).otherwise(F.lit(""))
    cp = F.when(n % 11 == 0, F.concat(F.lit("#-"), (n % 9 + 1).cast("string"))).otherwise(F.format_string("%.2f", (n % 700 - 350) / 100))
    note = F.when(n % 3 == 0, F.concat(F.lit(" {[%eval "), cp, F.lit("] [%clk 0:01]}"))).otherwise(F.lit(""))
    depth = (n % 41).cast("int")
    aside = F.when(
        n % 4 == 1,
        F.concat(F.lit(" "), F.repeat(F.lit("(1... d5 {[%eval 9.99]} "), depth), F.repeat(F.lit(")"), depth)),
    ).otherwise(F.lit(""))
    line = F.when(n % 7 == 2, F.lit(" ; then e5 and Nc6\n")).when(n % 7 == 3, F.lit(" (2. d4 ; c5)\n")).otherwise(F.lit(" "))
    rows = events(spark, sf).withColumn("o", F.struct("ts", "event_id")).withColumn("piece", F.concat(move, mark, note, aside, line))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "piece"))), lambda x: x["piece"]), "")
    made = rows.groupBy("user_id", "day").agg(body.alias("body"))
    indent = F.when(F.col("user_id") % 2 == 0, F.lit("   ")).otherwise(F.lit(""))
    user = F.col("user_id").cast("string")
    head = F.concat(indent, F.lit('[Event "'), F.col("day").cast("string"), F.lit('"]\n[White "Ann"]\n[White "u'), user, F.lit('"]\r\n\n'))
    return made.select("user_id", "day", F.concat(head, F.col("body"), F.lit("1-0\n")).alias("game"))


def game_file(spark, sf):
    """One file for each user and month."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("day", "game"))), lambda x: x["game"])
    found = G.read_games(games(spark, sf).groupBy("user_id", F.date_trunc("month", "day")).agg(F.array_join(in_order, "\n").alias("value")))
    notes = F.transform("evals", lambda e: F.concat_ws(":", e["at"].cast("string"), e["cp"].cast("string")))
    head = F.col("headers")
    return found.select(
        head["White"].alias("white"),
        head["Event"].alias("event"),
        F.array_join("moves", " ").alias("moves"),
        F.array_join(notes, " ").alias("evals"),
    )


def files_of_games(spark, sf):
    """The games of all users in text files, written and read as whole files: moves counted by day."""
    folder = kept_until_release(spark, f"{scratch_folder(spark)}/files-{uuid.uuid4().hex}")
    games(spark, sf).repartition(16, "user_id").select("game").write.text(folder)
    found = G.read_games(G.read_files(spark, folder))
    return found.groupBy(F.col("headers")["Event"].alias("day")).agg(F.count("*").alias("games"), F.sum(F.size("moves")).alias("moves"), F.sum(F.size("evals")).alias("evals"))


def transcript_blocks(spark, sf):
    """One page for each conversation: a turn is a heading, a diagram or a paragraph of two lines."""
    turns = table(spark, sf, "conversations").where("conv_id is not null").select(
        "conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("h")
    ).distinct()
    text = F.when(F.col("role") == "user", F.concat(F.lit("[[H]] "), "h")).when(
        F.col("role") == "system", F.concat(F.lit("[[DIAG w "), "h", F.lit("]]"))
    )
    text = F.coalesce(text, F.concat(F.substring("h", 1, 8), F.lit("\n"), F.substring("h", 9, 24), F.lit("\n")))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"])
    pages = turns.withColumn("text", text).groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(in_order, "\n").alias("text"))
    return P.blocks(pages, "doc", "text").select("doc", "kind", "payload")


def markdown_table(spark, sf):
    """A table of parts for each brand, written in pieces: its head, and its parts by thousands of numbers."""
    parts = table(spark, sf, "part")
    row = F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit("|"), F.coalesce("p_name", F.lit("")), F.lit(" |"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda x: x["row"])
    body = parts.groupBy("p_brand", F.floor(F.col("p_partkey") / 1000).alias("piece")).agg(F.array_join(in_order, "\n").alias("text"))
    first = F.lit("text\n| No | Name |\n|----|:-----:|")
    head = parts.groupBy("p_brand").agg((F.floor(F.min("p_partkey") / 1000) - 1).alias("piece")).select("p_brand", "piece", first.alias("text"))
    rows = P.rows_in_pieces(head.unionByName(body), ["p_brand"], "piece", "text")
    return rows.where("n > 0").select("p_brand", "n", F.array_join("cells", ";").alias("cells"))


def numbered_problems(spark, sf):
    """A text of problems for each brand and thousand of numbers; one of seven has no position."""
    k = F.col("p_partkey")
    side = F.when(k % 2 == 0, F.lit("белых")).otherwise(F.lit("чёрных"))
    board = F.when(k % 7 == 0, F.lit("none")).otherwise(F.concat(F.lit("```\n8/8/"), k.cast("string"), F.lit(" w - -\n```")))
    lines = F.concat(
        F.lit("## "), k.cast("string"), F.lit(". "), "p_name", F.lit("\n\n**Ход "), side, F.lit("** · ход "), F.col("p_size").cast("string"),
        F.lit("\n\n"), board, F.lit("\n\n**Решение.** 1.Rd"), (k % 8 + 1).cast("string"), F.lit("\n  Kc7 2.e4\n"),
    )
    text = F.concat(F.lit("# Book\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), lines.alias("t")))), lambda x: x["t"]), "\n"))
    texts = table(spark, sf, "part").groupBy("p_brand", F.floor(k / 1000)).agg(text.alias("text"))
    return texts.select("p_brand", F.inline(P.numbered_problems(F.col("text"))))


def embedded_data(spark, sf):
    """A script for each region, with its nations."""
    entry = F.struct(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name"))
    script = F.concat(F.lit("window.SEED = "), F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("nations"))), F.lit(";"))
    scripts = table(spark, sf, "nation").groupBy("n_regionkey").agg(script.alias("script"))
    found = scripts.select("n_regionkey", P.embedded_json(F.col("script")).alias("j"))
    first = F.get_json_object("j", "$.nations[0].n").cast("int").alias("first")
    return found.select(
        "n_regionkey", first, F.explode(P.fields(F.col("j"), r'"n":(\d+),"name":"([^"]*)"', ["n", "name"])).alias("f")
    ).select("n_regionkey", "first", "f.n", "f.name")


def archive_days(spark, sf):
    """Archives of all events, one for each user and month, as games of user 7 against others."""
    n = F.col("event_id")
    me, other = F.struct(
        F.lit("Me").alias("username"), (1000 + n % 900).cast("int").alias("rating")
    ), F.struct(F.lit("X").alias("username"), F.lit(1).alias("rating"))
    kind = F.element_at(F.array(*map(F.lit, ("blitz", "bullet", "rapid", "daily"))), (n % 4 + 1).cast("int"))
    game = F.struct(
        F.when(n % 2 == 0, me).otherwise(other).alias("white"),
        F.when(n % 2 == 0, other).otherwise(me).alias("black"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("end_time"),
        kind.alias("time_class"),
    )
    months = events(spark, sf).groupBy("user_id", F.date_trunc("month", "day")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(game)).alias("games"))).alias("value"))
    return G.games_by_day(months, "value", "me").select("day", "control", "games")


def activity_days(spark, sf):
    """An activity feed of each user's days, read back and summed by day."""
    n = F.col("event_id")
    days = events(spark, sf).groupBy("user_id", "day").agg(
        F.count_if(n % 3 == 0).cast("int").alias("w"), F.count_if(n % 3 == 1).cast("int").alias("l"), F.count_if(n % 3 == 2).cast("int").alias("d"), F.max(n % 1000).cast("int").alias("r")
    )
    score = F.struct(F.col("w").alias("win"), F.col("l").alias("loss"), F.col("d").alias("draw"))
    game = F.struct(
        F.col("w").alias("win"),
        F.col("l").alias("loss"),
        F.col("d").alias("draw"),
        F.struct(F.col("r").alias("after")).alias("rp"),
    )
    interval = F.struct(F.unix_millis(F.col("day").cast("timestamp")).alias("start"))
    entry = F.struct(
        interval.alias("interval"),
        F.create_map(F.lit("blitz"), game, F.lit("rapid"), game).alias("games"),
        F.struct(score.alias("score")).alias("puzzles"),
    )
    feeds = days.select(F.to_json(F.array(entry)).alias("value"))
    return G.activity_by_day(feeds, "value").select("day", "games", "puzzles", "blitz")


def address_kinds(spark, sf):
    rows = table(spark, sf, "pages").where("page_id is not null").select("page_id", F.md5(F.col("page_id").cast("string")).alias("h"))
    at = lambda *parts: F.concat(F.lit("https://site.example/"), *parts)
    one, two = F.substring("h", 1, 8), F.substring("h", 9, 8)
    shapes = F.array(
        at(F.lit("study/"), one, F.lit("/"), two),
        at(F.lit("study/"), one),
        at(one),
        at(F.substring("h", 1, 12), F.lit("?x")),
        at(F.lit("about")),
        F.col("h"),
    )
    return rows.select("page_id", G.source_of(F.element_at(shapes, (F.col("page_id") % 6 + 1).cast("int"))).alias("kind"))


def newest_games(spark, sf):
    """The hundred newest wanted orders, month by month: a budget, not a sample."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    wanted = (F.col("o_orderstatus") != "P") & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return G.newest_games(rows, "o_orderdate", "o_orderkey", 100, wanted).select("o_orderkey", "o_orderstatus")


def budgeted_scan(spark, sf):
    """Of orders laid out by month, the 50 newest that are not pending of each priority."""
    folder = kept_until_release(spark, f"{scratch_folder(spark)}/orders-{uuid.uuid4().hex}")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    L.write_by_month(orders, "o_orderdate", "month", folder)
    who = orders.select("o_orderpriority").distinct()
    found = L.newest_within(spark, folder, "month", ["o_orderdate", "o_orderkey"], 50, F.col("o_orderstatus") != "P", who)
    return found.select("o_orderpriority", "o_orderkey", "o_orderdate")


def compact_json(spark, sf):
    """Rows as JSON without what is null."""
    small = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey"))
    return table(spark, sf, "nation").select(
        F.to_json(F.struct(F.col("n_nationkey").alias("n"), small.alias("r"), F.col("n_name").alias("t"))).alias("json")
    )


def cell_prints(spark, sf):
    rows = table(spark, sf, "nation").select("n_regionkey", F.length("n_name").alias("size"), F.col("n_nationkey").alias("n"))
    return P.fingerprints(rows, ["n_regionkey"], ["size", "n"])


def prefix_read(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws(":", "p_brand", F.col("p_partkey").cast("string")).alias("key"))
    return P.by_prefix(rows, "key", "Brand#1", "Brand#12", 40)


def visible_rows(spark, sf):
    return P.visible_to(
        table(spark, sf, "orders"), "1", "o_custkey", F.startswith("o_orderpriority", F.lit("1"))
    ).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def kmeans_assign(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return ml.clusters(rows, "embedding", 12).select("vec_id", "label", "cluster")


def split_cluster(spark, sf):
    """The largest of the clusters put into three of its own."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    found = settled(ml.clusters(rows, "embedding", 12), "clusters")
    return ml.split_cluster(found, "embedding", 0, 3).select("vec_id", "label", "cluster")


def dense_groups(spark, sf):
    """Two groups found by 2-means, and the rows' density where their means differ most."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = settled(ml.clusters(rows, "embedding", 2), "clusters")
    places = match.telling_places(match.class_means(found, "cluster", "embedding"), "cluster", 0, 1, 10)
    return match.dense_there(found, places, "embedding", 0.0).select("vec_id", "cluster", F.round("density", 5).alias("density"), "dense")


def pca_project(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return ml.project(rows, "embedding", 8, 7, "vec_id").select(
        "vec_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected")
    )


QUERIES = {
    f.__name__: f for f in (
        game_file,
        files_of_games,
        transcript_blocks,
        markdown_table,
        numbered_problems,
        embedded_data,
        archive_days,
        activity_days,
        address_kinds,
        newest_games,
        budgeted_scan,
        compact_json,
        cell_prints,
        prefix_read,
        visible_rows,
        kmeans_assign,
        split_cluster,
        dense_groups,
        pca_project,
    )
}

SQL = {
    "game_file": """with e as (select *, cast(ts as date) as day, row_number() over (partition by user_id, cast(ts as date) order by ts,
        event_id) as i from events)
        select 'u' || user_id as white, cast(day as varchar) as event, string_agg(['e4', 'Nf3', 'O-O', 'Bxc6+', 'exd5', 'R1d2', 'Qh5#',
        'a8=Q'][event_id % 8 + 1], ' ' order by i) as moves,
          coalesce(string_agg(i || ':' || case when event_id % 11 = 0 then -10000 + event_id % 9 + 1 else event_id % 700 - 350 end,
        ' ' order by i) filter (event_id % 3 = 0), '') as evals
        from e group by user_id, day""",
    "files_of_games": """select cast(cast(ts as date) as varchar) as day, count(distinct user_id) as games, count(*) as moves,
        count(*) filter (event_id % 3 = 0) as evals from events group by 1""",
    "transcript_blocks": """with t as (select distinct conv_id, turn, role, md5(coalesce(text,
        '')) as h from conversations where conv_id is not null)
        select conv_id as doc, case role when 'user' then 'h' when 'system' then 'diag' else 'p' end as kind,
          case role when 'user' then h when 'system' then 'w ' || h else substr(h, 1, 8) || ' ' || substr(h, 9,
        24) end as payload from t""",
    "markdown_table": """select p_brand, cast(row_number() over (partition by p_brand order by p_partkey) as int) as n,
        p_partkey || ';' || trim(p_name) as cells from part""",
    "numbered_problems": """select p_brand, p_partkey::int as n, trim(p_name) as title, case when p_partkey % 2 = 0 then 'w' else 'b' end as side,
        p_size::int as move, '8/8/' || p_partkey || ' w - -' as position, '1.Rd' || (p_partkey % 8 + 1) || ' Kc7 2.e4' as solution
        from part where p_partkey % 7 <> 0""",
    "embedded_data": """select n_regionkey, min(n_nationkey) over (partition by n_regionkey) as first,
        cast(n_nationkey as varchar) as n, n_name as name from nation""",
    "archive_days": """select cast(ts as date) as day, ['blitz', 'bullet', 'rapid', 'daily'][event_id % 4 + 1] as control,
        count(*) as games from events group by all""",
    "activity_days": """with d as (select user_id, cast(ts as date) as day, count(*) as n,
        max(event_id % 1000) as r from events group by all)
        select day, cast(2 * sum(n) as bigint) as games, max(n) as puzzles, max(r) as blitz from d group by day""",
    "address_kinds": """select page_id, ['chapter', 'study', 'game', 'game', 'unknown',
        'unknown'][page_id % 6 + 1] as kind from pages where page_id is not null""",
    "newest_games": """select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'P' and o_orderpriority not in ('1-URGENT',
        '2-HIGH')
        order by o_orderdate desc, o_orderkey desc limit 100""",
    "budgeted_scan": """select o_orderpriority, o_orderkey, o_orderdate from orders where o_orderstatus <> 'P' qualify row_number() over (partition by
        o_orderpriority order by o_orderdate desc, o_orderkey desc) <= 50""",
    "compact_json": """select '{"n":' || n_nationkey || case when n_nationkey % 3 <> 0 then ',"r":' || n_regionkey else '' end ||
        ',"t":"' || n_name || '"}' as json from nation""",
    "cell_prints": """select n_regionkey, '[' || string_agg('{"size":' || length(n_name) || ',"n":' || n_nationkey || '}',
        ',' order by length(n_name), n_nationkey) || ']' as print from nation group by 1""",
    "prefix_read": """select p_partkey, p_brand || ':' || p_partkey as key from part where starts_with(p_brand,
        'Brand#1') and not starts_with(p_brand, 'Brand#12') order by key limit 40""",
    "visible_rows": "select o_orderstatus, count(*) as n from orders where o_custkey = 1 or starts_with(o_orderpriority, '1') group by 1",
}
