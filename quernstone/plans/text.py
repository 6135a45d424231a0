"""Queries over texts, addresses and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import plural
from ..operators import text as T
from ..sources.tables import events, table


def turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").where("conv_id is not null")


def paragraph_glue(spark, sf):
    return T.glue(
        turns(spark, sf).dropDuplicates(["conv_id", "turn"]).select("conv_id", "turn", F.md5("text").alias("piece"), "role"),
        "conv_id",
        "turn",
        F.col("role") == "user",
        "piece",
    )


def forward_fill(spark, sf):
    out = T.fill_forward(turns(spark, sf), "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("turn")), "asked_at")
    return out.select("conv_id", "turn", "role", "asked_at")


def text_spans(spark, sf):
    return T.spans(
        turns(spark, sf).select("conv_id", "turn", "text"), "conv_id", "turn", "text"
    ).select("conv_id", "turn", "start_at", "end_at")


def bracket_strip(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(" [x)] y) "), F.col("p_type"), F.lit(")")).alias("t"),
    )
    return rows.select("p_partkey", T.strip_brackets(F.col("t")).alias("outside"))


def label_sort(spark, sf):
    rows = table(spark, sf, "supplier").select(
        F.concat_ws("-", (F.col("s_nationkey")).cast("string"), F.col("s_suppkey").cast("string")).alias("label")
    )
    keyed = rows.withColumn("key", T.label_key(F.col("label")))
    return keyed.select(
        "label",
        F.array_join(F.transform("key", lambda x: x.cast("string")), ".").alias("key"),
        (F.element_at("key", 1) * 100000 + F.element_at("key", 2)).alias("place"),
    )


def reading_order(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("x"))
    return T.reading_order(rows, "c_nationkey", F.col("x"), "c_custkey", F.lit(4500)).select("c_nationkey", "c_custkey", "place")


def prefilter_reasons(spark, sf):
    rules = [
        ("not decisive", F.col("o_orderstatus") == "P"),
        ("wrong winner", F.contains(F.lower("o_orderpriority"), F.lit("low"))),
        ("fast", T.base_seconds(F.concat((F.col("o_custkey") % 1200).cast("string"), F.lit("+5"))) < 600),
        ("short", F.col("o_totalprice") < 60000),
    ]
    return table(spark, sf, "orders").select(
        F.coalesce(T.first_reason(rules), F.lit("kept")).alias("reason")
    ).groupBy("reason").agg(F.count("*").alias("n"))


def time_controls(spark, sf):
    shapes = F.array(*(F.lit(x) for x in ("", "-", "?", "600+5", "40/7200", "40/5400+30", "abc", "300")))
    whole = F.concat((F.col("o_orderkey") % 900).cast("string"), F.lit("+"), (F.col("o_orderkey") % 31).cast("string"))
    control = F.when(F.col("o_orderkey") % 3 == 0, whole).otherwise(F.element_at(shapes, (F.col("o_orderkey") % 8 + 1).cast("int")))
    rows = table(spark, sf, "orders").select("o_orderkey", control.alias("control"))
    return rows.select("o_orderkey", "control", T.base_seconds(F.col("control")).alias("seconds"))


def content_ids(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id",
        T.content_id(F.when(F.col("doc_id") % 5 == 0, F.col("source")), F.coalesce("text", F.lit(""))).alias("gid"),
    )
    return rows.groupBy("gid").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def fallback_ids(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", T.fallback_id(F.concat("p_brand", F.lit("|"), F.col("p_partkey").cast("string"))).alias("gid")
    )


def comment_spans(spark, sf):
    """Two moves in a text, the first with marks, the second with a sign for some parts."""
    first = F.concat(
        F.lit("e4"),
        F.element_at(F.array(F.lit("!"), F.lit("?! "), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")),
        F.lit(" "),
        "p_brand",
        F.lit(" "),
    )
    second = F.concat(F.lit("d4"), F.when(F.col("p_partkey") % 2 == 0, " +- ").otherwise(" "), F.lit("then"))
    at = F.length(first)
    moves = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")), F.struct(at.alias("start"), (at + 2).alias("end")))
    rows = table(spark, sf, "part").select("p_partkey", F.concat(first, second).alias("t"), moves.alias("m"))
    spans = rows.select("p_partkey", "t", F.posexplode(T.comment_spans(F.col("t"), F.col("m"))).alias("i", "x"))
    return spans.select(
        "p_partkey",
        "i",
        F.col("x.begins").alias("begins"),
        F.col("x.sign").alias("sign"),
        F.expr("substring(t, x.begins + 1, x.ends - x.begins)").alias("comment"),
    )


def url_dispatch(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url")
    found = rows.select(
        "page_id",
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/(\d+)", 2).alias("number"),
        F.regexp_extract("url", r"[?&]page=(\d+)", 1).alias("page"),
    )
    return found.withColumn(
        "kind",
        F.when(F.col("page") != "", "chapter").when(F.col("number") != "", "game").when(F.col("host") != "", "site").otherwise("unknown"),
    )


def props_json(spark, sf):
    return events(spark, sf).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def plurals(spark, sf):
    return table(spark, sf, "part").select("p_partkey", plural(F.col("p_partkey"), "one", "few", "many").alias("form"))


def title_clean(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.concat(
            "p_name",
            F.lit(" ("),
            F.col("p_size").cast("string"),
            F.lit("), "),
            (F.col("p_partkey") + 1900).cast("string"),
        ).alias("title"),
    )
    return rows.select("p_partkey", T.clean_title(F.col("title")).alias("title"), F.regexp_extract("title", r"(\d{4})", 1).alias("year"))


def context_windows(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", "text", F.lit(60).alias("at"))
    left, right = T.before_and_after(F.col("text"), F.col("at"), 50, 30)
    return rows.select("item_id", left.alias("before"), right.alias("after"))


def line_histogram(spark, sf):
    return table(spark, sf, "documents").select(
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines")
    ).groupBy("lines").agg(F.count("*").alias("n"))


def link_statistics(spark, sf):
    """Share of lines that found their supplier's account in order, by nation."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    out = lines.groupBy("s_nationkey").agg(
        F.count_if(F.col("s_acctbal") > 0).alias("linked"), F.count_if(~(F.col("s_acctbal") > 0)).alias("unlinked")
    )
    return out.select(
        "s_nationkey",
        "linked",
        "unlinked",
        F.round(100 * F.col("unlinked") / (F.col("linked") + F.col("unlinked")), 1).alias("pct"),
    )


def status_words(spark, sf):
    """Kinds of failure by status code, one word each."""
    code = F.col("c_custkey") % 5 * 100 + F.col("c_custkey") % 7
    word = F.when(code == 404, "unknown name").when(code == 403, "forbidden").when(code == 429, "too often").otherwise("failed")
    return table(spark, sf, "customer").select(
        "c_custkey", code.cast("long").alias("code"), F.when(code < 300, "ok").otherwise(word).alias("word")
    )


QUERIES = {
    f.__name__: f for f in (
        paragraph_glue,
        forward_fill,
        text_spans,
        bracket_strip,
        label_sort,
        reading_order,
        prefilter_reasons,
        time_controls,
        content_ids,
        fallback_ids,
        comment_spans,
        url_dispatch,
        props_json,
        plurals,
        title_clean,
        context_windows,
        line_histogram,
        link_statistics,
        status_words,
    )
}

SQL = {
    "paragraph_glue": """with t as (select conv_id, turn, any_value(md5(text)) as piece,
        any_value(role) as role from conversations where conv_id is not null group by conv_id, turn),
        f as (select *, case when coalesce(role = 'user', false) or row_number() over (partition by conv_id order by turn) = 1 then 1
        else 0 end as s from t), p as (select *, sum(s) over (partition by conv_id order by turn) as part from f)
        select conv_id, cast(part as bigint) as part, string_agg(piece, ' ' order by turn) as text,
        count(*) as pieces from p group by conv_id, part""",
    "forward_fill": """select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by
        conv_id order by turn rows between unbounded preceding and current row) as asked_at from conversations where conv_id is not
        null""",
    "text_spans": """select conv_id, turn, cast(sum(length(text)) over w - length(text) as bigint) as start_at,
        cast(sum(length(text)) over w as bigint) as end_at from conversations where conv_id is not null window w as (partition by
        conv_id order by turn rows between unbounded preceding and current row)""",
    "bracket_strip": "select p_partkey, p_name || '  y ' || p_type as outside from part",
    "label_sort": """select s_nationkey || '-' || s_suppkey as label, s_nationkey || '.' || s_suppkey as key,
        cast(s_nationkey * 100000 + s_suppkey as int) as place from supplier""",
    "reading_order": """select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by case when c_acctbal > 4500
        then 1 else 0 end, c_custkey) as place from customer""",
    "prefilter_reasons": """select case when o_orderstatus = 'P' then 'not decisive' when contains(lower(o_orderpriority),
        'low') then 'wrong winner' when o_custkey % 1200 < 600 then 'fast' when o_totalprice < 60000 then 'short' else 'kept' end as
        reason, count(*) as n from orders group by 1""",
    "time_controls": """with r as (select o_orderkey, case when o_orderkey % 3 = 0 then (o_orderkey % 900) || '+' || (o_orderkey % 31) else ['', '-', '?', '600+5',
        '40/7200', '40/5400+30', 'abc', '300'][o_orderkey % 8 + 1] end as control from orders)
        select o_orderkey, control, case when control in ('', '-', '?') then null else try_cast(string_split(string_split(control,
        '+')[1], '/')[-1] as int) end as seconds from r""",
    "content_ids": """with r as (select doc_id, substr(sha1(case when doc_id % 5 = 0 then source else '' end || '|' || coalesce(text,
        '')), 1, 16) as gid from documents) select gid, min(doc_id) as first_doc, count(*) as copies from r group by gid""",
    "fallback_ids": """select p_partkey, 'h' || lower(to_hex(list_reduce(list_prepend(5381::bigint,
        list_transform(string_split(p_brand || '|' || p_partkey, ''),
        lambda c: cast(unicode(c) as bigint))), lambda h, c: (h * 33 + c) % 4294967296))) as gid from part""",
    "comment_spans": """with r as (select p_partkey, ['!', '?! ', ''][p_partkey % 3 + 1] as mark, p_partkey % 2 = 0 as won,
        p_brand from part), s as (select *, length(mark) + length(p_brand) + 4 as second from r)
        select p_partkey, 0 as i, cast(3 + length(mark) as int) as begins, '' as sign, p_brand || ' ' as comment from s
        union all select p_partkey, 1, cast(second + case when won then 5 else 3 end as int), case when won then '+−' else '' end,
        case when won then ' then' else 'then' end from s""",
    "url_dispatch": r"""with f as (select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, regexp_extract(url,
        '^https?://[^/]+/([a-z]{2})/(\d+)', 2) as number, regexp_extract(url, '[?&]page=(\d+)', 1) as page from pages)
        select *, case when page <> '' then 'chapter' when number <> '' then 'game' when host <> '' then 'site' else 'unknown' end as
        kind from f""",
    "props_json": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "plurals": """select p_partkey, case when p_partkey % 10 = 1 and p_partkey % 100 <> 11 then 'one' when p_partkey % 10 between 2 and
        4 and p_partkey % 100 not between 12 and 14 then 'few' else 'many' end as form from part""",
    "title_clean": r"""with r as (select p_partkey, p_name || ' (' || p_size || '), ' || (p_partkey + 1900) as title from part)
        select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(title, '\(\d+\)', '', 'g'), '[ ,]*\b\d{4}$', ''), ' +', ' ',
        'g')) as title, regexp_extract(title, '(\d{4})', 1) as year from r""",
    "context_windows": """select item_id, regexp_split_to_array(substr(text, 10, 50), '[.!?] ')[-1] as before, substr(text, 60,
        30) as after from benchmark""",
    "line_histogram": "select len(string_split(coalesce(text, ''), chr(10))) as lines, count(*) as n from documents group by 1",
    "link_statistics": """with r as (select s_nationkey, count(*) filter (s_acctbal > 0) as linked,
        count(*) filter (not s_acctbal > 0) as unlinked from lineitem left join supplier on l_suppkey = s_suppkey group by 1)
        select *, round(100.0 * unlinked / (linked + unlinked), 1) as pct from r""",
    "status_words": """with r as (select c_custkey, c_custkey % 5 * 100 + c_custkey % 7 as code from customer) select c_custkey, code,
        case when code < 300 then 'ok' when code = 404 then 'unknown name' when code = 403 then 'forbidden' when code = 429 then
        'too often' else 'failed' end as word from r""",
}
