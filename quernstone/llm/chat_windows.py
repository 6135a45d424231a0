r"""Conversations as formatted windows within a token budget, with a loss mask: Spark expressions only.

A turn is `### role: text</turn>` and a line feed. Three control strings can't stand in a role or a text: a backslash is
written `\b`, the first mark of `###` `\h`, the first of `</turn>` `\l`, and in roles a colon `\c`; that is read back exactly.

Running sums of tokens over a conversation's turns choose the windows. A window takes new turns, whole ones, while their sum
fits; the next one begins at the first that doesn't. A window that doesn't hold the conversation's leading system turn
repeats it, and then the turns just before its first new one, at most HISTORY of them and at most HISTORY_TOKENS tokens.
So each turn is new in one window. The mask (start and length in code points) covers the texts of new assistant turns
alone: repeated ones are context. No window has more than BUDGET tokens, unless one turn or the system turn leaves no room;
turns are never cut or left out. Tokens are words and marks by default; any other count can be given as an expression.

Conversations of up to BLOCK turns are one group each. Longer ones, of any length, are numbered over range partitions and
dealt into blocks of BLOCK turns, at whose borders a window ends; the turns that the next block's first window repeats
go to both, and the system turn to all. So no group holds more than a block and its context, and no task a whole
conversation. (The contract's digests are of a whole conversation's text, so the query, not the operator, puts that
together in one value.)

Cases: a null text or role is empty; a null conversation id is a conversation; turns of equal number, null first, come
in the order of role and text; repeated rows are turns of their own; conversations without an assistant have no mask; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ranking import numbered, same_keys
from .common import settled, spread

BUDGET, HISTORY, HISTORY_TOKENS = 512, 2, 128
BLOCK = 256  # turns that are formatted together
HEAD, MARK, END = "### ", ": ", "</turn>\n"
TARGET, LEADING = "assistant", "system"
WORDS_AND_MARKS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"
SYSTEM_COPY, PAST, NEW = 0, 1, 2  # why a turn is in a block


def written(text: Column) -> Column:
    """The text without control strings."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.regexp_replace(text, "#(?=##)", r"\\h"), F.lit("</turn>"), F.lit("\\l/turn>"))


def read(text: Column) -> Column:
    """The text that `written` was given; each code is a backslash and a letter, so the backslash itself comes last."""
    for code, sign in (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def words_and_marks(piece: Column) -> Column:
    return F.regexp_count(piece, F.lit(WORDS_AND_MARKS))


def turns_of(rows: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """conv_id, turn, role, the turn's piece of the output, its tokens, and its code points: all, before the text, the text."""
    said = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = F.concat(F.lit(HEAD), F.replace(written(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(MARK))
    parts = said.select("conv_id", "turn", "role", named.alias("head"), written(F.col("text")).alias("body"))
    return parts.select(
        "conv_id",
        "turn",
        "role",
        F.concat("head", "body", F.lit(END)).alias("piece"),
        tokens(F.concat("head", "body", F.lit(END))).cast("long").alias("tokens"),
        F.length("head").alias("head"),
        F.length("body").alias("body"),
        (F.length("head") + F.length("body") + len(END)).cast("long").alias("chars"),
    )


def in_blocks(turns: DataFrame, block: int, history: int) -> DataFrame:
    """Each turn with its block and why it is there: its own block, and those that repeat it."""
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > block)
    many = settled(counts, "long-conversations")
    held = turns.alias("t").join(many.alias("m"), same_keys("t", "m", ["conv_id"]), "left").select("t.*", "n")
    own = held.where("n is null").drop("n").withColumns({"block": F.lit(0).cast("long"), "why": F.lit(NEW)})
    if many.isEmpty():
        return own
    placed = numbered(held.where("n is not null"), ["conv_id"], ["turn", "role", "piece"], "at")
    at, here, last = F.col("at"), F.floor(F.col("at") / block), F.floor((F.col("n") - 1) / block)
    copy = lambda b, why: F.struct(b.cast("long").alias("block"), F.lit(why).alias("why"))
    leading = (at == 0) & (F.col("role") == LEADING) & (last > 0)
    repeated = (at % block >= block - history) & (here < last) & ~((at == 0) & (F.col("role") == LEADING))
    none = F.array().cast("array<struct<block:bigint,why:int>>")
    copies = F.concat(
        F.array(copy(here, NEW)),
        F.when(repeated, F.array(copy(here + 1, PAST))).otherwise(none),
        F.when(leading, F.transform(F.sequence(F.lit(1).cast("long"), last), lambda b: copy(b, SYSTEM_COPY))).otherwise(none),
    )
    dealt = placed.withColumn("__copy", F.explode(copies)).select(*turns.columns, "__copy.*")
    return own.unionByName(dealt)


def format_windows(
    rows: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    history_tokens: int = HISTORY_TOKENS,
    block: int = BLOCK,
    tokens: Callable[[Column], Column] = words_and_marks,
) -> DataFrame:
    """conv_id, block, window, text, n_turns, n_context (leading turns that are repeated), n_tokens and the mask `targets`."""
    order = ["why", "turn", "role", "piece"]
    upto = W.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = in_blocks(turns_of(rows, tokens), max(block, history + 1), history).withColumns(
        {"upto": F.sum("tokens").over(upto), "chars_upto": F.sum("chars").over(upto)}
    )
    fields = [*order, "upto", "chars_upto", "tokens", "chars", "head", "body"]
    groups = summed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("t"))
    size, one = F.size("t"), F.get("t", F.lit(0))
    groups = groups.select(
        "conv_id",
        "block",
        "t",
        ((one["why"] == SYSTEM_COPY) | ((F.col("block") == 0) & (one["role"] == LEADING))).alias("led"),
        F.size(F.filter("t", lambda x: x["why"] != NEW)).alias("old"),
    )
    system_tokens = F.when(F.col("led"), one["tokens"]).otherwise(0)
    first_base = F.when(F.col("old") > 0, F.get("t", F.col("old") - 1)["upto"]).otherwise(F.lit(0)).cast("long")
    groups = groups.withColumn("room", F.lit(budget) - history_tokens - system_tokens).withColumn("base", first_base)
    later = F.slice(F.transform("t", lambda x, i: F.struct(i.alias("i"), x["upto"].alias("upto"), x["tokens"].alias("n"))), F.col("old") + 2, size)

    def next_turn(held: Column, x: Column) -> Column:
        """Turn i opens a window if the sum from the window's first turn to it is over what there is room for."""
        room = F.when((F.col("block") == 0) & (F.size(held["starts"]) == 1), F.lit(budget)).otherwise(F.col("room"))
        opens = F.struct((x["upto"] - x["n"]).alias("base"), F.array_append(held["starts"], x["i"]).alias("starts"))
        return F.when(x["upto"] - held["base"] > room, opens).otherwise(held)

    begun = F.aggregate(later, F.struct(F.col("base").alias("base"), F.array("old").alias("starts")), next_turn)["starts"]
    starts = groups.withColumn("starts", begun)
    lowest = lambda s: F.greatest(F.col("led").cast("int"), s - history)

    def span(s: Column, k: Column) -> Column:
        before = F.slice("t", lowest(s) + 1, F.greatest(F.lit(0), s - lowest(s)))
        near = F.filter(before, lambda x: F.get("t", s - 1)["upto"] - x["upto"] + x["tokens"] <= history_tokens)
        return F.struct(
            k.alias("window"),
            s.alias("from"),
            F.coalesce(F.get("starts", k + 1), size).alias("upto"),
            (s - F.size(near)).alias("since"),
            (F.col("led") & ((s > 0) | (F.col("block") > 0))).alias("led"),
        )

    spans = starts.withColumn("spans", F.transform("starts", span)).select("conv_id", "block", "t", "spans")

    def window(s: Column) -> Column:
        repeats, first = s["led"].cast("int"), F.get("t", s["since"])
        lead = F.when(s["led"], one["piece"]).otherwise("")
        shown = F.slice("t", s["since"] + 1, s["upto"] - s["since"])
        moved = F.when(s["led"], one["chars"]).otherwise(0) - first["chars_upto"] + first["chars"]
        new = F.filter(F.slice("t", s["from"] + 1, s["upto"] - s["from"]), lambda x: x["role"] == TARGET)
        sums = F.get("t", s["upto"] - 1)["upto"] - first["upto"] + first["tokens"]
        return F.struct(
            s["window"].alias("window"),
            F.concat(lead, F.array_join(F.transform(shown, lambda x: x["piece"]), "")).alias("text"),
            (s["upto"] - s["since"] + repeats).alias("n_turns"),
            (s["from"] - s["since"] + repeats).alias("n_context"),
            (sums + F.when(s["led"], one["tokens"]).otherwise(0)).alias("n_tokens"),
            F.transform(
                new,
                lambda x: F.struct((x["chars_upto"] - x["chars"] + x["head"] + moved).cast("int").alias("start"), x["body"].alias("length")),
            ).alias("targets"),
        )

    return spans.select("conv_id", "block", F.inline(F.transform("spans", window)))


def turns_read(text: Column, context: Column, n: Column) -> Column:
    """role and text of each new turn of a window, from the window's text."""
    pieces = F.slice(F.split(text, END), context + 1, n - context)
    heads = F.transform(pieces, lambda p: F.struct(p.alias("p"), F.substring_index(p, MARK, 1).alias("h")))
    return F.transform(
        heads,
        lambda x: F.struct(
            read(F.substr(x["h"], F.lit(len(HEAD) + 1))).alias("role"),
            read(F.substr(x["p"], F.length(x["h"]) + len(MARK) + 1)).alias("text"),
        ),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id with what the contract asks of a conversation, all of it from the windows' texts and masks."""
    said = F.transform(turns_read(F.col("text"), F.col("n_context"), F.col("n_turns")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    under = F.transform("targets", lambda m: read(F.substr("text", m["start"] + 1, m["length"])))
    told = windows.select(
        "conv_id",
        (F.col("n_turns") - F.col("n_context")).alias("n"),
        F.length("text").alias("chars"),
        F.struct("block", "window", F.array_join(said, "").alias("said"), F.array_join(under, "").alias("loss")).alias("w"),
    )
    whole = told.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("w")
    )
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    texts = whole.select("conv_id", "n_turns", "formatted_chars", joined("said").alias("said"), joined("loss").alias("loss"))
    return texts.select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "turn", "role", "text")
    control = r"\### Assistant: </turn> ok"
    more = spark.sql("select -7L as conv_id, stack(2, 0L, 'user', :t, 1L, 'assistant', :t) as (turn, role, text)", {"t": control})
    return read_back(settled(format_windows(given.unionByName(more)), "windows"))


#: Escapes, token sums and window starts in DuckDB's own terms; a window's size follows from the turns that it shows.
OP13_SQL = rf"""
with recursive g as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
b as (select *, replace(text, '\', '\b') as x from g),
e as (select *, replace(case when contains(x, '###') then array_to_string(list_transform(range(1, length(x) + 1),
  lambda i: case when x[i:i+2] = '###' then '\h' else x[i] end), '') else x end, '</turn>', '\l/turn>') as body from b),
p as (select *, '### ' || role || ': ' || body || '</turn>' || chr(10) as piece from e),
t as (select *, row_number() over (partition by conv_id order by turn, role, piece) - 1 as i, length(piece) as chars,
  len(regexp_extract_all(piece, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\x20\x09-\x0D]')) as tokens from p),
u as materialized (select *, sum(tokens) over (partition by conv_id order by i) as upto, sum(chars) over (partition by conv_id order by i) as cupto from t),
s as (select conv_id, case when role = 'system' then tokens else 0 end as sys, case when role = 'system' then chars else 0 end as sys_chars,
  (role = 'system')::int as led from u where i = 0),
nxt as materialized (select a.conv_id, a.i as f, min(b.i) as g from u a join u b using (conv_id) join s using (conv_id)
  where b.i > a.i and b.i // {BLOCK} = a.i // {BLOCK}
    and b.upto - a.upto + a.tokens > case when a.i = 0 then {BUDGET} else {BUDGET - HISTORY_TOKENS} - sys end group by all),
w as (select conv_id, i as f from u where i % {BLOCK} = 0 union all select conv_id, g from w join nxt using (conv_id, f)),
h as (select w.conv_id, w.f, sum(case when a.upto - b.upto + b.tokens <= {HISTORY_TOKENS} then b.chars else 0 end) as past
  from w join s using (conv_id) join u a on a.conv_id = w.conv_id and a.i = w.f - 1
  join u b on b.conv_id = w.conv_id and b.i < w.f and b.i >= greatest(led, w.f - {HISTORY}) group by all),
c as (select w.conv_id, sum(case when w.f > 0 then sys_chars else 0 end + coalesce(past, 0)) as repeated
  from w join s using (conv_id) left join h using (conv_id, f) group by all)
select u.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256,
  (sum(chars) + any_value(repeated))::bigint as formatted_chars
from u join c using (conv_id) group by u.conv_id
"""
