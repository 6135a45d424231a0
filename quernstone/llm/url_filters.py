"""URL filters by dated lists: every capture is held against the entries active when it was fetched.

A list is a log of dated entries that put a pattern on it or take it off. Per pattern the log becomes
validity intervals [from, to) by date, so a pattern has as many intervals at most as its log has days. A
capture's URL gives the patterns that could hold it (its host and the domains above, its address cut
at each path segment), and an as-of join on pattern, month and a salt of the capture's id finds the interval
that covers the fetch date. Month and salt split a pattern that a third of all captures share; the intervals,
few for each pattern, are repeated for each salt. Only captures that an entry holds come out of the join.

Cases: a null or unreadable url, or a null fetch date, matches nothing and is kept; entries with a null pattern or
date are left out; of several entries of a pattern on one day, one that adds wins; an interval starts on
its entry's day; repeated captures get a row each; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import pages

LAST_DAY = "9999-12-31"
SALTS = 8  # parts that the captures of one pattern and month are dealt to


def address(url: Column) -> Column:
    """host/path of a URL: no scheme, user, port, query or fragment; the host in lower case; null if there is no host."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^?#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^([^/:]*)", 1))
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/]*", ""), r"/+$", "")
    return F.when(host != "", F.concat(F.rtrim(host, F.lit(".")), path))


def patterns(at: Column) -> Column:
    """The patterns that can hold an address: 'd:' and each domain of its host, 'p:' and each beginning at a path segment."""
    parts = F.split(at, "/")
    labels = F.split(parts[0], r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("p:"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.concat(domains, paths)


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, valid_from, valid_to (exclusive) from a log of pattern, on_date, adds."""
    dated = entries.where("pattern is not null and on_date is not null").groupBy(
        "pattern", F.col("on_date").cast("date").alias("valid_from")
    )
    daily = dated.agg(F.max(F.coalesce("adds", F.lit(False))).alias("adds"))
    by_pattern = W.partitionBy("pattern").orderBy("valid_from")
    return daily.withColumn(
        "valid_to", F.coalesce(F.lead("valid_from").over(by_pattern), F.lit(LAST_DAY).cast("date"))
    ).where("adds").drop("adds")


def month_of(day: Column) -> Column:
    return 12 * F.year(day) + F.month(day)


def evaluate_captures(captures: DataFrame, entries: DataFrame, key: str = "page_id", salts: int = SALTS) -> DataFrame:
    """key, url, fetched_on of each capture with blocked, n_entries, and the most specific entry's pattern and date."""
    seen = captures.select(key, "url", F.col("fetched_on").cast("date").alias("fetched_on"))
    whole = [key, "url", "fetched_on"]
    held = seen.where("url is not null and fetched_on is not null").select(
        *whole,
        month_of(F.col("fetched_on")).alias("month"),
        F.pmod(F.xxhash64(key, "fetched_on"), F.lit(salts)).alias("salt"),
        F.explode(patterns(address(F.col("url")))).alias("pattern"),
    )
    last = seen.agg(F.max("fetched_on")).first()[0]
    spans = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    if last is not None:  # an open interval is spread over the months up to the last capture
        months = F.sequence(month_of(F.col("valid_from")), month_of(F.least(F.date_sub("valid_to", 1), F.lit(last))))
        spans = spans.where(F.col("valid_from") <= F.lit(last)).withColumn("month", F.explode(months))
    else:
        spans = spans.withColumn("month", F.lit(0))
    same_key = [F.col(f"c.{c}") == F.col(f"e.{c}") for c in ("pattern", "month", "salt")]
    active = (F.col("c.fetched_on") >= F.col("e.valid_from")) & (F.col("c.fetched_on") < F.col("e.valid_to"))
    found = held.alias("c").join(spans.alias("e"), [*same_key, active])
    rule = F.struct(F.length("e.pattern").alias("size"), F.col("e.pattern").alias("pattern"), F.col("e.valid_from").alias("since"))
    # Repeated captures meet here, so a capture's entries are told apart by their patterns, of which a URL has a few.
    ruled = found.groupBy(*(F.col(f"c.{c}").alias(c) for c in whole)).agg(
        F.size(F.collect_set("e.pattern")).cast("long").alias("n_entries"), F.max(rule).alias("rule")
    )
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in whole]
    return seen.alias("s").join(ruled.alias("r"), same, "left").select(
        *(F.col(f"s.{c}").alias(c) for c in whole),
        F.col("r.rule").isNotNull().alias("blocked"),
        F.coalesce("r.n_entries", F.lit(0).cast("long")).alias("n_entries"),
        F.col("r.rule.pattern").alias("pattern"),
        F.col("r.rule.since").alias("since"),
    )


def dated_captures(table: DataFrame) -> DataFrame:
    """Pages with a fetch date that their id gives: a day of 2024."""
    day = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    return table.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_on"))


def dated_entries(table: DataFrame) -> DataFrame:
    """A log that grows with the hosts.

    Each third host is listed, taken off and listed again; each fourth has its first folder listed; each ninth has
    its domain listed for a while.
    """
    at = address(F.col("url"))
    hosts = table.where(at.isNotNull()).groupBy(F.split(at, "/")[0].alias("host")).agg(
        F.min("page_id").alias("n"), F.min(F.split(at, "/")[1]).alias("folder")
    )
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    day = F.pmod(F.col("n") * 11, F.lit(200)).cast("int")

    def rows(chosen: Column, pattern: Column, steps: tuple[tuple[int, bool], ...]) -> Column:
        on = lambda after: F.date_add(F.lit("2024-01-01").cast("date"), day + F.lit(after))
        log = (F.struct(pattern.alias("pattern"), on(after).alias("on_date"), F.lit(adds).alias("adds")) for after, adds in steps)
        return F.when(chosen, F.array(*log))

    none = F.array().cast("array<struct<pattern:string,on_date:date,adds:boolean>>")
    logs = [
        rows(F.col("n") % 3 == 0, F.concat(F.lit("d:"), "host"), ((0, True), (60, False), (110, True))),
        rows(
            (F.col("n") % 4 == 1) & (F.coalesce("folder", F.lit("")) != ""),
            F.concat(F.lit("p:"), "host", F.lit("/"), "folder"),
            ((10, True), (10, False), (90, False)),
        ),
        rows((F.col("n") % 9 == 2) & (domain != ""), F.concat(F.lit("d:"), domain), ((5, True), (25, False))),
    ]
    return hosts.select(F.explode(F.concat(*(F.coalesce(x, none) for x in logs))).alias("e")).select("e.*")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pages(spark, sf_dir)
    return evaluate_captures(dated_captures(table), dated_entries(table))


OP10_SQL = r"""
with addressed as (
  select page_id, url, cast('2024-01-01' as date) + cast(((page_id * 37) % 366) as int) as fetched_on,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^?#]*)', 1) as rest from pages),
parts as (
  select *, rtrim(lower(regexp_extract(rest, '^([^/:]*)', 1)), '.') as host, regexp_replace(regexp_replace(rest, '^[^/]*', ''), '/+$',
    '') as path from addressed),
hosts as (
  select host, min(page_id) as n, min(string_split(host || path, '/')[2]) as folder, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$',
    1) as domain
  from parts where host <> '' group by host),
logs as (
  select 'd:' || host as pattern, unnest([struct_pack(a := 0, adds := true), struct_pack(a := 60, adds := false), struct_pack(a := 110,
    adds := true)]) as s, n from hosts where n % 3 = 0
  union all select 'p:' || host || '/' || folder, unnest([struct_pack(a := 10, adds := true), struct_pack(a := 10, adds := false),
    struct_pack(a := 90, adds := false)]), n from hosts where n % 4 = 1 and folder <> ''
  union all select 'd:' || domain, unnest([struct_pack(a := 5, adds := true), struct_pack(a := 25, adds := false)]),
    n from hosts where n % 9 = 2 and domain <> ''),
daily as (
  select pattern, cast('2024-01-01' as date) + cast((n * 11) % 200 + s.a as int) as valid_from,
    bool_or(s.adds) as adds from logs group by 1, 2),
spans as (
  select *, coalesce(lead(valid_from) over (partition by pattern order by valid_from), date '9999-12-31') as valid_to from daily),
held as (
  select page_id, url, fetched_on, 'd:' || list_aggregate(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))),
    'string_agg', '.') as pattern
  from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as i from parts where host <> '')
  union all select page_id, url, fetched_on, 'p:' || list_aggregate(list_slice(string_split(host || path, '/'), 1, i), 'string_agg', '/')
  from (select *, unnest(range(1, len(string_split(host || path, '/')) + 1)) as i from parts where host <> '')),
found as (
  select h.page_id, count(*) as n_entries, max(struct_pack(size := length(s.pattern), pattern := s.pattern, since := s.valid_from)) as rule
  from held h join spans s on h.pattern = s.pattern and s.adds and h.fetched_on >= s.valid_from and h.fetched_on < s.valid_to group by
    h.page_id)
select p.page_id, p.url, p.fetched_on, f.page_id is not null as blocked, coalesce(f.n_entries, 0) as n_entries,
    f.rule.pattern as pattern, f.rule.since as since
from parts p left join found f using (page_id)
"""
