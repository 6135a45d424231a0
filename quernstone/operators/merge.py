"""Conflict-free merges of two snapshots, change data, and keyed writes without a transactional table.

A merge never needs both sides in one place: both are put under each other with a source number (0: local,
1: cloud) and meet in one grouping, of which Spark adds up parts before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranking import numbered


def both(local: DataFrame, cloud: DataFrame) -> DataFrame:
    return local.withColumn("src", F.lit(0)).unionByName(cloud.withColumn("src", F.lit(1)))


def merge_greatest(local: DataFrame, cloud: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per key the greater value of every field; keys with nothing but zeros are left out."""
    merged = both(local, cloud).groupBy(*keys).agg(*(F.max(F.coalesce(f, F.lit(0))).alias(f) for f in fields))
    return merged.where(F.greatest(*fields, F.lit(0)) > 0)


def merge_override(local: DataFrame, cloud: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per key the whole local value if there is one, else the cloud's: no field is taken from the other side."""
    return both(local, cloud).groupBy(*keys).agg(F.min_by(F.struct(*fields), "src").alias("v")).select(*keys, "v.*")


def merge_latest(local: DataFrame, cloud: DataFrame, keys: list[str], touched: Column, fields: list[str]) -> DataFrame:
    """Per key the record touched last; of equals the local one."""
    return both(local, cloud).groupBy(*keys).agg(
        F.max_by(F.struct("src", *fields), F.struct(touched, -F.col("src"))).alias("v")
    ).select(*keys, "v.*")


def merge_nested(local: DataFrame, cloud: DataFrame, parent: str, child: str, touched: str, fields: list[str]) -> DataFrame:
    """Children by the latest touch, ties local; each with the fields of the parent that was touched last on either side."""
    rows = both(local, cloud)
    parents = rows.groupBy(parent, "src").agg(F.max(touched).alias("t")).groupBy(parent).agg(
        F.max_by("src", F.struct("t", -F.col("src"))).alias("base")
    )
    children = rows.groupBy(parent, child).agg(
        F.max_by(F.struct("src", touched, *fields), F.struct(touched, -F.col("src"))).alias("v")
    ).select(parent, child, "v.*")
    return children.join(parents, parent)


def positive_changes(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """What grew from one snapshot to the next, over the keys of the later one; falls count as nothing."""
    old = before.select(*keys, *(F.col(f).alias(f"old_{f}") for f in fields))
    joined = after.join(old, keys, "left")
    return joined.select(
        *keys,
        *(F.greatest(F.lit(0), F.coalesce(f, F.lit(0)) - F.coalesce(f"old_{f}", F.lit(0))).alias(f) for f in fields)
    )


def ordered_union(local: DataFrame, cloud: DataFrame, name: str, order: str) -> DataFrame:
    """Distinct trimmed names that are not empty, with their first place: local ones first."""
    rows = both(local, cloud).withColumn(name, F.trim(name)).where(F.col(name) != "")
    return rows.groupBy(name).agg(F.min(F.struct("src", order)).alias("at")).select(name, "at.src", F.col(f"at.{order}").alias(order))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The table after the incoming rows replaced those with their keys."""
    return merge_override(incoming, stored, keys, fields)


def insert_if_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the incoming rows whose keys it does not have."""
    return stored.unionByName(incoming.join(stored.select(*keys), keys, "left_anti"))


def keep_latest(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The last `most` rows of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def drop_sources(rows: DataFrame, source: str, gone: list[str]) -> DataFrame:
    """Rows of the named sources go, and with them keys that have no others."""
    return rows.where(~F.col(source).isin(gone))


def renumber(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Numbers from 1 within each group, of any size."""
    return numbered(rows, [group], order, "n").withColumn("n", (F.col("n") + 1).cast("int"))


def tiered(keys: DataFrame, key: str, tiers: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """The value of the first tier that has the key, and its name; null and 'compute' where none has."""
    out = keys.select(key)
    for name, tier in tiers:
        out = out.join(tier.select(key, F.struct(F.col(value).alias("value"), F.lit(name).alias("tier")).alias(f"__{name}")), key, "left")
    found = F.coalesce(*(F.col(f"__{name}") for name, _ in tiers))
    return out.select(key, found["value"].alias(value), F.coalesce(found["tier"], F.lit("compute")).alias("tier"))


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, that of the least order, and how many there were."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def except_or_all(pool: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    """The pool without the skipped rows; the whole pool if nothing would be left."""
    left = pool.join(skipped.select(key).distinct().withColumn("__skip", F.lit(True)), key, "left")
    any_left = left.agg(F.bool_or(F.col("__skip").isNull()).alias("__any"))
    return left.crossJoin(F.broadcast(any_left)).where(F.col("__skip").isNull() | ~F.col("__any")).drop("__skip", "__any")


def zip_prefix(one: DataFrame, other: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Two sequences side by side; `same` while they have not differed yet."""
    joined = one.select(key, at, F.col(value).alias("a")).join(other.select(key, at, F.col(value).alias("b")), [key, at], "full")
    so_far = W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    return joined.withColumn("same", F.min(F.col("a").eqNullSafe(F.col("b"))).over(so_far))


def override_cells(cells: DataFrame, fixes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Corrections replace the values of their cells."""
    fixed = fixes.select(*keys, F.col(value).alias("__fix"))
    return cells.join(fixed, keys, "left").withColumn(
        "fixed", F.col("__fix").isNotNull()
    ).withColumn(value, F.coalesce("__fix", value)).drop("__fix")


def missing_keys(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are absent and found keys that nothing expects."""
    there = expected.select(*keys).distinct().withColumn("__e", F.lit(1)).join(
        found.select(*keys).distinct().withColumn("__f", F.lit(1)), keys, "full"
    )
    return there.where("__e is null or __f is null").select(
        *keys, F.when(F.col("__f").isNull(), "absent").otherwise("unexpected").alias("problem")
    )


def merge_entities(
    local: dict[str, DataFrame],
    cloud: dict[str, DataFrame],
    rules: dict[str, Callable[[DataFrame, DataFrame], DataFrame]],
) -> dict[str, DataFrame]:
    """Every entity of two snapshots merged by its own rule. An entity that one side lacks is merged with an empty one; without rows it is left out."""
    out = {}
    for name, rule in rules.items():
        sides = [side.get(name) for side in (local, cloud)]
        known = next((x for x in sides if x is not None), None)
        if known is None:
            continue
        merged = rule(*(known.limit(0) if x is None else x for x in sides))
        if not merged.isEmpty():
            out[name] = merged
    return out


def merge_readings(local: DataFrame, cloud: DataFrame, key: str, maps: list[str], last: str, at: str) -> DataFrame:
    """Per key the union of each map, in which local values win, and the place read last; of equal times the local one.

    Rows: key, the maps, the place `last` and its time `at`, null where nothing was read.
    """
    rows = both(local, cloud)
    newest = F.max_by(F.struct(last, at), F.when(F.col(at).isNotNull(), F.struct(at, -F.col("src"))))
    entries = [F.collect_list(F.when(F.col(m).isNotNull(), F.struct("src", F.map_entries(m).alias("e")))).alias(m) for m in maps]
    met = rows.groupBy(key).agg(*entries, newest.alias("x"))  # two rows for a key at most
    pick = lambda m, s: F.map_from_entries(F.flatten(F.transform(F.filter(m, lambda x: x["src"] == s), lambda x: x["e"])))

    def union(m: str) -> Column:
        own, other = pick(F.col(m), 0), pick(F.col(m), 1)
        return F.map_concat(F.map_filter(other, lambda k, _: ~F.map_contains_key(own, k)), own).alias(m)

    return met.select(key, *(union(m) for m in maps), f"x.{last}", f"x.{at}")


def dedup_by_place(incoming: DataFrame, stored: DataFrame, place: str, number: str, side: str) -> DataFrame:
    """Each incoming row with what it repeats: a stored row of the same placement, whatever its side; else an earlier incoming one; or nothing.

    `other` is the number repeated, `clash` tells that the sides to move differ; of several rows that repeat, the least number counts.
    """
    there = stored.groupBy(place).agg(F.min(F.struct(F.col(number).alias("n"), F.col(side).alias("s"))).alias("there"))
    first = incoming.groupBy(place).agg(F.min(number).alias("first"))
    met = incoming.join(there, place, "left").join(first, place)
    kind = F.when(F.col("there").isNotNull(), "stored").when(F.col("first") < F.col(number), "incoming").otherwise("new")
    other = F.when(F.col("there").isNotNull(), F.col("there.n")).when(F.col("first") < F.col(number), F.col("first"))
    clash = F.coalesce(F.col("there.s") != F.col(side), F.lit(False))
    return met.select(number, kind.alias("repeats"), other.alias("other"), clash.alias("clash"))


def suppressed(sources: list[DataFrame], key: str) -> DataFrame:
    """All rows of the sources, of which the earlier ones win: later rows with a key that came before are left out."""
    rows = sources[0].withColumn("src", F.lit(0))
    for i, more in enumerate(sources[1:], 1):
        rows = rows.unionByName(more.withColumn("src", F.lit(i)))
    own = [c for c in rows.columns if c not in (key, "src")]
    return rows.groupBy(key).agg(F.min_by(F.struct("src", *own), "src").alias("v")).select(key, "v.*")
