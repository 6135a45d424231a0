"""Near-duplicate documents by circulant MinHash, banding, and Jaccard similarity of the full shingle sets.

Two fixed permutations of the 32-bit numbers make all signature coordinates: the first scatters the
shingles, the second, shifted round by k, gives coordinate k, the least value over the set. Five coordinates
make a band, forty bands a signature. A sketch of one bit from each of 192 coordinates goes with a set, and a pair
whose sketches differ more than sets of 0.8 do is not looked at; all other pairs are decided on the full sets.
Bands and sketches together find pairs at the limit with a share that tests/llm measures on planted pairs (README).

Documents with the same set are one node, which is named by 64 bits of the set's digest, so that texts
under one id stay apart; 64 further bits tell whether a name stands for different sets, which then get names of all 128 bits.
The least id of a component is looked up at the end. A bucket never emits all its
pairs: its members are held against one centre, then, while it still has several components, against other centres drawn at
random, and what is still apart at last is compared over component borders only, so no link between components is
lost. Large buckets are compared in blocks of rows by columns, each a task's share. Copies by the thousand make as
many pairs, not their square.

Cases: null and empty texts have empty sets and are linked with nothing; a null id is linked with nothing
and has a null component; rows with equal ids are judged each by its own text; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, ordered
from .common import Scratch, documents, rows_of, settled
from .graph import joined
from .substrings import WordHashes, tagged

ROWS, BANDS = 5, 40
BITS = 192
APART = 46  # sketch bits; sets of similarity 0.8 differ in 19, give or take 4
FINE = 2048
FINE_APART = 280  # of these bits; sets of similarity 0.8 differ in 205, give or take 14
RANDOM_ROUNDS = 1
CHUNK = 4096  # shingles that are permuted at once
BLOCK = 1000  # members of a bucket that are compared with as many others at once


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence if there are fewer words."""
    words = text.lower().split()  # on bytes: A-Z alone, and the six ASCII white-space characters
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    runs = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        runs = (runs ^ h[k : k + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(32)
    return np.unique(runs)


def permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit numbers: odd multiplications and shifts, each of which can be undone. In place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int = ROWS * BANDS) -> np.ndarray:
    """The first `size` coordinates; others follow by further shifts of the same permutation."""
    scattered = permute((shingles >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for first in range(0, size, 256):
        shifts = np.arange(first, min(first + 256, size), dtype=np.uint32)[:, None]
        part = least[first : first + 256]
        for at in range(0, len(scattered), CHUNK):
            np.minimum(part, permute(scattered[at : at + CHUNK] - shifts, 0x7FEB352D, 0x846CA68B).min(1), out=part)
    return least


def bits_of(sign: np.ndarray) -> list[int]:
    """The lowest bit of each coordinate, 64 in a number."""
    return np.packbits((sign & 1).astype(np.uint8)).view(np.int64).tolist()


def band_keys(sign: np.ndarray) -> np.ndarray:
    rows = sign.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = (keys ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


NAME_BITS = 64


def node_of(shingles: np.ndarray, bits: int = NAME_BITS) -> tuple[int, int]:
    """So many bits of the set's digest, and 64 more."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    name, rest = (int.from_bytes(part, "big", signed=True) for part in (digest[:8], digest[8:]))
    return name >> (64 - bits), rest


def survey(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """doc_id, tag, set size, node and rest (from the digest of the set), sketch and band keys of every text."""
    names = ["doc_id", "tag", "n", "node", "rest", "s1", "s2", "s3", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for rows in rows_of(batch):
                sets = [shingle_set(text.encode(), size, hashes) for _, _, text in rows]
                signs = [signature(s) for s in sets]
                sketches = [bits_of(s[:BITS]) for s in signs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id for doc_id, _, _ in rows], pa.int64()),
                        pa.array([tag for _, tag, _ in rows], pa.int64()),
                        pa.array(list(map(len, sets)), pa.int64()),
                        *(pa.array(c, pa.int64()) for c in zip(*(node_of(x, bits) for x in sets), strict=True)),
                        *(pa.array([s[k] for s in sketches], pa.int64()) for k in range(3)),
                        pa.array([band_keys(s) if len(x) else None for s, x in zip(signs, sets, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=names,
                )

    schema = "doc_id long, tag long, n long, node long, rest long, s1 long, s2 long, s3 long, bands array<long>"
    return docs.select("doc_id", "tag", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node and shingles of the named nodes (node, doc_id, tag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for rows in rows_of(batch):
                sets = [shingle_set(text.encode(), size, hashes).view(np.int64) for _, text in rows]
                columns = [pa.array([k for k, _ in rows], pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles"])

    named = docs.join(nodes.select("node", "doc_id", "tag").hint("merge"), ["doc_id", "tag"])
    return named.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def fine_sketches(sets: DataFrame) -> DataFrame:
    """node and a long sketch of its set, in numbers f0 and on."""
    names = ["node", *(f"f{k}" for k in range(FINE // 64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, 64):
                found = [(node, *bits_of(signature(np.array(shingles, np.int64).view(np.uint64), FINE))) for node, shingles in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

    return sets.select("node", "shingles").mapInArrow(run, ", ".join(f"{name} long" for name in names))


def may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches that allow the similarity."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in ("s1", "s2", "s3")), F.lit(0))
    return (100 * small >= percent * large) & (differ <= APART)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    sizes = F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both")
    enough = 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))
    return both.select("a", "b", *sizes).where(enough).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable) and kept of every document."""
    with Scratch(docs.sparkSession) as scratch:
        return settled(linked(tagged(docs), size, percent, scratch).drop("tag"), "linked")


def linked(rows: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    scanned = scratch.settled(survey(rows, size, NAME_BITS), "signatures")
    of_node = F.struct("doc_id", "tag", "n", "s1", "s2", "s3", "bands")

    def nodes() -> DataFrame:
        one = scanned.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min(of_node).alias("x"), (F.min("rest") < F.max("rest")).alias("clash"))
        return scratch.settled(one.select("node", "x.*", "clash"), "nodes")

    one_each = nodes()
    clashing = scratch.settled(one_each.where("clash").select("node", "clash"), "clashing")
    if not clashing.isEmpty():
        whole_name = F.when(F.col("clash"), F.xxhash64("node", "rest").bitwiseXOR(F.col("rest"))).otherwise(F.col("node"))
        scanned = scratch.settled(scanned.join(clashing, "node", "left").withColumn("node", whole_name).drop("clash"), "signatures")
        one_each = nodes()
    one_each = one_each.drop("clash")
    light = one_each.select("node", "n", "s1", "s2", "s3")

    keyed = one_each.select("node", F.explode("bands").alias("key"))
    in_bucket = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("size"))
    buckets = scratch.settled(in_bucket.where("a < b"), "buckets")
    a, b = light.alias("a"), light.alias("b")
    twos = buckets.where("size = 2").select(F.col("a").alias("i"), F.col("b").alias("j")).distinct()
    twos = twos.join(a, F.col("i") == F.col("a.node")).join(b, F.col("j") == F.col("b.node"))
    twos = twos.where(may_link("a", "b", percent)).select(F.col("i").alias("a"), F.col("j").alias("b"))
    big = scratch.settled(keyed.join(buckets.where("size > 2").select("key", "size"), "key"), "big")
    # A node that shares large buckets with many others is the likeliest to link with what is in its own.
    known = big.groupBy("node").agg(F.sum("size").alias("known"))
    members = scratch.settled(big.drop("size").join(known, "node").join(light, "node"), "members")

    def held_to(first: Column) -> Callable[[DataFrame, Column], DataFrame]:
        """Pairs of the members of each bucket with the one that comes first."""
        one = F.struct(first.alias("first"), "node", "n", "s1", "s2", "s3", "component")

        def pairs(of: DataFrame, apart: Column) -> DataFrame:
            # Written first, so that nothing but the join needs a bucket's rows together and Spark can split large ones.
            centres = scratch.settled(of.groupBy("key").agg(F.min(one).alias("x")).select("key", "x.*"), "centres")
            found = of.alias("m").join(centres.alias("c"), F.col("m.key") == F.col("c.key"))
            wanted = (F.col("m.node") != F.col("c.node")) & apart & may_link("m", "c", percent)
            return found.where(wanted).select(*ordered(F.col("m.node"), F.col("c.node"))).distinct()

        return pairs

    stars = held_to(-F.col("known"))(members.withColumn("component", F.col("node")), F.lit(True))
    tested = scratch.settled(twos.unionByName(stars).distinct(), "pairs")
    named = tested.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct()
    sets = scratch.settled(full_sets(rows, named.join(one_each.select("node", "doc_id", "tag"), "node"), size), "sets")
    found = components(scratch.settled(confirmed(tested, sets, percent), "links"), scratch.paths)

    apart = F.col("m.component") != F.col("c.component")
    for turn in range(RANDOM_ROUNDS + 1):
        placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # Written first, so that nothing but the join needs a bucket's rows together and Spark can split large ones.
        apart_in = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"))
        split = scratch.settled(apart_in.where("x < y").select("key", "size"), "split")
        placed = scratch.settled(placed.join(split, "key"), "placed")
        if placed.isEmpty():
            break
        if turn < RANDOM_ROUNDS:
            pairs = held_to(F.xxhash64("node", F.lit(turn)))(placed, apart)
        else:
            pairs = over_borders(placed, sets, one_each, percent, scratch)
        pairs = scratch.settled(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        more = scratch.settled(confirmed(pairs, sets, percent), "links")
        if not more.isEmpty():
            found = joined(found, more, scratch.paths)

    placed = scratch.settled(one_each.select("node", "doc_id").join(found, "node", "left").select("node", "doc_id", "component"), "placed")
    least = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    by_set = placed.join(scratch.settled(least, "least"), "component", "left").select(
        "node", F.coalesce("least", "doc_id").alias("component")
    )
    whole = scanned.select("doc_id", "tag", "n", "node").join(by_set, "node", "left")
    return whole.select(
        "doc_id",
        "tag",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def over_borders(placed: DataFrame, sets: DataFrame, one_each: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs of a bucket whose components differ and that may link by sketches long enough to tell.

    A pair that shares several buckets comes out of the one of its first band only. A bucket of `size` members is dealt
    into blocks, and each block of rows meets each block of columns under a key of its own.
    """
    nodes = scratch.settled(placed.select("node").distinct(), "left")
    fine = fine_sketches(sets.join(nodes, "node", "left_semi")).dropDuplicates(["node"])
    bands = one_each.join(nodes, "node", "left_semi").select("node", "bands").dropDuplicates(["node"])
    fine = scratch.settled(fine.join(bands, "node"), "fine")
    full = placed.select("node", "key", "component", "n", "s1", "s2", "s3", "size").join(fine, "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own, all_blocks = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    m = full.withColumn("row", own).withColumn("column", all_blocks).alias("m")
    c = full.withColumn("column", own).withColumn("row", all_blocks).alias("c")
    differ = sum((F.bit_count(F.col(f"m.f{k}").bitwiseXOR(F.col(f"c.f{k}"))) for k in range(FINE // 64)), F.lit(0))
    first_band = F.get(F.array_intersect("m.bands", "c.bands"), F.lit(0))  # in the order of the first array
    one_key = [F.col(f"m.{k}") == F.col(f"c.{k}") for k in ("key", "row", "column")]
    apart = (F.col("m.node") < F.col("c.node")) & (F.col("m.component") != F.col("c.component"))
    wanted = apart & may_link("m", "c", percent) & (differ <= FINE_APART) & (first_band == F.col("m.key"))
    return m.join(c, [*one_key, wanted]).select(F.col("m.node").alias("a"), F.col("c.node").alias("b"))


def keep_one_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all their columns, without those that a document with a smaller id stands for."""
    with Scratch(docs.sparkSession) as scratch:
        gone = settled(linked(tagged(docs), size, percent, scratch).where("not kept").select("doc_id", "tag").distinct(), "gone")
    tag = F.xxhash64(F.coalesce("d.text", F.lit("")))
    same = (F.col("d.doc_id") == F.col("g.doc_id")) & (tag == F.col("g.tag"))
    return docs.alias("d").join(gone.alias("g"), same, "left_anti")


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=4)


OP9_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
  else list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) end) as g from w),
sized as (select doc_id, count(*) as n from s group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as m from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from shared join sized p on p.doc_id = a join sized q on q.doc_id = b where 100 * m >= 80 * (p.n + q.n - m)),
twoway as (select a, b from links union all select b, a from links),
reach(doc_id, r) as (select doc_id, doc_id from w union select twoway.b, reach.r from reach join twoway on twoway.a = reach.doc_id)
select w.doc_id, coalesce(n, 0) as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from w left join sized using (doc_id) join (select doc_id, min(r) as component_id from reach group by doc_id) c using (doc_id)
"""
