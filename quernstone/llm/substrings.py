"""Substring dedup: words in long passages that a document with a smaller id has too are removed.

Only suffixes that can repeat are looked at. Each window has a least hash of its 8-word runs, its key, which
equal windows share; windows in a row with one key make a region. Keys that one document alone has are dropped. Equal
regions, as of exact copies, are one, with its least document and whether others have it; it is in the trees once.

A suffix starts at each word that begins a window. The suffixes of a key's regions are one group as long as its
regions have at most TOGETHER words: they are put in order by their words, the words that neighbours share are counted, and
runs of neighbours that share WINDOW or more are the subtree's deep internal nodes. A repeat is a stretch of a region
whose windows are below nodes with one least document id; it is given once, with its length. Nothing but words decides.

The regions of a key with more words have their suffixes split by their prefixes instead, which have 8 words and are
lengthened to 16, 32 and 50 words where more suffixes share one than a group may have. So a group is what the suffix tree has
below one of its nodes, and its subtree fits in memory. Where even 50 words are too common the prefix is such a node
itself, and its least id is found by partial minima. Here prefixes go by 64-bit names of each of these lengths, all of which
have to agree, so that a part of a third of all documents needs no text in any shuffle.

Cases: a null text has no words; a null id takes no part and keeps all; windows of documents with the same id
do not remove each other; rows with equal ids are judged each; an empty table gives an empty table;
columns other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, rows_of, settled

WINDOW = 50
RUN = 8
LENGTHS = (8, 16, 32, WINDOW)  # words of the prefixes by which suffixes are split
REGION = 63  # windows in a region at most: one bit each
TOGETHER = 60_000  # words of a key's regions that are one group; more are split by prefixes
BATCH = 300_000  # words of the groups whose suffixes are put in order at once
GROUP = 8_000  # suffixes that a group split by prefixes takes; the prefix of a larger one is lengthened
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHashes(dict):
    """Hash of each word, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, in doubling steps."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def regions(words: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of each region of a text."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    runs = np.zeros(len(words) - RUN + 1, np.uint64)
    for k in range(RUN):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(runs)]
    runs = (runs ^ (runs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(29)
    keys = sliding_least(runs, WINDOW - RUN + 1)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, n))
    if sizes.max() > REGION:  # text that repeats itself
        parts = -(-sizes // REGION)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, sizes = np.repeat(starts, parts) + REGION * within, np.minimum(np.repeat(sizes, parts) - REGION * within, REGION)
    return keys[starts].view(np.int64), starts, sizes


def survey(docs: DataFrame) -> DataFrame:
    """One scan of all texts: a row with count and digest for each document, and a row for each of its keys."""
    names = ["doc_id", "tag", "n_words", "sha", "key"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for rows in rows_of(batch):
                ids, keyed = [], []
                out: list[list] = [[], [], [], []]
                for doc_id, text, tag in rows:
                    words = text.encode().split()
                    row = (doc_id, tag, len(words), hashlib.sha256(b" ".join(words)).hexdigest())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    if doc_id is not None:
                        found = np.unique(regions(words, hashes)[0])
                        keyed.append(found)
                        ids.append(np.full(len(found), doc_id, np.int64))
                n = sum(map(len, keyed))
                known = [pa.array(c, k) for c, k in zip(out, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*known, pa.nulls(len(rows), pa.int64())], names=names)
                if n:
                    empty = [pa.nulls(n, kind) for kind in kinds[1:4]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), *empty, pa.array(np.concatenate(keyed))], names=names)

    return docs.mapInArrow(run, "doc_id long, tag long, n_words long, sha string, key long")


def cut_regions(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """The regions with shared keys (region set; content once for each task), and the texts that have any (region null)."""
    names = ["doc_id", "tag", "key", "region", "first", "n", "content"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for rows in rows_of(batch, 64):
                out: list[tuple] = []
                for doc_id, text, tag, wanted in rows:
                    words = text.encode().split()
                    keys, starts, sizes = regions(words, hashes)
                    chosen = np.isin(keys, np.array(wanted, np.int64))
                    if chosen.any():
                        out.append((doc_id, tag, None, None, None, None, text.encode()))
                    for key, first, n in zip(keys[chosen].tolist(), starts[chosen].tolist(), sizes[chosen].tolist(), strict=True):
                        content = b" ".join(words[first : first + n + WINDOW - 1])
                        region = hashlib.blake2b(content, digest_size=16).digest()
                        out.append((doc_id, tag, key, region, first, n, None if region in seen else content))
                        if len(seen) > 300_000:
                            seen.clear()
                        seen.add(region)
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names
                    )

    wanted = docs.join(shared, "doc_id").select("doc_id", "text", "tag", "wanted")
    return wanted.mapInArrow(run, "doc_id long, tag long, key long, region binary, first int, n int, content binary")


def word_ranks(contents: list[list[bytes]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks, by their words, of the stretches of 1, 2, 4 .. 64 words from each word on, and how many words there are to its region's end.

    Stretches that a region's end cuts short come before longer ones that begin with them.
    """
    rank = {word: i for i, word in enumerate(sorted({word for words in contents for word in words}))}
    lengths = np.fromiter(map(len, contents), np.int64, len(contents))
    n = int(lengths.sum())
    rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    levels, span = [np.fromiter((rank[word] for words in contents for word in words), np.int64, n)], 1
    while span <= WINDOW:
        then = np.full(n, -1, np.int64)
        then[:-span] = levels[-1][span:]
        then[rest <= span] = -1
        levels.append(np.unique(levels[-1] * (n + 1) + then + 1, return_inverse=True)[1])
        span *= 2
    return levels, rest


def shared_words(levels: list[np.ndarray], rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and at b have in common from their starts on."""
    most, same = np.minimum(rest[a], rest[b]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = np.minimum(np.stack([a, b]) + same, len(rest) - 1)
        same += ((same + (1 << k) <= most) & (levels[k][at[0]] == levels[k][at[1]])).astype(np.int64) << k
    return same


def repeats(rows: list[tuple[int, int, bool, int, list[bytes]]]) -> tuple[np.ndarray, ...]:
    """Of regions (key, doc_id, several, n, words), those of a key in a row: row, first window, windows and least id of each repeat.

    `several`: other documents have the region, too, so that its own windows repeat.
    """
    keys, docs, several, windows, contents = zip(*rows, strict=True)
    levels, rest = word_ranks(contents)
    n = np.array(windows)
    of = np.repeat(np.arange(len(rows)), n)
    i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    lengths = np.fromiter(map(len, contents), np.int64, len(rows))
    at = (np.cumsum(lengths) - lengths)[of] + i
    group = np.cumsum(np.append(0, np.diff(np.array(keys, np.int64)) != 0))[of]
    own = np.array(docs, np.int64)[of]
    order = np.lexsort((levels[-1][at], group))
    a = at[order]
    joined = (group[order][1:] == group[order][:-1]) & (shared_words(levels, rest, a[:-1], a[1:]) >= WINDOW)
    starts = np.flatnonzero(np.append(True, ~joined))
    least = np.empty(len(of), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(own[order], starts), np.diff(np.append(starts, len(of))))
    chosen = np.flatnonzero(np.array(several)[of] | (least < own))
    if not len(chosen):
        return (np.empty(0, np.int64),) * 4
    goes_on = (np.diff(of[chosen]) == 0) & (np.diff(i[chosen]) == 1) & (np.diff(least[chosen]) == 0)
    begins = np.flatnonzero(np.append(True, ~goes_on))
    return of[chosen][begins], i[chosen][begins], np.diff(np.append(begins, len(chosen))), least[chosen][begins]


def tree_repeats(different: DataFrame, parts: int) -> DataFrame:
    """region, first, windows and least of each repeat in the groups of keys."""
    names = ["region", "first", "windows", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def found() -> pa.RecordBatch:
            row, first, windows, least = repeats([r[1:] for r in held])
            region = pa.array([r[0] for r in held], pa.binary()).take(pa.array(row))
            return pa.RecordBatch.from_arrays([region, *(pa.array(c.astype(k)) for c, k in ((first, np.int32), (windows, np.int32), (least, np.int64)))], names=names)

        for batch in batches:
            for rows in rows_of(batch, 1024):
                for region, key, doc_id, several, n, content in rows:
                    if size >= BATCH and held[-1][1] != key:
                        yield found()
                        held.clear()
                        size = 0
                    held.append((region, key, doc_id, several, n, content.split()))
                    size += n + WINDOW - 1
        if held:
            yield found()

    dealt = different.select("region", "key", "doc_id", "several", "n", "content").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "region binary, first int, windows int, least long")


def name_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def prefix_names(contents: list[list[bytes]], hashes: WordHashes) -> tuple[list[np.ndarray], np.ndarray]:
    """The names of the prefixes of LENGTHS words of all suffixes of the regions, and each region's number of suffixes.

    The name of 2k words is that of its halves' names, the last one that of two halves that overlap.
    """
    lengths = np.fromiter(map(len, contents), np.int64, len(contents))
    names = np.fromiter((hashes[w] for words in contents for w in words), np.uint64, int(lengths.sum()))
    windows = lengths - WINDOW + 1
    ends = np.cumsum(lengths)
    firsts = np.repeat(ends - lengths - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    found, span = [], 1
    while 2 * span <= WINDOW:
        names, span = name_of(names[:-span], names[span:]), 2 * span
        if span in LENGTHS:
            found.append(names[firsts].view(np.int64))
    found.append(name_of(names[firsts], names[firsts + WINDOW - span]).view(np.int64))
    return found, windows


def first_prefixes(regions: DataFrame) -> DataFrame:
    """prefix (the shortest) and how many suffixes have it, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for rows in rows_of(batch, 4096):
                prefix, n = np.unique(prefix_names([content.split() for (content,) in rows], hashes)[0][0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(n)], names=["prefix", "n"])

    return regions.select("content").mapInArrow(run, "prefix long, n long")


def suffixes(regions: DataFrame) -> DataFrame:
    """prefix (the shortest), names of the longer ones, doc_id, region and place of every suffix of the regions."""
    longer = [f"p{n}" for n in LENGTHS[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for rows in rows_of(batch):
                named, windows = prefix_names([content.split() for _, _, content in rows], hashes)
                of = np.repeat(np.arange(len(rows)), windows)
                place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
                region = pa.array([r for r, _, _ in rows], pa.binary()).take(pa.array(of))
                doc_id = np.array([d for _, d, _ in rows], np.int64)[of]
                columns = [*map(pa.array, named), pa.array(doc_id), region, pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["prefix", *longer, "doc_id", "region", "i"])

    schema = ", ".join(f"{name} long" for name in ("prefix", *longer, "doc_id"))
    return regions.select("region", "doc_id", "content").mapInArrow(run, f"{schema}, region binary, i int")


def split_by_prefixes(regions: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """The suffixes in groups by `prefix`, and those, if any, whose prefix has become the whole window."""
    rows, groups = suffixes(regions), []
    sizes = first_prefixes(regions).groupBy("prefix").agg(F.sum("n").alias("n"))
    for longer in LENGTHS[1:]:
        large = scratch.settled(sizes.where(F.col("n") > GROUP).select("prefix"), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*groups, rows]), None
        groups.append(rows.join(large, "prefix", "left_anti"))
        rows = rows.join(large, "prefix", "left_semi")
        if longer == LENGTHS[1]:
            rows = scratch.settled(rows, "long")
        rows = rows.withColumn("prefix", F.col(f"p{longer}"))
        sizes = rows.groupBy("prefix").agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, groups), rows


def shared_depths(names: list[np.ndarray]) -> np.ndarray:
    """How many words, of LENGTHS, each suffix in order shares with the one before it."""
    same = np.ones(len(names[0]), bool)
    same[:1] = False
    depths = np.zeros(len(same), np.int64)
    for name, length in zip(names, LENGTHS, strict=True):
        same[1:] &= name[1:] == name[:-1]
        depths[same] = length
    return depths


def subtrees(groups: DataFrame, parts: int) -> DataFrame:
    """region, i and least: the least document id below the suffix's node of depth WINDOW, where that is another's."""
    names = ["prefix", *(f"p{n}" for n in LENGTHS[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # the last node's names, and its least id
        for batch in batches:
            if not batch.num_rows:
                continue
            levels = [batch.column(n).to_numpy() for n in names]
            doc_id = batch.column("doc_id").to_numpy()
            goes_on = before is not None and all(level[0] == b for level, b in zip(levels, before[0], strict=True))
            starts = np.maximum.accumulate(np.where(shared_depths(levels) < WINDOW, np.arange(len(doc_id)), 0))
            least = doc_id[starts]  # a node's suffixes come in order of their documents
            if goes_on:
                least[starts == 0] = before[1]
            before = [level[-1] for level in levels], least[-1]
            lower = np.flatnonzero(least < doc_id)
            chosen = [batch.column(n).take(pa.array(lower)) for n in ("region", "i")]
            yield pa.RecordBatch.from_arrays([*chosen, pa.array(least[lower])], names=["region", "i", "least"])

    dealt = groups.select(*names, "doc_id", "region", "i").repartition(parts, "prefix").sortWithinPartitions(*names, "doc_id")
    return dealt.mapInArrow(run, "region binary, i int, least long")


def whole_windows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for suffixes whose prefix is the whole window: each prefix is a node, its least id found by partial minima.

    The minima are written first: a join of two written tables is one that Spark can split where a key is large.
    """
    names = [f"p{n}" for n in LENGTHS[1:]]
    least = scratch.settled(rows.groupBy(*names).agg(F.min("doc_id").alias("least")), "nodes")
    return rows.join(least, names).where("least < doc_id").select("region", "i", "least")


def strike(texts: DataFrame, struck: DataFrame, with_text: bool) -> DataFrame:
    """Removes the words of the struck windows from each text: doc_id, tag, n_removed, kept_sha, and the text that is left.

    A removed passage goes with the white space after it; all that stands between kept words stays.
    """
    names = ["doc_id", "tag", "n_removed", "kept_sha"] + ["kept"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, 64):
                out: list[tuple] = []
                for doc_id, tag, content, found in rows:
                    words = content.split()
                    change = np.zeros(len(words) + 1, np.int32)
                    for x in found:
                        starts = x["first"] + np.flatnonzero((x["windows"] >> np.arange(REGION)) & 1)
                        np.add.at(change, starts, 1)
                        np.add.at(change, starts + WINDOW, -1)
                    keep = np.cumsum(change[:-1]) == 0
                    sha = hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(keep)])).hexdigest()
                    row = (doc_id, tag, int((~keep).sum()), sha)
                    out.append((*row, without(content, keep).decode()) if with_text else row)
                columns = zip(zip(*out, strict=True), kinds, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=names)

    schema = "doc_id long, tag long, n_removed long, kept_sha string" + ", kept string" * with_text
    return texts.join(struck, ["doc_id", "tag"]).mapInArrow(run, schema)


def without(content: bytes, keep: np.ndarray) -> bytes:
    """The text without the words that are not kept and the white space after each removed passage."""
    begins = np.fromiter((m.start() for m in WORDS.finditer(content)), np.int64, len(keep))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
    begins, out, at = np.append(begins, len(content)), [], 0
    for first, after in zip(edges[::2], edges[1::2], strict=True):
        out.append(content[at : begins[first]])
        at = begins[after]
    return b"".join([*out, content[at:]])


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and a tag of the text: rows with one id but different texts stay apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tag"))


def find_removals(docs: DataFrame, scratch: Scratch, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """What the scan knows of every document (doc_id, tag, n_words, sha), and the documents that lose words (see strike)."""
    rows = tagged(docs)
    scanned = scratch.settled(survey(rows), "survey")
    keys = scanned.where("key is not null").select("key", "doc_id")
    several = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    several = scratch.settled(several, "several")  # written, like other sides below, so that Spark can split joins on large keys
    shared = keys.join(several, "key").groupBy("doc_id").agg(F.collect_set("key").alias("wanted"))
    cut = scratch.settled(cut_regions(rows, shared), "regions")
    found = cut.where("region is not null")
    # One row for each different region, with its least document; content is in at least one of its rows.
    of_region = [F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most"), F.max("n").alias("n"), F.max("content").alias("content")]
    different = found.groupBy("key", "region").agg(*of_region).withColumn("several", F.col("most") > F.col("doc_id")).drop("most")
    different = scratch.settled(different, "different")
    spark = rows.sparkSession
    parts = max(8, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = F.sum(F.col("n") + WINDOW - 1)
    large = scratch.settled(different.groupBy("key").agg(words.alias("words")).where(F.col("words") > TOGETHER).select("key"), "large-keys")
    if large.isEmpty():
        repeated = tree_repeats(different, parts)
    else:
        crowd = scratch.settled(different.join(large, "key", "left_semi"), "crowd")
        groups, whole = split_by_prefixes(crowd, scratch)
        lower = subtrees(groups, parts)
        lower = lower if whole is None else lower.unionByName(whole_windows(whole, scratch))
        copies = crowd.where("several").selectExpr("region", "0 as first", "n as windows", "doc_id as least")
        repeated = tree_repeats(different.join(large, "key", "left_anti"), parts).unionByName(copies)
        repeated = repeated.unionByName(lower.selectExpr("region", "i as first", "1 as windows", "least"))
    by_region = repeated.groupBy("region").agg(F.collect_list(F.struct("first", "windows", "least")).alias("repeats"))  # 63 windows at most
    known = scratch.settled(by_region, "known")
    left = lambda x, by: F.call_function("shiftleft", x, by)
    bits = lambda x: left(F.bitwise_not(left(F.lit(-1).cast("long"), x["windows"])), x["first"])
    none = F.lit(0).cast("long")
    lower_ids = F.transform("repeats", lambda x: F.when(x["least"] < F.col("doc_id"), bits(x)).otherwise(none))
    windows = F.aggregate(lower_ids, none, lambda a, b: a.bitwiseOR(b))
    hits = found.select("region", "doc_id", "tag", "first").join(known, "region").select("doc_id", "tag", "first", windows.alias("windows"))
    struck = hits.where("windows <> 0").groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "windows")).alias("struck"))
    texts = cut.where("region is null").select("doc_id", "tag", "content").dropDuplicates(["doc_id", "tag"])
    return scanned.where("key is null").select("doc_id", "tag", "n_words", "sha"), strike(texts, struck, with_text)


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, and the SHA-256 of the kept words, of every document."""
    with Scratch(docs.sparkSession) as scratch:
        every, changed = find_removals(docs, scratch)
        joined = every.join(changed.select("doc_id", "tag", "n_removed", "kept_sha"), ["doc_id", "tag"], "left")
        removed = F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed")
        return settled(joined.select("doc_id", "n_words", removed, F.coalesce("kept_sha", "sha").alias("kept_sha256")), "removals")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, with the removed words, and the white space after each passage of them, gone from the texts."""
    with Scratch(docs.sparkSession) as scratch:
        _, changed = find_removals(docs, scratch, with_text=True)
        kept = settled(changed.select("doc_id", "tag", "kept"), "changed")
    tag = F.xxhash64(F.coalesce("d.text", F.lit("")))
    same = (F.col("d.doc_id") == F.col("k.doc_id")) & (tag == F.col("k.tag"))
    text = F.coalesce("k.kept", "d.text").alias("text")
    return docs.alias("d").join(kept.alias("k"), same, "left").select(*(text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(documents(spark, sf_dir))


OP2_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') as words from documents),
starts as (select doc_id, unnest(range(1, len(words) - 48)) as i, words from w where len(words) >= 50),
windows as (select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h from starts),
firsts as (select h, min(doc_id) as first_id from windows group by h having count(*) > 1),
covered as (select distinct doc_id, unnest(range(i, i + 50)) as j from windows join firsts using (h) where first_id < doc_id),
gone as (select doc_id, list(j) as js, count(*) as n from covered group by doc_id),
kept as (select w.doc_id, len(words) as n_words, coalesce(n, 0) as n_removed,
  case when n is null then words else list_filter(words, lambda x, i: not list_contains(js,
    i)) end as kept from w left join gone using (doc_id))
select doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from kept
"""
