"""Vector codes: each part of a vector becomes the number of its nearest entry in that part's codebook.

Components become whole numbers (1024ths, rounded down), so that sums are exact and every order of adding gives the same
codebooks. Vectors are kept as blocks of at most BLOCK rows, stored by component: component after component, each one a
NumPy column. A round of training is one `treeAggregate` over the blocks: in a block the distances to all entries grow
component by component, the nearest entry is taken, and `np.add.at` adds the rows to int64 tensors of sums and counts
(parts x entries x components). The tensors have a fixed size and are merged in a reduction tree, so the driver gets a few
of them, whatever the number of rows. Codebooks, of the same size, go to the tasks with the closure.

The blocks are a table in the shared folder, from which each round reads anew: a lost executor costs its own tasks only.
No round shuffles rows and none groups by a key, so equal vectors and equal labels, however many, are spread as they lie.
The error by label is summed in parts, written, and joined to the rows: below Spark's broadcast limit rows stay where they
are, above it Spark splits labels that are skewed.

Cases: a vector that is null or holds null or non-finite components is dropped, as the contract says. The number of
components is that of the vector with the least id; a vector of another length, and every vector if that number is no
positive multiple of the parts, stays with a null code and error. Whole numbers beyond the square root of 2^60 over the number of
components are held at it, so that no distance overflows. With fewer vectors than entries the codebooks are shorter. Rows with
equal ids each count; a null id gives no entry but gets a code; null labels are one label; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, settled, spread

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
BLOCK = 1024  # rows whose distances to all entries are held at once: two arrays of a few MB
DEPTH = 3  # levels of the reduction tree


def whole_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds finite numbers only."""
    usual = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(vector).isNotNull() & usual)


def in_whole_numbers(values: np.ndarray, dims: int) -> np.ndarray:
    most = isqrt(2**60 // dims)
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most).astype(np.int32)


def part_blocks(rows: DataFrame, key: str, label: str, vector: str, dims: int) -> DataFrame:
    """Blocks of vectors: ids and labels of up to BLOCK rows and their components, column after column; no block for vectors of another length."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(ids: pa.Array, labels: pa.Array, block: bytes | None) -> pa.RecordBatch:
            one = pa.array([0, len(ids)], pa.int32())
            columns = [pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, labels), pa.array([block], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "block"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, labels, vectors = batch.slice(at, BLOCK).columns
                fits = pc.equal(pc.list_value_length(vectors), dims)
                good, rest = (np.flatnonzero(f.to_numpy(zero_copy_only=False)) for f in (fits, pc.invert(fits)))
                if len(good):
                    values = pc.list_flatten(vectors.take(pa.array(good))).to_numpy(zero_copy_only=False).reshape(-1, dims)
                    yield row(ids.take(pa.array(good)), labels.take(pa.array(good)), in_whole_numbers(values, dims).T.tobytes())
                if len(rest):
                    yield row(ids.take(pa.array(rest)), labels.take(pa.array(rest)), None)

    return rows.select(key, label, vector).mapInArrow(run, f"ids array<{kinds[key]}>, labels array<{kinds[label]}>, block binary")


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (k x d) of each row of a part (d x n), ties to the lower number, and its squared distance."""
    reach = int(np.abs(part).max(initial=0)) + int(np.abs(entries).max(initial=0))
    kind = np.int32 if len(part) * reach**2 < 2**31 else np.int64
    far = np.zeros((part.shape[1], len(entries)), kind)
    gap = np.empty_like(far)
    for column, component in zip(part.astype(kind), entries.T.astype(kind), strict=True):
        np.subtract(column[:, None], component, out=gap)
        np.multiply(gap, gap, out=gap)
        far += gap
    best = far.argmin(1)
    return best, far[np.arange(len(best)), best].astype(np.int64)


def parts_of(block: bytes, books: np.ndarray) -> np.ndarray:
    """A block as parts x components x rows."""
    return np.frombuffer(block, np.int32).reshape(len(books), books.shape[2], -1)


def next_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, every used entry to the mean of its parts, rounded down."""

    def add(held: tuple[np.ndarray, np.ndarray] | None, row: tuple) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = held or (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
        for p, part in enumerate(parts_of(row[0], books)):
            best, _ = nearest(part, books[p])
            np.add.at(sums[p], best, part.T.astype(np.int64))
            np.add.at(counts[p], best, 1)
        return sums, counts

    def merge(a: tuple | None, b: tuple | None) -> tuple | None:
        return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

    found = blocks.where("block is not null").select("block").rdd.treeAggregate(None, add, merge, DEPTH)
    if not found:
        return books
    sums, counts = found
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)


def first_books(rows: DataFrame, key: str, vector: str, parts: int, entries: int) -> np.ndarray:
    """Codebooks (parts x entries x components) of the vectors with the least ids; ties in the order of their components.

    Without a vector, or if the first one has no positive multiple of the parts, they have no entries.
    """
    least = rows.where(F.col(key).isNotNull()).orderBy(key, vector).select(vector)
    first = least.first()
    dims = len(first[0]) if first else 0
    if not dims or dims % parts:
        return np.zeros((parts, 0, 0), np.int64)
    found = least.where(F.size(vector) == dims).limit(entries).collect()
    whole = in_whole_numbers(np.array([r[0] for r in found], np.float64), dims).astype(np.int64)
    return np.ascontiguousarray(whole.reshape(len(found), parts, -1).transpose(1, 0, 2))


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(blocks: DataFrame, books: np.ndarray, key: str, label: str) -> DataFrame:
    """key, label, code (two hex digits for each part) and error of every row."""
    kinds = {n: k.removeprefix("array<").removesuffix(">") for n, k in blocks.dtypes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                block = batch.column(2)[i].as_py()
                if block is None:
                    codes, errors = pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64())
                else:
                    found = [nearest(part, books[p]) for p, part in enumerate(parts_of(block, books))]
                    shown = np.stack([best for best, _ in found], 1).astype(np.uint8).tobytes().hex()
                    width = 2 * len(books)
                    codes = pa.array([shown[at : at + width] for at in range(0, len(shown), width)])
                    errors = pa.array(sum(far for _, far in found))
                yield pa.RecordBatch.from_arrays([ids, labels, codes, errors], names=[key, label, "code", "error"])

    return blocks.mapInArrow(run, f"`{key}` {kinds['ids']}, `{label}` {kinds['labels']}, code string, error long")


def compress(
    rows: DataFrame, key: str, label: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """The written codes (key, label, code, error) and the codebooks after so many rounds."""
    kept = whole_vectors(rows.select(key, label, vector), vector)
    books = first_books(kept, key, vector, parts, entries)
    with Scratch(rows.sparkSession) as scratch:
        blocks = scratch.settled(part_blocks(kept, key, label, vector, parts * books.shape[2] or -1), "vector-blocks")
        for _ in range(rounds):
            books = next_books(blocks, books)
        return settled(encoded(blocks, books, key, label), "vector-codes"), books


def decoded(code: Column, books: np.ndarray) -> Column:
    """The vector that a code stands for; the codebooks, which have a fixed size, are part of the expression."""
    tables = [F.lit((book / SCALE).tolist()) for book in books]
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.concat(*(F.get(table, at(p)) for p, table in enumerate(tables)))


def with_label_errors(codes: DataFrame, label: str) -> DataFrame:
    """Codes with the error summed over equal labels, nulls together."""
    sums = settled(codes.groupBy(label).agg(F.sum("error").alias("label_error")), "label-errors")
    same = F.col(f"c.{label}").eqNullSafe(F.col(f"s.{label}"))
    return codes.alias("c").join(sums.alias("s"), same).select("c.*", "label_error")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vec_id", "label", "embedding")
    return with_label_errors(codes, "label").select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def _round(k: int) -> str:
    """Assigns parts to the entries of round k - 1 and makes those of round k."""
    return f"""
a{k} as materialized (select vec_id, part, min(list_sum(list_transform(range(1, d + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) * 256 + entry)::bigint as m
  from p join b{k - 1} using (part) group by all),
s{k} as (select part, (m % 256)::bigint as entry, i, sum(x[i])::bigint as s, count(*)::bigint as n
  from a{k} join p using (vec_id, part), unnest(range(1, d + 1)) t(i) group by all),
n{k} as (select part, entry, list((s - ((s % n) + n) % n) // n order by i) as c from s{k} group by all),
b{k} as materialized (select b.part, b.entry, coalesce(n.c, b.c) as c from b{k - 1} b left join n{k} n using (part, entry)),"""


OP12_SQL = f"""
with v as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, label, part::bigint as part, (len(e) // 4)::bigint as d, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] as x
  from v, unnest(range(4)) t(part)),
f as (select vec_id, row_number() over (order by vec_id) - 1 as entry from v order by vec_id limit 256),
b0 as materialized (select part, entry::bigint as entry, x as c from f join p using (vec_id)),{"".join(map(_round, range(1, ROUNDS + 2)))}
e as (select vec_id, any_value(label) as label, string_agg(printf('%02x', m % 256), '' order by part) as code, sum(m // 256)::bigint as error
  from a{ROUNDS + 1} join p using (vec_id, part) group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) from b{ROUNDS}) as codebooks_sha256
from e
"""
