"""Byte-level BPE encoding and decoding by a rank file.

Each match of the split pattern is merged by itself. A segment tree over its byte positions holds
the rank of the pair that starts at each live position; its root gives the least rank and the
descent to the left the leftmost place of it, so a merge costs a few logarithmic point updates on
live neighbours, also in pieces of a million bytes. Pieces repeat a lot, so each worker keeps a
bounded table of pieces that it has merged.

Cases: null text is empty and has no tokens; rows with equal ids each get a row; an empty table gives an
empty table; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, rows_of, texts_of
from .splitting import pieces, tiktoken_joins

NONE = 1 << 40  # above every rank
REMEMBERED = 800_000  # pieces that a worker keeps; the table is emptied when it is full


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the piece itself if it is a token, else merges by the leftmost least rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    leaves = 1 << max(0, (n - 2).bit_length())
    tree = [NONE] * (2 * leaves)
    for i in range(n - 1):
        tree[leaves + i] = get(piece[i : i + 2], NONE)
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, rank: int) -> None:
        node = leaves + i
        tree[node] = rank
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    after, before = list(range(1, n + 1)), list(range(-1, n))
    while (best := tree[1]) != NONE:
        node = 1
        while node < leaves:
            node *= 2
            node += tree[node] != best
        i = node - leaves
        gone = after[i]
        end = after[gone]
        after[i] = end
        before[end] = i
        if gone < n - 1:
            put(gone, NONE)
        put(i, get(piece[i : after[end]], NONE) if end < n else NONE)
        if i:
            left = before[i]
            put(left, get(piece[left:end], NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encodes texts to ids and ids to bytes with one vocabulary."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        known, found = self.known, []
        for piece in pieces(text, text.encode(), tiktoken_joins):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(merge_piece(piece.encode(), self.ranks), np.uint32).tobytes()
                if len(piece) <= 64:  # long pieces hardly come again
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            found.append(ids)
        return np.frombuffer(b"".join(found), np.uint32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and `ids array<int>` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for rows in rows_of(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in rows], batch.schema.types[0]),
                        pa.array([own.encode(t).astype(np.int32) for _, t in rows], pa.list_(pa.int32()))
                    ],
                    names=[key, "ids"],
                )

    kind = dict(docs.dtypes)[key]
    return texts_of(docs, key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The key and the `decoded binary` of each array of ids; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for rows in rows_of(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], batch.schema.types[0]), pa.array([own.decode(x or ()) for _, x in rows], pa.binary())],
                    names=[key, "decoded"],
                )

    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, ids).mapInArrow(run, f"{key} {kind}, decoded binary")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text in one pass; counts and hashes of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        decimal = [str(i) for i in range(len(own.tokens))]
        for batch in batches:
            for rows in rows_of(batch):
                out: list[list] = [[], [], [], []]
                for doc_id, text in rows:
                    ids = own.encode(text).tolist()
                    written = ",".join(map(decimal.__getitem__, ids))
                    for column, value in zip(
                        out,
                        (doc_id, len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()),
                        strict=True,
                    ):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
