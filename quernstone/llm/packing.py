"""Best-fit packing of token sequences into fixed-length rows.

Texts become ids with an end id; only documents longer than a sequence are cut, into full pieces and
a rest. The pieces are dealt to packers by a hash of the document, as many packers as the tokens
need, and each packs by bounded-space online best-fit: a fixed number of open sequences, found through
a bitset that has a bit for every amount of free space with an open sequence. A piece goes where it
leaves the least free; if none has room and all places are taken, the fullest closes first. Pieces come in
blocks of 1000, the longest of a block first. A packer so holds a fixed amount of memory however much passes
through it.

Cases: null text is empty and is one piece of the end id alone; rows with equal ids are packed each;
an empty table gives an empty table; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, settled, texts_of

BYTES_AT_ONCE = 3_000_000  # text that is encoded together
WORDS_AT_ONCE = 2_000  # words that the library is asked for together
REMEMBERED = 150_000  # words after which a worker starts a new table; it keeps the one before


class WordIds:
    """Ids by the tokenizers library, which is asked once for each word between ASCII white space.

    The library's normalizer and split never join anything over white space, so a text's ids are those
    of its words in turn. Nor do they join an ASCII letter or digit and the closing marks after it, or tell
    ASCII capitals apart, so both are put aside first: there are far fewer words then. A text keeps its
    capitals if it may hold a special string, or a capital with a combining mark, with which it may compose
    before it is put in lower case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # words of the time before; what comes again moves on to known

    def look_up(self, words: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = list(map(known.get, words))
        new = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            if (ids := before.get(words[i])) is None:
                new.append(i)
            else:
                found[i] = known[words[i]] = ids
        for at in range(0, len(new), WORDS_AT_ONCE):  # what the library gives back for a word is far larger than its ids
            some = new[at : at + WORDS_AT_ONCE]
            encoded = self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)
            for i, got in zip(some, encoded, strict=True):
                found[i] = array("I", got.ids).tobytes()
        known.update((words[i], found[i]) for i in new if len(words[i]) <= 64)  # long ones hardly come again
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Each different word of the batch is looked up once."""
        texts = pc.replace_substring_regex(texts, CLOSING, r"\1 \2\3")
        texts = pc.if_else(pc.match_substring_regex(texts, CAPITALS_COUNT), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        found = self.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        at = np.cumsum(sizes) - sizes
        word = coded.indices.to_numpy()
        counts = sizes[word]
        ends = np.cumsum(counts)
        ids = pool[np.repeat(at[word] - ends + counts, counts) + np.arange(counts.sum())]
        words = np.cumsum(pc.list_value_length(split).to_numpy())
        return np.split(ids, np.append(0, ends)[words[:-1]])


CLOSING = r"([A-Za-z0-9])([.,;:!?]+)(\s|$)"
CAPITALS_COUNT = r"<\||[A-Z]\pM"


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut_into_pieces(docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and the ids if asked for."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for some in by_bytes(batch, BYTES_AT_ONCE):
                ids_now, texts = some.columns
                out: list[list] = [[] for _ in names]
                for doc_id, ids in zip(ids_now.to_pylist(), own.encode(texts), strict=True):
                    ids = np.concatenate([ids, end])
                    for piece, start in enumerate(range(0, len(ids), length)):
                        part = ids[start : start + length]
                        row = (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32))
                        for column, value in zip(out, row, strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(out, kinds, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return texts_of(docs).mapInArrow(run, schema)


class OpenSequences:
    """A fixed number of open sequences, keyed by free space in a bitset."""

    def __init__(self, length: int, places: int):
        self.length, self.places, self.open, self.bits, self.made = length, places, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        sequence = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return sequence

    def place(self, size: int) -> tuple[int, int]:
        """The sequence that a piece goes to and its offset there."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open == self.places and size < self.length:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, sequence = self.length, self.made
            self.made += 1
        if free > size:
            self.by_free[free - size].append(sequence)
            self.bits |= 1 << (free - size)
            self.open += 1
        return sequence, self.length - free


def pack(pieces: DataFrame, length: int = 2048, places: int = 256, tokens_per_packer: int = 16_000_000, block: int = 1000) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must be a written table as it is read twice.

    Pieces come in blocks, and the longest of a block first: short ones then fill what the long ones leave.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-total // tokens_per_packer))
    rest = [c for c in pieces.columns if c not in ("doc_id", "piece", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenSequences(length, places)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = batch.column("length").to_numpy()
            sequence, offset = np.empty((2, len(sizes)), np.int64)
            for at in range(0, len(sizes), block):
                for i in at + np.argsort(-sizes[at : at + block], kind="stable"):
                    sequence[i], offset[i] = bins.place(int(sizes[i]))
            found = [*batch.columns, pa.array(first + sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(found, names=[*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {kind}" for c, kind in pieces.dtypes)
    place = F.xxhash64("doc_id", "piece")
    mixed = pieces.repartition(packers, place).sortWithinPartitions(place, "doc_id", "piece", *rest[:1])
    return mixed.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, length: int = 2048, places: int = 256, with_ids: bool = False) -> DataFrame:
    return pack(settled(cut_into_pieces(docs, path, length, with_ids=with_ids), "pieces"), length, places)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
