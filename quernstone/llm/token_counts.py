"""Token counts of whole texts and of all their prefixes, by dynamic programming.

Within one piece of the split pattern the last token of a prefix settles the rest: the encoding of
piece[:i] is that of piece[:i - len(t)] and then t, for the one token t ending there that the merges
leave beside the token before it. One pass over a piece thus stores the count of each of its
prefixes. Over pieces the counts add up to one array with the count at every prefix of the text. It is stored
beside the document as the steps from one prefix to the next, a byte each or four where a step is large; whole
counts, budget questions (the longest prefix of at most n tokens) and the counts of truncated texts are looked
up in what is stored, and nothing is encoded again.

A prefix can end inside a piece, where the pattern may split its end otherwise than the text: white
space before a word, a contraction cut short, a special string cut short. Those ends are counted as
they would be split.

Cases: null text is empty, with no tokens; a special string in a text counts as one token, as the
library has it by default; rows with equal ids each get a row; an empty table gives an empty table;
columns other than the key and the text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import by_bytes, documents, rows_of, settled, texts_of
from .splitting import pieces, tokenizers_joins

REMEMBERED = 800_000  # pieces, and pairs of tokens, that a worker keeps; a table is emptied when it is full
ANY_RANK = 1 << 40
SPACES = regex.compile(r"\s\s+(?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact counts at every prefix, for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {tuple(bytes(letters[c] for c in side) for side in m): rank for rank, m in enumerate(merges)}
        self.sides = {a + b: (a, b) for a, b in reversed(self.rank)}
        special = "|".join(regex.escape(x["content"]) for x in spec["added_tokens"])
        self.stop = regex.compile(f"({special})") if special else None
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, tuple[bytes, int]] = {}
        stands = {bytes([b]): True for b in range(256)}
        for token in sorted(self.sides, key=len):
            a, b = self.sides[token]
            stands[token] = stands[a] and stands[b] and self.stay_apart(a, b, self.rank[a, b])
        #: each ending of a token, and whether its own bytes are encoded as this one token
        self.endings = {token[i:]: False for token in stands for i in range(len(token))} | stands

    def stay_apart(self, left: bytes, right: bytes, before: int = ANY_RANK) -> bool:
        """Whether no merge over the border of two tokens comes before the merges that built them.

        Takes the tokens apart, the later merge first, and looks up each pair that meets at the border.
        Where both are of one rank the left one was merged first.
        """
        rank, sides = self.rank, self.sides
        while True:
            if rank.get((left, right), ANY_RANK) < before:
                return False
            of_left = rank[sides[left]] if left in sides else -1
            of_right = rank[sides[right]] if right in sides else -1
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                before, left = of_left, sides[left][1]
            else:
                before, right = of_right + 1, sides[right][0]

    def count_piece(self, piece: bytes) -> list[int]:
        """The token counts of piece[:1], piece[:2] and so on."""
        endings, beside = self.endings, self.beside
        last, counts = [b""], [0]
        for end in range(1, len(piece) + 1):
            for start in range(end - 1, -1, -1):
                token = piece[start:end]
                if endings[token]:  # an ending that no token has can't come before the token is found
                    if not start:
                        break
                    pair = (last[start], token)
                    fits = beside.get(pair)
                    if fits is None:
                        if len(beside) >= REMEMBERED:
                            beside.clear()
                        fits = beside[pair] = self.stay_apart(*pair)
                    if fits:
                        break
            last.append(piece[start:end])
            counts.append(counts[start] + 1)
        return counts[1:]

    def piece(self, piece: str) -> tuple[bytes, int]:
        """The counts at a piece's characters, as 32-bit numbers, and the last of them."""
        found = self.known.get(piece)
        if found is None:
            utf8 = piece.encode()
            counts = np.array(self.count_piece(utf8), np.uint32)
            if len(utf8) > len(piece):
                counts = counts[np.append(np.frombuffer(utf8, np.uint8)[1:] & 0xC0 != 0x80, True)]
            if piece[0] == "'" and len(piece) == 3 and piece.isascii() and piece[1:].isalpha():
                counts[1] = 2  # a contraction cut after its first letter is two pieces
            found = counts.tobytes(), int(counts[-1])
            if len(piece) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = found
        return found

    def plain(self, text: str) -> tuple[np.ndarray, int]:
        """Counts at the end of each character of a text without special strings, and of the whole."""
        parts = pieces(text, text.encode(), tokenizers_joins)
        found = list(map(self.piece, parts))
        totals = np.fromiter((x[1] for x in found), np.int64, len(found))
        before = np.cumsum(totals) - totals
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        counts = np.frombuffer(b"".join([x[0] for x in found]), np.uint32) + np.repeat(before, sizes)
        for m in SPACES.finditer(text):  # a prefix that ends with white space has all of it in one piece
            counts[m.end() - 1] = (counts[m.start() - 1] if m.start() else 0) + self.piece(m.group())[1]
        return counts, int(totals.sum())

    def prefixes(self, text: str) -> tuple[np.ndarray, int]:
        """The count at every prefix, the empty one first, and of the whole text."""
        if self.stop is None or not self.stop.search(text):
            counts, total = self.plain(text)
            return np.concatenate([[0], counts]), total
        out, total = [np.zeros(1, np.int64)], 0
        parts = self.stop.split(text)  # plain text and special strings in turn
        for part, special in zip(parts[::2], [*parts[1::2], ""], strict=True):
            # The beginnings of a special string are plain text still, which follows what is before it.
            counts, own = self.plain(part + special[:-1]) if part or len(special) > 1 else (np.zeros(0, np.int64), 0)
            out.append(counts + total)
            total += own if not special else int(counts[len(part) - 1]) if part else 0
            if special:
                total += 1
                out.append(np.array([total]))
        return np.concatenate(out), total


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def longest_within(prefixes: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most so many tokens; counts can fall again, so the last fit counts."""
    return int(np.flatnonzero(prefixes <= budget)[-1])


def as_steps(prefixes: np.ndarray) -> tuple[int, bytes]:
    """The changes of the count from prefix to prefix: bytes for each, and all of them."""
    steps = np.diff(prefixes)
    width = 1 if not len(steps) or np.abs(steps).max() < 128 else 4
    return width, steps.astype(f"<i{width}").tobytes()


def from_steps(width: int, steps: bytes) -> np.ndarray:
    return np.append(0, np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64))


def store_prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, and the count at every prefix as `width` and `steps`, of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("width", pa.int32()), ("steps", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for rows in rows_of(batch):
                found = [(doc_id, len(text.encode()), *as_steps(own.prefixes(text)[0])) for doc_id, text in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)],
                    schema=schema,
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, width int, steps binary")


def answer_budget(stored: DataFrame, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and the characters that fit the limit, from stored prefix counts."""
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_(), "n_chars_within": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch):
                found = []
                for doc_id, n_bytes, width, steps in rows:
                    prefixes = from_steps(width, steps)
                    total = int(prefixes[-1])
                    found.append((doc_id, n_bytes, total, total > limit, longest_within(prefixes, limit)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds.values(), strict=True)],
                    names=list(kinds),
                )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chars_within long"
    return stored.select("doc_id", "n_bytes", "width", "steps").mapInArrow(run, schema)


def tokens_of_beginnings(stored: DataFrame, n_chars: str) -> DataFrame:
    """The rows with `n_tokens_cut`: the count of the text cut after so many characters, a column of `stored`; the whole text's if it is shorter."""
    names = stored.columns
    width, steps, size = names.index("width"), names.index("steps"), names.index(n_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 4_000_000, 256):
                columns = [part.column(i).to_pylist() for i in (width, steps, size)]
                found = []
                for one, many, cut in zip(*columns, strict=True):
                    prefixes = from_steps(one, many)
                    found.append(None if cut is None else int(prefixes[min(max(cut, 0), len(prefixes) - 1)]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int64())], names=[*names, "n_tokens_cut"])

    return stored.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in stored.dtypes) + ", n_tokens_cut long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_budget(
        settled(store_prefix_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")), "prefix_counts")
    )
