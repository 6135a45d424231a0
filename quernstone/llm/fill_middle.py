"""Fill-in-the-middle: texts cut at two token borders and put in another order, a batch of rows at a time in numpy.

The kernel works on the bytes of a whole Arrow batch at once. A table of 256 entries gives every byte its class (white
space, inside a code point, the rest). A mask over adjacent bytes marks where tokens end: a word's last byte before white
space, and the last byte of each text. Its running sum, started anew at each text, counts tokens, and one search in that
sum finds the cuts of all rows together. Code points are counted by a second sum in the same way. The parts of all
outputs are then copied from the batch's bytes.

A token is white space and the word after it, or white space at the end of a text. Cuts are the smaller and the larger of
two hashes of the row's id, modulo one more than the number of tokens; a third hash decides whether a text is transformed
and a fourth in which order. Hashes come from SHA-256 of the seed and the id, so they stay the same on any cluster.

Rows need no others, so there is no shuffle. A batch has at most BATCH_BYTES of text, or one row; the sums take nine bytes
for each byte of text.

Cases: null text is empty and stays plain; so does a text that holds one of the marks; a null id is hashed as an empty
one; rows with equal ids are cut by the same hashes, each its own text; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, texts_of

SEED = 42
RATE, SPM_SHARE = 50, 80  # percent of the texts that are transformed, and of these in the order suffix, prefix, middle
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BATCH_BYTES = 4_000_000
SPACE, INSIDE = 1, 2
#: Class of each byte: the six ASCII white-space characters, bytes inside a code point, the rest.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASSES[0x80:0xC0] = INSIDE
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}


def hashes(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first 8-digit groups of the SHA-256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts, and where each text starts, the end of the last one after them."""
    wide = texts.cast(pa.large_string())
    _, places, data = wide.buffers()
    ends = np.frombuffer(places, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return held, ends - ends[0]


def running(marks: np.ndarray) -> np.ndarray:
    """How many marks come before each place, and before the end."""
    out = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=out[1:])
    return out


def cut_rows(held: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all texts of a batch: number of tokens, the bytes at which prefix and middle end, and their code points."""
    starts, ends = at[:-1], at[1:]
    kinds = CLASSES[held]
    space = kinds == SPACE
    closes = np.zeros(len(held), bool)
    closes[:-1] = ~space[:-1] & space[1:]  # the mask over adjacent bytes
    closes[ends[ends > starts] - 1] = True
    tokens, points = running(closes), running(kinds != INSIDE)
    before = tokens[starts]
    n = (tokens[ends] - before).astype(np.int64)
    cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    # the first place with so many closed tokens before it, those of earlier texts put aside
    first, second = np.maximum(starts, np.searchsorted(tokens, before + cuts))
    chars = points[np.stack([first, second])] - points[np.stack([starts, first])]
    return n, first, second, chars[0], chars[1]


def marked(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text holds one of the marks."""
    found = np.zeros(len(at) - 1, bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        hits = np.flatnonzero((held[:-2] == mark[0]) & (held[1:-1] == mark[1]) & (held[2:] == mark[2])) if len(held) > 2 else np.empty(0, int)
        of = np.searchsorted(at, hits, "right") - 1
        found[of[hits + 3 <= at[of + 1]]] = True
    return found


def transformed(held: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray, forms: np.ndarray) -> pa.Array:
    """The outputs of a batch, copied part by part."""
    whole, out = held.tobytes(), []
    for form, start, one, two, end in zip(forms.tolist(), at[:-1].tolist(), first.tolist(), second.tolist(), at[1:].tolist(), strict=True):
        if form == "plain":
            out.append(whole[start:end])
        else:
            parts = (whole[start:one], whole[one:two], whole[two:end])
            out.append(b"".join(mark + parts[i] for mark, i in ORDERS[form]))
    return pa.array(out, pa.binary()).cast(pa.string())


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM_SHARE) -> DataFrame:
    """The key, n (tokens), form, prefix_chars and middle_chars (null if plain), and the output, of every whole text."""
    rows = texts_of(docs, key, text).select(F.col(key), F.col(text), *(h.alias(f"h{i}") for i, h in enumerate(hashes(F.col(key), seed), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, BATCH_BYTES):
                held, at = bytes_of(part.column(1))
                h1, h2, h3, h4 = (part.column(i).to_numpy() for i in range(2, 6))
                n, first, second, prefix, middle = cut_rows(held, at, h1, h2)
                plain = (n == 0) | (h3 % 100 >= rate) | marked(held, at)
                forms = np.where(plain, "plain", np.where(h4 % 100 < spm, "spm", "psm"))
                columns = [part.column(0), pa.array(n), pa.array(forms, pa.string())]
                columns += [pa.array(x.astype(np.int64), mask=plain) for x in (prefix, middle)]
                columns.append(transformed(held, at, first, second, forms))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = dict(docs.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: marks are in no text that is transformed, so the first of each is the cut's."""
    upto = lambda s, mark: F.call_function("substring_index", s, mark, F.lit(1))
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    one = upto(rest, F.when(form == "psm", SUFFIX.decode()).otherwise(PREFIX.decode()))
    rest = F.substr(rest, F.length(one) + len(PREFIX) + 1)
    two = upto(rest, F.lit(MIDDLE.decode()))
    middle = F.substr(rest, F.length(two) + len(PREFIX) + 1)
    prefix, suffix = F.when(form == "psm", one).otherwise(two), F.when(form == "psm", two).otherwise(one)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: Tokens are cut with DuckDB's expressions, the form and both digests follow from the same hashes.
OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as x from documents),
k as (select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as p, ('0x' || x[1:8])::bigint as h1,
  ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d),
c as (select *, len(p) as n, least(h1 % (len(p) + 1), h2 % (len(p) + 1)) as a, greatest(h1 % (len(p) + 1), h2 % (len(p) + 1)) as b from k),
f as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
  when h4 % 100 < 80 then 'spm' else 'psm' end as form, array_to_string(p[1:a], '') as pre, array_to_string(p[a+1:b], '') as mid,
  array_to_string(p[b+1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end
  as middle_chars, sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
  else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from f
"""
