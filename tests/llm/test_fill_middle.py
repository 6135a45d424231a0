"""Fill-in-the-middle against plain Python, on marks, all kinds of white space and batches of every size."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from quernstone.llm import fill_middle as fim

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = " ".join(f"wörd{i}" for i in range(40_000)) + "\n"
TEXTS = ["", None, " \n", "one", " lead", "trail \t", "a <P> b", "<S>", "x<M>", "< P>", "<P", "<", "é 漢字 🙂 b\x0bc\x1cd", LONG, "same", "same"]


def expected(key, text):
    """What the contract says, token by token."""
    text = text or ""
    parts = TOKENS.findall(text)
    hexes = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    pre, mid, suf = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, len(parts), "plain", None, None, text
    if h[3] % 100 < 80:
        return key, len(parts), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return key, len(parts), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_outputs_are_those_of_plain_python(spark):
    rng = random.Random(5)
    letters = "ab<>PSM \t\n\r\x0b\x0c\x1c é漢🙂"
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)] + [(None, "no id at all", 0, "y"), (3, "again", 0, "z")]
    rows += [(i, "".join(rng.choices(letters, k=rng.randrange(60))), 0, "") for i in range(100, 1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n int, form string").repartition(3)
    found = fim.fill_in_middle(table)
    assert Counter(map(tuple, found.collect())) == Counter(expected(k, t) for k, t, *_ in rows)
    assert {r.form for r in found.collect()} == {"plain", "spm", "psm"}
    back = found.select("doc_id", fim.restored(F.col("output"), F.col("form")))
    assert Counter(map(tuple, back.collect())) == Counter((k, t or "") for k, t, *_ in rows)
    assert fim.fill_in_middle(table.where("false")).count() == 0


def test_a_batch_and_its_slices_agree():
    texts = [t or "" for t in TEXTS]
    whole = pa.array(texts)
    h1, h2 = (np.array([i * k % 2**32 for i in range(len(texts))]) for k in (2654435761, 40503))
    together = fim.cut_rows(*fim.bytes_of(whole), h1, h2)
    for i in range(len(texts)):
        alone = fim.cut_rows(*fim.bytes_of(whole.slice(i, 1)), h1[i : i + 1], h2[i : i + 1])
        start = len("".join(texts[:i]).encode())
        assert [int(x[0]) for x in alone] == [int(x[i]) - start * (k in (1, 2)) for k, x in enumerate(together)]


def test_cuts_of_a_part_between_marks_are_restored(spark):
    """Prefixes that end like the start of a mark, and suffixes that start like its end."""
    rows = [(i, f"<P {'<' * (i % 4)} S> <S{' ' * (i % 3)}M> {i} <M") for i in range(400)]
    found = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=100, spm=50)
    assert {r.form for r in found.collect()} == {"spm", "psm"}
    assert sorted(map(tuple, found.select("doc_id", fim.restored(F.col("output"), F.col("form"))).collect())) == rows
