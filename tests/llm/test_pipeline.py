"""The pipeline's stages, one after the other, against what each is to do; and the queries that SQL can express."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import queries as corpus
from tests.duck import connect, same

FOLDER = "/root/testdata/sf0.001"


def judged_brute(spark, texts):
    """The base rule and the learned rules, one text after another."""
    from quernstone.llm import quality
    from tests.llm.test_small_cases import base_of, features_of

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rules = quality.learn(quality.labelled_statistics(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")))
    for i, text in texts:
        b, f = base_of(text or ""), features_of(text or "")
        if not (b[0] < 10 or 100 * b[4] > 20 * b[0] or any(rule.holds(f) for rule in rules)):
            yield i, text


def packed(rows, texts):
    """Pieces are those of the tokenizer's ids, each once, and sequences are full from 0 on and at most 2048 tokens long."""
    import zlib
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, held = Counter(), {}
    for i, text in texts:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            expected[i, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [at for at, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


def test_stages_on_repeated_rows_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = docs.where("doc_id < 40").withColumns({c: F.lit(7) for c in ("__row", "node", "key", "tag", "region", "kept", "n")})
    twice = some.unionByName(some)
    once = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        once[name] = [sorted(map(tuple, stage(spark, frame, FOLDER).collect()), key=repr) for frame in (some, twice)]
        single, double = once[name]
        assert double == sorted(single * 2, key=repr), name
    rows = corpus_pipeline.packing(spark, twice, FOLDER).collect()
    packed(rows, [(r.doc_id, r.text) for r in twice.collect()])


def test_stages(spark):
    from quernstone.llm.common import settled
    from tests.llm.test_small_cases import jaccard_brute, strike_brute

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, settled(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns and docs.schema == before.schema
        seen[name] = ([(r.doc_id, r.text) for r in before.collect()], [(r.doc_id, r.text) for r in docs.collect()])
    before, after = seen["quality"]
    assert sorted(after) == sorted(judged_brute(spark, before)) and 0 < len(after) < len(before)
    before, after = seen["near_dedup"]
    assert sorted(i for i, _ in after) == sorted(i for i, _, _, kept in jaccard_brute(before, 5) if kept)
    before, after = seen["substring_dedup"]
    expected = {i: n for i, _, n, _ in strike_brute(before)}
    texts = dict(before)
    for i, text in after:
        assert (text == texts[i]) if not expected[i] else len(text.split()) == len(texts[i].encode().split()) - expected[i]
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    packed(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect(), texts)


def test_stages_on_null_texts_and_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.where("doc_id < 20"))
    for frame in (some, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, FOLDER)
            assert name == "packing" or out.schema == docs.schema
            assert frame is some or out.count() == 0
    assert corpus_pipeline.packing(spark, some, FOLDER).count() >= some.count()
    assert corpus_pipeline.near_dedup(spark, some, FOLDER).where("text is null").count() == some.where("text is null").count()


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query(spark, name):
    same(corpus.queries()[name](spark, FOLDER), connect(FOLDER), corpus.oracle_sql()[name])
