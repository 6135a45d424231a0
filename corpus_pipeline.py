"""A corpus from quality rules to packed sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import documents, settled
from quernstone.llm.neardup import keep_one_each
from quernstone.llm.packing import pack_documents
from quernstone.llm.quality import keep_good
from quernstone.llm.substrings import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id."""
    return keep_one_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that a document with a smaller id has go from the texts; n_chars follows the text."""
    out = remove_repeats(docs)
    return out if "n_chars" not in out.columns else out.selectExpr(
        *(f"cast(length(text) as {dict(out.dtypes)[c]}) as n_chars" if c == "n_chars" else f"`{c}`" for c in out.columns)
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left goes into sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The rules are learned and the ids are a tokenizer's: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
