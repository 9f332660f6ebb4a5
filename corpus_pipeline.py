"""A corpus pipeline of five of the operators: each stage reads what the one before it wrote.

No stage fails on nulls in any column, on empty or very long texts, repeated rows or other columns, which go; a table without rows gives one without rows.
Language ID drops null texts, empty ones and those without a letter, so that the stages after it have none; by themselves line dedup gives
a null text back as an empty one, the Jaccard join keeps it, the mix has no row for it, and packing gives it a sequence's end only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.llm.jaccard import linked
from trestle.llm.langid import learn, predict
from trestle.llm.linededup import drop_lines
from trestle.llm.mixing import mixed_documents
from trestle.llm.packing import packed_documents
from trestle.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't determined (no letter, or no language with half of the likelihood) go."""
    model = learn(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = predict(docs, model, COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*(f"row.{c}" for c in COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents hold stay in the first of them only; documents of which nothing is left go."""
    rest = [c for c in COLUMNS if c not in ("text", "n_chars")]
    found = drop_lines(docs, carry=[*rest, "n_chars"], min_docs=10, keep_first=True)
    found = found.where((F.col("n_dropped") == 0) | (F.trim("kept") != ""))
    text = found.select("row.*", F.col("kept").alias("text"), "n_dropped")
    return text.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of a similarity of 0.8 in words of five connect, the one with the smallest id stays, with all rows of that id. Rows with a null id stay."""
    kept = linked(docs, words=5, percent=80).where("component_id = doc_id").select(F.col("doc_id").alias("kept")).distinct()
    stay = docs.where("doc_id IS NOT NULL").join(kept, F.col("doc_id") == F.col("kept"), "left_semi")
    return stay.unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row for each pass that takes words of a document."""
    return mixed_documents(docs.select(*COLUMNS), block=64, shard=8192).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens. A document of more tokens is cut; each row of the mix is a document of its own."""
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=1024)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("packing", pack)]

#: The language model has no form in SQL; the tests follow each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
