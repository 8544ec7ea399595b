"""A training-corpus pipeline over the documents table; part of the subpackage quillstone.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.decontaminate import remove_leaks
from quillstone.llm.mixing import mix_sources
from quillstone.llm.neardup import remove_near_duplicates
from quillstone.llm.tokens import token_output
from quillstone.llm.toxicity import remainder, remove_toxic
from quillstone.session import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; labels are learnt from the rows that op3 learns from."""
    return remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(3) != 1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity of 0.8 or more."""
    return remove_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source to an equal share of the bytes; a document drawn n times is there n times."""
    return mix_sources(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in blocks, in ascending doc_id order; one row a document with its place and checksum."""
    # an executor still holds what the stages before have used of its heap, so its workers take small slices
    return token_output(docs, slice_bytes=2_000_000)


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token blocks", tokens),
]

#: The stages' models, signatures and tokenizer are beyond SQL; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
