"""The corpus pipeline: five stages from the documents table to token files.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of documents. Its
result is written as Parquet and read again as the documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reachspark.llm import importance, jaccard, mixing, templates, token_files
from reachspark.llm.queries import new_folder, read, tokenizer_path
from reachspark.session import cut


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go."""
    return importance.keep_sampled(docs, read(spark, sf_dir, "labels"))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by 5-word shingles at a Jaccard similarity of 0.8."""
    return jaccard.one_per_component(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return templates.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the weights 5, 2, 1 of their sources ask, three times at most."""
    return mixing.draw(mixing.mix(docs, (5, 2, 1), 3))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; returns their digest by document."""
    path = new_folder(spark)
    token_files.write_token_files(docs, tokenizer_path(), path)
    return token_files.digest(token_files.read_token_files(spark, path))


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]

#: The classifier and the tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
