"""The corpus pipeline: what is kept for training, packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept.  All but the last return the columns of documents, extra ones of any name too; the
last returns a slot in a packed sequence for every piece of every document.

Of odd rows: texts that are null, empty or without a word are rejected by the first stage
(and would be by the second); null ids and null
languages are kept as they are; repeated rows are one row after the third; texts of any
length count in full; an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import classifier, decontam, neardup, packing, rules, shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose characters and words are like those of their language, the null language one of them.

    Rows without a word go; each other row is judged by itself, short ones by their length's rules alone.
    """
    return rules.passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones, fitted on the labels of those still here.

    Rows without a token go; equal texts are judged alike, whatever their ids; without labels all others stay.
    """
    return classifier.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the least id, null last, then the least text hash.

    Repeated rows are copies, null ids take part, and rows without a word all stay.
    """
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no long run of words with a benchmark item: each row by its own text, whatever its id."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The slot of every piece of every document; texts without a token take none, repeated rows one each."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier's network and the signatures are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
