"""The corpus pipeline: documents through five stages, each one of the corpus operators.

toxicity: documents that the model marks toxic go. near_duplicates: one document of each group stays. decontamination: documents
that hold a benchmark passage go. mixing: the mix is cut to the target weights, a document for each pass in which words of it
are taken. token_output: what is left is written as token-id files, and read back as one digest row per document.

Every stage works on all that its predecessor kept. Labels and benchmark are those of sf_dir; a null or empty text, repeated
rows, null columns and further columns pass as each operator's docstring says. run() writes each stage's result to
the shared folder and reads it again for the next; a stage's folder goes when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, mixing, ngram_join, token_output, toxicity
from tidemark.llm._spark import fresh_path, remove, table
from tidemark.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels train the model, as in the operator's own query; every document is judged by its text alone."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_digest(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: trained models, similarity components and token ids have no SQL form; the stages are tested one by one
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
