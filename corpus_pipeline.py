"""The corpus pipeline: five stages over `documents`, each one of the operators in sparvane.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparvane.llm import decontamination, mixing, simhash, token_output, toxicity
from sparvane.llm.common import read, scratch, shared_path
from sparvane.llm.queries import tokenizer_path
from sparvane.shared import remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below a half; the model is learnt from this stage's documents and their labels."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model, 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links connect."""
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontamination.uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mixing.mixture(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document, what the written token files hold."""
    return token_output.read_tokens(spark, token_output.write_tokens(docs, tokenizer_path(), end_id=2))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: hashes, learnt scores and entropy coding are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's intermediate tables are deleted once its output is written, and so is the output before it."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
