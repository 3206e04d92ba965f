"""A corpus made ready for training: toxic documents go, one of each group of near-duplicates stays, secrets are blotted
out, and what is left is packed into sequences.

In every stage a null text counts as empty and stays null, rows with empty texts or null ids are kept, repeated rows are
told apart where a stage keeps one of a group, an empty table gives an empty one, and a very long text is taken whole.
Columns beside those of documents are left out, so that none can clash.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it again as the next stage's docs.  SQL cannot express the trained classifier, so there is no ORACLE_SQL; the
tests hold the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import near_dup, packing, secrets, toxicity
from concordia.llm.common import DOC_COLUMNS, merged, table, tokenizer_path, written

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of rows that aren't held out, doesn't call toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(merged(docs.select(*DOC_COLUMNS)), model).where(F.col("predicted") == 0).select(*DOC_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more."""
    return near_dup.drop_near_duplicates(docs.select(*DOC_COLUMNS), words=5, percent=80)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret replaced by a mark; n_chars follows the text."""
    return secrets.redact(docs.select(*DOC_COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", blot_secrets), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
