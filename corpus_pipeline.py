"""The documents through five text operators, each stage written and read again.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows it is given; all but the last return the columns of
``docs``.  Nulls, empty texts, repeated rows and further columns are handled as the stage's operator states.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from stridelake.llm import decontaminate, jaccard, pieces, secrets, toxicity
from stridelake.llm.queries import table, tokenizer_file
from stridelake.sources.folders import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word n-grams with a similarity of 0.8 or more, that of the smallest id stays."""
    return jaccard.keep_one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mark_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in ``text`` are replaced by a mark, and ``n_chars`` follows."""
    marked = secrets.redact(docs)
    return marked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else marked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, the byte span of every piece in the text (starts, ends), n_tokens, and the text decoded from the ids."""
    return pieces.encoded(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mark_secrets),
    ("sentencepiece", encode),
]

#: The first stage is a fitted model, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
