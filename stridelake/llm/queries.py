"""The text operators on the test tables: one query per operator, and SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from stridelake.llm import decontaminate, jaccard, language, pieces, quality, ranked, secrets, simhash, statements, substrings, tokens, toxicity, urls, whitening
from stridelake.sources.folders import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of an installed public tokenizer; every node has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_frames")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokens.token_digest(docs, shared_folder(spark, "tokens"), tokenizer_file("byte_bpe_50k.json"))


@query("op2_jaccard_join", statements.JACCARD)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard.jaccard_groups(docs, n=3, similarity=Fraction(9, 10))


@query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(table(spark, folder, "documents"))


@query("op4_substring_dedup", statements.REPEATS)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeats(table(spark, folder, "documents"), window=13, digest=True)


@query("op5_url_filter")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return urls.url_verdicts(table(spark, folder, "pages"))


@query("op6_decontaminate", statements.HITS)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), size=10)


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_sentencepiece")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", pieces.piece_digest("text", tokenizer_file("piece_bpe_32k.model")).alias("__digest"))
    return docs.select("doc_id", *(F.col("__digest")[c].alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes")))


@query("op10_line_quality", statements.QUALITY)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


@query("op9_secret_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_spans(table(spark, folder, "documents"))


@query("op11_simhash_pivots")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"), n=3)


@query("op12_ranked_search", statements.RANKED)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), top=20)


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"), components=16, scale=64, offset=1_000_000)
