"""The text queries as registered, and the pipeline against its stages' own rules."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from stridelake.llm import decontaminate, jaccard  # noqa: E402
from stridelake.llm.queries import QUERIES  # noqa: E402


def test_every_operator_is_registered(registered):
    queries, _ = registered
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in queries)] == [] and "pipeline" in queries
    assert set(QUERIES) <= set(queries)


def test_stages(spark, folder, tmp_path):
    docs = before = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        if name == "ngram_jaccard_join":
            groups = jaccard.jaccard_groups(before)
            assert sorted(ids) == sorted(r.doc_id for r in groups.where("doc_id = component_id").collect())
        if name == "benchmark_decontamination":
            found = decontaminate.contamination(before, spark.read.parquet(f"{folder}/benchmark.parquet"))
            assert sorted(ids) == sorted(r.doc_id for r in found.where("not contaminated").collect())
        if name == "secret_scan":
            assert len(ids) == before.count()
            assert docs.where("n_chars <> length(text)").count() == 0
    row = docs.where("n_tokens > 0").first()
    assert len(row.ids) == row.n_tokens == len(row.starts) == len(row.ends)


def test_pipeline_takes_awkward_rows(spark, folder):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "x y", None, None, None), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            rows = spark.createDataFrame(stage(spark, rows, folder).collect(), stage(spark, rows, folder).schema)
        assert rows.columns == ["doc_id", "ids", "starts", "ends", "n_tokens", "decoded"]
