"""Registered text queries: those with SQL against DuckDB, the pipeline against the operators one by one."""

import pytest

import corpus_pipeline
from checks.compare import difference, expected_rows, oracle_connection
from opsloom.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_equals_oracle(spark, name):
    expected = expected_rows(oracle_connection(SMALL), queries.ORACLES[name])
    assert difference(queries.QUERIES[name](spark, SMALL), expected) is None


def test_pipeline_filters_take_effect(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    step, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        step = spark.createDataFrame(stage(spark, step, SMALL).collect(), step.schema)
        assert step.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = [r["doc_id"] for r in step.collect()]
    assert len(good & set(seen["quality"])) >= 0.95 * len(good) and len(bad & set(seen["quality"])) <= 0.2 * len(bad)
    texts = {}
    for i in seen["quality"]:
        texts[docs[i]["text"]] = max(i, texts.get(docs[i]["text"], -1))
    assert sorted(seen["exact"]) == sorted(texts.values())
    assert set(seen["near"]) <= set(seen["exact"]) and set(seen["mixing"]) <= set(seen["near"])
    assert max(seen["mixing"].count(i) for i in set(seen["mixing"])) <= 3


def test_pipeline_result(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"] and not got.isEmpty()
