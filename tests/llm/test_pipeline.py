"""The pipeline's stages on their own input, and what is left of planted documents."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from kondate.llm import queries


def test_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] == list(queries.queries())
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(90_001, base, "en", "x", 1), (90_002, base.replace(" ", "\n"), "en", "x", 1), (90_003, base.replace("word77", "other"), "en", "x", 1), (90_004, None, None, None, None), (90_005, "", "en", "x", 0), (90_006, "%%% 123 ###", "en", "x", 9), (90_007, None, "en", "x", 0), (90_008, "the and of it was that with this from " * 20_000, "en", "x", 1), (90_001, base, "en", "x", 1)]
    start = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    extra = ("_id", "id", "row", "dropped_id", "_tokens", "_topic", "weight", "probability", "_digest", "n", "scores", "host", "leader", "elements")
    start = start.withColumns({c: F.lit(f"my {c}") for c in extra})
    seen, at = {}, start
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, data).persist()
        seen[name] = Counter(r["doc_id"] for r in at.select("doc_id").distinct().collect())
        if name != "packing":
            assert at.columns == start.columns
            assert at.where(" or ".join(f"{c} <> 'my {c}'" for c in extra)).count() == 0
    assert {90_004, 90_005, 90_006, 90_007} & seen["language_id"].keys() == set()
    assert 90_008 in seen["ngram_jaccard"]
    assert {r[0] for r in docs.select("doc_id").collect()} <= seen["language_id"].keys()
    assert {90_001, 90_002, 90_003} & seen["exact_dedup"].keys() == {90_001, 90_003}
    assert {90_001, 90_003} & seen["ngram_jaccard"].keys() == {90_001}
    assert seen["packing"].keys() == seen["mixing"].keys() < seen["ngram_jaccard"].keys()


def test_stages_of_an_empty_table(spark, data):
    at = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, data)
        assert at.count() == 0


@pytest.mark.parametrize("name", ["pipeline"])
def test_run(spark, data, name):
    assert __spark_entry__.queries()[name](spark, data).count() > 0
