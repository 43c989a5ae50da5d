"""Registered queries of the subpackage and the pipeline."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import difference, duck

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op6_url_filters", "op8_exact_topk", "op10_quality_rules", "op12_filter_audit"])
def test_queries_match_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), duck(SF).sql(entry.oracle_sql()[name])) is None


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces.doc_id) == {r[0] for r in docs.select("doc_id").collect()}
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
    assert len(corpus_pipeline.run(spark, SF).toPandas()) == len(pieces)
