"""Every stage of the pipeline, and the whole, over nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("cases")
    text = dict((i, t) for i, t, _ in rows)
    spark.createDataFrame([(1, " ".join(text[10].split()[5:25]), 7), (2, None, 7), (3, "", 7)], "item_id long, text string, pos int").write.parquet(str(path / "benchmark.parquet"))
    return path


def test_stages_keep_columns_and_rows_of_hard_documents(spark, docs, folder):
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, str(folder))
        assert out.columns == docs.columns, name
        kept = out.collect()
        before = {r.doc_id for r in given.select("doc_id").collect()}
        assert 0 < len(kept) <= given.count() and {r.doc_id for r in kept} <= before
        assert {tuple(r)[5:] for r in kept} == {("r", 1, 2, 3.0, "x", "y", 7, 8)}
        given = spark.createDataFrame(kept, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, given, str(folder)).collect()
    assert len(last) == given.count() and not any(r.n_tokens is None for r in last)


def test_empty_tables_stay_empty(spark, empty, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(folder)).count() == 0, name
    path = folder / "none"
    empty.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(path)).count() == 0


def test_the_whole_equals_its_stages_one_by_one(spark, docs, folder):
    docs.write.mode("overwrite").parquet(str(folder / "documents.parquet"))
    given = spark.read.parquet(str(folder / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        given = spark.createDataFrame(stage(spark, given, str(folder)).collect(), docs.schema)
    want = corpus_pipeline.STAGES[-1][1](spark, given, str(folder))
    got = corpus_pipeline.run(spark, str(folder))
    both = [sorted(map(str, x.select(*sorted(x.columns)).collect())) for x in (want, got)]
    assert both[0] == both[1] and got.where(F.col("doc_id").isin(6, 7)).count() <= 1
