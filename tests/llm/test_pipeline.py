import corpus_pipeline as p


def test_stages_keep_columns_and_rows_shrink(spark, sf, documents):
    docs = documents
    for name, stage in p.STAGES[:-1]:
        new = stage(spark, docs, sf)
        assert new.columns == documents.columns
        rows = new.collect()
        assert 0 < len(rows) <= docs.count()
        docs = spark.createDataFrame(rows, documents.schema)
    assert p.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == len(rows)


def test_run(spark, sf):
    assert p.run(spark, sf).count() > 0
