import corpus_pipeline


def test_every_stage_passes_small_batches(spark):
    """With ten thousand texts to a batch the pipeline took more than its memory on 0.51 GB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    try:
        for stage in (corpus_pipeline.keeping_names(lambda spark, docs, sf_dir: docs), corpus_pipeline.packed):
            spark.conf.set(name, "10000")
            stage(spark, docs, "")
            assert int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)
