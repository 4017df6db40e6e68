import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, DIR)
        if name != "sharding":
            assert got.columns == docs.columns
        got.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "mixing" or after.count() <= docs.count()
        docs = after


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0
