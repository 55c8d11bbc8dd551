import inspect

import corpus_pipeline
from hirelake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)


def test_stages_keep_columns_and_drop_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, rows = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        left = docs.count()
        assert 0 < left <= rows, name
        if name != "shards":
            assert docs.columns == names
        rows = left
    assert "shard" in docs.columns
