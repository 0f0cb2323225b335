import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert kept and kept <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, DATA).collect()
    starts = {}
    for r in packed:
        starts.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in starts.values():
        assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))]
        assert sum(n for _, n in v) <= 2048
