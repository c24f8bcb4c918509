"""The pipeline's contract on a small table."""

import corpus_pipeline
from barloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    before = columns = docs.columns
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        assert docs.columns == columns == before, name
        assert 0 < docs.count() <= n
        n = docs.count()
    assert n < corpus_pipeline.table(spark, SF, "documents").count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == n
    assert corpus_pipeline.run(spark, SF).agg({"length": "sum"}).first() == pieces.agg({"length": "sum"}).first()


def test_registered_names():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
