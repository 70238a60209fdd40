"""Every registered text query on whole tables, against its SQL twin or for the rows that it must give."""

import pytest
from oracle import compare, connect

from corpus_pipeline import STAGES, run
from gridscan.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLE:
        assert compare(spark, connect(sf), sf, QUERIES[name], ORACLE[name]) is None
    else:
        least = spark.read.parquet(f"{sf}/documents.parquet").count()
        assert QUERIES[name](spark, sf).count() >= least


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    out = run(spark, sf)
    ids = out.select("doc_id").distinct()
    assert 0 < ids.count() < docs.count() and ids.join(docs, "doc_id", "left_anti").count() == 0
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
