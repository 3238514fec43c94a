"""Registered queries against their SQL, and the pipeline's stages against their contracts, on the smallest tables."""

import duckdb
import pytest

from quillon.llm import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect()) == sorted(repr(tuple(map(plain, r))) for r in found.fetchall())


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF).checkpoint()
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == first.columns, name
        if i < 3:
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] == sizes[5] > 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in docs.collect())
