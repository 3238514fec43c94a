"""The stages on a small table with the odd cases of the contract, one after another and on an empty table."""

import random

import corpus_pipeline
from quillon.llm.common import stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shards string, key string, component_id string, __doc string"


def tables(spark, path, rows, benchmark, labels):
    spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def stages(spark, path):
    """What each stage returns, as it is read again."""
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, path), "stage")
        out.append(docs)
    return out


def test_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, item = text(80), text(12)
    near = base.rsplit(" ", 1)[0] + " other"
    rows = [(1, base, "en", "a", 0), (2, near, "en", "a", 0), (3, base, "en", "b", 0), (4, None, "en", "b", 0), (5, "", "en", "b", 0), (6, f"{text(20)} {item} {text(20)}", "en", "a", 0), (7, text(50), "en", None, 0)]
    rows += [(8, text(50), "en", None, 0), (8, text(50), None, "b", 0), (None, text(40), "en", "a", 0), (10, "w1 " * 30_000, "en", "a", 0), (11, text(60), "en", "a", 0), (11, rows[0][1], "en", "a", 0)]
    path = tables(spark, tmp_path / "odd", rows, [(1, item), (2, None), (None, "w1")], [])
    quality, joined, clean, mixed, encoded = stages(spark, path)
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    assert all(d.columns == [c.split()[0] for c in COLUMNS.split(", ")] for d in (quality, joined, clean, mixed))
    assert quality.count() == len(rows)
    # of the copies 1, 2 and 3 one stays; rows that share an id are one document, and 11 is a copy of 1
    assert ids(joined) == [(False, i) for i in (1, 4, 5, 6, 7, 8, 10)] + [(True, 0)]
    kept = {i for _, i in ids(joined)}
    assert not kept & {2, 3}
    assert {i for _, i in ids(clean)} == kept - {6}
    assert {i for _, i in ids(mixed)} <= kept - {6} and mixed.count() > 0
    assert encoded.count() == mixed.count() and encoded.where("n_tokens < 1").count() == 0


def test_empty_tables(spark, tmp_path):
    path = tables(spark, tmp_path / "empty", [], [], [])
    assert [d.count() for d in stages(spark, path)] == [0] * 5


def test_stages_begin_without_garbage(spark, tmp_path):
    """Each stage has the JVMs of the executors, here the driver's, collect what the stages before it have left."""
    path = tables(spark, tmp_path / "small", [(1, "a b c", "en", "a", 0)], [], [])
    docs = spark.read.parquet(f"{path}/documents.parquet")

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    for _, stage in corpus_pipeline.STAGES:
        before = collections()
        stage(spark, docs, path)
        assert collections() > before
