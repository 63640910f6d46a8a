import pyarrow as pa

import corpus_pipeline


def test_stages_run_python_on_small_batches(spark, monkeypatch):
    """A split of texts in one batch, in the JVM and in each worker, took an executor beyond its memory."""
    seen = []

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["bytes"])

    def components(docs):
        seen.extend(r[0] for r in docs.select("text").mapInArrow(sizes, "bytes long").collect())
        return docs.select("doc_id", docs["doc_id"].alias("component_id"))

    monkeypatch.setattr(corpus_pipeline.jaccard_join, "jaccard_join", components)
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('a', 4000) as text").coalesce(1)
    before = spark.conf.get(corpus_pipeline.BATCH) if hasattr(corpus_pipeline, "BATCH") else None
    assert dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").count() == 4000
    assert max(seen) < 5_000_000 and spark.conf.get(corpus_pipeline.BATCH) == before
