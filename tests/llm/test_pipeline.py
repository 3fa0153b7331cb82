"""The pipeline's stages take effect on small tables."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == corpus_pipeline.COLUMNS, name
        out = out.cache()
        if name == "pii":
            assert out.count() == docs.count() and out.filter(F.col("text").rlike(r"[0-9a-z]@mail[0-9]")).count() == 0
        elif name != "mixing":
            assert out.count() <= docs.count() and out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and last.filter("n_tokens = 0 AND length(text) > 0").count() == 0


def test_odd_documents(spark):
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13), (None, "x y", None, None, 3)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, toxicity double")
    now = docs
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "/root/testdata/sf0.001").cache()
        left[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in now.select("doc_id").collect())
    # Documents without text or words stay once in every stage, rows of one id stay together, and nothing else comes.
    for name in left:
        assert left[name].count((False, 1)) == left[name].count((False, 2)) == 1, name
    for name in ("toxicity", "near_duplicates", "pii"):
        assert left[name].count((False, 3)) in (0, 2) and left[name].count((True, 0)) == 1, name
    assert left["bpe"] == left["mixing"] and set(left["mixing"]) <= {(False, 1), (False, 2), (False, 3), (True, 0)} and len(left["mixing"]) <= 3 * len(rows)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "/root/testdata/sf0.001")
    assert none.count() == 0
