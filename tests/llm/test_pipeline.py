"""The pipeline against brute force, stage by stage, and on rows that are hard to handle."""

from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import quality, simhash
from tests.llm.test_ops import HARD, _components, base_secrets, scan, windows


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"]: r["text"] for r in steps["quality_rules"](spark, docs, small).collect()}
    assert set(kept) == {r["doc_id"] for r in quality.report(docs).where("kept").collect()}
    d = docs.where(F.col("doc_id").isin(list(kept)))
    fps = {i: simhash.fingerprint(t) & ((1 << 64) - 1) for i, t in kept.items()}
    assert {r["doc_id"] for r in steps["near_dedup"](spark, d, small).collect()} == set(_components(fps).values())
    wins = windows([(r["item_id"], r["text"]) for r in bench.collect()])
    clean = {i for i, t in kept.items() if not ((s := scan(t, wins))[1] and 20 * s[1] >= s[0])}
    assert {r["doc_id"] for r in steps["decontamination"](spark, d, small).collect()} == clean
    for r in steps["secret_scans"](spark, d, small).collect():
        spans = base_secrets(kept[r["doc_id"]])
        assert (r["text"] == kept[r["doc_id"]]) == (not spans) and not base_secrets(r["text"])
        assert r["n_chars"] == len(r["text"]) or not spans
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, small).columns == docs.columns, name


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and all(r["offset"] + r["length"] <= 2048 for r in rows)


def test_hard_rows(spark, small):
    d = spark.createDataFrame(HARD, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, small).count() >= 0, name
        assert stage(spark, d.limit(0), small).count() == 0, name
