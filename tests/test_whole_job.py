"""Model queries take the whole table they are named for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import explain
from terrane.plans import models
from terrane.plans.registry import QUERIES, Tables


def test_embeddings_are_whole(spark, small):
    d, cols = models._emb(Tables(spark, small))
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()], dtype=float)
    assert len(cols) == x.shape[1] == 64
    assert np.array_equal(np.array([list(r) for r in d.orderBy("id_").select(*cols).collect()]), x)


def test_queries_use_a_late_coordinate(spark, tmp_path):
    """Only the last coordinate tells the classes apart."""
    r = np.random.default_rng(0)
    x = r.normal(0, 0.1, (200, 12))
    x[:, 11] += np.where(np.arange(200) % 10 < 5, -1, 1)
    spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda q: QUERIES[q](spark, str(tmp_path)).collect()
    assert {row["feature"]: row["importance"] for row in run("cart_importance")} == {"e11": 1.0}
    importance = {row["feature"]: row["mean"] for row in run("perm_importance")}
    assert len(importance) == 12 and importance["e11"] > 0.2 and all(v == 0 for f, v in importance.items() if f != "e11")


def test_importance_of_one_shuffle(spark):
    """Permuting all columns at once gives what permuting each by itself gives."""
    d = spark.range(150).select("id", F.rand(1).alias("x"), F.rand(2).alias("z")).withColumn("y", 2 * F.col("x") + F.col("z")).cache()
    score = lambda s: s.agg(F.avg(F.abs(2 * F.col("x") + F.col("z") - F.col("y")))).first()[0]
    got = explain.importance(d, "id", {"x": ["x"], "z": ["z"]}, score, repeats=1)
    for c in ("x", "z"):
        assert got[c][0] == pytest.approx(score(explain.permuted(d, "id", [c], 42)) - score(d))


def test_queries_read_the_lines(spark, tmp_path):
    """The target of these lines follows from the quantity alone."""
    n = 400
    spark.range(n).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "cast(1 + id % 4 AS double) AS l_quantity", "0.01D * (id % 3) AS l_discount", "0.01D * (id % 5) AS l_tax", "exp(1 + id % 4) AS l_extendedprice", "timestamp '2000-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["boosting_fit"](spark, str(tmp_path)).first()
    assert got["rmse_0"] == pytest.approx(np.std([0, 1, 2, 3]), abs=1e-6) and got["rmse_4"] == pytest.approx(got["rmse_0"] * 0.7**4, abs=1e-6)
    best = [r for r in QUERIES["ridge_select"](spark, str(tmp_path)).collect() if r["best"]]
    assert len(best) == 1 and best[0]["rmse"] < 0.1
    band = QUERIES["oob_conformal"](spark, str(tmp_path)).first()
    assert abs(band["lo"]) < 1e-9 and abs(band["hi"]) < 1e-9
