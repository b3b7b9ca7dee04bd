"""Queries of the models: exact where one step or one split has a SQL form, fitted models besides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import fixed
from terrane.operators import encode, explain, linear, stats, svm, tree
from terrane.plans.registry import Tables, iterated, query
from terrane.sources import synthetic

#: What the SQL reads of the embeddings; label below 5 is class 0. The queries take all coordinates.
EMB_SQL = "SELECT vec_id AS id_, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(8)) + ", CAST(CASE WHEN label < 5 THEN 0 ELSE 1 END AS INT) AS y FROM embeddings"


def _emb(t: Tables) -> tuple[DataFrame, list[str]]:
    """(id_, a column e0, e1, ... for each coordinate of the longest vector, y), and the names of those columns."""
    d = t.embeddings
    dims = d.agg(F.max(F.size("embedding"))).first()[0] or 0
    cols = [f"e{i}" for i in range(dims)]
    return iterated(d.select(F.col("vec_id").alias("id_"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)), F.when(F.col("label") < 5, 0).otherwise(1).alias("y"))), cols


#: Distinct-valued, small features for one exact split.
CELLS = "SELECT o_orderkey AS id_, CAST(o_orderkey % 13 AS DOUBLE) AS a, CAST(o_custkey % 17 AS DOUBLE) AS b, CAST(CASE WHEN (o_custkey % 17) * 3 + o_orderkey % 5 > 24 THEN 1 ELSE 0 END AS INT) AS y, CAST(round(o_totalprice) AS DOUBLE) AS price FROM orders"


def _stump(criterion: str) -> str:
    if criterion == "mse":
        imp = lambda n, s, q: f"greatest(({q}) / ({n}) - pow(({s}) / ({n}), 2), 0)"
        cols, target = "sum(price - m) AS s, sum(pow(price - m, 2)) AS q", f"({CELLS}), (SELECT avg(round(o_totalprice)) AS m FROM orders)"
    elif criterion == "gini":
        imp = lambda n, s, q: f"1 - pow(({s}) / ({n}), 2) - pow(1 - ({s}) / ({n}), 2)"
        cols, target = "sum(y)::DOUBLE AS s, 0.0 AS q", f"({CELLS})"
    else:
        h = lambda p: f"CASE WHEN {p} > 0 THEN {p} * log2({p}) ELSE 0 END"
        imp = lambda n, s, q: f"-({h(f'(({s}) / ({n}))')}) - ({h(f'(1 - ({s}) / ({n}))')})"
        cols, target = "sum(y)::DOUBLE AS s, 0.0 AS q", f"({CELLS})"
    return f"""WITH x AS (SELECT * FROM {target}), l AS (SELECT 'a' AS f, a AS v, count(*)::DOUBLE AS n, {cols} FROM x GROUP BY a UNION ALL SELECT 'b', b, count(*)::DOUBLE, {cols} FROM x GROUP BY b),
c AS (SELECT f, v, lead(v) OVER w AS nx, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(n) OVER (PARTITION BY f) AS tn, sum(s) OVER (PARTITION BY f) AS ts, sum(q) OVER (PARTITION BY f) AS tq FROM l WINDOW w AS (PARTITION BY f ORDER BY v)),
g AS (SELECT f, (v + nx) / 2 AS threshold, {imp('tn', 'ts', 'tq')} - (n * ({imp('n', 's', 'q')}) + (tn - n) * ({imp('tn - n', 'ts - s', 'tq - q')})) / tn AS gain FROM c WHERE nx IS NOT NULL)
SELECT f AS feature, threshold, round(gain, {2 if criterion == 'mse' else 6}) AS gain FROM g ORDER BY round(gain, 10) DESC, f, threshold LIMIT 1"""


def _split(t: Tables, criterion: str) -> DataFrame:
    d = t.sql(CELLS, "orders")
    made = tree.grow(d, ["a", "b"], "price" if criterion == "mse" else "y", task="regression" if criterion == "mse" else "classification", criterion=criterion, max_depth=1)[0].nodes[0]
    return t.spark.createDataFrame([(made.feature, made.threshold, float(made.gain))], "feature string, threshold double, gain double").withColumn("gain", F.round("gain", 2 if criterion == "mse" else 6))


@query(_stump("gini"))
def cart_stump_gini(t: Tables) -> DataFrame:
    return _split(t, "gini")


@query(_stump("entropy"))
def cart_stump_entropy(t: Tables) -> DataFrame:
    return _split(t, "entropy")


@query(_stump("mse"))
def cart_stump_mse(t: Tables) -> DataFrame:
    return _split(t, "mse")


def _tree(d: DataFrame, cols: list[str], depth: int = 4) -> tree.Tree:
    return tree.grow(d, cols, "y", max_depth=depth, min_leaf=5)[0]


@query()
def cart_tree_predict(t: Tables) -> DataFrame:
    d, cols = _emb(t)
    m = _tree(d, cols)
    return d.select("id_", m.predict().alias("label"), F.round(m.probability(), 6).alias("p"), m.node_id().alias("leaf"))


@query()
def cart_truncated(t: Tables) -> DataFrame:
    """One deep fit gives the error of each depth."""
    d, cols = _emb(t)
    m = _tree(d, cols)
    return d.agg(*(F.round(F.avg((m.predict(k) != F.col("y")).cast("double")), 6).alias(f"error_{k}") for k in range(m.depth() + 1)))


@query()
def cart_importance(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(_tree(*_emb(t)).importances().items()), "feature string, importance double")


@query()
def saabas_factors(t: Tables) -> DataFrame:
    """Base and effects add up to the prediction."""
    d, cols = _emb(t)
    m = _tree(d, cols)
    parts = m.path_effects(cols)
    return d.select("id_", F.lit(m.value(m.nodes[0])[-1]).alias("base"), *(c.alias(f) for f, c in parts.items()), m.probability().alias("p"))


@query("SELECT 0 AS i, 0 AS j, round(sum(l_quantity * l_quantity), 2) AS v FROM lineitem UNION ALL SELECT 0, 1, round(sum(l_quantity * l_discount), 2) FROM lineitem UNION ALL SELECT 1, 1, round(sum(l_discount * l_discount), 2) FROM lineitem")
def gram_matrix(t: Tables) -> DataFrame:
    return linear.gram(t.lineitem, ["l_quantity", "l_discount"]).select("i", "j", F.round("v", 2).alias("v"))


@query("WITH c AS (SELECT l_quantity - avg(l_quantity) OVER () AS x, l_discount - avg(l_discount) OVER () AS z, l_extendedprice - avg(l_extendedprice) OVER () AS y FROM lineitem), s AS (SELECT sum(x * x) + 10 AS xx, sum(x * z) AS xz, sum(z * z) + 10 AS zz, sum(x * y) AS xy, sum(z * y) AS zy FROM c) SELECT round((xy * zz - zy * xz) / (xx * zz - xz * xz), 4) AS quantity, round((zy * xx - xy * xz) / (xx * zz - xz * xz), 4) AS discount FROM s")
def ridge_2d(t: Tables) -> DataFrame:
    m = linear.Ridge(10.0, ["l_quantity", "l_discount"]).fit(t.lineitem, "l_extendedprice")
    return t.spark.createDataFrame([(float(m.coef[0]), float(m.coef[1]))], "quantity double, discount double").select(F.round("quantity", 4).alias("quantity"), F.round("discount", 4).alias("discount"))


def _lines(t: Tables) -> DataFrame:
    """Every priced line: id_ (equal lines of an order share it), quantity, discount, tax, price and its logarithm."""
    d = t.lineitem.where("l_extendedprice > 0").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").alias("id_"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"))
    return iterated(d.withColumn("log_price", F.ln("price")))


#: Features of a line.
LINE = ["quantity", "discount", "tax"]


@query()
def ridge_select(t: Tables) -> DataFrame:
    """Every alpha from one Gram matrix."""
    d = encode.with_split(encode.with_strata(_lines(t), "price"), "id_")
    best, scores = linear.select_alpha(d.where("split = 'train'"), d.where("split = 'val'"), LINE, "log_price", fixed.RIDGE_ALPHAS)
    return t.spark.createDataFrame([(a, float(s), a == best) for a, s in scores.items()], "alpha double, rmse double, best boolean")


_CENTRES = [[10.0, 0.02], [25.0, 0.05], [40.0, 0.08]]
_D = ", ".join(f"pow(l_quantity - {a}, 2) + pow(l_discount - {b}, 2)" for a, b in _CENTRES)


@query(f"WITH d AS (SELECT l_quantity, l_discount, [{_D}] AS d FROM lineitem), k AS (SELECT *, list_position(d, list_min(d)) - 1 AS k FROM d) SELECT k::INT AS k, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount FROM k GROUP BY k")
def kmeans_lloyd_step(t: Tables) -> DataFrame:
    new, _ = linear.KMeans(["l_quantity", "l_discount"], 3).step(t.lineitem, _CENTRES)
    return t.spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(new)], "k int, quantity double, discount double").select("k", F.round("quantity", 6).alias("quantity"), F.round("discount", 6).alias("discount"))


@query()
def kmeans_fit(t: Tables) -> DataFrame:
    d, cols = _emb(t)
    m = linear.KMeans(cols, 4, n_init=1, max_iter=15).fit(d)
    return d.groupBy(m.predict().alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share"))


@query("SELECT " + ", ".join(f"round(covar_samp({a}, {b}), 6) AS {a}_{b}" for a, b in (("e0", "e0"), ("e0", "e1"), ("e1", "e2"), ("e7", "e7"))) + f" FROM ({EMB_SQL})")
def pca_covariance(t: Tables) -> DataFrame:
    n, _, g = linear.centred_gram(*_emb(t))
    v = [("e0_e0", 0, 0), ("e0_e1", 0, 1), ("e1_e2", 1, 2), ("e7_e7", 7, 7)]
    return t.spark.createDataFrame([tuple(float(g[i, j] / (n - 1)) for _, i, j in v)], ", ".join(f"{c} double" for c, _, _ in v)).select(*(F.round(c, 6).alias(c) for c, _, _ in v))


@query()
def pca_fit(t: Tables) -> DataFrame:
    d, cols = _emb(t)
    m = linear.PCA(cols, 3).fit(d)
    return m.transform(d).select("id_", "pc1", "pc2", "pc3")


@query(f"SELECT count(*) AS n, round(sum(2 * y - 1), 6)::DOUBLE AS bias, round(sum((2 * y - 1) * e0), 6) AS g0, round(sum((2 * y - 1) * e7), 6) AS g7 FROM ({EMB_SQL})")
def pegasos_fullbatch_step(t: Tables) -> DataFrame:
    d, cols = _emb(t)
    n, g, _ = svm.PegasosSVM(cols).gradient_sums(d, np.zeros(len(cols) + 1), "y")
    return t.spark.createDataFrame([(n, float(g[-1]), float(g[0]), float(g[7]))], "n long, bias double, g0 double, g7 double").select("n", "bias", F.round("g0", 6).alias("g0"), F.round("g7", 6).alias("g7"))


@query()
def pegasos_fit(t: Tables) -> DataFrame:
    d, cols = _emb(t)
    m = svm.PegasosSVM(cols, lam=0.01, steps=10, average=True).fit(d, "y")
    return d.select("id_", F.round(m.score(), 6).alias("score"), m.predict().alias("label"))


@query()
def pegasos_grid(t: Tables) -> DataFrame:
    return svm.fit_grid(*_emb(t), "y", "id_", [1e-4, 1e-3, 1e-2])


@query()
def svr_fit(t: Tables) -> DataFrame:
    d, cols = _emb(t)
    m = svm.PegasosSVR(cols[1:], lam=0.01, steps=10).fit(d, "e0")
    return m.tube(d, "e0").withColumn("inside", F.round("inside", 6))


@query()
def rff_kernel_error(t: Tables) -> DataFrame:
    d, cols = _emb(t)
    return svm.kernel_error(d, svm.FourierFeatures(cols, 512, 0.5), "id_")


@query()
def rff_svm_fit(t: Tables) -> DataFrame:
    """A classifier on Fourier features, and its share of right labels."""
    d, cols = _emb(t)
    m = svm.rff_svm(cols, 256, 0.5, lam=0.001, steps=15, average=True).fit(d, "y")
    return m.transform(d).select("id_", F.round(m.model.score(), 6).alias("score"), m.model.predict().alias("label"))


@query()
def rff_svr_fit(t: Tables) -> DataFrame:
    d = _lines(t).withColumns({c: F.col(c) / s for c, s in (("quantity", 50.0), ("discount", 0.1), ("tax", 0.08))})
    m = svm.rff_svr(LINE, 64, 1.0, lam=1e-4, steps=20).fit(d, "log_price")
    return m.transform(d).agg(F.round(F.sqrt(F.avg(F.pow(F.col("log_price") - m.model.predict(), 2))), 4).alias("rmse"), F.round(F.stddev_pop("log_price"), 4).alias("deviation"))


@query()
def forest_fit(t: Tables) -> DataFrame:
    d, cols = _emb(t)
    m = tree.forest(d, cols, "y", "id_", trees=4, max_depth=3, min_leaf=3)
    return d.select("id_", F.round(m.predict(), 6).alias("p"), F.round(m.out_of_bag(), 6).alias("oob"))


@query()
def oob_conformal(t: Tables) -> DataFrame:
    """The band of out-of-bag residuals of a regression forest."""
    d = _lines(t)
    m = tree.forest(d, LINE, "log_price", "id_", trees=4, max_features=None, task="regression", max_depth=4, min_leaf=5)
    return stats.conformal(d.withColumn("r", F.col("log_price") - m.out_of_bag()), "r")


@query()
def boosting_fit(t: Tables) -> DataFrame:
    d = _lines(t)
    m = tree.boost(d, LINE, "log_price", trees=4, rate=0.3, max_depth=2)
    return d.agg(*(F.round(F.sqrt(F.avg(F.pow(F.col("log_price") - m.predict(k), 2))), 6).alias(f"rmse_{k}") for k in range(5)))


@query()
def perm_importance(t: Tables) -> DataFrame:
    d, cols = _emb(t)
    m = _tree(d, cols, 3)
    score = lambda x: x.agg(F.avg((m.predict() == F.col("y")).cast("double"))).first()[0]
    got = explain.importance(d, "id_", {c: [c] for c in cols}, score, repeats=2, higher_is_better=True)
    return t.spark.createDataFrame([(k, *map(float, v)) for k, v in got.items()], "feature string, mean double, std double")


@query()
def synthetic_listings(t: Tables) -> DataFrame:
    return synthetic.listings(t.spark, 500)
