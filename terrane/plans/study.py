"""Queries of the joined-up run, of error analysis, and of models with fixed numbers, which SQL can follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import storage
from terrane.operators import clean, encode, errors, linear, metrics, predictor, report, serve, study, svm, tree
from terrane.plans import parsing
from terrane.plans.registry import Tables, kept, query
from terrane.plans.statistics import LOGS, SCORED, _logs, _scored

#: Sizes of the registered runs: every row, small models.
SMALL = study.Settings(resamples=1000, folds=3, trees=3, rounds=3, depth=3, steps=8, fourier=64)
_HASH = "('0x' || substr(md5(concat({0}, '|', {1})), 1, 8))::BIGINT"


def cleaned(t: Tables) -> DataFrame:
    """Cleaned listings with key_, the listing's page: each is left once."""
    order = [*parsing.ORDER, "estate_rel_url"]
    return clean.clean(storage.spread(parsing.listings(t), "estate_rel_url"), order).withColumnRenamed(f"o{len(order) - 1}_", "key_")


def ready(t: Tables) -> DataFrame:
    d = kept(study.featured(cleaned(t), "key_"))
    return storage.replaced(d, kept(study.divided(d)))


def prices(t: Tables) -> DataFrame:
    """Of ready(), what needs no feature: cleaning runs once, and a few numbers of each listing are kept."""
    d = kept(study.featured(cleaned(t), "key_").select("id_", "price_azn", "log_price"))
    return storage.replaced(d, kept(study.divided(d)))


_SPLIT = f"""{parsing._STAGED}, k AS (SELECT estate_rel_url AS key, price_azn, area_m2 FROM staged WHERE step = 9), e AS (SELECT quantile_cont(ln(price_azn), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM k),
s AS (SELECT k.*, len(list_filter(q, lambda x: x <= ln(price_azn))) AS stratum FROM k, e), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_HASH.format('key', 42)}, key) AS place, count(*) OVER (PARTITION BY stratum) AS n FROM s),
split AS (SELECT *, CASE WHEN place <= round_even(n * 0.15, 0) THEN 'test' WHEN place <= round_even(n * 0.15, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'train' END AS split FROM r)"""


@query(f"{_SPLIT}, m AS (SELECT median(ln(price_azn)) AS m, count(*) AS n_dev FROM split WHERE split <> 'test') SELECT any_value(n_dev) AS n_dev, count(*) AS n_test, round(any_value(m), 6) AS median, round(sqrt(avg(pow(ln(price_azn) - m, 2))), 6) AS rmse FROM split, m WHERE split = 'test'")
def study_baseline(t: Tables) -> DataFrame:
    """From raw text to the test error of the constant median."""
    d = prices(t)
    dev, test = encode.development(d), d.where("split = 'test'")
    m = study.Constant().fit(dev, None, "log_price")
    return test.agg(F.lit(dev.count()).alias("n_dev"), F.count(F.lit(1)).alias("n_test"), F.lit(round(m.median, 6)).alias("median"), F.round(metrics.rmse(F.col("log_price"), m.value()), 6).alias("rmse"))


@query(f"{_SPLIT}, m AS (SELECT median(price_azn) AS m FROM split WHERE split <> 'test') SELECT split, count(*) AS n, round(avg((price_azn > m)::INT), 6) AS premium FROM split, m GROUP BY split")
def study_tiers(t: Tables) -> DataFrame:
    """The tier's threshold comes from the development rows alone."""
    d = prices(t)
    _, all_ = study.tiers(encode.development(d), d)
    return all_.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("tier"), 6).alias("premium"))


@query()
def study_test(t: Tables) -> DataFrame:
    """Models refitted on the development rows, the test scored once, with intervals."""
    names = ["median", "ridge", "tree", "svm_fourier_tier"]
    return study.test_table(study.final_models(ready(t), SMALL, names).cache(), names, SMALL)


@query()
def study_cv(t: Tables) -> DataFrame:
    """Folds go by stratum; the split takes no part."""
    d = kept(study.featured(cleaned(t), "key_"))
    return study.over_folds(study.cross_validate(encode.with_strata(d, "price_azn"), SMALL, ["median", "ridge"]))


@query()
def predicted_prices(t: Tables) -> DataFrame:
    """A predictor fitted on the cleaned listings answers for each of them."""
    d = kept(cleaned(t))
    return predictor.PricePredictor.fit(d, "key_", SMALL).predict(d, "key_")


_CURVE = f"WITH d AS ({SCORED}), s AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY score), c AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s WINDOW w AS (ORDER BY score DESC)), f AS (SELECT count(*) FILTER (WHERE y = 1 AND score > 0.7)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND score > 0.7)::DOUBLE AS fp, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n, count(*) FILTER (WHERE (y = 1) = (score > 0.7))::DOUBLE AS ok FROM d)"


@query(f"{_CURVE} SELECT round(any_value(ok / f.n), 6) AS accuracy, round(any_value(f.tp / (f.tp + f.fp)), 6) AS \"precision\", round(any_value(f.tp / f.p), 6) AS recall, round(any_value(2 * f.tp / (2 * f.tp + f.fp + f.p - f.tp)), 6) AS f1, round((sum(pos * (c.n - c.fp + neg / 2.0)) / any_value(c.p * c.n))::DOUBLE, 6) AS roc_auc, round((sum(pos * (c.tp / (c.tp + c.fp))) / any_value(c.p))::DOUBLE, 6) AS average_precision FROM c, f")
def classification_metrics(t: Tables) -> DataFrame:
    d = _scored(t).withColumn("label", (F.col("score") > 0.7).cast("int"))
    got = metrics.classification_metrics(d, "y", "label", "score")
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query(f"WITH f AS (SELECT id % 5 AS fold, sqrt(avg(pow(p - y, 2))) AS v FROM ({LOGS}) GROUP BY 1) SELECT 'p' AS model, count(*) AS folds, round(avg(v), 6) AS mean_value, round(stddev_pop(v), 6) AS std_value FROM f")
def fold_mean_std(t: Tables) -> DataFrame:
    d = _logs(t).groupBy((F.col("id") % 5).alias("fold")).agg(metrics.rmse(F.col("y"), F.col("p")).alias("value"))
    return metrics.over_folds(d.withColumn("model", F.lit("p")), ["model"], ["value"]).select("model", "folds", F.round("mean_value", 6).alias("mean_value"), F.round("std_value", 6).alias("std_value"))


_TIERS = f"SELECT *, (y > ln(150000.0))::INT AS tier, (p > ln(150000.0))::INT AS label FROM ({LOGS})"


def _tiers(t: Tables) -> DataFrame:
    cut = F.ln(F.lit(150000.0))
    return _logs(t).withColumns({"tier": (F.col("y") > cut).cast("int"), "label": (F.col("p") > cut).cast("int")})


@query(f"SELECT grp AS \"group\", count(*) AS n, round(sqrt(avg(pow(p - y, 2))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(avg(p - y), 6) AS bias, round(avg((tier <> label)::INT), 6) AS tier_error FROM ({_TIERS}) GROUP BY grp")
def errors_by_group(t: Tables) -> DataFrame:
    d = errors.by_group(_tiers(t), F.col("grp"), "y", "p", "tier", "label")
    return d.select("group", "n", *(F.round(c, 6).alias(c) for c in ("rmse", "mae", "bias", "tier_error")))


@query(f"SELECT (abs(y - ln(150000.0)) >= 0.1)::INT + (abs(y - ln(150000.0)) >= 0.3)::INT + (abs(y - ln(150000.0)) >= 0.6)::INT AS bin, count(*) AS n, round(avg((tier <> label)::INT), 6) AS tier_error FROM ({_TIERS}) GROUP BY 1")
def error_by_distance(t: Tables) -> DataFrame:
    d = errors.by_distance(_tiers(t), "y", F.lit(150000.0), "tier", "label", [0.1, 0.3, 0.6])
    return d.select("bin", "n", F.round("tier_error", 6).alias("tier_error"))


@query(f"WITH d AS (SELECT *, abs(y - ln(150000.0)) <= 0.1 AS near, tier <> label AS wrong FROM ({_TIERS})) SELECT round(avg(near::INT), 6) AS share_rows, round(coalesce(count(*) FILTER (WHERE near AND wrong) / nullif(count(*) FILTER (WHERE wrong), 0), 0)::DOUBLE, 6) AS share_errors FROM d")
def near_threshold(t: Tables) -> DataFrame:
    return errors.near_threshold(_tiers(t), "y", F.lit(150000.0), "tier", "label").select(F.round("share_rows", 6).alias("share_rows"), F.round("share_errors", 6).alias("share_errors"))


@query(f"SELECT round(avg((abs(exp(round(p - y, 2)) - 1) > 0.333)::INT), 6) AS share FROM ({LOGS})")
def far_off_share(t: Tables) -> DataFrame:
    d = _logs(t).withColumn("r", F.round(F.col("p") - F.col("y"), 2)).withColumn("zero", F.lit(0.0))
    return errors.far_off(d, "zero", "r", 0.333).select(F.round("share", 6).alias("share"))


@query(f"SELECT round(avg((abs(round(p, 1) - round(p2, 1)) <= 0.15 * greatest(abs(round(p, 1)), abs(round(p2, 1)), 1.0) / 10)::INT), 6) AS share FROM ({LOGS})")
def model_agreement(t: Tables) -> DataFrame:
    d = _logs(t).select(F.round("p", 1).alias("a"), F.round("p2", 1).alias("b"))
    return errors.agreement(d, "a", "b", 0.015).select(F.round("share", 6).alias("share"))


@query("SELECT 'l_extendedprice' AS \"column\", count(DISTINCT l_extendedprice) AS doubles, count(DISTINCT l_extendedprice::FLOAT) AS floats FROM lineitem UNION ALL SELECT 'l_discount', count(DISTINCT l_discount), count(DISTINCT l_discount::FLOAT) FROM lineitem")
def precision_lost(t: Tables) -> DataFrame:
    return errors.precision_lost(t.lineitem, ["l_extendedprice", "l_discount"])


@query("SELECT round(corr(ln(l_quantity), ln(l_extendedprice)), 6) AS correlation FROM lineitem")
def correlation(t: Tables) -> DataFrame:
    return errors.correlation(t.lineitem, F.ln("l_quantity"), F.ln("l_extendedprice")).select(F.round("correlation", 6).alias("correlation"))


@query("SELECT min(l_shipdate)::VARCHAR AS first, max(l_shipdate)::VARCHAR AS last FROM (SELECT l_shipdate::DATE AS l_shipdate FROM lineitem)")
def scrape_span(t: Tables) -> DataFrame:
    return errors.span_of(t.lineitem.select(F.col("l_shipdate").cast("date").alias("day")), "day").select(*(F.col(c).cast("string").alias(c) for c in ("first", "last")))


@query("WITH w AS (SELECT c_custkey AS name, round(c_acctbal, 2) AS weight FROM customer) SELECT * FROM w ORDER BY abs(weight) DESC, name LIMIT 12")
def largest_weights(t: Tables) -> DataFrame:
    return errors.largest(t.customer.select(F.col("c_custkey").alias("name"), F.round("c_acctbal", 2).alias("weight")), "weight", "name", 12)


@query("WITH g AS (SELECT c_nationkey AS location, median(o_totalprice / (o_custkey % 90 + 10)) AS price_m2, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), e AS (SELECT count(*) FILTER (WHERE n >= 30) AS k FROM g), o AS (SELECT g.*, k FROM g, e WHERE k = 0 OR n >= 30 ORDER BY CASE WHEN k = 0 THEN n ELSE price_m2 END DESC, location LIMIT 18), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, location) AS r FROM o) SELECT location, round(price_m2, 4) AS price_m2, n FROM r WHERE k > 0 OR r <= 12")
def price_level(t: Tables) -> DataFrame:
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("place"), "o_totalprice", (F.col("o_custkey") % 90 + 10).alias("area"))
    return errors.price_level(d, "place", "o_totalprice", "area").select("location", F.round("price_m2", 4).alias("price_m2"), "n")


@query("WITH s AS (SELECT p_size AS lam, round(avg(p_retailprice), 4) AS f1 FROM part GROUP BY 1) SELECT lam, f1 FROM s ORDER BY f1 DESC, lam DESC LIMIT 1")
def lambda_selection(t: Tables) -> DataFrame:
    return study.select_lambda(t.part.groupBy(F.col("p_size").alias("lam")).agg(F.round(F.avg("p_retailprice"), 4).alias("f1")), "f1")


@query("SELECT CASE WHEN contains(f, 'area') THEN 'area' ELSE f END AS feature, round(sum(v), 4) AS value FROM (SELECT split_part(['area_m2', 'log_area', 'rooms', 'district'][c_nationkey % 4 + 1], '=', 1) AS f, c_acctbal AS v FROM customer) GROUP BY 1")
def folded_importances(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, ("area_m2", "log_area", "rooms_missing", "district=x")))
    d = t.customer.select(F.get(names, (F.col("c_nationkey") % 4).cast("int")).alias("f"), F.col("c_acctbal").alias("v"))
    return errors.folded_importances(d, "f", "v").select("feature", F.round("value", 4).alias("value"))


@query(f"WITH f AS (SELECT *, id % 5 AS fold FROM ({LOGS})) SELECT h.fold::INT AS held, count(*) AS n_fit, round(avg(f.y), 6) AS mean FROM f JOIN (SELECT DISTINCT fold FROM f) h ON f.fold <> h.fold GROUP BY 1")
def fold_complements(t: Tables) -> DataFrame:
    d = _logs(t).withColumn("fold", F.col("id") % 5)
    out = None
    for k in range(5):
        fit_rows, _ = encode.fold_sets(d, k)
        got = fit_rows.agg(F.lit(k).alias("held"), F.count(F.lit(1)).alias("n_fit"), F.round(F.avg("y"), 6).alias("mean"))
        out = got if out is None else out.unionByName(got)
    return out


@query("WITH c AS (SELECT c_nationkey AS k, c_mktsegment AS district, count(*) AS n FROM customer GROUP BY ALL), g AS (SELECT k, district FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, district) AS r FROM c) WHERE r = 1), m AS (SELECT c_nationkey AS k, round(median(c_acctbal), 4) AS lat FROM customer GROUP BY 1) SELECT s_suppkey AS id, s_nationkey < 20 AS known, CASE WHEN s_nationkey < 20 THEN district END AS district, CASE WHEN s_suppkey % 3 = 0 THEN 40.0 WHEN s_nationkey < 20 THEN lat END AS lat FROM supplier LEFT JOIN g ON s_nationkey = g.k LEFT JOIN m ON s_nationkey = m.k")
def gazetteer_lookup(t: Tables) -> DataFrame:
    """Listings by place name: given coordinates stay, others come from the gazetteer with the district."""
    name = lambda c: F.when(F.col(c) < 20, F.concat(F.lit("place "), F.col(c).cast("string")))
    places = t.customer.select(name("c_nationkey").alias("location"), F.col("c_mktsegment").alias("district"), F.lit("x").alias("city"), F.lit("").alias("tags"), F.col("c_acctbal").alias("lat"), F.lit(49.0).alias("lng"))
    asked = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Place "), F.col("s_nationkey").cast("string")).alias("location"), F.when(F.col("s_suppkey") % 3 == 0, 40.0).alias("lat"), F.when(F.col("s_suppkey") % 3 == 0, 49.5).alias("lng"))
    d = predictor.filled(asked, serve.gazetteer(places))
    return d.select("id", F.col("known_").alias("known"), "district", F.round("lat", 4).alias("lat"))


# Models with fixed numbers.
_FIXED = [
    [(0, "quantity", 24.5, 1, 2, 10.0), (1, "discount", 0.045, 3, 4, 8.0), (2, None, None, None, None, 12.0), (3, None, None, None, None, 7.0), (4, None, None, None, None, 9.5)],
    [(0, "discount", 0.055, 1, 2, 9.0), (1, None, None, None, None, 8.5), (2, "quantity", 40.5, 3, 4, 9.75), (3, None, None, None, None, 9.0), (4, None, None, None, None, 11.0)],
    [(0, "quantity", 10.5, 1, 2, 10.0), (1, None, None, None, None, 6.0), (2, None, None, None, None, 10.5)],
]


def fixed_trees() -> list[tree.Tree]:
    depth = {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}
    return [tree.Tree("regression", "mse", 2, [tree.Node(i, depth[i], 1.0, [v, v * v], 1.0, f, c, a, b) for i, f, c, a, b, v in nodes]) for nodes in _FIXED]


def _case(k: int, value, depth: int = 9) -> str:
    """value(path): SQL of a leaf from the nodes on its path."""
    nodes = {n[0]: n for n in _FIXED[k]}

    def go(path: list[int]) -> str:
        _, f, c, a, b, _ = nodes[path[-1]]
        if f is None or len(path) > depth:
            return value([nodes[i] for i in path])
        return f"CASE WHEN {f} <= {c} THEN {go([*path, a])} ELSE {go([*path, b])} END"

    return go([0])


_VALUE = [_case(k, lambda p: str(p[-1][5])) for k in range(3)]
_LINES = "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_quantity AS quantity, l_discount AS discount FROM lineitem"


def _effect(f: str) -> str:
    return " + ".join("(" + _case(k, lambda p: str(sum(b[5] - a[5] for a, b in zip(p, p[1:], strict=False) if a[1] == f))) + ")" for k in range(3))


@query(
    f"WITH d AS ({_LINES}), v AS (SELECT id, {_VALUE[0]} AS a, {_VALUE[1]} AS b, {_VALUE[2]} AS c, {_case(0, lambda p: str(p[-1][0]))} AS leaf, {_case(0, lambda p: str(p[-1][5]), 1)} AS shallow, ({_effect('quantity')}) / 3 AS eq, ({_effect('discount')}) / 3 AS ed FROM d)\n"
    "SELECT id, leaf::INT AS leaf, shallow::DOUBLE AS shallow, round((a + b + c) / 3, 6)::DOUBLE AS mean, round((a + b) / 2, 6)::DOUBLE AS two, round(list_sort([a, b, c])[1] + 0.2 * (list_sort([a, b, c])[2] - list_sort([a, b, c])[1]), 6)::DOUBLE AS low, round(list_sort([a, b, c])[2] + 0.8 * (list_sort([a, b, c])[3] - list_sort([a, b, c])[2]), 6)::DOUBLE AS high, round(eq, 6)::DOUBLE AS by_quantity, round(ed, 6)::DOUBLE AS by_discount FROM v"
)
def fixed_forest(t: Tables) -> DataFrame:
    """Node tables of three trees: leaves, a shallower tree, staged means, spread, and what each feature adds along the paths."""
    trees = fixed_trees()
    m = tree.Forest(trees, "id", 0)
    low, high = m.spread()
    e = m.path_effects(["quantity", "discount"])
    d = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return d.select("id", trees[0].node_id().alias("leaf"), trees[0].predict(1).alias("shallow"), *(F.round(c, 6).alias(n) for n, c in (("mean", m.predict()), ("two", F.get(m.staged(), F.lit(1))), ("low", low), ("high", high), ("by_quantity", e["quantity"]), ("by_discount", e["discount"]))))


_ROUNDS = 3
_C0 = [[10.0, 0.02], [25.0, 0.05], [40.0, 0.08]]


def _lloyd() -> str:
    steps = ["c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(_C0)) + ") c(k, a, b))"]
    for i in range(_ROUNDS):
        steps.append(f"n{i} AS (SELECT x.q, x.s, arg_min(k, pow(q - a, 2) + pow(s - b, 2) + 1e-15 * k) AS k, min(pow(q - a, 2) + pow(s - b, 2)) AS d, x.i FROM x, c{i} GROUP BY x.i, x.q, x.s)")
        steps.append(f"c{i + 1} AS (SELECT k, avg(q) AS a, avg(s) AS b FROM n{i} GROUP BY k)")
    last = f"n{_ROUNDS} AS (SELECT arg_min(k, pow(q - a, 2) + pow(s - b, 2) + 1e-15 * k) AS k, min(pow(q - a, 2) + pow(s - b, 2)) AS d, any_value(q) AS q FROM x, c{_ROUNDS} GROUP BY x.i)"
    return f"WITH x AS (SELECT row_number() OVER () AS i, l_quantity AS q, l_discount AS s FROM lineitem), {', '.join(steps)}, {last} SELECT k::INT AS cluster, count(*) AS n, round(sum(d), 3) AS inertia, round(sqrt(avg(pow(q - 25, 2))), 6) AS rmse FROM n{_ROUNDS} GROUP BY k"


@query(_lloyd())
def kmeans_from_seeds(t: Tables) -> DataFrame:
    """Three Lloyd steps, then size, inertia and an error of each cluster."""
    d = t.lineitem.select("l_quantity", "l_discount")
    m = linear.KMeans(["l_quantity", "l_discount"], 3, max_iter=_ROUNDS, tol=0.0).fit(d, [list(c) for c in _C0])
    got = m.report(d, F.col("l_quantity") - 25)
    return got.select("cluster", "n", F.round("inertia", 3).alias("inertia"), F.round("rmse", 6).alias("rmse"))


_LAM, _STEPS = 0.1, 4
_RETURNS = "SELECT l_quantity / 50 AS a, l_discount * 10 AS b, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE -1.0 END AS s, l_extendedprice / 10000 AS y FROM lineitem"


def _pegasos() -> str:
    steps = ["w0 AS (SELECT 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS wc)"]
    for t in range(1, _STEPS + 1):
        eta = 1 / (_LAM * t)
        steps.append(f"g{t} AS (SELECT any_value(wa) AS wa, any_value(wb) AS wb, any_value(wc) AS wc, avg(CASE WHEN s * (a * wa + b * wb + wc) < 1 THEN s * a ELSE 0 END) AS ga, avg(CASE WHEN s * (a * wa + b * wb + wc) < 1 THEN s * b ELSE 0 END) AS gb, avg(CASE WHEN s * (a * wa + b * wb + wc) < 1 THEN s ELSE 0 END) AS gc, {_LAM} / 2 * any_value(wa * wa + wb * wb + wc * wc) + avg(greatest(1 - s * (a * wa + b * wb + wc), 0)) AS obj FROM x, w{t - 1})")
        steps.append(f"u{t} AS (SELECT {1 - eta * _LAM}::DOUBLE * wa + {eta}::DOUBLE * ga AS wa, {1 - eta * _LAM}::DOUBLE * wb + {eta}::DOUBLE * gb AS wb, {1 - eta * _LAM}::DOUBLE * wc + {eta}::DOUBLE * gc AS wc FROM g{t})")
        f = f"least(1.0, {(1 / _LAM) ** 0.5}::DOUBLE / greatest(sqrt(wa * wa + wb * wb + wc * wc), 1e-300))"
        steps.append(f"w{t} AS (SELECT wa * {f} AS wa, wb * {f} AS wb, wc * {f} AS wc FROM u{t})")
    rows = " UNION ALL ".join(f"SELECT {t} AS step, round(obj, 6) AS objective, round(w{t}.wa, 6) AS wa, round(w{t}.wb, 6) AS wb, round(w{t}.wc, 6) AS wc FROM g{t}, w{t}" for t in range(1, _STEPS + 1))
    return f"WITH x AS ({_RETURNS}), {', '.join(steps)} {rows}"


def _returns(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_extendedprice") / 10000).alias("price"))


@query(_pegasos())
def pegasos_steps(t: Tables) -> DataFrame:
    """The objective before, and the weights after, each of the first full-batch steps, projection included."""
    d, rows = _returns(t).cache(), []
    for k in range(1, _STEPS + 1):
        m = svm.PegasosSVM(["a", "b"], lam=_LAM, steps=k).fit(d, "y")
        rows.append((k, m.history[-1], *map(float, m.w)))
    d.unpersist()
    return t.spark.createDataFrame(rows, "step int, objective double, wa double, wb double, wc double").select("step", *(F.round(c, 6).alias(c) for c in ("objective", "wa", "wb", "wc")))


@query(f"WITH x AS ({_RETURNS}), m AS (SELECT avg(y) AS m FROM x), e AS (SELECT y - m - 0.5 * a + 0.1 * b - 0.2 AS e FROM x, m) SELECT round(0.05 * (0.25 + 0.01 + 0.04) + avg(greatest(abs(e) - 0.3, 0)), 6) AS objective, round(avg((abs(e) <= 0.3)::INT), 6) AS inside FROM e")
def svr_objective(t: Tables) -> DataFrame:
    """The epsilon-insensitive objective and the share in the tube, for given weights."""
    d = _returns(t)
    m = svm.PegasosSVR(["a", "b"], lam=0.1, epsilon=0.3)
    m.w, m.centre = np.array([0.5, -0.1, 0.2]), float(d.agg(F.avg("price")).first()[0])
    return m.tube(d, "price").select(F.lit(m.objective(d, "price")).alias("objective"), "inside").select(F.round("objective", 6).alias("objective"), F.round("inside", 6).alias("inside"))


@query(f"SELECT metric, task, round(value, 6) AS value FROM (SELECT 'bias' AS metric, 'A' AS task, avg(p - y) AS value FROM ({LOGS}) UNION ALL SELECT 'within', 'A', avg((abs(p - y) <= 0.2)::INT) FROM ({LOGS}))")
def error_summary(t: Tables) -> DataFrame:
    d = _logs(t)
    got = d.agg(F.avg(F.col("p") - F.col("y")).alias("bias"), F.avg((F.abs(F.col("p") - F.col("y")) <= 0.2).cast("double")).alias("within"))
    return got.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.lit("A").alias("task"), F.round(c, 6).alias("value")) for c in ("bias", "within")))))


_SCORES = f"SELECT 'rmse' AS metric, cust % 3 AS model, sqrt(avg(pow(p - y, 2))) AS value FROM ({LOGS}) GROUP BY 2 UNION ALL SELECT 'r2', cust % 3, 1 - avg(pow(p - y, 2)) / var_pop(y) FROM ({LOGS}) GROUP BY 2"


@query(f"WITH s AS ({_SCORES}), b AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY round(CASE WHEN metric = 'rmse' THEN -value ELSE value END, 10) DESC) = 1 AS best FROM s) SELECT metric, model, round(value, 6) AS value, best FROM b")
def best_models(t: Tables) -> DataFrame:
    """The best of each metric, of which less or more is better."""
    y, p = F.col("y"), F.col("p")
    d = _logs(t).groupBy((F.col("cust") % 3).alias("model")).agg(metrics.rmse(y, p).alias("rmse"), metrics.r2(y, p).alias("r2"))
    long = d.select("model", F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("rmse", "r2")))))
    return report.with_best(long, []).select("metric", "model", F.round("value", 6).alias("value"), "best")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN 'no clear difference' WHEN (c_acctbal < 0) = (c_custkey % 2 = 0) THEN 'a better' ELSE 'b better' END AS verdict, CASE WHEN c_nationkey / 100.0 < 0.001 THEN 'very sure' WHEN c_nationkey / 100.0 < 0.01 THEN 'sure' WHEN c_nationkey / 100.0 < 0.05 THEN 'likely' ELSE 'open' END AS word FROM customer WHERE c_acctbal <> 0")
def verdict_words(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    words = report.verdict(F.when(k % 2 == 0, "rmse").otherwise("f1"), F.col("c_acctbal"), k % 3 == 0)
    return t.customer.where("c_acctbal <> 0").select(k.alias("k"), words.alias("verdict"), report.size_word(F.col("c_nationkey") / 100.0).alias("word"))


@query(f"WITH g AS (SELECT grp, count(*) AS n, sqrt(avg(pow(p - y, 2))) AS rmse FROM ({LOGS}) GROUP BY 1 HAVING count(*) >= 30) SELECT arg_min(grp, rmse) AS strongest, round(min(rmse), 6) AS least, arg_max(grp, rmse) AS weakest, round(max(rmse), 6) AS largest, round(max(rmse) / min(rmse), 6) AS ratio FROM g")
def group_extremes(t: Tables) -> DataFrame:
    d = report.extremes(errors.by_group(_logs(t), F.col("grp"), "y", "p"))
    return d.select("strongest", F.round("least", 6).alias("least"), "weakest", F.round("largest", 6).alias("largest"), F.round("ratio", 6).alias("ratio"))


@query("SELECT CASE l_linenumber WHEN 4 THEN 'torpaq' END AS category, count(*) AS n FROM lineitem WHERE l_linenumber = 4 GROUP BY 1")
def dropped_categories(t: Tables) -> DataFrame:
    return errors.dropped_categories(parsing.listings(t), "kateqoriya")
