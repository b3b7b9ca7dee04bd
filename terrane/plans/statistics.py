"""Queries of features, encoding, splits, exploration, metrics and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrane.functions import fixed, numeric
from terrane.operators import encode, explain, features, metrics, serve, stats
from terrane.plans.registry import Tables, query

PLACES = "SELECT c_custkey AS k, 38.0 + (c_custkey % 500) / CAST(100 AS DOUBLE) AS lat, 44.0 + (c_custkey % 700) / CAST(100 AS DOUBLE) AS lng FROM customer"


@query(f"WITH p AS ({PLACES}) SELECT k, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(49.8920) - radians(lng)) / 2), 2) * cos(radians(lat)) * cos(radians(40.3777)) + pow(sin((radians(40.3777) - radians(lat)) / 2), 2))), 4) AS km, round(lng * 111.32 * cos(radians(40.4)), 4) AS x, round(lat * 110.57, 4) AS y FROM p")
def haversine_features(t: Tables) -> DataFrame:
    x, y = numeric.plane_km(F.col("lat"), F.col("lng"))
    return t.sql(PLACES, "customer").select("k", F.round(numeric.haversine_km(F.col("lat"), F.col("lng"), *map(F.lit, fixed.CENTER)), 4).alias("km"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


HOMES = "SELECT l_orderkey AS o_, l_linenumber AS n_, l_extendedprice AS price_azn, l_quantity AS area_m2, CAST(NULLIF(l_linenumber % 5, 0) AS DOUBLE) AS rooms, CAST(NULLIF(l_suppkey % 9, 8) AS DOUBLE) AS floor, CAST(NULLIF(l_partkey % 12, 0) AS DOUBLE) AS total_floors, CASE WHEN l_returnflag = 'A' THEN l_tax * 100 END AS land_area_sot, 40.0 AS lat, 49.0 AS lng, CASE WHEN l_linestatus = 'O' THEN CAST(1.0 AS DOUBLE) END AS repair, CAST(NULL AS DOUBLE) AS mortgage, CAST(1.0 AS DOUBLE) AS bill_of_sale, l_returnflag AS category, l_linestatus AS building_type, CAST(NULL AS STRING) AS city, l_linestatus AS district, l_returnflag AS location, '' AS tags, CASE l_suppkey % 4 WHEN 0 THEN 'Metro yaxın, təcili' WHEN 1 THEN 'dəniz' WHEN 2 THEN CAST(NULL AS STRING) ELSE 'mebel' END AS description FROM lineitem"


@query(f"""WITH h AS ({HOMES}) SELECT o_, n_, round(ln(area_m2), 6) AS log_area, round(area_m2 / rooms, 6) AS area_per_room, round(floor / total_floors, 6) AS floor_ratio, CASE WHEN floor IS NOT NULL AND total_floors IS NOT NULL THEN (floor = total_floors)::INT::DOUBLE END AS is_top_floor, (floor <= 1)::INT::DOUBLE AS is_first_floor, round(coalesce(land_area_sot, 0), 6) AS land, (coalesce(land_area_sot, 0) > 0)::INT::DOUBLE AS has_land, round(ln(1 + length(coalesce(description, ''))), 6) AS desc_log_len, 0.0::DOUBLE AS mortgage, contains(lower(coalesce(description, '')), 'metro')::INT::DOUBLE AS kw_metro, contains(coalesce(description, ''), 'dəniz')::INT::DOUBLE AS kw_sea FROM h""")
def engineered_features(t: Tables) -> DataFrame:
    d = features.make_features(t.sql(HOMES, "lineitem"))
    r = lambda c: F.round(c, 6).alias(c)
    return d.select("o_", "n_", r("log_area"), r("area_per_room"), r("floor_ratio"), "is_top_floor", "is_first_floor", F.round("land_area_sot", 6).alias("land"), "has_land", r("desc_log_len"), "mortgage", "kw_metro", "kw_sea")


GAPS = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE o_totalprice END AS a, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) END AS b, CAST(NULL AS DOUBLE) AS z FROM orders"


@query(f"WITH g AS ({GAPS}), m AS (SELECT median(a) AS ma, median(b) AS mb FROM g) SELECT k, round(coalesce(a, ma), 6) AS a, coalesce(b, mb) AS b, 0.0::DOUBLE AS z, (a IS NULL)::INT::DOUBLE AS a_missing FROM g, m")
def missing_impute_median(t: Tables) -> DataFrame:
    d = t.sql(GAPS, "orders")
    p = encode.Preprocessor(numeric=["a", "b", "z"], binary=[], categorical=[], indicators=["a"], multilabel=[]).fit(d)
    out = dict(zip(p.names(), p.columns(), strict=True))
    return d.select("k", F.round(out["a"], 6).alias("a"), out["b"].alias("b"), out["z"].alias("z"), out["a_missing"].alias("a_missing"))


@query("""WITH c AS (SELECT p_brand AS level, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 20 ORDER BY n DESC, level LIMIT 5), k AS (SELECT list(level ORDER BY level) AS l FROM c)
SELECT p_partkey, coalesce((p_brand = l[1])::INT::DOUBLE, 0) AS v1, coalesce((p_brand = l[5])::INT::DOUBLE, 0) AS v5, (NOT coalesce(list_contains(l, p_brand), false))::INT::DOUBLE AS other FROM part, k""")
def onehot_topk_other(t: Tables) -> DataFrame:
    p = encode.Preprocessor(numeric=[], binary=[], categorical=["p_brand"], indicators=[], multilabel=[], max_levels=5).fit(t.part)
    *levels, other = p.columns()
    levels += [F.lit(0.0)] * 5
    return t.part.select("p_partkey", levels[0].alias("v1"), levels[4].alias("v5"), other.alias("other"))


@query("""WITH w AS (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part), c AS (SELECT w, count(*) AS n FROM w WHERE w <> '' GROUP BY w HAVING count(*) >= 20 ORDER BY n DESC, w LIMIT 4), k AS (SELECT list(w ORDER BY w) AS l FROM c)
SELECT p_partkey, coalesce(list_contains(string_split(p_name, ' '), l[1])::INT::DOUBLE, 0) AS a, coalesce(list_contains(string_split(p_name, ' '), l[4])::INT::DOUBLE, 0) AS b FROM part, k""")
def multilabel_encode(t: Tables) -> DataFrame:
    d = t.part.withColumn("tags", F.replace("p_name", F.lit(" "), F.lit("|")))
    p = encode.Preprocessor(numeric=[], binary=[], categorical=[], indicators=[], multilabel=["tags"], max_labels=4).fit(d)
    c = [*p.columns(), *[F.lit(0.0)] * 4]
    return d.select("p_partkey", c[0].alias("a"), c[3].alias("b"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS z, 0.0::DOUBLE AS one FROM orders")
def standardize_pop(t: Tables) -> DataFrame:
    d = t.orders.select("o_orderkey", F.col("o_totalprice").alias("z"), F.lit(1.0).alias("one"))
    return encode.Standardizer(["z", "one"]).fit(d).transform(d).select("o_orderkey", F.round("z", 6).alias("z"), "one")


@query("SELECT o_orderkey, (o_totalprice > (SELECT median(o_totalprice) FROM orders WHERE o_orderstatus = 'F'))::INT AS tier FROM orders")
def tier_label(t: Tables) -> DataFrame:
    return encode.with_tier(t.orders, "o_totalprice", F.col("o_orderstatus") == "F").select("o_orderkey", "tier")


_STRATA = "WITH e AS (SELECT quantile_cont(ln(o_totalprice), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM orders), s AS (SELECT o_orderkey, o_totalprice, len(list_filter(q, lambda x: x <= ln(o_totalprice)))::INT AS stratum FROM orders, e), h AS (SELECT *, ('0x' || substr(md5(concat(o_orderkey, '|', 42)), 1, 8))::BIGINT AS h FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, o_orderkey) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM h)"


def _strata(t: Tables) -> DataFrame:
    return encode.with_strata(t.orders, "o_totalprice")


@query(f"{_STRATA} SELECT stratum, count(*) AS n, round(min(o_totalprice), 2) AS low FROM r GROUP BY stratum")
def price_strata(t: Tables) -> DataFrame:
    return _strata(t).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("o_totalprice"), 2).alias("low"))


@query(f"{_STRATA} SELECT o_orderkey, CASE WHEN rn <= round_even(n * 0.15::DOUBLE, 0) THEN 'test' WHEN rn <= round_even(n * 0.15::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM r")
def stratified_split(t: Tables) -> DataFrame:
    return encode.with_split(_strata(t), "o_orderkey").select("o_orderkey", "split")


@query(f"{_STRATA} SELECT o_orderkey, ((rn - 1) % 5)::INT AS fold FROM r")
def stratified_kfold(t: Tables) -> DataFrame:
    return encode.with_fold(_strata(t), "o_orderkey").select("o_orderkey", "fold")


@query("SELECT o_orderkey FROM orders ORDER BY ('0x' || substr(md5(concat(o_orderkey, '|', 42)), 1, 8))::BIGINT, o_orderkey LIMIT 1000")
def learning_prefix(t: Tables) -> DataFrame:
    return encode.sample(t.orders, "o_orderkey", 1000).select("o_orderkey")


@query("WITH x AS (SELECT ln(o_totalprice) AS v, o_totalprice AS p FROM orders), m AS (SELECT avg(v) AS a, stddev_pop(v) AS s FROM x) SELECT round(any_value(a), 6) AS mean, round(any_value(s), 6) AS std, round(avg(pow((v - a) / s, 3)), 4) AS skew, round(median(p), 4) AS median, round(quantile_cont(p, 0.01), 4) AS p01, round(quantile_cont(p, 0.99), 4) AS p99 FROM x, m")
def eda_stats(t: Tables) -> DataFrame:
    v, p = F.ln("o_totalprice"), F.col("o_totalprice")
    q = F.percentile(p, F.array(F.lit(0.01), F.lit(0.99)))
    return t.orders.agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.round(F.skewness(v), 4).alias("skew"), F.round(F.median(p), 4).alias("median"), q.alias("q")).select("mean", "std", "skew", "median", F.round(F.get("q", F.lit(0)), 4).alias("p01"), F.round(F.get("q", F.lit(1)), 4).alias("p99"))


@query("SELECT c_nationkey, round(median(o_totalprice), 4) AS median_price, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey HAVING count(*) >= 30 ORDER BY median_price DESC, c_nationkey LIMIT 18")
def location_effect(t: Tables) -> DataFrame:
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.round(F.median("o_totalprice"), 4).alias("median_price"), F.count(F.lit(1)).alias("n"))
    return d.where("n >= 30").orderBy(F.desc("median_price"), "c_nationkey").limit(18)


@query("SELECT o_orderpriority, round(avg((o_totalprice > (SELECT median(o_totalprice) FROM orders))::INT), 6) AS share FROM orders GROUP BY 1")
def premium_share(t: Tables) -> DataFrame:
    return encode.with_tier(t.orders, "o_totalprice").groupBy("o_orderpriority").agg(F.round(F.avg("tier"), 6).alias("share"))


@query("WITH b AS (SELECT min(o_totalprice) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 60)), 59)::BIGINT AS bin, count(*) AS n FROM orders, b WHERE o_totalprice <= hi GROUP BY 1")
def histogram60(t: Tables) -> DataFrame:
    b = t.orders.agg(F.min("o_totalprice").alias("lo"), F.percentile("o_totalprice", F.lit(0.99)).alias("hi"))
    d = t.orders.crossJoin(F.broadcast(b)).where("o_totalprice <= hi")
    return d.groupBy(F.least(F.floor((F.col("o_totalprice") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 60)), F.lit(59)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT least(l_linenumber, 6)::INT AS rooms, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY 1")
def boxplot_stats(t: Tables) -> DataFrame:
    q = F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = t.lineitem.groupBy(F.least("l_linenumber", F.lit(6)).alias("rooms")).agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return d.select("rooms", "n", *(F.round(F.get("q", F.lit(i)), 4).alias(c) for i, c in enumerate(("q1", "med", "q3"))))


@query("SELECT floor(l_quantity / 5)::BIGINT AS x, floor(l_extendedprice / 5000)::BIGINT AS y, count(*) AS n FROM lineitem GROUP BY ALL")
def density_grid(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.floor(F.col("l_quantity") / 5).cast("bigint").alias("x"), F.floor(F.col("l_extendedprice") / 5000).cast("bigint").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH p AS ({PLACES}) SELECT count(*) FILTER (WHERE lat BETWEEN 40.25 AND 40.65 AND lng BETWEEN 49.60 AND 50.40) AS inside, round(avg((lat BETWEEN 40.25 AND 40.65 AND lng BETWEEN 49.60 AND 50.40)::INT), 6) AS share FROM p")
def map_box(t: Tables) -> DataFrame:
    here = F.col("lat").between(*fixed.MAP_BOX["lat"]) & F.col("lng").between(*fixed.MAP_BOX["lng"])
    return t.sql(PLACES, "customer").agg(F.count_if(here).alias("inside"), F.round(numeric.share(here), 6).alias("share"))


#: A deterministic score with many ties, and a log price with a prediction.
SCORED = "SELECT l.doc_id AS id, l.quality AS y, CAST((d.n_chars * 7 + l.doc_id) % 11 AS DOUBLE) / 10 + l.quality * CAST(0.3 AS DOUBLE) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
LOGS = "SELECT o_orderkey AS id, o_orderpriority AS grp, o_custkey AS cust, ln(o_totalprice) AS y, ln(o_totalprice) + ((o_orderkey * 37) % 101 - 50) / CAST(100 AS DOUBLE) AS p, ln(o_totalprice) + ((o_orderkey * 53) % 89 - 40) / CAST(100 AS DOUBLE) AS p2 FROM orders"


def _scored(t: Tables) -> DataFrame:
    return t.labels.alias("l").join(t.documents.alias("d"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), (((F.col("n_chars") * 7 + F.col("doc_id")) % 11).cast("double") / 10 + F.col("quality") * 0.3).alias("score"))


def _logs(t: Tables) -> DataFrame:
    return t.sql(LOGS, "orders")


@query(f"WITH d AS ({LOGS}) SELECT round(sqrt(avg(pow(y - p, 2))), 6) AS rmse_log, round(avg(abs(y - p)), 6) AS mae_log, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2_log, round(sqrt(avg(pow(exp(y) - exp(p), 2))), 3) AS rmse, round(avg(abs(exp(y) - exp(p))), 3) AS mae, round(1 - sum(pow(exp(y) - exp(p), 2)) / (var_pop(exp(y)) * count(*)), 6) AS r2, round(avg(abs(exp(y) - exp(p)) / exp(y)), 6) AS mape FROM d")
def regression_metrics(t: Tables) -> DataFrame:
    return metrics.regression_metrics(_logs(t), "y", "p").select(*(F.round(c, k).alias(c) for c, k in (("rmse_log", 6), ("mae_log", 6), ("r2_log", 6), ("rmse", 3), ("mae", 3), ("r2", 6), ("mape", 6))))


@query(f"WITH d AS (SELECT y, (score > 0.7)::INT AS p FROM ({SCORED})), c AS (SELECT count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp FROM d) SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS \"precision\", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def confusion_prf(t: Tables) -> DataFrame:
    d = metrics.confusion(_scored(t).withColumn("p", (F.col("score") > 0.7).cast("int")), "y", "p")
    return d.select("tn", "fp", "fn", "tp", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query(f"WITH d AS ({SCORED}) SELECT round((sum(CASE WHEN a.y = 1 AND b.y = 0 THEN CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END ELSE 0.0 END) / sum(CASE WHEN a.y = 1 AND b.y = 0 THEN 1.0 ELSE 0.0 END))::DOUBLE, 6) AS roc_auc FROM d a, d b")
def roc_auc(t: Tables) -> DataFrame:
    return metrics.roc_auc(_scored(t), "y", "score").select(F.round("roc_auc", 6).alias("roc_auc"))


_CURVE = f"WITH d AS ({SCORED}), s AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY score), c AS (SELECT score, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s WINDOW w AS (ORDER BY score DESC))"


@query(f"{_CURVE} SELECT round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c UNION ALL SELECT 1e9, 0, 0")
def roc_curve(t: Tables) -> DataFrame:
    d = metrics.roc_curve(_scored(t), "y", "score")
    return d.select(F.round(F.least("threshold", F.lit(1e9)), 6).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"{_CURVE} SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS \"precision\", round(tp / p, 6) AS recall FROM c")
def pr_curve(t: Tables) -> DataFrame:
    return metrics.pr_curve(_scored(t), "y", "score").select(*(F.round(c, 6).alias(c) for c in ("threshold", "precision", "recall")))


@query(f"{_CURVE} SELECT round((sum(pos * (tp / (tp + fp))) / max(p))::DOUBLE, 6) AS average_precision FROM c")
def average_precision(t: Tables) -> DataFrame:
    return metrics.average_precision(_scored(t), "y", "score").select(F.round("average_precision", 6).alias("average_precision"))


@query(f"WITH d AS ({SCORED}) SELECT DISTINCT round(score, 6) AS value, count(*) OVER (PARTITION BY score) AS n, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2)::DOUBLE AS rank FROM d")
def rank_ties(t: Tables) -> DataFrame:
    return metrics.ranks(_scored(t), "score").select(F.round("value", 6).alias("value"), "n", "rank")


RESAMPLES = 1000
_H = "('0x' || substr(md5(concat({0}, '|', 42)), 1, 8))::BIGINT"
_EDGES = ", ".join(repr(e) for e in stats.poisson_edges())
_DRAWN = f"""k AS (SELECT *, {_H.format('id')} % {stats.PRIME} AS h FROM ({SCORED})), b AS (SELECT b, {_H.format("'a|', b")} % {stats.PRIME - 1} + 1 AS ha, {_H.format("'b|', b")} % {stats.PRIME} AS hb FROM range({RESAMPLES}) r(b)),
draw AS (SELECT *, len(list_filter([{_EDGES}], lambda e: e <= ((h * ha + hb) % {stats.PRIME}) / {float(stats.PRIME)!r}::DOUBLE)) AS w FROM k, b)"""


@query(f"WITH {_DRAWN}, v AS (SELECT b, sum(w * score) / sum(w) AS m FROM draw WHERE w > 0 GROUP BY b) SELECT round((SELECT avg(score) FROM k), 6) AS point, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM v")
def bootstrap_ci(t: Tables) -> DataFrame:
    got = stats.bootstrap_ci(_scored(t), "id", F.sum(F.col("weight") * F.col("score")) / F.sum("weight"), RESAMPLES)
    return got.select(*(F.round(c, 6).alias(c) for c in ("point", "lo", "hi")))


_RMSE = "sqrt(sum(w * pow(y - {0}, 2)) / sum(w))"


@query(f"WITH {_DRAWN}, v AS (SELECT b, {_RMSE.format('score')} - {_RMSE.format('0.5')} AS d FROM draw WHERE w > 0 GROUP BY b), o AS (SELECT sqrt(avg(pow(y - score, 2))) AS a, sqrt(avg(pow(y - 0.5, 2))) AS b FROM k) SELECT round(any_value(a), 6) AS a, round(any_value(o.b), 6) AS b, round(any_value(a - o.b), 6) AS diff, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(least(1.0, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))), 6) AS p, (quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0) AS significant FROM v, o")
def paired_bootstrap(t: Tables) -> DataFrame:
    got = stats.paired_bootstrap(_scored(t).withColumn("flat", F.lit(0.5)), "id", lambda c: metrics.rmse(F.col("y"), F.col(c), F.col("weight")), "score", "flat", RESAMPLES)
    return got.select(*(F.round(c, 6).alias(c) for c in ("a", "b", "diff", "lo", "hi", "p")), "significant")


_F1 = "2.0 * sum(w * y * ({0})::INT) / (sum(w * y) + sum(w * ({0})::INT))"
_PLANNED = [("rmse", "score", "flat"), ("rmse", "half", "flat"), ("f1", "high", "low"), ("rmse", "score", "absent")]
_PAIRS = {("rmse", "score", "flat"): (_RMSE.format("score"), _RMSE.format("0.5")), ("rmse", "half", "flat"): (_RMSE.format("(score / 2)"), _RMSE.format("0.5")), ("f1", "high", "low"): (_F1.format("score > 0.7"), _F1.format("score > 0.3"))}


@query(f"WITH {_DRAWN}, " + " UNION ALL ".join(f"{'v AS (' * (i == 0)}SELECT '{m}' AS metric, '{a}' AS a, '{b}' AS b, b AS r, {x} - {z} AS d FROM draw WHERE w > 0 GROUP BY b" for i, ((m, a, b), (x, z)) in enumerate(_PAIRS.items())).replace("'score' AS a, 'flat' AS b, b AS r", "'score' AS a, 'flat' AS b, draw.b AS r") + "), one AS (SELECT *, 1 AS w FROM k), o AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, '{a}' AS a, '{b}' AS b, {x} AS va, {z} AS vb FROM one" for (m, a, b), (x, z) in _PAIRS.items()) + ") SELECT metric, a, b, round(any_value(va), 6) AS value_a, round(any_value(vb), 6) AS value_b, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(least(1.0, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))), 6) AS p, (quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0) AS significant FROM v JOIN o USING (metric, a, b) GROUP BY metric, a, b")
def paired_tests(t: Tables) -> DataFrame:
    """Pairs whose columns are missing are skipped."""
    w, y = F.col("weight"), F.col("y")
    f1 = lambda c: 2.0 * F.sum(w * y * F.col(c)) / (F.sum(w * y) + F.sum(w * F.col(c)))
    d = _scored(t).withColumns({"flat": F.lit(0.5), "half": F.col("score") / 2, "high": (F.col("score") > 0.7).cast("int"), "low": (F.col("score") > 0.3).cast("int")})
    got = stats.paired_tests(d, "id", _PLANNED, {"rmse": lambda c: metrics.rmse(y, F.col(c), w), "f1": f1}, RESAMPLES)
    return got.select("metric", "a", "b", *(F.round(c, 6).alias(c) for c in ("value_a", "value_b", "lo", "hi", "p")), "significant")


_AT = "l[floor({q} * (n - 1))::BIGINT + 1] + ({q} * (n - 1) - floor({q} * (n - 1))) * (l[least(floor({q} * (n - 1))::BIGINT + 2, n)] - l[floor({q} * (n - 1))::BIGINT + 1])"


@query(f"WITH d AS (SELECT list_sort(list(p - y)) AS l, count(*) AS n FROM ({LOGS})) SELECT round({_AT.format(q='least(1.0::DOUBLE, ceil((n + 1) * 0.9::DOUBLE) / n)')}, 6) AS hi, round({_AT.format(q='greatest(0.0::DOUBLE, floor((n + 1) * 0.1::DOUBLE) / n)')}, 6) AS lo FROM d")
def conformal_quantiles(t: Tables) -> DataFrame:
    return stats.conformal(_logs(t).withColumn("r", F.col("p") - F.col("y")), "r").select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"WITH d AS ({LOGS}) SELECT grp, count(*) AS n, round(sqrt(avg(pow(p - y, 2))), 6) AS rmse_p, round(avg(p - y), 6) AS bias_p, round(sqrt(avg(pow(p2 - y, 2))), 6) AS rmse_p2, round(avg(p2 - y), 6) AS bias_p2 FROM d GROUP BY grp")
def error_breakdown(t: Tables) -> DataFrame:
    d = stats.breakdown(_logs(t), "grp", "y", ["p", "p2"])
    return d.select("grp", "n", *(F.round(c, 6).alias(c) for c in ("rmse_p", "bias_p", "rmse_p2", "bias_p2")))


@query(f"WITH d AS ({LOGS}) SELECT coalesce(grp, 'All') AS grp, count(*) AS n, round(sqrt(avg(pow(p - y, 2))), 6) AS rmse_p, round(avg(p - y), 6) AS bias_p FROM d GROUP BY ROLLUP (grp)")
def rollup_total(t: Tables) -> DataFrame:
    return stats.breakdown(_logs(t), "grp", "y", ["p"], total="All").select("grp", "n", F.round("rmse_p", 6).alias("rmse_p"), F.round("bias_p", 6).alias("bias_p"))


@query(f"WITH d AS ({LOGS}), e AS (SELECT quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM d) SELECT len(list_filter(q, lambda x: x <= y))::INT AS decile, count(*) AS n, round(avg(abs(p - y)), 6) AS mae FROM d, e GROUP BY 1")
def error_by_decile(t: Tables) -> DataFrame:
    d = _logs(t).withColumn("price", F.exp("y"))
    e = d.agg(F.percentile("y", F.array(*(F.lit(i / 10) for i in range(1, 10)))).alias("q"))
    return d.crossJoin(F.broadcast(e)).groupBy(F.size(F.filter("q", lambda x: x <= F.col("y"))).alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.round(metrics.mae(F.col("y"), F.col("p")), 6).alias("mae"))


@query(f"WITH d AS ({LOGS}), c AS (SELECT cust, count(*) AS n FROM d WHERE id % 2 = 0 GROUP BY cust) SELECT CASE WHEN coalesce(c.n, 0) < 3 THEN 0 WHEN c.n < 6 THEN 1 ELSE 2 END AS density, count(*) AS n, round(avg(abs(p - y)), 6) AS mae FROM d LEFT JOIN c USING (cust) WHERE id % 2 = 1 GROUP BY 1")
def error_vs_density(t: Tables) -> DataFrame:
    d = _logs(t)
    seen = d.where("id % 2 = 0").groupBy("cust").agg(F.count(F.lit(1)).alias("seen"))
    test = d.where("id % 2 = 1").join(seen, "cust", "left")
    return test.groupBy(numeric.digitize(F.coalesce("seen", F.lit(0)), [3, 6]).alias("density")).agg(F.count(F.lit(1)).alias("n"), F.round(metrics.mae(F.col("y"), F.col("p")), 6).alias("mae"))


@query(f"WITH d AS (SELECT id, round(p - y, 2) AS residual FROM ({LOGS})) SELECT id, residual, abs(exp(residual) - 1) > 0.5 AS off FROM d ORDER BY abs(residual) DESC, id LIMIT 10")
def worst_k(t: Tables) -> DataFrame:
    d = _logs(t).select("id", F.round(F.col("p") - F.col("y"), 2).alias("residual"))
    return d.withColumn("off", F.abs(F.exp("residual") - 1) > 0.5).orderBy(F.abs("residual").desc(), "id").limit(10)


@query(f"WITH d AS (SELECT cust % 40 AS g, p - y AS e FROM ({LOGS})), c AS (SELECT g, count(*) AS n FROM d GROUP BY g HAVING count(*) >= 30 ORDER BY n DESC, g LIMIT 12) SELECT coalesce(CAST(c.g AS STRING), 'other') AS grp, count(*) AS n, round(avg(e), 6) AS bias FROM d LEFT JOIN c ON d.g = c.g GROUP BY 1")
def top_groups_other(t: Tables) -> DataFrame:
    d = stats.top_groups(_logs(t).withColumn("g", F.col("cust") % 40), "g", fixed.MAX_DISTRICTS, fixed.MIN_DISTRICT_ROWS)
    return d.groupBy(F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("p") - F.col("y")), 6).alias("bias"))


@query(f"WITH d AS ({LOGS}), g AS (SELECT grp, sqrt(avg(pow(p - y, 2))) AS a, sqrt(avg(pow(p2 - y, 2))) AS b FROM d GROUP BY grp), r AS (SELECT rank() OVER (ORDER BY a) AS a, rank() OVER (ORDER BY b) AS b FROM g) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman_errors(t: Tables) -> DataFrame:
    return explain.spearman(stats.breakdown(_logs(t), "grp", "y", ["p", "p2"]), "rmse_p", "rmse_p2").select(F.round("spearman", 6).alias("spearman"))


@query("WITH g AS (SELECT l_linenumber AS g, count(*)::DOUBLE AS n, sum(l_quantity) AS t FROM lineitem GROUP BY 1), l AS (SELECT * FROM g ORDER BY n DESC LIMIT 3) SELECT round(regr_slope(ln(t), ln(n)), 4) AS slope FROM l")
def loglog_slope(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy("l_linenumber").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_quantity").alias("t"))
    return stats.slope(d, "n", "t").select(F.round("slope", 4).alias("slope"))


@query("WITH s AS (SELECT c_nationkey % 10 AS depth, c_mktsegment AS leaf, avg(c_acctbal) AS m FROM customer GROUP BY ALL) SELECT depth::INT AS depth, leaf, round(m, 6) AS m FROM s ORDER BY round(m, 10) DESC, depth, leaf DESC LIMIT 1")
def model_selection(t: Tables) -> DataFrame:
    d = t.customer.groupBy((F.col("c_nationkey") % 10).alias("depth"), F.col("c_mktsegment").alias("leaf")).agg(F.avg("c_acctbal").alias("m"))
    return d.orderBy(F.round("m", 10).desc(), "depth", F.desc("leaf")).limit(1).select("depth", "leaf", F.round("m", 6).alias("m"))


@query("WITH c AS (SELECT c_nationkey AS location, c_mktsegment AS district, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY n DESC, district) AS rn FROM c), m AS (SELECT c_nationkey AS location, round(median(c_acctbal), 4) AS lat, count(*) AS n FROM customer GROUP BY 1) SELECT location, district, m.lat, m.n FROM r JOIN m USING (location) WHERE rn = 1")
def gazetteer(t: Tables) -> DataFrame:
    d = t.customer.select(F.col("c_nationkey").alias("location"), F.col("c_mktsegment").alias("district"), F.lit("x").alias("city"), F.lit("").alias("tags"), F.col("c_acctbal").alias("lat"), F.lit(0.0).alias("lng"))
    return serve.gazetteer(d).select("location", "district", F.round("lat", 4).alias("lat"), "n")


@query("WITH b AS (SELECT quantile_cont(c_acctbal, 0.005) AS lo, quantile_cont(c_acctbal, 0.995) AS hi FROM customer) SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal NOT BETWEEN lo AND hi THEN 'c_acctbal out of range' END, CASE WHEN c_nationkey % 5 <> 0 AND c_nationkey >= 20 THEN 'unknown location' END, CASE WHEN c_nationkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'no location' END], lambda x: x IS NOT NULL), ',') AS warnings FROM customer, b")
def listing_warnings(t: Tables) -> DataFrame:
    d = t.customer.select("*", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("location"), F.when(F.col("c_custkey") % 2 == 1, 40.0).alias("lat"))
    r = serve.ranges(d, ["c_acctbal"]).first()
    return d.select("c_custkey", F.array_join(serve.warnings(d, {"c_acctbal": (r["lo"], r["hi"])}, F.col("location") < 20), ",").alias("warnings"))


@query("SELECT k, array_to_string(list_filter([CASE WHEN k % 4 = 3 THEN 'category' END, CASE WHEN area NOT BETWEEN 10 AND 3000 THEN 'area_m2' END, CASE WHEN rooms NOT BETWEEN 1 AND 20 THEN 'rooms' END, CASE WHEN fl > tf THEN 'floor_above_total' END, CASE WHEN k % 6 = 0 THEN 'lat_without_lng' END], lambda x: x IS NOT NULL), ',') AS broken FROM (SELECT p_partkey AS k, p_size * 2.0 AS area, p_size % 23 AS rooms, p_size % 10 AS fl, p_partkey % 12 + 1 AS tf FROM part)")
def validate_listings(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    names = F.array(*(F.lit(c) for c in fixed.CATEGORY_LABELS), F.lit("torpaq"))
    broken = serve.violations({"category": F.element_at(names, (k % 4 + 1).cast("int")), "area_m2": size * 2.0, "rooms": size % 23, "floor": size % 10, "total_floors": k % 12 + 1, "lat": F.lit(40.0), "lng": F.when(k % 6 != 0, 49.0)})
    return t.part.select(k.alias("k"), F.array_join(broken, ",").alias("broken"))


@query(f"WITH d AS ({LOGS}) SELECT id, round_even(exp(p) / 100, 0)::DOUBLE * 100 AS price, round_even(exp(p) * exp(-0.2) / 100, 0)::DOUBLE * 100 AS price_low, (p2 - 12 >= 0) AS premium, abs(p2 - 12) < 1 AS inside_margin, (exp(p) > 150000) = (p2 - 12 >= 0) AS models_agree FROM d")
def serve_answers(t: Tables) -> DataFrame:
    a = serve.answer(F.col("p"), (-0.2, 0.25), F.col("p2") - 12, 150000.0)
    return _logs(t).select("id", *(a[c].alias(c) for c in ("price", "price_low", "premium", "inside_margin", "models_agree")))
