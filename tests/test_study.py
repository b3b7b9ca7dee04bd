"""The joined-up run on generated listings, error analysis, and the predictor with its round trip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import text
from terrane.operators import clean, encode, errors, metrics, predictor, stats, study, svm, tree
from terrane.plans import parsing
from terrane.plans import study as study_plans
from terrane.plans.registry import Tables
from terrane.sources import synthetic

FAST = study.Settings(resamples=100, folds=2, trees=2, rounds=2, depth=2, steps=8, fourier=32)


@pytest.fixture(scope="module")
def cleaned(spark):
    d = clean.clean(synthetic.listings(spark, 450), ["estate_rel_url_x", "datetime_scrape_x"]).withColumnRenamed("o0_", "key_")
    return d.cache()


@pytest.fixture(scope="module")
def ready(cleaned):
    return study.prepared(cleaned, "key_").cache()


def test_design_learns_from_the_fit_rows_alone(spark, ready):
    train, test = ready.where("split = 'train'"), ready.where("split = 'test'")
    design = study.Design().fit(train)
    z = np.array([r["z"] for r in design.transform(train).select("z").collect()])
    assert np.abs(z.mean(axis=0)).max() < 1e-9 and all(abs(s - 1) < 1e-6 or s < 1e-9 for s in z.std(axis=0))
    other = study.Design().fit(train)
    odd = test.withColumn("category", F.lit("never seen")).withColumn("rooms", F.lit(None).cast("double"))
    assert other.transform(odd).count() == test.count() and other.names == design.names


def test_run_from_listings_to_numbers(spark, ready):
    """Models of each kind are fitted and judged; most beat the constant median."""
    log = {}
    names = ["median", "ridge", "tree", "forest", "svr_fourier", "tree_tier", "svm_fourier_tier"]
    p = study.final_models(ready, FAST, names, log).cache()
    assert set(log) == {"design", *names} and p.count() == ready.where("split = 'test'").count()
    t = {(r["model"], r["metric"]): r for r in study.test_table(p, names, FAST).collect()}
    for n in ("ridge", "tree", "forest"):
        assert t[n, "rmse_log"]["value"] < t["median", "rmse_log"]["value"] and t[n, "rmse_log"]["lo"] < t[n, "rmse_log"]["value"] < t[n, "rmse_log"]["hi"]
    assert t["tree_tier", "f1"]["value"] > 0.6 and t["svm_fourier_tier", "roc_auc"]["value"] > 0.6
    got = study.comparisons(p, FAST).collect()
    assert {(r["a"], r["b"]) for r in got} >= {("ridge", "median"), ("forest", "tree")} and all(r["metric"] in ("rmse", "f1") for r in got)
    assert next(r for r in got if (r["a"], r["b"]) == ("ridge", "median"))["significant"]


def test_cross_validation_refits_in_each_fold(spark, ready):
    cv = study.cross_validate(ready, FAST, ["median", "ridge"]).cache()
    assert {r["fold"] for r in cv.collect()} == set(range(FAST.folds))
    rows = {(r["model"], r["metric"]): r for r in study.over_folds(cv).collect()}
    values = [r["value"] for r in cv.where("model = 'ridge' and metric = 'rmse_log'").collect()]
    r = rows["ridge", "rmse_log"]
    assert r["folds"] == FAST.folds and r["mean_value"] == pytest.approx(np.mean(values)) and r["std_value"] == pytest.approx(np.std(values))
    folded = encode.with_fold(ready, "id_")
    fit_rows, held = encode.fold_sets(folded, 2)
    assert fit_rows.count() + held.count() == ready.count() and fit_rows.join(held, "id_").count() == 0


def test_curves_and_selection(spark, ready):
    lines = study.learning_curve(ready, FAST, "ridge", (0.3, 1.0)).where("metric = 'rmse_log'").orderBy("share").collect()
    assert lines[0]["rows"] < lines[1]["rows"] and len(lines) == 2
    (d,) = study.tiers(ready)
    d = d.select("area_m2", "lat", "tier", "split").where("lat is not null").cache()
    curve = study.depth_curve(d.where("split = 'train'"), d.where("split = 'val'"), ["area_m2", "lat"], "tier", leaves=(1, 20), depth=3).cache()
    best = study.select_tree(curve).first()
    assert best["val_error"] == min(r["val_error"] for r in curve.collect())
    equal = spark.createDataFrame([(1e-4, 0.9), (1e-3, 0.9), (1e-2, 0.8)], "lam double, f1 double")
    assert study.select_lambda(equal, "f1").first()["lam"] == 1e-3
    x = d.withColumn("a", F.col("area_m2") / 100).where("split = 'train'")
    assert study.lambda_curve(x, x, ["a"], "tier", [1e-3, 1e-1], steps=20).count() == 2
    times = study.scaling(ready, [50, 100], "id_", {"count": lambda s: s.count()}).collect()
    assert [r["n"] for r in times] == [50, 100] and all(r["seconds"] > 0 for r in times)


def test_errors(spark):
    r = np.random.default_rng(0)
    y, e = r.normal(12, 1, 500), r.normal(0, 0.4, 500)
    rows = [(i, float(a), float(a + b), ["p", "q", None][i % 3], int(a > 12), int(a + b > 12)) for i, (a, b) in enumerate(zip(y, e, strict=True))]
    d = spark.createDataFrame(rows, "id long, y double, p double, place string, tier int, label int").cache()
    cut = F.lit(float(np.exp(12.0)))
    wrong = (y > 12) != (y + e > 12)
    near = errors.near_threshold(d, "y", cut, "tier", "label").first()
    assert near["share_rows"] == pytest.approx((np.abs(y - 12) <= 0.1).mean()) and near["share_errors"] == pytest.approx((np.abs(y - 12) <= 0.1)[wrong].mean())
    assert errors.far_off(d, "y", "p").first()[0] == pytest.approx((np.abs(np.expm1(e)) > 0.5).mean())
    bins = {x["bin"]: x["tier_error"] for x in errors.by_distance(d, "y", cut, "tier", "label", [0.5, 1.0]).collect()}
    assert bins[0] == pytest.approx(wrong[np.abs(y - 12) < 0.5].mean()) and len(bins) == 3
    worst = errors.worst(d, "y", "p", "id", 3).collect()
    assert [x["id"] for x in worst] == np.argsort(-np.abs(e))[:3].tolist() and worst[0]["percent"] == pytest.approx(100 * np.expm1(e[worst[0]["id"]]))
    groups = {x["group"]: x for x in errors.by_group(d, F.col("place"), "y", "p", "tier", "label").collect()}
    assert groups["p"]["tier_error"] == pytest.approx(wrong[::3].mean()) and groups[None]["rmse"] == pytest.approx(np.sqrt((e[2::3] ** 2).mean()))
    assert sum(x["n"] for x in errors.by_decile(d, "y", "p").collect()) == 500
    assert {x["density"]: x["n"] for x in errors.by_density(d.limit(0), d, "place", "y", "p", [1.0]).collect()} == {0: 500}
    assert errors.agreement(d.withColumn("q", F.col("p")), "p", "q").first()[0] == 1.0
    fold = spark.createDataFrame([("log_area", 1.0), ("area_m2", 2.0), ("rooms_missing", 0.5), ("district=x", 3.0)], "f string, v double")
    assert {x["feature"]: x["value"] for x in errors.folded_importances(fold, "f", "v").collect()} == {"area": 3.0, "rooms": 0.5, "district": 3.0}
    lost = errors.precision_lost(spark.createDataFrame([(1.0,), (1.0 + 1e-12,)], "x double"), ["x"]).first()
    assert (lost["doubles"], lost["floats"]) == (2, 1)
    few = spark.createDataFrame([(f"l{i % 20}", 100.0 * (i % 20 + 1), 10.0) for i in range(60)], "location string, price double, area double")
    assert errors.price_level(few, "location", "price", "area").count() == 12 and errors.price_level(few, "location", "price", "area", least=3, most=5).first()["price_m2"] == 200.0


def test_predictor(spark, cleaned, tmp_path):
    model = predictor.PricePredictor.fit(cleaned, "key_", FAST)
    asked = [
        (1, "yeni tikili", 80.0, 3.0, 4.0, 9.0, "nesimi r.", None, None),
        (2, "yeni tikili", 80.0, 3.0, 12.0, 9.0, "nesimi r.", None, None),
        (3, "torpaq", 80.0, 3.0, 4.0, 9.0, None, None, None),
        (4, "kohne tikili", 80.0, None, None, None, "atlantis r.", None, None),
        (5, "kohne tikili", 2900.0, None, None, None, None, 40.4, 49.9),
    ]
    d = spark.createDataFrame(asked, "id long, category string, area_m2 double, rooms double, floor double, total_floors double, location string, lat double, lng double")
    rows = {r["id"]: r for r in model.predict(d, "id").collect()}
    assert model.predict(d, "id").columns == ["id", *predictor.OUTPUT.names]
    assert rows[2]["violations"] == ["floor_above_total"] and rows[3]["violations"] == ["category"] and rows[4]["violations"] == ["location"] and rows[4]["price"] is None
    one = rows[1]
    assert one["violations"] == [] and one["price_low"] <= one["price"] <= one["price_high"] and one["trees_low"] <= one["price"] * 1.02 and one["price"] <= one["trees_high"] * 1.02
    assert one["price"] % 100 == 0 and 1 <= len(one["factors"]) <= 6 and "area_m2 out of range" in rows[5]["warnings"]
    assert model.filled(d.where("id = 1")).select("known_", F.col("lat").isNotNull()).first()[:] == (True, True)
    model.save(f"{tmp_path}/bundle")
    again = predictor.PricePredictor.load(spark, f"{tmp_path}/bundle")
    assert again.predict(d, "id").orderBy("id").collect() == model.predict(d, "id").orderBy("id").collect()
    assert again.card() == model.card() and model.card()["test"]["forest.rmse_log"] > 0
    assert {r["field"] for r in model.options().collect()} == {"category", "location"}


def test_six_metrics(spark):
    d = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.9), (1, 0, 0.4), (0, 1, 0.6)], "y int, p int, s double")
    r = metrics.classification_metrics(d, "y", "p", "s").first()
    assert r["accuracy"] == 0.5 and r["f1"] == 0.5 and r["roc_auc"] == 0.75 and set(r.asDict()) == {"accuracy", "precision", "recall", "f1", "roc_auc", "average_precision"}
    assert svm.rate("constant", 5, 1.0, 0.3) == 0.3


def test_cleaning_shuffles_twice_and_keeps_what_the_stages_keep(spark, small):
    raw = parsing.listings(Tables(spark, small))
    got = clean.clean(raw, parsing.ORDER)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number") == 2
    want = clean.staged(raw, parsing.ORDER).where(F.col("step_") == len(clean.STEPS) - 1)
    want = clean.nullified(want).select(got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_prices_are_kept(spark, small):
    """What reads the divided listings again doesn't clean them again."""
    for d in (study_plans.prices(Tables(spark, small)), study_plans.ready(Tables(spark, small))):
        assert d.storageLevel.useMemory and d.storageLevel.useDisk
        assert "Relation [l_orderkey" not in d.where("split = 'test'")._jdf.queryExecution().withCachedData().toString()
    spark.catalog.clearCache()


def test_both_ways_read_a_number_alike(spark):
    texts = ["12 ", "-3", "120 m²", "1 000", "1,5", "1,234,567", "12.5 sot", "x", "", None, "5-", "5 m-7", "1e5", "1.5.", " 7", "3\n", "12-15", "7 000", "8.", "-1 .5", "9 ²"]
    d = spark.createDataFrame([(s,) for s in texts], "s string")
    assert all(r[0] == r[1] for r in d.select(text.parse_number(F.col("s")), text._parse_number(F.col("s"))).collect())


def test_scope_is_known_without_all_rows(spark):
    """A table has categories if a latest row has one; an older row's doesn't count."""
    rows = [("a", "2020", "yeni tikili", "90000"), ("a", "2021", None, "90000"), ("b", "2020", None, "80000")]
    made = lambda more: spark.createDataFrame([(k, w, c, p, f"{i + 50} m2") for i, (k, w, c, p) in enumerate(rows + more)], "estate_rel_url string, scraped_at string, kateqoriya string, qiymet string, sahe string")
    order = ["estate_rel_url", "scraped_at", "kateqoriya", "qiymet", "sahe"]
    assert clean.clean(made([]), order).count() == 2
    assert clean.clean(made([("c", "2020", "yeni tikili", "70000")]), order).count() == 1


def test_split_moves_no_row(spark):
    """A row's side is a comparison with where the shares end; equal keys go the long way."""
    d = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("id_"), (F.col("id") % 10).cast("int").alias("stratum"), F.exp(F.col("id") % 97 + 1).alias("price_azn"))
    got = study.divided(d)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.exceptAll(encode.with_split(encode.with_strata(d, "price_azn"), "id_").select(got.columns)).isEmpty()
    same = d.withColumn("id_", F.lit(None).cast("string"))
    sizes = lambda x: sorted(tuple(r) for r in x.groupBy("stratum", "split").count().collect())
    assert sizes(encode.with_split_at(same, "id_")) == sizes(encode.with_split(same, "id_"))
    assert encode.with_split_at(d.limit(0), "id_").count() == 0


def test_intervals_of_all_models_in_one_pass(spark):
    """What one model at a time gives, without a row for each resample."""
    d = spark.range(700).select(F.col("id").cast("string").alias("id_"), F.rand(1).alias("log_price"), F.rand(2).alias("m"), (F.rand(3) < 0.4).cast("int").alias("tier"), (F.rand(4) < 0.4).cast("int").alias("s_label"), F.rand(5).alias("s")).cache()
    w = F.col("weight")
    got = study.intervals(d, ["m", "s"], FAST)
    for n, metric in (("m", metrics.rmse(F.col("log_price"), F.col("m"), w)), ("s", study.f1(F.col("tier"), F.col("s_label"), w))):
        want = stats.bootstrap_ci(d, "id_", metric, FAST.resamples, seed=FAST.seed).first()
        assert got[n] == pytest.approx((want["lo"], want["hi"]), abs=1e-12)
    assert study.intervals(d.limit(0), ["m"], FAST) == {"m": (None, None)}


def test_kept_rows_are_planned_from_themselves(spark, small):
    """Jobs on kept rows don't carry the plan of the cleaning."""
    d = study_plans.ready(Tables(spark, small))
    assert d._jdf.queryExecution().analyzed().toString().count("\n") < 5
    spark.catalog.clearCache()


def test_driver_and_windows_find_the_same_splits(spark, monkeypatch):
    d = spark.range(4000).select(F.col("id").cast("string").alias("id_"), F.when(F.rand(1) < 0.1, None).otherwise(F.floor(F.rand(2) * 9)).alias("a"), F.rand(3).alias("b"), (F.rand(4) < 0.5).cast("int").alias("c")).withColumn("y", F.coalesce("a", F.lit(3)) + F.sin(9 * F.col("b")) + F.col("c")).cache()
    grown = lambda: [[(n.feature, n.threshold, n.left, n.n) for n in t.nodes] for t in tree.forest(d, ["a", "b", "c"], "y", "id_", trees=2, task="regression", max_depth=3).trees]
    one = grown()
    monkeypatch.setattr(tree, "CELLS", 0)
    assert one == grown() and len(one[0]) > 5
