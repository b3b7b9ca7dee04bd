"""Cleaning, encoding, splits, metrics and models on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import numbering, quantiles
from terrane.operators import clean, encode, explain, linear, metrics, stats, svm, tree
from terrane.operators.features import make_features
from terrane.sources import files, synthetic


@pytest.fixture(scope="module")
def raw(spark):
    return synthetic.listings(spark, 400)


def test_clean_and_log(spark, raw):
    order = ["estate_rel_url_x", "datetime_scrape_x"]
    log = [r["n_rows"] for r in clean.cleaning_log(raw, order).orderBy("step_no").collect()]
    assert log == sorted(log, reverse=True) and log[0] == raw.count() and log[1] == 400
    d = clean.clean(raw, order)
    assert d.count() == log[-1]
    assert d.where("price_azn not between 5000 and 15000000 or area_m2 not between 10 and 3000 or floor > total_floors").count() == 0
    assert d.where("category = 'torpaq'").count() == 0
    f = make_features(d)
    assert f.where("log_area is null").count() == 0


def test_blank_keys_are_kept(spark):
    d = spark.createDataFrame([(" ", "a", 1), (" ", "b", 2), ("k", None, 3), ("k", "z", 4)], "key string, at string, n int")
    assert sorted(r["n"] for r in d.where("true").withColumn("l", clean.latest(d, "key", "at", ["n"])).where("l").collect()) == [1, 2, 3]


def test_attribute_blob(spark):
    d = spark.createDataFrame([("100", '{"Sahə": "85 m²", "Otaq sayı": "3"}'), ("200", "Sahə: 40 m²; Otaq sayı: 1")], "price string, attributes string")
    out = clean.fill_from_attributes(clean.canonicalize(d))
    assert [(r["area_raw"], r["rooms_raw"]) for r in out.collect()] == [("85 m²", "3"), ("40 m²", "1")]


def test_dropped_columns():
    got = clean.dropped_columns(["price", "price_x", "owner_id", "img_1", "vip", "listing_key", "area_raw"])
    assert got == {"leakage": ["price_x"], "identifiers": ["owner_id", "img_1", "listing_key"], "listing_meta": ["vip"]}


def test_preprocessor_learns_from_fit_rows(spark):
    fit = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, "b")], "x double, c string")
    p = encode.Preprocessor(["x"], [], ["c"], ["x"], [], min_count=2).fit(fit)
    assert p.names() == ["x", "x_missing", "c=a", "c=other"]
    new = spark.createDataFrame([(None, "new"), (100.0, None), (5.0, "a")], "x double, c string")
    assert [r["x_"] for r in p.transform(new, "x_").collect()] == [[2.0, 1.0, 0.0, 1.0], [100.0, 0.0, 0.0, 1.0], [5.0, 0.0, 1.0, 0.0]]


def test_split_and_folds(spark):
    d = encode.with_strata(synthetic.homes(spark, 1000), "price")
    s = encode.with_split(d, "row_id")
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(n.values()) == 1000 and abs(n["test"] - 150) <= 5 and abs(n["val"] - 150) <= 5
    assert s.select("row_id", "split").exceptAll(encode.with_split(d, "row_id").select("row_id", "split")).count() == 0
    assert {r["fold"] for r in encode.with_fold(d, "row_id").select("fold").distinct().collect()} == set(range(5))


def test_metrics(spark):
    r = random.Random(0)
    rows = [(r.randint(0, 1), round(r.random(), 1)) for _ in range(300)]
    d = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(d, "y", "s").first()[0] == pytest.approx(want)
    assert metrics.roc_auc(d.where("y = 1"), "y", "s").first()[0] is None
    empty = metrics.confusion(spark.createDataFrame([(0, 0)], "y int, p int"), "y", "p").first()
    assert (empty["precision"], empty["recall"], empty["f1"]) == (0.0, 0.0, 0.0)
    ranks = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (5.0,)], "v double")
    assert {x["value"]: x["rank"] for x in metrics.ranks(ranks, "v").collect()} == {5.0: 1.0, 10.0: 2.0, 20.0: 3.5}
    assert spark.createDataFrame([(1.0, 2.0)], "y double, p double").agg(metrics.r2(F.col("y"), F.col("p"))).first()[0] == 0.0


def test_paired_bootstrap_of_equals(spark):
    d = spark.range(50).select("id", F.col("id").cast("double").alias("y"), (F.col("id") + 1.0).alias("a"))
    got = stats.paired_bootstrap(d.withColumn("b", F.col("a")), "id", lambda c: metrics.rmse(F.col("y"), F.col(c), F.col("weight")), "a", "b", 50).first()
    assert got["p"] == 1.0 and not got["significant"]


def _best(x, y):
    """Exact split by brute force: (feature, threshold)."""
    gini = lambda v: 1 - sum((v == c).mean() ** 2 for c in (0, 1)) if len(v) else 0.0
    out = []
    for j in range(x.shape[1]):
        u = np.unique(x[:, j])
        for a, b in zip(u, u[1:], strict=False):
            t = (a + b) / 2
            left = x[:, j] <= t
            out.append((-round(gini(y) - left.mean() * gini(y[left]) - (~left).mean() * gini(y[~left]), 10), j, t))
    return min(out)[1:]


def test_tiny_tree(spark):
    x = [(1.0, 5.0, 0), (2.0, 3.0, 0), (3.0, 4.0, 0), (3.0, 1.0, 0), (4.0, 2.0, 1), (5.0, 5.0, 1), (6.0, 1.0, 1), (7.0, 3.0, 0)]
    d = spark.createDataFrame(x, "x0 double, x1 double, y int")
    t = tree.grow(d, ["x0", "x1"], "y")[0]
    a = np.array(x)
    f, threshold = _best(a[:, :2], a[:, 2])
    assert (t.nodes[0].feature, t.nodes[0].threshold) == (f"x{f}", threshold) == ("x0", 3.5)
    assert d.where(t.predict() != F.col("y")).count() == 0
    shallow = tree.grow(d, ["x0", "x1"], "y", max_depth=1)[0]
    assert d.where(t.predict(1) != shallow.predict()).count() == 0
    assert sum(t.importances().values()) == pytest.approx(1.0)
    parts = t.path_effects(["x0", "x1"])
    off = d.select(F.abs(F.lit(t.value(t.nodes[0])[1]) + parts["x0"] + parts["x1"] - t.probability()).alias("e"))
    assert off.agg(F.max("e")).first()[0] < 1e-9
    assert tree.compare(t, t)["same_split"] == sum(n.left is not None for n in t.nodes)


def test_many_values_cross_buckets(spark):
    """More distinct values than buckets: running sums over buckets agree with one sweep."""
    r = np.random.default_rng(1)
    x = r.permutation(400).astype(float)
    y = (x + r.normal(0, 60, 400) > 170).astype(int)
    d = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y int")
    assert tree.grow(d, ["x"], "y", max_depth=1)[0].nodes[0].threshold == _best(x[:, None], y)[1]


def test_forest_and_boosting(spark):
    d = synthetic.homes(spark, 300).select(F.col("row_id").alias("id_"), "area", "rooms", F.ln("price").alias("p")).cache()
    m = tree.forest(d, ["area", "rooms"], "p", "id_", trees=3, max_features=None, task="regression", max_depth=3)
    assert d.where(m.out_of_bag().isNotNull()).count() > 150
    b = tree.boost(d, ["area", "rooms"], "p", trees=2, rate=0.5, max_depth=2)
    e = d.agg(*(F.avg(F.pow(F.col("p") - b.predict(k), 2)) for k in range(3))).first()
    assert e[0] > e[1] > e[2]


def test_linear_models(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3))
    y = x @ [1.0, 2.0, 3.0] + 5 + r.normal(0, 0.1, 300)
    d = spark.createDataFrame([(*map(float, a), float(b), int(b > 5)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double, t int").cache()
    m = linear.Ridge(2.0, ["a", "b", "c"]).fit(d, "y")
    xc, yc = x - x.mean(0), y - y.mean()
    assert m.coef == pytest.approx(np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc))
    p = linear.PCA(["a", "b", "c"]).fit(d)
    assert p.variance == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    s = svm.PegasosSVM(["a", "b", "c"], lam=0.01, steps=30, average=True).fit(d, "t")
    assert d.where(s.predict() != F.col("t")).count() < 30 and s.history[-1] < s.history[0]
    v = svm.PegasosSVR(["a", "b", "c"], lam=0.001, steps=40).fit(d, "y")
    assert d.agg(F.avg(F.abs(F.col("y") - v.predict()))).first()[0] < 1.5
    k = linear.KMeans(["a"], 2).fit(d, [[-1.0], [1.0]])
    assert k.centres[0][0] < 0 < k.centres[1][0]
    assert svm.fit_grid(d.withColumn("id", F.monotonically_increasing_id()), ["a", "b"], "t", "id", [0.01, 0.1], epochs=1).count() == 2
    with pytest.raises(ValueError, match="0 and 1"):
        svm.PegasosSVM(["a"]).fit(d.withColumn("t", F.lit(3)), "t")


def test_kernel_error_falls(spark):
    d = spark.range(30).select("id", (F.col("id") % 7 / 7).alias("a"), (F.col("id") % 5 / 5).alias("b"))
    e = [svm.kernel_error(d, svm.FourierFeatures(["a", "b"], n, 1.0), "id").first()["mean_error"] for n in (16, 1024)]
    assert e[1] < e[0]


def test_permutation_importance(spark):
    d = spark.range(200).select("id", F.rand(1).alias("x"), F.rand(2).alias("z")).withColumn("y", 2 * F.col("x")).cache()
    got = explain.importance(d, "id", {"x": ["x"], "z": ["z"]}, lambda s: s.agg(F.avg(F.abs(2 * F.col("x") - F.col("y")))).first()[0], repeats=2)
    assert got["x"][0] > 0.1 and abs(got["z"][0]) < 1e-12


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('price,note\n"1 000",NA\n5,"x\ny"\n')
    assert files.find_data_file(folder=str(tmp_path)) == str(tmp_path / "a.csv")
    d = files.load_raw(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in d.collect()] == [("1 000", None), ("5", "x\ny")]
    assert len(files.fingerprint(spark, str(tmp_path / "a.csv")).first()["sha256"]) == 64
    assert files.to_jsonable({"a": float("nan"), "_b": 1, "c": [np.float64(2)]}) == {"a": None, "c": [2.0]}
    files.save_bundle(spark, str(tmp_path / "m"), "ridge", {"w": spark.range(2)}, {"x": 1})
    tables, notes = files.load_bundle(spark, str(tmp_path / "m"), "ridge")
    assert tables["w"].count() == 2 and notes == {"x": 1}
    with pytest.raises(ValueError, match="ridge"):
        files.load_bundle(spark, str(tmp_path / "m"), "svm")
    with pytest.raises(FileNotFoundError):
        files.find_data_file("nowhere.csv")


def test_interval_skips_resamples_without_a_value(spark):
    d = spark.createDataFrame([(float(i),) for i in range(39)] + [(float("nan"),)] * 5 + [(None,)], "v double")
    got = stats.interval(d, "v").first()
    assert got["lo"] == pytest.approx(np.percentile(range(39), 2.5)) and got["hi"] == pytest.approx(np.percentile(range(39), 97.5))
    assert stats.interval(d.where("isnan(v)"), "v").first()["lo"] is None


def test_bootstrap_approaches_the_standard_error(spark):
    x = np.random.default_rng(3).normal(size=400)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    got = stats.bootstrap_ci(d, "id", F.sum(F.col("weight") * F.col("x")) / F.sum("weight"), 1000).first()
    assert got["point"] == pytest.approx(x.mean()) and (got["hi"] - got["lo"]) / 2 == pytest.approx(1.96 * x.std() / 20, rel=0.15)


def test_running_sums_against_brute_force(spark):
    r = np.random.default_rng(5)
    v = np.unique(np.round(r.normal(size=3000), 3))
    d = spark.createDataFrame([(float(x), int(n)) for x, n in zip(v, r.integers(0, 9, len(v)), strict=True)], "v double, n long")
    for descending in (False, True):
        rows = sorted(d.collect(), key=lambda x: x["v"], reverse=descending)
        want = dict(zip([x["v"] for x in rows], np.cumsum([x["n"] for x in rows]).tolist(), strict=True))
        assert {x["v"]: x["s"] for x in numbering.running(d, "v", {"s": "n"}, descending).collect()} == want
    assert numbering.running(d.limit(0), "v", {"s": "n"}).count() == 0


def test_permutation_is_of_the_whole_table(spark):
    """Values change places over all rows, whatever their number, and none is lost."""
    for n in (1, 7, 25_000):
        d = spark.range(n).withColumn("x", F.col("id"))
        got = explain.permuted(d, "id", ["x"], 3)
        assert got.agg(F.sum("x"), F.count_distinct("x")).first()[:] == (n * (n - 1) // 2, n)
        if n > 7:
            assert abs(got.agg(F.corr("id", "x")).first()[0]) < 0.03


def test_trees_without_a_depth_bound(spark):
    """Unbounded growth separates all rows; beyond SMALL nodes the node tables predict what the expression does."""
    r = np.random.default_rng(2)
    x = r.permutation(400).reshape(200, 2).astype(float)
    y = r.integers(0, 2, 200)
    d = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id_ long, a double, b double, y int")
    t = tree.grow(d, ["a", "b"], "y", max_depth=None)[0]
    assert d.where(t.predict() != F.col("y")).count() == 0
    small = d.select("id_", t.predict().alias("p"), t.node_id(3).alias("n"), t.probability(depth=2).alias("q")).orderBy("id_").collect()
    effects = t.path_effects(["a", "b"])
    total = d.select((effects["a"] + effects["b"] + t.value(t.nodes[0])[1] - t.probability()).alias("gap")).agg(F.max(F.abs("gap"))).first()[0]
    assert total < 1e-12
    tree.SMALL, kept = 0, tree.SMALL
    try:
        assert d.select("id_", t.predict().alias("p"), t.node_id(3).alias("n"), t.probability(depth=2).alias("q")).orderBy("id_").collect() == small
        assert tree.grow(d, ["a", "b"], "y", max_depth=None)[0].table() == t.table()
    finally:
        tree.SMALL = kept
    with pytest.raises(ValueError, match="criterion"):
        tree.grow(d, ["a"], "y", criterion="mse")


def test_missing_values_go_right(spark):
    d = spark.createDataFrame([(0, 1.0, 0), (1, 2.0, 1), (2, None, 1), (3, 1.0, 0)], "id_ int, a double, y int")
    t = tree.grow(d, ["a"], "y", max_depth=1)[0]
    want = {0: 0, 1: 1, 2: 1, 3: 0}
    assert {r["id_"]: r["p"] for r in d.select("id_", t.predict().alias("p")).collect()} == want
    tree.SMALL, kept = 0, tree.SMALL
    try:
        assert {r["id_"]: r["p"] for r in d.select("id_", t.predict().alias("p")).collect()} == want
    finally:
        tree.SMALL = kept


def test_out_of_bag_share_and_stages(spark):
    d = synthetic.homes(spark, 800).select(F.col("row_id").alias("id_"), "area", F.col("price").alias("p"))
    m = tree.forest(d, ["area"], "p", "id_", trees=3, max_features=None, task="regression", max_depth=2)
    share = d.agg(F.avg(m.out_of_bag().isNull().cast("double"))).first()[0]
    assert abs(share - (1 - np.exp(-1)) ** 3) < 0.06  # drawn by all three
    r = d.select(m.staged().alias("s"), m.predict().alias("p"), m.predict(1).alias("p1"), *(c.alias(n) for n, c in zip(("lo", "hi"), m.spread(), strict=True)), m.each().alias("e")).limit(50).collect()
    assert all(x["s"][-1] == pytest.approx(x["p"]) and x["s"][0] == pytest.approx(x["p1"]) for x in r)
    assert all(x["lo"] == pytest.approx(np.quantile(x["e"], 0.1)) and x["hi"] == pytest.approx(np.quantile(x["e"], 0.9)) for x in r)


def test_compare_tells_kinds_of_nodes(spark):
    d = spark.createDataFrame([(float(i), float(i) * 2, i // 4) for i in range(8)], "a double, b double, y int")
    of = lambda f, c: tree.Tree(nodes=[tree.Node(0, 0, 8, [4, 4], 0.5, f, c, 1, 2, 0.5), tree.Node(1, 1, 4, [4, 0], 0.0), tree.Node(2, 1, 4, [0, 4], 0.0)])
    a = of("a", 3.5)
    assert tree.compare(a, of("b", 7.0), d)["same_partition"] == 1 and tree.compare(a, of("b", 5.0), d)["tie"] == 1
    assert tree.compare(a, of("a", 3.5 + 3e-8), d)["float32"] == 1 and tree.compare(a, tree.Tree(nodes=a.nodes[1:2] + a.nodes), d)["decision_mismatch"] == 1


def test_labels_of_any_kind(spark):
    d = spark.createDataFrame([(0.0, "no"), (1.0, "no"), (2.0, "yes"), (3.0, "yes")], "x double, y string")
    names = tree.Labels.of(d, "y")
    t = tree.grow(d.withColumn("k", names.number(F.col("y"))), ["x"], "k", classes=len(names.values))[0]
    assert d.where(names.value(t.predict()) != F.col("y")).count() == 0
    s = svm.PegasosSVM(["x"], lam=0.01, steps=200, average=True).fit(d, "y")
    assert s.labels == ("no", "yes") and {r[0] for r in d.select(s.predict()).collect()} <= {"no", "yes"} and len(s.history) == 200


def test_fourier_models(spark):
    """On a ring, Fourier features separate what a line can't; on a wave, they follow it."""
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 2))
    d = spark.createDataFrame([(float(a), float(b), int(a * a + b * b > 1.4), float(np.sin(2 * a))) for a, b in x], "a double, b double, y int, v double").cache()
    right = lambda m, e: e.agg(F.avg((m.predict() == F.col("y")).cast("double"))).first()[0]
    flat = svm.PegasosSVM(["a", "b"], lam=0.01, steps=40, average=True).fit(d, "y")
    ring = svm.rff_svm(["a", "b"], 128, 0.5, lam=0.001, steps=60, average=True).fit(d, "y")
    assert right(ring.model, ring.transform(d)) > max(0.9, right(flat, d) + 0.1)
    wave = svm.rff_svr(["a"], 64, 1.0, lam=1e-4, steps=150, epsilon=0.05).fit(d, "v")
    assert wave.transform(d).agg(F.avg(F.abs(wave.model.predict() - F.col("v")))).first()[0] < 0.25


def test_quantiles_in_two_passes(spark, monkeypatch):
    """Brackets give what the plain percentile gives, ties, negatives and nulls included."""
    r = np.random.default_rng(8)
    v = np.concatenate([np.round(r.normal(size=4000), 2), np.full(1500, 0.25)])
    d = spark.createDataFrame([(float(x), None if i % 3 else float(i)) for i, x in enumerate(v)], "a double, b double")
    at = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    columns = {"a": F.col("a"), "b": F.col("b")}
    plain = quantiles.quantiles(d, columns, at)
    monkeypatch.setattr(quantiles, "FEW", 10)
    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    got = quantiles.quantiles(d, columns, at)
    for c in columns:
        assert got[c] == pytest.approx(plain[c])
    assert plain["a"] == pytest.approx(np.quantile(v, at).tolist())
    assert quantiles.quantile(d.limit(0), F.col("a")) is None
