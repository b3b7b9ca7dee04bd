"""Prices and tiers of listings as a batch transform: fitted on cleaned listings, saved as tables, applied to any number of rows.

A listing that names a known location takes its district, city, tags and, where it has none, coordinates from the gazetteer. The
price comes from a forest of the log price per square metre with the log area put back, its range from out-of-bag residuals, the
tier from a linear classifier on Fourier features, the factors from the paths through the trees."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import fixed, numeric, storage, text
from terrane.functions.quantiles import quantile
from terrane.operators import encode, serve, stats, study, svm, tree
from terrane.operators.features import make_features
from terrane.sources import files

KIND = "price predictor"
#: The fields of a listing to be priced; the first two are needed.
INPUT = T.StructType([T.StructField(n, t) for n, t in [("category", T.StringType()), ("area_m2", T.DoubleType()), ("rooms", T.DoubleType()), ("floor", T.DoubleType()), ("total_floors", T.DoubleType()), ("land_area_sot", T.DoubleType()), ("location", T.StringType()), ("lat", T.DoubleType()), ("lng", T.DoubleType()), ("repair", T.DoubleType()), ("mortgage", T.DoubleType()), ("bill_of_sale", T.DoubleType()), ("building_type", T.StringType()), ("description", T.StringType())]])
#: The columns of an answer.
OUTPUT = T.StructType([T.StructField(n, t) for n, t in [("price", T.DoubleType()), ("price_low", T.DoubleType()), ("price_high", T.DoubleType()), ("trees_low", T.DoubleType()), ("trees_high", T.DoubleType()), ("premium", T.BooleanType()), ("score", T.DoubleType()), ("inside_margin", T.BooleanType()), ("models_agree", T.BooleanType()), ("warnings", T.ArrayType(T.StringType())), ("factors", T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("percent", T.DoubleType())]))), ("violations", T.ArrayType(T.StringType()))]])
#: What the gazetteer knows of a place; places up to which it is broadcast.
FILLED, PLACES = ("district", "city", "tags", "lat", "lng"), 100_000
#: Numbers whose plausible range is learned.
RANGED = ["area_m2", "rooms", "floor", "total_floors", "land_area_sot"]


@dataclass
class PricePredictor:
    settings: study.Settings
    design: study.Design
    forest: tree.Forest
    classifier: svm.PegasosSVM
    band: tuple[float, float]
    threshold: float
    places: DataFrame
    bounds: dict[str, tuple[float, float]]
    honest: dict[str, float]
    baseline_log: float

    @classmethod
    def fit(cls, cleaned: DataFrame, key: str, settings: study.Settings | None = None) -> PricePredictor:
        """Test numbers come from models of the development rows; the models that serve are fitted on all rows."""
        settings = settings or study.Settings.make()
        featured = storage.kept(study.featured(cleaned, key))
        d = storage.replaced(featured, storage.kept(study.divided(featured, settings.seed)))
        honest = ["forest", "svm_fourier_tier"]
        numbers = {f"{m}.{k}": v for m, k, v in study.numbers(study.final_models(d, settings, honest), honest)}
        (rows,) = study.tiers(d)
        threshold = quantile(d, F.col("price_azn")) or 0.0
        design = study.Design().fit(rows)
        train = design.encoded(rows).withColumn("per_m2", F.col("log_price") - F.col("log_area"))
        forest = tree.forest(train, design.names, "per_m2", "id_", trees=settings.trees, max_features=max(1, len(design.names) // 3), seed=settings.seed, task="regression", max_depth=settings.depth, min_leaf=1)
        phi = svm.PegasosSVM(design.fourier(settings.fourier, settings.gamma, settings.seed), lam=settings.lam, steps=settings.steps, average=True).fit(train, "tier")
        residuals = storage.kept(train.select((F.col("per_m2") - forest.out_of_bag()).alias("r_")))
        r = stats.conformal(residuals, "r_").first()
        residuals.unpersist()
        bounds = {x["column"]: (x["lo"], x["hi"]) for x in serve.ranges(rows, RANGED).collect()}
        places = serve.gazetteer(rows)
        places = rows.sparkSession.createDataFrame(places.collect(), places.schema) if places.limit(PLACES + 1).count() <= PLACES else places  # a row for each place
        base = quantile(rows, F.col("log_price")) or 0.0
        d.unpersist()
        return cls(settings, design, forest, phi, (float(r["lo"] or 0.0), float(r["hi"] or 0.0)), threshold, places, bounds, numbers, base)

    def filled(self, listings: DataFrame) -> DataFrame:
        return filled(listings, self.places)

    def predict(self, listings: DataFrame, key: str, factors: int = 6) -> DataFrame:
        """key and OUTPUT of each listing. One that breaks a rule, an unknown location among them, gets its violations and nulls."""
        raw = {f.name: (F.col(f.name) if f.name in listings.columns else F.lit(None)).cast(f.dataType) for f in INPUT}
        d = self.filled(listings.withColumn("broken_", serve.violations(raw)).withColumn("given_lat_", raw["lat"]))
        unknown = F.col("location").isNotNull() & ~F.col("known_")
        d = d.withColumn("broken_", F.when(unknown, F.concat("broken_", F.array(F.lit("location")))).otherwise(F.col("broken_")))
        notes = serve.warnings(d.withColumn("lat", F.col("given_lat_")), {c: b for c, b in self.bounds.items() if b[0] is not None}, F.col("known_"))
        features = make_features(d.withColumns({"id_": F.col(key), "notes_": notes, "price_azn": F.lit(None).cast("double")}))
        x = self.design.encoded(features).withColumn("score_", self.classifier.score())
        low, high = self.forest.spread()
        log_price, area = self.forest.predict() + F.col("log_area"), F.col("log_area")
        a = serve.answer(log_price, self.band, F.col("score_"), self.threshold)
        effects = self.forest.path_effects(self.design.names)
        folded = {}
        for name, label in zip(self.design.names, self.design.labels, strict=True):
            folded.setdefault(base_of(label), []).append(effects[name])
        parts = F.array(*(F.struct(F.lit(f).alias("feature"), F.expm1(sum(cs[1:], cs[0])).alias("percent")) for f, cs in folded.items()))
        top = F.slice(F.sort_array(F.transform(parts, lambda p: F.struct(F.abs(p["percent"]).alias("size"), p["feature"].alias("feature"), (100 * p["percent"]).alias("percent"))), asc=False), 1, factors)
        out = {**a, "trees_low": numeric.to_hundreds(F.exp(low + area)), "trees_high": numeric.to_hundreds(F.exp(high + area)), "score": F.col("score_"), "warnings": F.col("notes_"), "factors": F.transform(top, lambda p: F.struct(p["feature"].alias("feature"), p["percent"].alias("percent")))}
        fine = F.size("broken_") == 0
        return x.select(F.col("id_").alias(key), *(F.when(fine, out[f.name]).cast(f.dataType).alias(f.name) for f in OUTPUT if f.name != "violations"), F.col("broken_").alias("violations"))

    def options(self) -> DataFrame:
        """(field, value, label) of what a form may offer: categories, and locations by name."""
        spark = self.places.sparkSession
        kinds = spark.createDataFrame([("category", k, v) for k, v in fixed.CATEGORY_LABELS.items()], "field string, value string, label string")
        return kinds.unionByName(self.places.select(F.lit("location").alias("field"), F.col("location").alias("value"), text.location_label(F.col("location")).alias("label")))

    def card(self) -> dict[str, object]:
        """What a reader should know of the model."""
        return {"kind": KIND, "threshold": self.threshold, "band_percent": [100 * (float(np.exp(b)) - 1) for b in self.band], "baseline_price": float(np.exp(self.baseline_log)), "test": self.honest, "trees": len(self.forest.trees), "nodes": sum(len(t.nodes) for t in self.forest.trees), "features": len(self.design.names)}

    def save(self, path: str) -> None:
        spark = self.places.sparkSession
        nodes = [(k, n.id, n.depth, float(n.n), [float(s) for s in n.sums], float(n.impurity), n.feature, n.threshold, n.left, n.right, float(n.gain)) for k, t in enumerate(self.forest.trees) for n in t.nodes]
        tables = {"nodes": spark.createDataFrame(nodes, "tree int, id int, depth int, n double, sums array<double>, impurity double, feature string, threshold double, left int, right int, gain double"), "places": self.places}
        pre, m = self.design.pre, self.classifier
        notes = {"settings": asdict(self.settings), "pre": {**{k: getattr(pre, k) for k in ("numeric", "binary", "categorical", "indicators", "multilabel", "medians", "flags", "levels", "labels")}}, "mean": self.design.mean, "deviation": self.design.deviation, "w": [float(v) for v in m.w], "labels": list(m.labels), "band": list(self.band), "threshold": self.threshold, "bounds": self.bounds, "honest": self.honest, "baseline_log": self.baseline_log, "seed": self.forest.seed, "key": self.forest.key}
        files.save_bundle(spark, path, KIND, tables, {"json": json.dumps(notes)})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PricePredictor:
        tables, manifest = files.load_bundle(spark, path, KIND)
        n = json.loads(manifest["json"])
        settings, pre = study.Settings(**n["settings"]), encode.Preprocessor(**{k: n["pre"][k] for k in ("numeric", "binary", "categorical", "indicators", "multilabel")})
        for k in ("medians", "flags", "levels", "labels"):
            setattr(pre, k, n["pre"][k])
        design = study.Design(pre)
        design.labels = pre.names()
        design.names = [f"x{i}" for i in range(len(design.labels))]
        design.mean, design.deviation = n["mean"], n["deviation"]
        trees: dict[int, tree.Tree] = {}
        for r in tables["nodes"].orderBy("tree", "id").collect():  # the model's own size
            t = trees.setdefault(r["tree"], tree.Tree("regression", "mse", 2))
            t.nodes.append(tree.Node(r["id"], r["depth"], r["n"], list(r["sums"]), r["impurity"], r["feature"], r["threshold"], r["left"], r["right"], r["gain"]))
        phi = svm.PegasosSVM(design.fourier(settings.fourier, settings.gamma, settings.seed), lam=settings.lam, steps=settings.steps, average=True, labels=tuple(n["labels"]))
        phi.w = np.array(n["w"])
        bounds = {k: tuple(v) for k, v in n["bounds"].items()}
        return cls(settings, design, tree.Forest([trees[k] for k in sorted(trees)], n["key"], n["seed"]), phi, tuple(n["band"]), n["threshold"], tables["places"], bounds, n["honest"], n["baseline_log"])


def filled(listings: DataFrame, places: DataFrame) -> DataFrame:
    """Listings with all INPUT columns, the features' missing ones from the gazetteer, and known_: whether the place is in it. Coordinates
    that are given as a pair stay. The gazetteer has a row for each place name; it is broadcast up to PLACES rows."""
    d = listings.select(*(c for c in listings.columns if c not in INPUT.names), *((F.col(f.name) if f.name in listings.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in INPUT))
    d = d.withColumn("location", text.tidy(F.col("location")))
    g = places.select(F.col("location").alias("place_"), *(F.col(c).alias(f"{c}_of_") for c in FILLED))
    g = F.broadcast(g) if places.limit(PLACES + 1).count() <= PLACES else g
    d = d.join(g, F.col("location") == F.col("place_"), "left")
    both = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return d.withColumns({"known_": F.col("place_").isNotNull(), "district": F.col("district_of_"), "city": F.col("city_of_"), "tags": F.coalesce("tags_of_", F.lit("")), "lat": F.when(both, F.col("lat")).otherwise(F.col("lat_of_")), "lng": F.when(both, F.col("lng")).otherwise(F.col("lng_of_"))}).drop("place_", *(f"{c}_of_" for c in FILLED))


def base_of(label: str) -> str:
    """'district=x' and 'rooms_missing' to the feature they come from; both areas are one, and so are both coordinates."""
    name = label.split("=")[0].removesuffix("_missing")
    return {"area_m2": "area", "log_area": "area", "lat": "position", "lng": "position", "dist_center_km": "position"}.get(name, name)
