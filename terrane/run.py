"""Command line: run the study on a listing table, train a predictor, or rebuild the report from saved results.

    python -m terrane.run study --data listings.csv --out-dir out [--fast] [--skip-cv]
    python -m terrane.run train --data listings.csv --out-dir bundle [--fast]
    python -m terrane.run report --out-dir out

The table has a header; its listing key and scrape time are found by their spellings."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import clean, errors, predictor, report, study
from terrane.sources import files

REGRESSION = ["median", "ridge", "tree", "boosting", "forest", "svr_fourier"]
CLASSIFICATION = ["tree_tier", "forest_tier", "svm_tier", "svm_fourier_tier"]


def cleaned(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(raw rows, cleaned listings with key_, the columns that order rows)."""
    raw = files.load_raw(spark, path)
    names = clean.canonical_names(raw.columns)
    order = [c for c, n in names.items() if n in ("listing_key", "scraped_at")] or raw.columns[:1]
    d = clean.clean(raw, order)
    key = F.col("o0_") if "listing_key" in names.values() else F.monotonically_increasing_id().cast("string")
    return raw, d.withColumn("key_", F.concat_ws("#", key, F.xxhash64(*clean.CLEANED).cast("string"))), order


def run_study(spark: SparkSession, data: str, out: str, fast: bool = False, skip_cv: bool = False) -> dict:
    """Writes the result tables as CSV, a JSON of all numbers, and the report."""
    settings, log = study.Settings.make(fast), {}
    raw, listings, order = cleaned(spark, data)
    d = study.prepared(listings, "key_", settings.seed).cache()
    regression, classification = (["median", "ridge", "tree"], ["tree_tier", "svm_tier"]) if fast else (REGRESSION, CLASSIFICATION)
    names = [*regression, *classification]
    predicted = study.final_models(d, settings, names, log).cache()
    tables = {
        "cleaning_log": clean.cleaning_log(raw, order),
        "test_regression": study.test_table(predicted, regression, settings),
        "test_classification": study.test_table(predicted, classification, settings),
        "paired_tests": study.comparisons(predicted, settings),
        "errors_by_category": errors.by_group(predicted, F.col("category"), "log_price", regression[-1], "tier", f"{classification[0]}_label"),
    }
    if not skip_cv:
        tables["cv_results"] = study.over_folds(study.cross_validate(d, settings, regression[:2]))
    results = {"seconds": log, "tables": {}}
    for name, table in tables.items():
        rows = [r.asDict() for r in table.collect()]  # result tables: a row for each model, metric, step or group
        results["tables"][name] = rows
        files.write_csv(spark.createDataFrame(rows, table.schema), f"{out}/{name}")
    text = spark.createDataFrame([(json.dumps(files.to_jsonable(results)),)], "json string")
    text.coalesce(1).write.mode("overwrite").text(f"{out}/results")
    write_report(spark, out)
    return results


def write_report(spark: SparkSession, out: str) -> str:
    """LaTeX macros, tables with the best numbers marked, and a console summary, from the saved JSON."""
    results = json.loads("\n".join(r[0] for r in spark.read.text(f"{out}/results").collect()))
    text = report_text(spark, results)
    spark.createDataFrame([(text,)], "text string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return text


def report_text(spark: SparkSession, results: dict) -> str:
    macros, parts = files.Macros(), []
    for name in ("test_regression", "test_classification"):
        rows = results["tables"].get(name) or []
        if rows:
            kind = "model string, task string, metric string, value double, lo double, hi double"
            got = report.with_best(spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in rows], kind), ["task"]).orderBy("metric", "model").collect()
            for r in got:
                macros.add(f"{r['model']} {r['metric']}", files.number(r["value"]))
            parts.append(files.tabular("lllr", ["model", "metric", "best", "value"], [[files.tex_escape(r["model"]), files.tex_escape(r["metric"]), "*" if r["best"] else "", files.number(r["value"])] for r in got]))
            parts.append(files.console([r.asDict() for r in got], ["model", "metric", "value", "lo", "hi", "best"], name))
    pairs = results["tables"].get("paired_tests") or []
    if pairs:
        kind = "metric string, a string, b string, diff double, p double, significant boolean"
        d = spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in pairs], kind)
        got = d.withColumn("verdict", report.verdict(F.col("metric"), F.col("diff"), F.col("significant"))).withColumn("how", report.size_word(F.col("p"))).orderBy("metric", "a", "b").collect()
        parts.append(files.console([r.asDict() for r in got], ["metric", "a", "b", "diff", "p", "verdict", "how"], "paired_tests"))
    groups = results["tables"].get("errors_by_category") or []
    if groups:
        d = spark.createDataFrame([(r["group"], r["n"], r["rmse"]) for r in groups], "group string, n long, rmse double")
        r = report.extremes(d, least=1).first()
        macros.add("weakest category", files.tex_escape(r["weakest"] or "none"))
        macros.add("strongest category", files.tex_escape(r["strongest"] or "none"))
    return "\n\n".join([macros.text(), *parts])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("what", choices=["study", "train", "report"])
    p.add_argument("--data")
    p.add_argument("--out-dir", required=True)
    p.add_argument("--fast", action="store_true")
    p.add_argument("--skip-cv", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "report":
        print(write_report(spark, a.out_dir))
        return
    if not a.data:
        p.error("--data is needed")
    if a.what == "study":
        run_study(spark, a.data, a.out_dir, a.fast, a.skip_cv)
    else:
        model = predictor.PricePredictor.fit(cleaned(spark, a.data)[1], "key_", study.Settings.make(a.fast))
        model.save(a.out_dir)
        print(json.dumps(files.to_jsonable(model.card())))


if __name__ == "__main__":
    main()
