"""The command line on a small CSV: tables, report, and what is rebuilt from the saved results."""

import json

import pytest

from terrane import run
from terrane.operators import study
from terrane.sources import files, synthetic


def test_study_and_report(spark, tmp_path, monkeypatch):
    data, out = f"{tmp_path}/listings", f"{tmp_path}/out"
    synthetic.listings(spark, 300).coalesce(1).write.csv(data, header=True)
    small = study.Settings(resamples=20, folds=2, trees=2, rounds=2, depth=2, steps=5, fourier=16)
    monkeypatch.setattr(study.Settings, "make", classmethod(lambda cls, fast=False: small))
    results = run.run_study(spark, data, out, fast=True)
    assert set(results["tables"]) == {"cleaning_log", "test_regression", "test_classification", "paired_tests", "errors_by_category", "cv_results"}
    for name, rows in results["tables"].items():
        assert rows and spark.read.csv(f"{out}/{name}", header=True).count() == len(rows)
    text = run.write_report(spark, out)
    assert text == "\n".join(r[0] for r in spark.read.text(f"{out}/report").collect())
    assert r"\newcommand{\MedianRmseLog}" in text and r"\begin{tabular}" in text and "no clear difference" in text or "better" in text
    saved = json.loads(spark.read.text(f"{out}/results").first()[0])
    assert saved["tables"]["cleaning_log"] == results["tables"]["cleaning_log"] and saved["seconds"]["design"] > 0


def test_numbers_for_tex():
    assert files.signed(0.5) == "$+0.500$" and files.signed(None) == "--" and files.scientific(1.5e-4) == r"$1.5 \times 10^{-4}$"
    m = files.Macros()
    m.add("tree2 rmse", 1)
    assert m.text() == r"\newcommand{\TreeTwoRmse}{1}"
    with pytest.raises(ValueError, match="twice"):
        m.add("tree2 rmse", 2)
    with pytest.raises(SystemExit):
        run.main(["study", "--out-dir", "x"])
