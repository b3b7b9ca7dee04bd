"""The parsers on single values."""

import pytest
from pyspark.sql import functions as F

from terrane.functions import numeric, text


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [("85 m²", 85.0), ("1 250 000", 1250000.0), ("85,5", 85.5), ("1,250,000", 1250000.0), ("1.250.000", 1.25), ("12-15", 12.0), ("-3", -3.0), ("1 250 000", 1250000.0), ("", None), (None, None), ("x", None)])
def test_number(spark, raw, want):
    assert one(spark, text.parse_number, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("5 / 9", (5.0, 9.0)), ("5", (5.0, None)), ("-1/3", (-1.0, 3.0)), ("junk", (None, None)), (None, (None, None))])
def test_floor(spark, raw, want):
    assert tuple(one(spark, lambda c: F.struct(*text.parse_floor(c)), raw)) == want


@pytest.mark.parametrize(("raw", "want"), [("6 sot", 6.0), ("600 m²", 6.0), ("0.5 ha", 50.0), ("200 kv.m", 2.0), (None, None)])
def test_land(spark, raw, want):
    assert one(spark, text.parse_land, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("var", 1.0), ("Çıxarış var", 1.0), ("Təmirli", 1.0), ("yoxdur", 0.0), ("Təmirsiz", 0.0), ("Nəsimili", None), ("", None), (None, None), ("İpotekalı", 1.0)])
def test_yes_no(spark, raw, want):
    assert one(spark, text.parse_yes_no, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("USD", "USD"), ("$", "USD"), ("avro", "EUR"), ("₽", "RUB"), ("manat", "AZN"), (None, "AZN"), ("?", "AZN")])
def test_currency(spark, raw, want):
    assert one(spark, text.parse_currency, raw) == want


def test_names(spark):
    assert one(spark, text.normalize_name, "Binanın növü") == "binanin_novu"
    assert text.fold_name("Otaq sayı") == "otaq_sayi"
    assert one(spark, text.transliterate, "İmişli m²") == "imisli m2"


@pytest.mark.parametrize("raw", ['{"a": "1", "b": "2"}', "{'a': '1', 'b': '2'}", '[{"name": "a", "value": "1"}, {"key": "b", "value": "2"}]', "a: 1; b: 2", "b: 9\na: 1|b: 2"])
def test_attributes(spark, raw):
    assert one(spark, text.parse_attributes, raw) == {"a": "1", "b": "2"}


def test_tags(spark):
    d = spark.createDataFrame([("28 May m.* Nəsimi r.* ", "x"), (" ", "Yasamal r."), (None, None)], "e string, l string")
    rows = d.select(text.tags(F.col("e"), F.col("l")), text.district(F.col("e"), F.col("l"))).collect()
    assert [tuple(r) for r in rows] == [("28 may m.|nesimi r.", "nesimi r."), ("yasamal r.", "yasamal r."), ("", None)]


def test_labels_and_bands(spark):
    assert one(spark, text.location_label, "28 may m.") == "28 May (metro)"
    assert one(spark, text.base_feature, "district=x") == "district" and one(spark, text.base_feature, "rooms_missing") == "rooms"
    assert [one(spark, numeric.band, v, "double") for v in (50_000.0, 75_000.0, 1e6)] == ["<75k", "75k–125k", "600k+"]
    assert [one(spark, numeric.to_hundreds, v, "double") for v in (1250.0, 1350.0)] == [1200.0, 1400.0]


@pytest.mark.parametrize(("raw", "want"), [("{'a': \"it's\", 'b': True}", {"a": "it's", "b": "true"}), ("{'a': 'x \"q\" y', 'n': None}", {"a": 'x "q" y', "n": None}), ("[{'key': 'k', 'value': 'Truely True'}]", {"k": "Truely True"}), ("{'broken'", None)])
def test_quoted_literals(spark, raw, want):
    assert one(spark, text.parse_attributes, raw) == want
