"""Batch serving: validation, places, ranges, warnings and rounded predictions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import fixed, numeric
from terrane.functions.quantiles import quantiles


def violations(c: dict[str, Column]) -> Column:
    """Names of the rules that a listing breaks. c: its fields by name."""
    between = lambda x, lo, hi: x.isNotNull() & ~x.between(lo, hi)
    rules = {
        "category": ~F.coalesce(c["category"].isin(list(fixed.CATEGORY_LABELS)), F.lit(False)),
        "area_m2": ~F.coalesce(c["area_m2"].between(*fixed.AREA_RANGE), F.lit(False)),
        "rooms": between(c["rooms"], 1, 20),
        "floor": between(c["floor"], -2, 60),
        "total_floors": between(c["total_floors"], 1, 60),
        "floor_above_total": F.coalesce(c["floor"] > c["total_floors"], F.lit(False)),
        "lat": between(c["lat"], *fixed.LAT_RANGE),
        "lng": between(c["lng"], *fixed.LNG_RANGE),
        "lat_without_lng": c["lat"].isNull() != c["lng"].isNull(),
    }
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))


def gazetteer(df: DataFrame) -> DataFrame:
    """Per location: the most frequent district, city and tags (the smallest of equals), and median coordinates."""
    most = lambda c: F.mode(c, True).alias(c)
    return df.where("location is not null").groupBy("location").agg(most("district"), most("city"), most("tags"), F.median("lat").alias("lat"), F.median("lng").alias("lng"), F.count(F.lit(1)).alias("n"))


def ranges(df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    got = quantiles(df, {c: F.col(c) for c in columns}, [low, high])
    return df.sparkSession.createDataFrame([(c, *got[c]) for c in columns], "column string, lo double, hi double")


def warnings(df: DataFrame, bounds: dict[str, tuple[float, float]], known: Column) -> Column:
    out = [F.when(F.col(c).isNotNull() & ~F.col(c).between(lo, hi), F.lit(f"{c} out of range")) for c, (lo, hi) in bounds.items()]
    out += [F.when(F.col("location").isNotNull() & ~known, F.lit("unknown location")), F.when(F.col("location").isNull() & F.col("lat").isNull(), F.lit("no location"))]
    return F.array_compact(F.array(*out))


def answer(log_price: Column, band: tuple[float, float], score: Column, threshold: float) -> dict[str, Column]:
    price = F.exp(log_price)
    return {
        "price": numeric.to_hundreds(price), "price_low": numeric.to_hundreds(price * F.exp(F.lit(band[0]))), "price_high": numeric.to_hundreds(price * F.exp(F.lit(band[1]))),
        "premium": score >= 0, "inside_margin": F.abs(score) < 1.0, "models_agree": (price > threshold) == (score >= 0),
    }
