"""Where predictions go wrong: by group, by price, by how much data there was, and near the threshold of the tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrane.functions import fixed, numeric, text
from terrane.functions.numeric import share


def by_group(df: DataFrame, group: Column, y: str, p: str, tier: str | None = None, label: str | None = None) -> DataFrame:
    """(group, n, rmse, mae, bias, tier_error) of predictions of a log price."""
    e = F.col(p) - F.col(y)
    wrong = share(F.col(tier) != F.col(label)) if tier and label else F.lit(None).cast("double")
    return df.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), wrong.alias("tier_error"))


def by_decile(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """(decile, n, mae) by the true price; edges are one row."""
    edges = df.agg(F.percentile(y, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("edges_"))
    d = df.crossJoin(F.broadcast(edges))
    return d.groupBy(F.size(F.filter("edges_", lambda x: x <= F.col(y))).alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"))


def by_density(train: DataFrame, test: DataFrame, place: str, y: str, p: str, edges: list[float]) -> DataFrame:
    """(density, n, mae): by how many training rows share a test row's place."""
    seen = train.where(F.col(place).isNotNull()).groupBy(F.col(place).alias("place_")).agg(F.count(F.lit(1)).alias("seen_"))
    d = test.join(seen, F.col(place) == F.col("place_"), "left")
    return d.groupBy(numeric.digitize(F.coalesce("seen_", F.lit(0)), edges).alias("density")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"))


def by_distance(df: DataFrame, y: str, threshold: Column, tier: str, label: str, edges: list[float]) -> DataFrame:
    """(bin, n, tier_error): by |log price - log threshold|."""
    d = df.withColumn("distance_", F.abs(F.col(y) - F.ln(threshold)))
    return d.groupBy(numeric.digitize(F.col("distance_"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), share(F.col(tier) != F.col(label)).alias("tier_error"))


def near_threshold(df: DataFrame, y: str, threshold: Column, tier: str, label: str, within: float = 0.1) -> DataFrame:
    """One row: the share of rows, and of tier errors, whose log price is that near to the threshold's; 0 without errors."""
    near = F.abs(F.col(y) - F.ln(threshold)) <= within
    wrong = F.col(tier) != F.col(label)
    return df.agg(share(near).alias("share_rows"), numeric.ratio(F.count_if(near & wrong), F.count_if(wrong)).alias("share_errors"))


def far_off(df: DataFrame, y: str, p: str, beyond: float = 0.5) -> DataFrame:
    """The share of rows whose price is wrong by more than `beyond` of itself."""
    return df.agg(share(F.abs(F.expm1(F.col(p) - F.col(y))) > beyond).alias("share"))


def worst(df: DataFrame, y: str, p: str, key: str, k: int = 10) -> DataFrame:
    """The k rows of the largest errors, with their effect in percent."""
    d = df.withColumn("residual", F.col(p) - F.col(y)).withColumn("percent", 100 * F.expm1("residual"))
    return d.orderBy(F.abs("residual").desc(), key).limit(k)


def largest(rows: DataFrame, value: str, name: str, k: int) -> DataFrame:
    """The k rows of the largest absolute values; equals by name."""
    return rows.orderBy(F.abs(F.col(value)).desc(), name).limit(k)


def agreement(df: DataFrame, a: str, b: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: the share of rows where two predictions are close, relative to their size."""
    near = F.abs(F.col(a) - F.col(b)) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return df.agg(share(near).alias("share"))


def precision_lost(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, doubles, floats): distinct values in double and in single precision."""
    got = [F.struct(F.lit(c).alias("column"), F.count_distinct(F.col(c).cast("double")).alias("doubles"), F.count_distinct(F.col(c).cast("float")).alias("floats")) for c in columns]
    return df.agg(F.array(*got).alias("r")).select(F.inline("r"))


def folded_importances(rows: DataFrame, feature: str, value: str) -> DataFrame:
    """(feature, value): levels, missing flags and log twins summed into the column they come from."""
    base = F.regexp_replace(F.regexp_replace(F.col(feature), "=.*$", ""), "_missing$", "")
    return rows.groupBy(F.when(base.isin("area_m2", "log_area"), "area").otherwise(base).alias("feature")).agg(F.sum(value).alias("value"))


def price_level(df: DataFrame, location: str, price: str, area: str, least: int = 30, most: int = 18, fallback: int = 12) -> DataFrame:
    """(location, price_m2, n): the dearest places with `least` rows or more; where none has so many, the `fallback` places with
    most rows."""
    d = df.where(F.col(location).isNotNull()).groupBy(F.col(location).alias("location")).agg(F.median(F.try_divide(price, area)).alias("price_m2"), F.count(F.lit(1)).alias("n"))
    enough = F.broadcast(d.agg(F.count_if(F.col("n") >= least).alias("enough_")))
    d = d.crossJoin(enough).where((F.col("enough_") == 0) | (F.col("n") >= least))
    ranked = d.orderBy(F.when(F.col("enough_") == 0, F.col("n").cast("double")).otherwise(F.col("price_m2")).desc(), "location").limit(most)
    place = F.row_number().over(W.orderBy(F.desc("n"), "location"))  # `most` rows
    kept = ranked.withColumn("r_", place).where((F.col("enough_") > 0) | (F.col("r_") <= fallback))
    return kept.orderBy(F.desc("price_m2"), "location").drop("r_", "enough_")


def span_of(df: DataFrame, time: str) -> DataFrame:
    """(first, last) scrape."""
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def correlation(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(F.corr(a, b).alias("correlation"))


def dropped_categories(raw: DataFrame, category: str) -> DataFrame:
    """(category, n) of raw rows whose category is out of scope, the most frequent first."""
    folded, scope = text.normalize_name(text.tidy(F.col(category))), [text.fold_name(c) for c in fixed.KEEP_CATEGORIES]
    d = raw.where(folded.isNotNull() & ~folded.isin(scope)).groupBy(text.tidy(F.col(category)).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("n"), "category")
