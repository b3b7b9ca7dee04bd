"""What a report says of result tables: the best of each metric, verdicts in words, the groups at either end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Metrics of which less is better.
ERRORS = ("rmse", "rmse_log", "mae", "mae_log", "mape")


def with_best(rows: DataFrame, by: list[str], metric: str = "metric", value: str = "value", digits: int = 10) -> DataFrame:
    """rows (a few for each group) with `best`: whether a row has the group's best value; equals are all best."""
    good = F.when(F.col(metric).isin(*ERRORS), -F.col(value)).otherwise(F.col(value))
    w = W.partitionBy(*by, metric).orderBy(F.round(good, digits).desc_nulls_last())
    return rows.withColumn("best", (F.rank().over(w) == 1) & F.col(value).isNotNull())


def verdict(metric: Column, diff: Column, significant: Column) -> Column:
    """Of a planned comparison of a with b: 'a better', 'b better' or 'no clear difference'."""
    better = F.when(metric.isin(*ERRORS), diff < 0).otherwise(diff > 0)
    return F.when(~F.coalesce(significant, F.lit(False)), "no clear difference").when(better, "a better").otherwise("b better")


def size_word(p: Column) -> Column:
    """How sure a p-value makes a difference."""
    return F.when(p.isNull(), "not tested").when(p < 0.001, "very sure").when(p < 0.01, "sure").when(p < 0.05, "likely").otherwise("open")


def extremes(groups: DataFrame, value: str = "rmse", least: int = 30) -> DataFrame:
    """One row: the groups of `least` rows or more with the least and the largest value, and their ratio."""
    d = groups.where(F.col("n") >= least)
    name = F.col("group").cast("string")
    got = d.agg(F.min_by(name, F.struct(F.col(value), name)).alias("strongest"), F.min(value).alias("least"), F.max_by(name, F.struct(F.col(value), name)).alias("weakest"), F.max(value).alias("largest"))
    return got.withColumn("ratio", F.try_divide("largest", "least"))
