"""Gapless numbers, ranks and running sums over groups of any size, without one task for a group.

Rows of a group are dealt into buckets that follow its order: by the top bits of a hash, or by approximate quantiles of a value.
Each (group, bucket) works on its own rows; a running sum over the few bucket totals says where each bucket starts. The
buckets steer work, never results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HASH_BITS = 60
#: Rows of a bucket when a group holds all rows; at least MIN_BITS bits even for small tables.
BUCKET_ROWS, MIN_BITS = 65_536, 6
#: Buckets of a running sum.
RUNS = 256


def hash60(*cols: Column) -> Column:
    """60 bits of MD5 over the columns' text, the same in any SQL engine."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def numbered(df: DataFrame, by: str, hashed: str, order: list[str], rows: int, name: str, hash_bits: int = HASH_BITS) -> DataFrame:
    """df with `name`: 0, 1, ... within each group, by the hash, then `order`. hashed: a column of hash_bits bits, not negative."""
    bits = min(hash_bits, max(MIN_BITS, (max(rows, 1) // BUCKET_ROWS).bit_length()))
    df = df.withColumn("bucket_", F.shiftright(hashed, hash_bits - bits))
    w = W.partitionBy(by, "bucket_")
    within = df.withColumn("within_", F.row_number().over(w.orderBy(hashed, *order)).cast("long") - 1)
    counts = df.groupBy(by, "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    first = counts.select(F.col(by).alias("by_"), F.col("bucket_").alias("b_"), (F.sum("n_").over(W.partitionBy(by).orderBy("bucket_")) - F.col("n_")).alias("first_"))
    out = within.join(first, F.col(by).eqNullSafe(F.col("by_")) & (F.col("bucket_") == F.col("b_")))
    return out.withColumn(name, (F.col("first_") + F.col("within_")).cast("long")).drop("bucket_", "within_", "by_", "b_", "first_")


def running(df: DataFrame, value: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """df (a row for each value) with running sums over the values: sums names a new column for each summed one.

    Nulls count as the lowest value."""
    at = F.array(*(F.lit(i / RUNS) for i in range(1, RUNS)))
    edges = df.agg(F.array_distinct(F.coalesce(F.percentile_approx(F.col(value).cast("double"), at, F.lit(10 * RUNS)), F.array().cast("array<double>"))).alias("edges_"))
    d = df.crossJoin(F.broadcast(edges)).withColumn("bucket_", F.size(F.filter("edges_", lambda e: e <= F.col(value).cast("double")))).drop("edges_")
    w = W.partitionBy("bucket_").orderBy(F.desc_nulls_last(value) if descending else F.asc_nulls_first(value))
    d = d.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    total = df.crossJoin(F.broadcast(edges)).groupBy(F.size(F.filter("edges_", lambda e: e <= F.col(value).cast("double"))).alias("b")).agg(*(F.sum(c).alias(c) for c in sums.values()))
    totals = total.agg(F.collect_list(F.struct("b", *sums.values())).alias("totals_"))  # RUNS entries at most
    d = d.crossJoin(F.broadcast(totals))
    ahead = F.filter("totals_", lambda x: (x["b"] > F.col("bucket_")) if descending else (x["b"] < F.col("bucket_")))
    d = d.withColumn("ahead_", ahead)

    def before(c: str) -> Column:
        zero = F.lit(0).cast("double" if df.schema[c].dataType.typeName() == "double" else "long")
        return F.aggregate("ahead_", zero, lambda acc, x: acc + x[c])

    return d.withColumns({name: F.col(name) + before(c) for name, c in sums.items()}).drop("bucket_", "totals_", "ahead_")
