"""Rows that are read many times."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def iterated(d: DataFrame) -> DataFrame:
    """d for many passes: kept in memory or on executors' disks (and computed again if these are lost), over all cores even where its
    file is one piece. It stays until the session clears it, as results are computed from it later."""
    cores = d.sparkSession.sparkContext.defaultParallelism
    return (d.repartition(cores) if d.rdd.getNumPartitions() < cores else d).persist(StorageLevel.MEMORY_AND_DISK)


def kept(d: DataFrame) -> DataFrame:
    """Like iterated, for plans that end in shuffles, which use all cores as they are: asking for their partitions would run them once more.

    What reads it is planned from its rows on, not from the tables: each job on a long plan would cost seconds of the driver. The
    shuffles of d run at once, its rows when they are first read."""
    spark = d.sparkSession
    rows = spark._jsparkSession.internalCreateDataFrame(d._jdf.queryExecution().toRdd(), d._jdf.schema(), False)
    return DataFrame(rows, spark).persist(StorageLevel.MEMORY_AND_DISK)


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, which reads old, is filled and takes old's place: no two copies stay."""
    new.count()
    old.unpersist()
    return new


def spread(d: DataFrame, key: str) -> DataFrame:
    """d over all cores where its file is one piece, by key; larger tables as they are."""
    cores = d.sparkSession.sparkContext.defaultParallelism
    return d.repartition(cores, key) if d.rdd.getNumPartitions() < cores else d
