"""What the corpus operators share: tables, the checkpoint folder, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: texts are long, so a batch is kept small for the Python worker's memory.
ARROW_ROWS, ARROW_BYTES = 512, 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one on a single machine and an error elsewhere."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(given)
        return given
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="terrane-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def saved(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; a lost executor loses none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of written() while a working() block is open.
_open: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: computed once, compressed, columns read as needed."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if _open:
        _open[-1].append(at)
    return spark.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Tables of written() that are made inside are deleted at the end: for callers that have saved their result by then."""
    _open.append([])
    try:
        yield
    finally:
        for folder in _open.pop():
            removed(spark, folder)


#: Groups that may be too large for one task; so many at most are broadcast.
HOT_GROUPS, HOT_ROWS = 10_000, 256


def with_group(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to groups (one row for each key, n_: how many of the `total` rows hold it, dropped here).

    A key with more than total / HOT_GROUPS rows (HOT_ROWS at least) is joined by broadcast, where its rows are: there are
    HOT_GROUPS of these at most. The rest is shuffled, and no task gets a large group."""
    limit = max(HOT_ROWS, -(-total // HOT_GROUPS))
    names = [c for c in groups.columns if c not in (key, "n_")]
    hot = F.broadcast(groups.where(F.col("n_") > limit).select(F.col(key).alias("hot_"), F.struct(*names).alias("of_")))
    d = rows.join(hot, F.col(key) == F.col("hot_"), "left")
    cold = d.where("hot_ is null").drop("hot_", "of_").join(groups.where(F.col("n_") <= limit).drop("n_"), key)
    met = d.where("hot_ is not null").select(*rows.columns, *(F.col("of_")[c].alias(c) for c in names))
    return met.unionByName(cold.select(*rows.columns, *names))


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, for this session from now on: plans run later than they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))
