"""Permutation importance and the correlation of error profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrane.functions.numbering import numbered
from terrane.functions.numeric import hash32
from terrane.operators.encode import SPREAD

def permuted(df: DataFrame, key: str, columns: list[str], seed: int) -> DataFrame:
    """df with the given columns shuffled together over the whole table: the row at a place by key takes the values of the row
    at that place of a seeded shuffle. Places are numbered in two levels, so no task sees the whole table."""
    d = df.withColumns({"all_": F.lit(0), "here_": hash32(0, F.col(key)), "there_": hash32(seed + 1, F.col(key))})
    here = numbered(d.drop("there_"), "all_", "here_", [key], SPREAD, "place_", hash_bits=32).drop("all_", "here_", *columns)
    there = numbered(d.select("all_", "there_", key, *columns), "all_", "there_", [key], SPREAD, "place_", hash_bits=32)
    return here.join(there.select("place_", *columns), "place_").drop("place_")


def importance(df: DataFrame, key: str, groups: dict[str, list[str]], score: Callable[[DataFrame], float], repeats: int = 3, seed: int = 42, higher_is_better: bool = False) -> dict[str, tuple[float, float]]:
    """Per group: mean and deviation of how much worse the score gets."""
    base, every = score(df), sorted({c for columns in groups.values() for c in columns})
    worse: dict[str, list[float]] = {name: [] for name in groups}
    for r in range(repeats):  # one shuffle for all groups: rows change places in the same way for each
        aside = permuted(df.select("*", *(F.col(c).alias(f"{c}__") for c in every)), key, [f"{c}__" for c in every], seed + r).cache()
        for name, columns in groups.items():
            s = score(aside.select(*(F.col(f"{c}__").alias(c) if c in columns else F.col(c) for c in df.columns)))
            worse[name].append(base - s if higher_is_better else s - base)
        aside.unpersist()
    out = {}
    for name, w in worse.items():
        mean = sum(w) / repeats
        out[name] = (mean, (sum((x - mean) ** 2 for x in w) / repeats) ** 0.5)
    return out


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation over a small table of groups; null for fewer than three."""
    rank = lambda c: F.rank().over(W.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(c)) - 1) / 2
    return df.select(rank(a).alias("a"), rank(b).alias("b")).agg(F.when(F.count(F.lit(1)) >= 3, F.corr("a", "b")).alias("spearman"))
