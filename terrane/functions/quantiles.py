"""Exact quantiles (linear between ranks) of columns of any size: an approximate bracket first, then the exact rank inside it.

One aggregation buffer of all distinct values, as an exact percentile keeps it, doesn't hold for large columns; a bracket holds a
few millionths of the rows. Large columns of few distinct values need none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which the plain percentile is as good; how fine brackets are beyond. Both ways give the same numbers.
FEW, ACCURACY = 1_000_000, 100_000
#: Distinct values, as estimated, up to which one buffer holds a column of any size.
DISTINCT = 50_000


def quantiles(df: DataFrame, columns: dict[str, Column], at: list[float], n: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """For each named column its quantiles; None without values. NaN counts as the largest. n: how many values each has, if that is known."""
    cells = {name: c.cast("double") for name, c in columns.items()}
    d = df.select(*(c.alias(name) for name, c in cells.items()))
    n = n or d.agg(*(F.count(F.col(c)).alias(c) for c in cells)).first().asDict()
    out: dict[str, list[float | None]] = {}
    large = [c for c in cells if n[c] > FEW]
    seen = d.agg(*(F.approx_count_distinct(c, 0.1).alias(c) for c in large)).first().asDict() if large else {}
    few = [c for c in cells if seen.get(c, 0) <= DISTINCT]
    if few:
        got = d.agg(*(F.percentile(c, F.array(*map(F.lit, at))).alias(c) for c in few)).first()
        out |= {c: list(got[c]) if got[c] is not None else [None] * len(at) for c in few}
    many = [c for c in cells if c not in few]
    if many:
        near = lambda q, side: min(1.0, max(0.0, q + side * 2 / ACCURACY))
        edges = d.agg(*(F.percentile_approx(c, F.array(*(F.lit(near(q, s)) for q in at for s in (-1, 1))), F.lit(ACCURACY)).alias(c) for c in many)).first()
        inside = {(c, i): (edges[c][2 * i], edges[c][2 * i + 1]) for c in many for i in range(len(at))}
        counts = d.agg(*(x for (c, i), (lo, hi) in inside.items() for x in (F.count_if(F.col(c) < lo).alias(f"{c}|{i}|b"), F.count_if(F.col(c).between(lo, hi)).alias(f"{c}|{i}|m")))).first()
        asked = []
        for (c, i), (lo, hi) in inside.items():
            rank, before, m = at[i] * (n[c] - 1), counts[f"{c}|{i}|b"], counts[f"{c}|{i}|m"]
            if not before <= int(rank) or not int(rank) + (rank % 1 > 0) < before + m:
                raise ArithmeticError(f"the bracket of quantile {at[i]} misses it")
            asked.append(F.percentile(F.when(F.col(c).between(lo, hi), F.col(c)), F.lit(min(1.0, (rank - before) / max(m - 1, 1)))).alias(f"{c}|{i}"))
        got = d.agg(*asked).first()
        out |= {c: [got[f"{c}|{i}"] for i in range(len(at))] for c in many}
    return out


def quantile(df: DataFrame, column: Column, q: float = 0.5) -> float | None:
    return quantiles(df, {"v": column}, [q])["v"][0]
