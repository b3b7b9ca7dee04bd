"""Sums over the rows of a matrix: numpy on Arrow batches, a short vector for each partition, added up by an aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Derived:
    """of(x), `width` numbers for each row of the named columns. They are made where they are used, in the same Python pass, and never
    stored or sent."""

    names: list[str]
    of: Callable[[np.ndarray], np.ndarray]
    width: int


#: Columns by name, the name of one array column, or numbers derived from columns.
Columns = list[str] | str | Derived


def vector(columns: Columns, missing: bool = False) -> Column:
    """array<double> of the columns; nulls are 0, or NaN where missing values are told apart."""
    if isinstance(columns, str):
        return F.col(columns)
    instead = "cast('NaN' as double)" if missing else "0D"
    return F.expr("array(" + ", ".join(f"coalesce(cast(`{c}` as double), {instead})" for c in columns) + ")")


def rows_of(arrays: pa.Array) -> np.ndarray:
    flat = arrays.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(arrays), -1) if len(arrays) else np.zeros((0, 0))


def sums(df: DataFrame, columns: Columns, extra: dict[str, Column], of: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all batches of of(x, **extra): x a row for each row of df, extra further columns as arrays, the result of
    one length. An empty df gives an empty vector."""
    names, first = list(extra), (lambda x: x)
    if isinstance(columns, Derived):
        columns, first = columns.names, columns.of

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = np.asarray(of(first(rows_of(b.column(0))), **{n: b.column(i + 1).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}), dtype=float)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    rows = df.select(vector(columns).alias("x"), *(c.alias(n) for n, c in extra.items())).mapInArrow(partial, "i int, v double")
    got = rows.groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row for each entry of the vector
    out = np.zeros(len(got))
    for r in got:
        out[r["i"]] = r["v"]
    return out


def mapped(columns: Columns, of: Callable[[np.ndarray], np.ndarray], missing: bool = False) -> Column:
    """array<double> of each row: of(x) has a row for each row of x."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = of(rows_of(b)) if len(b) else np.zeros((0, 0))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * (out.shape[1] if len(b) else 0)), pa.array(np.ascontiguousarray(out, dtype=float).ravel()))

    return run(vector(columns, missing))
