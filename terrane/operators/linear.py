"""Ridge, PCA and k-means: the data is reduced to small sums by aggregates, the algebra on them happens at the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import matrix


def _gram(df: DataFrame, columns: matrix.Columns) -> np.ndarray:
    """Sums of products, as a matrix; a null counts as 0."""
    d = len(columns) if not isinstance(columns, str) else None
    got = matrix.sums(df, columns, {}, lambda x: (x.T @ x).ravel())
    d = d if d is not None else int(len(got) ** 0.5)
    return got.reshape(d, d) if len(got) else np.zeros((d, d))


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, v): sums of products, i <= j. One small matrix for each partition is all that leaves the executors."""
    g = _gram(df, columns)
    return df.sparkSession.createDataFrame([(i, j, float(g[i, j])) for i in range(len(columns)) for j in range(i, len(columns))], "i int, j int, v double")


def centred_gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, sums of centred products). A null counts as its column's mean."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(c).cast("double") for c in columns)).alias("m")).first()
    mean = np.array([v or 0.0 for v in r["m"]])
    centred = df.select(*((F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - F.lit(float(m))).alias(f"c{i}") for i, (c, m) in enumerate(zip(columns, mean, strict=True))))
    return r["n"], mean, _gram(centred, centred.columns)


def linear(weights: np.ndarray, columns: list[str], intercept: float = 0.0) -> Column:
    return sum((F.lit(float(w)) * F.col(c) for w, c in zip(weights, columns, strict=True)), F.lit(float(intercept)))


@dataclass
class Ridge:
    alpha: float
    columns: list[str]

    @staticmethod
    def solve(g: np.ndarray, mean: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
        """From centred sums over the columns and the target, the target last. The intercept isn't penalised."""
        a, b = g[:-1, :-1] + alpha * np.eye(len(g) - 1), g[:-1, -1]
        try:
            w = np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            w = np.linalg.lstsq(a, b, rcond=None)[0]
        return w, float(mean[-1] - mean[:-1] @ w)

    def fit(self, df: DataFrame, y: str) -> Ridge:
        _, mean, g = centred_gram(df, [*self.columns, y])
        self.coef, self.intercept = self.solve(g, mean, self.alpha)
        return self

    def predict(self) -> Column:
        return linear(self.coef, self.columns, self.intercept)


def select_alpha(train: DataFrame, val: DataFrame, columns: list[str], y: str, alphas: list[float]) -> tuple[float, dict[float, float]]:
    """(best, validation rmse of each): one pass over train for all, one over val for all; ties to the larger."""
    _, mean, g = centred_gram(train, [*columns, y])
    models = {a: Ridge.solve(g, mean, a) for a in alphas}
    errors = val.agg(*(F.sqrt(F.avg(F.pow(F.col(y) - linear(w, columns, b), 2))).alias(f"e{i}") for i, (w, b) in enumerate(models.values()))).first()
    scores = dict(zip(models, errors, strict=True))
    return min(scores, key=lambda a: (scores[a], -a)), scores


@dataclass
class PCA:
    """Centred; variance over n - 1; a component's largest entry is positive."""

    columns: list[str]
    k: int | None = None

    def fit(self, df: DataFrame) -> PCA:
        n, self.mean, g = centred_gram(df, self.columns)
        values, vectors = np.linalg.eigh(g / max(n - 1, 1))
        order = np.argsort(-values)[: self.k]
        self.components = vectors[:, order].T
        self.components *= np.sign(self.components[np.arange(len(order)), np.abs(self.components).argmax(axis=1)])[:, None]
        self.variance = np.maximum(values[order], 0.0)
        self.ratio = self.variance / max(values.sum(), 1e-300)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"pc{i + 1}": linear(c, self.columns, -float(c @ self.mean)) for i, c in enumerate(self.components)})

    def variance_table(self, df: DataFrame) -> DataFrame:
        """(component, ratio, total): each component's share of the variance, and the running total."""
        rows = [(i + 1, float(r), float(t)) for i, (r, t) in enumerate(zip(self.ratio, np.cumsum(self.ratio), strict=True))]
        return df.sparkSession.createDataFrame(rows, "component int, ratio double, total double")

    def enough(self, share: float = 0.9) -> int:
        return int(np.searchsorted(np.cumsum(self.ratio), share - 1e-12) + 1)


def nearest(columns: list[str], centres: list[list[float]]) -> Column:
    """struct<d, k>: squared distance to the nearest centre; equals go to the first."""
    d = lambda c: sum((F.pow(F.col(x) - F.lit(float(v)), 2) for x, v in zip(columns, c, strict=True)), F.lit(0.0))
    return F.array_min(F.array(*(F.struct(d(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres))))


@dataclass
class KMeans:
    columns: list[str]
    k: int = 8
    n_init: int = 2
    max_iter: int = 50
    tol: float = 1e-6
    seed: int = 42

    def _seeds(self, df: DataFrame, rng: np.random.Generator) -> list[list[float]]:
        """k-means++: each next centre by weighted reservoir sampling on the squared distance, one pass each."""
        row = lambda d: [float(x) for x in d.select(*self.columns).first()]
        centres = [row(df.orderBy(F.xxhash64(*self.columns, F.lit(int(rng.integers(1 << 30))))).limit(1))]
        while len(centres) < self.k:
            u = (F.pmod(F.xxhash64(*self.columns, F.lit(int(rng.integers(1 << 30)))), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
            d = df.select(*self.columns, nearest(self.columns, centres)["d"].alias("d_")).where("d_ > 0").withColumn("p_", -F.ln(u) / F.col("d_"))
            got = d.orderBy("p_").limit(1)
            centres.append(centres[-1] if got.isEmpty() else row(got))
        return centres

    def step(self, df: DataFrame, centres: list[list[float]]) -> tuple[list[list[float]], float]:
        """One Lloyd step: (means, an empty cluster keeps its centre; inertia against the given centres)."""
        got = df.select(*self.columns, nearest(self.columns, centres).alias("n_")).groupBy("n_.k").agg(F.sum("n_.d").alias("d"), *(F.avg(c).alias(c) for c in self.columns)).collect()
        out = [list(c) for c in centres]
        for r in got:
            out[r["k"]] = [r[c] for c in self.columns]
        return out, sum(r["d"] for r in got)

    def fit(self, df: DataFrame, seeds: list[list[float]] | None = None) -> KMeans:
        rng, best = np.random.default_rng(self.seed), None
        for _ in range(1 if seeds else self.n_init):
            centres = seeds or self._seeds(df, rng)
            for _ in range(self.max_iter):
                new, _ = self.step(df, centres)
                moved = max(abs(a - b) for x, y in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True))
                centres = new
                if moved < self.tol:
                    break
            inertia = self.step(df, centres)[1]
            if best is None or inertia < best[0]:
                best = (inertia, centres)
        self.inertia, self.centres = best
        return self

    def predict(self) -> Column:
        return nearest(self.columns, self.centres)["k"]

    def report(self, df: DataFrame, error: Column | None = None) -> DataFrame:
        """(cluster, n, inertia) of each cluster, and the root mean square of `error` over its rows."""
        d = df.withColumn("near_", nearest(self.columns, self.centres))
        extra = [F.sqrt(F.avg(F.pow(error, 2))).alias("rmse")] if error is not None else []
        return d.groupBy(F.col("near_.k").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum("near_.d").alias("inertia"), *extra)
