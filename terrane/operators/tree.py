"""Exact CART, random forests and boosting by level-wise aggregation.

A level is one job for all open nodes of all trees: rows go to (tree, node, feature, value) sums, combined before
the shuffle; sorted running sums give every threshold's gain. The running sums are two-level (within value buckets, then over bucket
totals), so no feature of a node has to fit one task. Trees live at the driver as node tables; rows find their node through a CASE
expression, or, beyond SMALL nodes, by walking down the tables (`descend`), with the same result. Nothing is checkpointed
between levels. A missing value takes no part in choosing a split on its feature and goes right."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrane.functions import matrix, storage
from terrane.functions.numeric import hash32, ratio
from terrane.operators.descend import Nodes

BUCKETS = 64
#: Sums of a level (some tens of bytes each) up to which the driver takes them.
CELLS = 200_000
#: Nodes up to which a tree is written out as an expression.
SMALL = 200


@dataclass
class Node:
    id: int
    depth: int
    n: float
    sums: list[float]  # class counts, or [sum of y, sum of y squared]
    impurity: float
    feature: str | None = None
    threshold: float | None = None
    left: int | None = None
    right: int | None = None
    gain: float = 0.0


@dataclass
class Tree:
    """task: classification (y is 0 to classes - 1) or regression."""

    task: str = "classification"
    criterion: str = "gini"
    classes: int = 2
    nodes: list[Node] = field(default_factory=list)

    def value(self, node: Node) -> list[float]:
        return [c / node.n for c in node.sums] if self.task == "classification" else [node.sums[0] / node.n]

    def features(self) -> list[str]:
        return sorted({n.feature for n in self.nodes if n.left is not None})

    def arrays(self, features: list[str], values: list[float] | None = None) -> Nodes:
        """The tree over columns in the given order. values: of the nodes; by default the mean, or the last class's share."""
        at = {f: i for i, f in enumerate(features)}
        values = [self.value(n)[-1] for n in self.nodes] if values is None else values
        number = lambda xs, kind: np.array(xs, dtype=kind)
        inner = [n.left is not None for n in self.nodes]
        return Nodes(
            number([at[n.feature] if i else -1 for n, i in zip(self.nodes, inner, strict=True)], np.int64),
            number([n.threshold if i else 0.0 for n, i in zip(self.nodes, inner, strict=True)], float),
            number([n.left or 0 for n in self.nodes], np.int64),
            number([n.right or 0 for n in self.nodes], np.int64),
            number([n.depth for n in self.nodes], np.int64),
            number(values, float),
        )

    def _walk(self, values: list[float], depth: int | None = None) -> Column:
        """The value of the node that a row ends in."""
        if len(self.nodes) > SMALL:
            return F.get(_tables([self], [values], self.features(), depth), F.lit(0))

        def branch(at: int) -> Column:
            node = self.nodes[at]
            if node.left is None or (depth is not None and node.depth >= depth):
                return F.lit(float(values[at]))
            return F.when(F.col(node.feature) <= F.lit(node.threshold), branch(node.left)).otherwise(branch(node.right))

        return branch(0)

    def node_id(self, depth: int | None = None) -> Column:
        return self._walk([n.id for n in self.nodes], depth).cast("int")

    def _label(self, node: Node) -> int:
        return max(range(self.classes), key=lambda c: (node.sums[c], -c))

    def predict(self, depth: int | None = None) -> Column:
        """The mean, or the most probable class, the lowest of equals. depth: as if grown to it."""
        if self.task == "regression":
            return self._walk([self.value(n)[0] for n in self.nodes], depth)
        return self._walk([self._label(n) for n in self.nodes], depth).cast("int")

    def probability(self, label: int = 1, depth: int | None = None) -> Column:
        return self._walk([self.value(n)[label] for n in self.nodes], depth)

    def path_effects(self, features: list[str]) -> dict[str, Column]:
        """Per feature, the change of the value along a row's path that its splits cause; they add up to the prediction
        less the root's value."""
        return path_effects([self], features)

    def depth(self) -> int:
        return max(n.depth for n in self.nodes)

    def importances(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for n in self.nodes:
            if n.left is not None:
                out[n.feature] = out.get(n.feature, 0.0) + n.gain * n.n
        total = sum(out.values())
        return {f: v / total for f, v in sorted(out.items())} if total else {}

    def table(self) -> list[tuple]:
        """(node_id, feature, threshold, left, right, value, depth, n)."""
        return [(n.id, n.feature, n.threshold, n.left, n.right, self.value(n), n.depth, n.n) for n in self.nodes]

    def export_text(self, most: int = 3, at: int = 0, indent: str = "") -> str:
        n = self.nodes[at]
        if n.left is None or n.depth >= most:
            return f"{indent}value={[round(v, 3) for v in self.value(n)]} n={n.n:g}\n"
        return f"{indent}{n.feature} <= {n.threshold:.3f}\n{self.export_text(most, n.left, indent + '|   ')}{indent}{n.feature} > {n.threshold:.3f}\n{self.export_text(most, n.right, indent + '|   ')}"


def _tables(trees: list[Tree], values: list[list[float]], features: list[str], depth: int | None = None) -> Column:
    """array<double>: the value of the node that a row ends in, for each tree."""
    tables = [t.arrays(features, v) for t, v in zip(trees, values, strict=True)]

    def of(x: np.ndarray) -> np.ndarray:
        return np.stack([t.value[t.leaves(x, depth)] for t in tables], axis=1)

    return matrix.mapped(features, of, missing=True)


def path_effects(trees: list[Tree], features: list[str]) -> dict[str, Column]:
    """Mean over the trees of what each feature's splits change along a row's path; with the mean of the root values they add up
    to the prediction."""
    tables = [t.arrays(features) for t in trees]

    def of(x: np.ndarray) -> np.ndarray:
        return sum(t.effects(x, len(features)) for t in tables) / len(tables)

    all_ = matrix.mapped(features, of, missing=True)
    return {f: F.get(all_, F.lit(i)) for i, f in enumerate(features)}


def impurity(sums: list[Column], n: Column, criterion: str) -> Column:
    if criterion == "mse":
        return F.greatest(ratio(sums[1], n) - F.pow(ratio(sums[0], n), 2), F.lit(0.0))
    out = F.lit(1.0 if criterion == "gini" else 0.0)
    for s in sums:
        p = ratio(s, n)
        out = out - (F.pow(p, 2) if criterion == "gini" else F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return out


def _impurity(sums: list[float], n: float, criterion: str) -> float:
    if criterion == "mse":
        return max(sums[1] / n - (sums[0] / n) ** 2, 0.0)
    p = [s / n for s in sums]
    return 1 - sum(x * x for x in p) if criterion == "gini" else -sum(x * math.log2(x) for x in p if x)


#: Rows that are added up together before they leave a worker.
ROWS = 65_536


def cell_sums(df: DataFrame, features: list[str], sums: list[str]) -> DataFrame:
    """(t, node, fi, v, w, sums...): of the rows of each batch, added up by tree, node, feature and value; without missing values. A row
    of numbers is never spread over its features: numpy counts a batch feature by feature."""
    values = ", ".join(f"cast(`{f}` as double)" for f in features)
    d = df.select("t", "node", F.expr(f"array({values})").alias("x"), F.array("w", *sums).alias("s"))
    width = len(features)

    def added(t: np.ndarray, node: np.ndarray, x: np.ndarray, there: np.ndarray, s: np.ndarray, known: dict[int, np.ndarray]) -> pa.RecordBatch:
        group, at = np.unique(t.astype(np.int64) << 32 | node, return_inverse=True)
        parts = []
        for f in range(width):
            v, ok = x[:, f], there[:, f]
            g, weights = (at, s) if ok.all() else (at[ok], s[ok])
            v = v if ok.all() else v[ok]
            number = known.get(f, np.zeros(0))
            place = np.searchsorted(number, v)
            if not len(number) or not np.array_equal(number[np.minimum(place, len(number) - 1)], v, equal_nan=True):
                own = np.unique(v)
                number = np.unique(np.concatenate([number, own])) if len(number) + len(own) <= ROWS // 16 else own
                known[f] = number if len(number) <= ROWS // 16 else np.zeros(0)
                place = np.searchsorted(number, v)
            cell = place * len(group) + g
            size = max(len(number) * len(group), 1)
            if size > 4 * len(v):  # values that few rows share
                named, cell = np.unique(cell, return_inverse=True)
                size = len(named)
            else:
                named = None
            n = np.bincount(cell, minlength=size)
            seen = np.flatnonzero(n)
            name = seen if named is None else named[seen]
            parts.append((group[name % len(group)], np.full(len(seen), f), number[name // len(group)], np.stack([np.bincount(cell, weights=w, minlength=size)[seen] for w in weights.T])))
        of = np.concatenate([p[0] for p in parts])
        columns = [of >> 32, of & 0xFFFFFFFF, np.concatenate([p[1] for p in parts])]
        total = np.concatenate([p[3] for p in parts], axis=1)
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(np.concatenate([p[2] for p in parts])), *map(pa.array, total)], [*("t", "node", "fi", "v"), "w", *sums])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, known = [], 0, {}
        for b in itertools.chain(batches, [None]):
            if b is not None and b.num_rows:
                flat = b.column(2).flatten()
                x, there = flat.to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
                waiting.append((b.column(0).to_numpy(), b.column(1).to_numpy(), x.reshape(-1, width), there.reshape(-1, width), matrix.rows_of(b.column(3))))
                n += b.num_rows
            if waiting and (b is None or n >= ROWS):
                yield added(*map(np.concatenate, zip(*waiting, strict=True)), known)
                waiting, n = [], 0

    return d.mapInArrow(partial, "t int, node int, fi int, v double, w double, " + ", ".join(f"{s} double" for s in sums)) if width else d.select("t", "node", F.lit(0).alias("fi"), F.lit(0.0).alias("v"), "w", *sums).limit(0)


def best_splits(df: DataFrame, features: list[str], sums: list[str], criterion: str, min_leaf: float, edges: dict[str, list[float]], tried: int | None = None, seed: int = 42) -> DataFrame:
    """df (t, node, w, sums..., features): the best split of each (t, node): feature, threshold, gain and the left side's sums.

    Gain ties go to the feature that comes first, then the lower threshold; tried: that many features of a node, by hash, come
    before the others."""
    return splits_of(cells_of(df, features, sums), features, sums, criterion, min_leaf, edges, tried, seed)


def cells_of(df: DataFrame, features: list[str], sums: list[str]) -> DataFrame:
    return cell_sums(df, features, sums).groupBy("t", "node", "fi", "v").agg(F.sum("w").alias("w"), *(F.sum(s).alias(s) for s in sums))


def found_splits(df: DataFrame, features: list[str], sums: list[str], criterion: str, min_leaf: float, edges: Callable[[], dict[str, list[float]]], tried: int | None = None, seed: int = 42) -> list[dict[str, object]]:
    """best_splits as rows at the driver, one for each open node. Up to CELLS sums are searched there, with no further job."""
    cells = storage.kept(cells_of(df, features, sums))
    try:
        if cells.count() > CELLS:
            return [r.asDict() for r in splits_of(cells, features, sums, criterion, min_leaf, edges(), tried, seed).collect()]
        got = cells.toArrow()
    finally:
        cells.unpersist()
    c = {n: got.column(n).to_numpy() for n in got.column_names}
    order = np.lexsort((c["v"], c["fi"], c["node"], c["t"]))
    c = {n: x[order] for n, x in c.items()}
    if not len(order):
        return []
    starts = np.flatnonzero(np.r_[True, (np.diff(c["t"]) != 0) | (np.diff(c["node"]) != 0) | (np.diff(c["fi"]) != 0)])
    best: dict[tuple[int, int], tuple] = {}
    for a, b in zip(starts, np.r_[starts[1:], len(order)], strict=True):
        if b - a < 2:
            continue
        v, run = c["v"][a:b], {s: np.cumsum(c[s][a:b]) for s in ("w", *sums)}
        whole, left = {s: x[-1] for s, x in run.items()}, {s: x[:-1] for s, x in run.items()}
        right = {s: whole[s] - x for s, x in left.items()}
        side = lambda d: impurities([d[s] for s in sums], d["w"], criterion)
        gain = side({s: np.array([x]) for s, x in whole.items()})[0] - (left["w"] * side(left) + right["w"] * side(right)) / whole["w"]
        with np.errstate(invalid="ignore", over="ignore"):
            middle = (v[:-1] + v[1:]) / 2
            threshold = np.where(middle < v[1:], middle, v[:-1])
        may = np.flatnonzero((left["w"] >= min_leaf) & (right["w"] >= min_leaf))
        if not len(may):
            continue
        i = may[np.lexsort((threshold[may], -np.round(gain[may], 12)))[0]]
        t, node, fi = int(c["t"][a]), int(c["node"][a]), int(c["fi"][a])
        rank = (fi in drawn(t, node, len(features), tried, seed), np.round(gain[i], 12), -fi)
        if (t, node) not in best or rank > best[t, node][0]:
            best[t, node] = (rank, {"t": t, "node": node, "f": features[fi], "threshold": float(threshold[i]), "gain": float(gain[i]), **{f"l_{s}": float(left[s][i]) for s in ("w", *sums)}})
    return [r for _, r in best.values()]


@lru_cache(100_000)
def drawn(t: int, node: int, features: int, tried: int | None, seed: int) -> frozenset[int]:
    """The numbers of the features that a node tries first: hash32's order."""
    if tried is None or tried >= features:
        return frozenset(range(features))
    draw = [int(hashlib.md5(f"{t}|{node}|{i}|{seed}".encode()).hexdigest()[:8], 16) for i in range(features)]
    return frozenset(i for i in range(features) if sum(d < draw[i] for d in draw) < tried)


def impurities(sums: list[np.ndarray], n: np.ndarray, criterion: str) -> np.ndarray:
    """impurity of arrays."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = [np.where(n != 0, s / n, 0.0) for s in sums]
        if criterion == "mse":
            return np.maximum(p[1] - p[0] ** 2, 0.0)
        if criterion == "gini":
            return 1.0 - sum(x * x for x in p)
        return -sum(np.where(x > 0, x * np.log2(x), 0.0) for x in p)


def splits_of(cells: DataFrame, features: list[str], sums: list[str], criterion: str, min_leaf: float, edges: dict[str, list[float]], tried: int | None = None, seed: int = 42) -> DataFrame:
    """best_splits of cells_of."""
    low = F.from_json(F.lit(json.dumps([edges[f] for f in features])), "array<array<double>>")  # one literal, by feature number
    keys = ["t", "node", "fi"]
    cells = cells.withColumn("bucket", F.size(F.filter(F.get(low, F.col("fi")), lambda e: e <= F.col("v"))))
    inner = W.partitionBy(*keys, "bucket").orderBy("v")
    cells = cells.withColumns({f"c_{s}": F.sum(s).over(inner) for s in ("w", *sums)}).withColumn("next_in", F.lead("v").over(inner))
    totals = cells.groupBy(*keys, "bucket").agg(*(F.sum(s).alias(f"b_{s}") for s in ("w", *sums)), F.min("v").alias("first"))
    outer = W.partitionBy(*keys).orderBy("bucket")
    every = W.partitionBy(*keys)
    totals = totals.select(*keys, "bucket", F.lead("first").over(outer).alias("next_out"), *((F.sum(f"b_{s}").over(outer) - F.col(f"b_{s}")).alias(f"before_{s}") for s in ("w", *sums)), *(F.sum(f"b_{s}").over(every).alias(f"all_{s}") for s in ("w", *sums)))
    d = cells.join(totals, [*keys, "bucket"]).withColumn("next", F.coalesce("next_in", "next_out")).where("next is not null")
    left = {s: F.col(f"c_{s}") + F.col(f"before_{s}") for s in ("w", *sums)}
    d = d.select(*keys, "v", "next", *(c.alias(f"l_{s}") for s, c in left.items()), *(F.col(f"all_{s}") for s in ("w", *sums)))
    side = lambda pre: impurity([F.col(f"{pre}_{s}") if pre == "l" else F.col(f"all_{s}") - F.col(f"l_{s}") for s in sums], F.col("l_w") if pre == "l" else F.col("all_w") - F.col("l_w"), criterion)
    whole = impurity([F.col(f"all_{s}") for s in sums], F.col("all_w"), criterion)
    d = d.withColumn("gain", whole - (F.col("l_w") * side("l") + (F.col("all_w") - F.col("l_w")) * side("r")) / F.col("all_w"))
    middle = (F.col("v") + F.col("next")) / 2
    d = d.where((F.col("l_w") >= min_leaf) & (F.col("all_w") - F.col("l_w") >= min_leaf)).withColumn("threshold", F.when(middle >= F.col("next"), F.col("v")).otherwise(middle))
    found = F.max_by(F.struct("threshold", "gain", *(F.col(f"l_{s}") for s in ("w", *sums))), F.struct(F.round("gain", 12), -F.col("threshold")))
    d = d.groupBy(*keys).agg(found.alias("s"))  # a row for each node and feature
    first = F.lit(1)
    if tried is not None and tried < len(features):
        draws = lambda i: hash32(seed, F.col("t"), F.col("node"), i)
        first = (F.size(F.filter(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda i: draws(i) < draws(F.col("fi")))) < tried).cast("int")
    name = F.get(F.from_json(F.lit(json.dumps(features)), "array<string>"), F.col("fi"))
    best = F.max_by(F.struct(name.alias("f"), "s"), F.struct("first_", F.round("s.gain", 12), -F.col("fi"), -F.col("s.threshold")))
    return d.withColumn("first_", first).groupBy("t", "node").agg(best.alias("b")).select("t", "node", "b.f", "b.s.*")


def edges_of(df: DataFrame, features: list[str], buckets: int = BUCKETS) -> dict[str, list[float]]:
    """Cut points that deal a feature's values into buckets of about one size; they steer work, never results."""
    at = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    r = df.agg(*(F.percentile_approx(F.col(f).cast("double"), at, F.lit(200)).alias(f) for f in features)).first()
    return {f: sorted(set(r[f] or [])) for f in features}


def grow(df: DataFrame, features: list[str], y: str, task: str = "classification", criterion: str | None = None, classes: int = 2, trees: int = 1, weight: Column | None = None, max_depth: int | None = 6, min_split: float = 2, min_leaf: float = 1, min_decrease: float = 0.0, max_features: int | str | float | None = None, seed: int = 42) -> list[Tree]:
    """trees over df; weight: of a row in tree `t` (a column expression over `t`), 1 by default. max_depth: None for no bound."""
    criterion = criterion or ("gini" if task == "classification" else "mse")
    if criterion not in (("gini", "entropy") if task == "classification" else ("mse",)):
        raise ValueError(f"no criterion of {task}: {criterion}")
    d = len(features)
    tried = {"sqrt": max(1, int(math.sqrt(d))), "log2": max(1, int(math.log2(d))), None: None}.get(max_features, max_features) if not isinstance(max_features, float) else max(1, int(max_features * d))
    shift = 0.0
    if task == "regression":  # sums of squares keep their digits around the mean
        shift = float(df.agg(F.avg(y)).first()[0] or 0.0)
    sums = [f"s{c}" for c in range(classes)] if task == "classification" else ["s0", "s1"]
    edges = cache(lambda: edges_of(df, features))
    out = [Tree(task, criterion, classes) for _ in range(trees)]

    def rows(at: Column) -> DataFrame:
        """A row for each tree it takes part in, with its node (-1: in a leaf). at: the node for each tree."""
        x = df.select(y, *features, *(c for c in df.columns if c.endswith("_")), F.posexplode(at).alias("t", "node")).withColumn("node", F.col("node").cast("int")).where("node >= 0")
        if weight is None:
            x = x.withColumn("w", F.lit(1.0))
        else:  # made once: a plain column would be written out wherever it is used
            x = x.select("*", F.inline(F.array(F.struct(weight.cast("double").alias("w"))))).where("w > 0")
        yy = F.col(y).cast("double") - shift
        s = [F.when(F.col(y) == c, F.col("w")).otherwise(0.0) for c in range(classes)] if task == "classification" else [F.col("w") * yy, F.col("w") * yy * yy]
        return x.withColumns(dict(zip(sums, s, strict=True)))

    for r in rows(F.array(*([F.lit(0.0)] * trees))).groupBy("t").agg(F.sum("w").alias("w"), *(F.sum(s).alias(s) for s in sums)).collect():
        v = [r[s] for s in sums]
        out[r["t"]].nodes.append(Node(0, 0, r["w"], v, _impurity(v, r["w"], criterion)))
    root_n = [t.nodes[0].n if t.nodes else 0.0 for t in out]
    for depth in itertools.count() if max_depth is None else range(max_depth):
        may = [[n for n in t.nodes if n.depth == depth and n.left is None and n.n >= max(min_split, 2 * min_leaf) and n.impurity > 1e-12] for t in out]
        if not any(may):
            break
        ids = [{n.id for n in m} for m in may]
        values = [[n.id if n.id in ids[k] else -1 for n in t.nodes] for k, t in enumerate(out)]
        if sum(len(t.nodes) for t in out) > SMALL and all(t.nodes for t in out):
            at = _tables(out, values, features)
        else:
            at = F.array(*(t._walk(v) if t.nodes else F.lit(-1.0) for t, v in zip(out, values, strict=True)))
        split = False
        for r in found_splits(rows(at), features, sums, criterion, min_leaf, edges, tried, seed):  # a row for each open node
            t = out[r["t"]]
            n = t.nodes[r["node"]]
            if n.n / root_n[r["t"]] * r["gain"] < min_decrease - 1e-12:
                continue
            ls = [r[f"l_{s}"] for s in sums]
            rs = [a - b for a, b in zip(n.sums, ls, strict=True)]
            n.feature, n.threshold, n.gain, n.left, n.right = r["f"], r["threshold"], r["gain"], len(t.nodes), len(t.nodes) + 1
            for s, w in ((ls, r["l_w"]), (rs, n.n - r["l_w"])):
                t.nodes.append(Node(len(t.nodes), depth + 1, w, s, _impurity(s, w, criterion)))
            split = True
        if not split:
            break
    if shift:
        for t in out:
            for n in t.nodes:
                n.sums = [n.sums[0] + shift * n.n, n.sums[1]]
    return out


def bootstrap_weight(key: str, seed: int = 42) -> Column:
    """How often tree `t` draws a row: Poisson with mean 1, which n draws of n rows approach; by hash, so every pass agrees."""
    h = F.md5(F.concat_ws("|", F.col("t").cast("string"), F.col(key).cast("string"), F.lit(str(seed))))  # hash32 in hex: its digits are in the order of the numbers
    total, p = 0.0, math.exp(-1)
    steps = []
    for k in range(6):
        total += p / math.factorial(k)
        steps.append((total, k))

    def draws(v: Column) -> Column:
        out = F.lit(6)
        for edge, k in reversed(steps):
            out = F.when(v < f"{math.ceil(edge * 2**32):08x}", F.lit(k)).otherwise(out)
        return out

    return F.get(F.transform(F.array(h), draws), F.lit(0))  # so that the hash is made once


@dataclass
class Forest:
    trees: list[Tree]
    key: str
    seed: int

    def each(self, stages: int | None = None) -> Column:
        """array<double>: each tree's value, or its probability of class 1."""
        ts = self.trees[:stages]
        values = [[t.value(n)[-1] for n in t.nodes] for t in ts]
        if sum(len(t.nodes) for t in ts) > SMALL:
            return _tables(ts, values, sorted({f for t in ts for f in t.features()}))
        return F.array(*(t._walk(v) for t, v in zip(ts, values, strict=True)))

    def predict(self, stages: int | None = None) -> Column:
        """Mean value, or mean probability of class 1."""
        return F.aggregate(self.each(stages), F.lit(0.0), lambda acc, v: acc + v) / float(len(self.trees[:stages]))

    def staged(self) -> Column:
        """array<double>: the prediction of the first tree, of the first two, and so on."""
        start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
        step = lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array((acc["sum"] + v) / (F.size(acc["out"]) + 1.0))).alias("out"))
        return F.aggregate(self.each(), start, step, lambda acc: acc["out"])

    def spread(self, low: float = 0.1, high: float = 0.9) -> tuple[Column, Column]:
        """Linear quantiles of the trees' values for a row."""
        values = F.sort_array(self.each())
        n = len(self.trees) - 1

        def at(q: float) -> Column:
            k = int(q * n)
            below, above = F.get(values, F.lit(k)), F.get(values, F.lit(min(k + 1, n)))
            return below + (q * n - k) * (above - below)

        return at(low), at(high)

    def path_effects(self, features: list[str]) -> dict[str, Column]:
        return path_effects(self.trees, features)

    def base(self) -> float:
        """Mean of the root values: the prediction before any split."""
        return sum(t.value(t.nodes[0])[-1] for t in self.trees) / len(self.trees)

    def out_of_bag(self) -> Column:
        """Mean over the trees that didn't draw the row; null if all did."""
        drawn = [hash32(self.seed, F.lit(k), F.col(self.key)) / F.lit(4294967296.0) < math.exp(-1) for k in range(len(self.trees))]
        left = F.filter(F.arrays_zip(self.each().alias("v"), F.array(*drawn).alias("out")), lambda e: e["out"])
        return F.try_divide(F.aggregate(left, F.lit(0.0), lambda acc, e: acc + e["v"]), F.size(left).cast("double"))


def forest(df: DataFrame, features: list[str], y: str, key: str, trees: int = 8, max_features: int | str | float | None = "sqrt", seed: int = 42, **params) -> Forest:
    """key: names the rows; it must end with _ to pass through."""
    return Forest(grow(df, features, y, trees=trees, weight=bootstrap_weight(key, seed), max_features=max_features, seed=seed, **params), key, seed)


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)  # mean squared error on the fit rows after each tree

    def predict(self, stages: int | None = None) -> Column:
        ts = self.trees[:stages]
        if not ts:
            return F.lit(self.base)
        return F.lit(self.base) + self.rate * F.aggregate(Forest(ts, "", 0).each(), F.lit(0.0), lambda acc, v: acc + v)


def boost(df: DataFrame, features: list[str], y: str, trees: int = 20, rate: float = 0.1, max_depth: int | None = 4, min_leaf: float = 1) -> Boosted:
    """Residual trees from the mean on; every tree is scaled by the rate."""
    model = Boosted(float(df.agg(F.avg(y)).first()[0]), rate, [])
    for _ in range(trees):
        d = df.withColumn("residual", F.col(y) - model.predict())
        model.trees += grow(d, features, "residual", task="regression", max_depth=max_depth, min_leaf=min_leaf)
        model.losses.append(float(df.agg(F.avg(F.pow(F.col(y) - model.predict(), 2))).first()[0]))
    return model


@dataclass
class Labels:
    """Classes of any values, numbered in their order; a tree works on the numbers."""

    values: list

    @staticmethod
    def of(df: DataFrame, y: str, most: int = 1000) -> Labels:
        got = [r[0] for r in df.where(F.col(y).isNotNull()).select(y).distinct().limit(most + 1).collect()]
        if len(got) > most:
            raise ValueError(f"more than {most} classes")
        return Labels(sorted(got))

    def number(self, c: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, self.values)), c).cast("int") - 1

    def value(self, c: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.values)), c)


def compare(a: Tree, b: Tree, df: DataFrame | None = None, tolerance: float = 1e-9) -> dict[str, int]:
    """Lockstep walk of two trees: same_split, float32 (thresholds that are equal in single precision), same_partition (other
    splits that deal df's rows in the same way), tie (the same gain), decision_mismatch, gain_mismatch, leaves. Below a node whose
    splits aren't the same the walk ends."""
    out = dict.fromkeys(("same_split", "same_partition", "tie", "float32", "gain_mismatch", "decision_mismatch", "leaves"), 0)
    todo, unlike = [(0, 0, F.lit(True))], []
    while todo:
        i, j, here = todo.pop()
        m, n = a.nodes[i], b.nodes[j]
        if m.left is None and n.left is None:
            out["leaves"] += 1
        elif m.left is None or n.left is None:
            out["decision_mismatch"] += 1
        else:
            low = F.col(m.feature) <= F.lit(m.threshold)
            near = m.feature == n.feature and abs(m.threshold - n.threshold) <= tolerance * max(1.0, abs(m.threshold))
            single = m.feature == n.feature and np.float32(m.threshold) == np.float32(n.threshold)
            if near or single:
                out["same_split" if near else "float32"] += 1
                todo += [(m.left, n.left, here & low), (m.right, n.right, here & ~low)]
            else:
                unlike.append((here, low, F.col(n.feature) <= F.lit(n.threshold), abs(m.gain - n.gain) <= tolerance))
    alike = df.agg(*(F.count_if(here & (p != q)).alias(f"c{k}") for k, (here, p, q, _) in enumerate(unlike))).first() if unlike and df is not None else [1] * len(unlike)
    for (_, _, _, tie), differ in zip(unlike, alike, strict=True):
        out["same_partition" if not differ else "tie" if tie else "gain_mismatch"] += 1
    return out
