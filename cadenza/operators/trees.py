"""Extremely randomised trees, grown level by level over all rows.

A node draws its features and one cut of each between the least and greatest value that its
rows have. A pass over the rows sends each down the trees that are known so far and counts by node;
what a task has counted is added up by one ``groupBy``. Nodes, not rows, come to the driver: at most
``trees`` * 2^``depth`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship
from ..storage import stored

#: Rows that a task sends down the trees at once.
ROWS = 8_192


@dataclass
class Node:
    """Rows by class, and what divides them: rows with feature < cut go left; feature -1 is a leaf."""

    counts: np.ndarray
    feature: int = -1
    cut: float = 0.0


@dataclass
class ExtraTrees:
    """ML-19: trees as nodes by number; the root is 1, the children of k are 2k and 2k + 1. Leaves give the share of class 1 by balanced weights."""

    trees: int
    depth: int
    features: Sequence[str]
    weights: np.ndarray
    nodes: list[dict[int, Node]] = field(default_factory=list)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, cut, score) by tree and node."""
        shape = (self.trees, 2 << self.depth)
        feature, cut, score = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape)
        for t, tree in enumerate(self.nodes):
            for k, node in tree.items():
                weighted = node.counts * self.weights
                feature[t, k], cut[t, k], score[t, k] = node.feature, node.cut, weighted[1] / max(weighted.sum(), 1e-300)
        return feature, cut, score


def draw(seed: int, tree: int, node: int, low: np.ndarray, high: np.ndarray, tried: int) -> list[tuple[int, float]]:
    """The features that a node tries, none constant in it, and a cut of each above its least and up to its greatest value."""
    random = np.random.default_rng([seed, tree, node])
    order, share = random.permutation(len(low)), random.random(len(low))
    found = []
    for f in order[high[order] > low[order]][:tried].tolist():
        cut = low[f] + share[f] * (high[f] - low[f])
        found.append((f, float(high[f] if cut <= low[f] else cut)))
    return found


def gini(counts: np.ndarray, weights: np.ndarray) -> float:
    """Weighted impurity times weight."""
    w = counts * weights
    return float(w.sum() - (w * w).sum() / w.sum()) if w.sum() else 0.0


def best_cut(cuts: Sequence[tuple[int, float]], left: np.ndarray, whole: np.ndarray, weights: np.ndarray, least: int) -> tuple[int, float] | None:
    """The cut of the least impurity whose sides have ``least`` rows; of equal ones the first that was drawn."""
    best, found = np.inf, None
    for (f, cut), own in zip(cuts, left):
        if min(own.sum(), (whole - own).sum()) >= least:
            cost = gini(own, weights) + gini(whole - own, weights)
            if cost < best - 1e-12:
                best, found = cost, (f, cut)
    return found


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row of ``x`` in one tree."""
    at, rows = np.ones(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[at]
        at = np.where(f >= 0, 2 * at + (x[rows, np.maximum(f, 0)] >= cut[at]), at)
    return at


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n)])


def fit(df: DataFrame, label: str, features: Sequence[str], trees: int = 100, depth: int = 10, least: int = 5, tried: int | None = None, seed: int = 42) -> ExtraTrees:
    """ML-09, ML-19: a forest over the rows whose label is 0 or 1; other labels and null ones take no part, missing and NaN values are 0.

    ``least`` rows stand in every leaf, a node tries ``tried`` features (the root of their number). Counts are whole numbers, so the
    forest does not depend on the order of rows or their partitions. No rows give a forest that scores 0.
    """
    spark, n = df.sparkSession, len(features)
    values = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x{k}") for k, c in enumerate(features)]
    rows = stored(df.where(F.col(label).isin(0, 1)).select(*values, F.col(label).cast("int").alias("y")), "tree-rows")
    tried = tried or max(1, int(np.sqrt(n)))
    forest = ExtraTrees(trees, depth, list(features), np.ones(2), [{} for _ in range(trees)])
    names = ["tree", "node", "n0", "n1", *[f"lo{k}" for k in range(n)], *[f"hi{k}" for k in range(n)]]
    ship(spark)

    def ranges(open_nodes: set[tuple[int, int]], level: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        feature, cut, _ = forest.arrays()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    x, y, out = _matrix(batch, n), batch.column(n).to_numpy(), []
                    for t in range(trees):
                        at = walk(x, feature[t], cut[t], level)
                        order = np.argsort(at, kind="stable")
                        starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                        keys = at[order][starts]
                        ones = np.add.reduceat(y[order].astype(np.int64), starts)
                        size = np.diff(np.append(starts, len(at)))
                        low, high = np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts)
                        keep = np.array([(t, k) in open_nodes for k in keys.tolist()])
                        out.append(np.column_stack((np.full(len(keys), t), keys, size - ones, ones, low, high))[keep])
                    yield _batch(np.concatenate(out), names)

        found = rows.mapInArrow(run, _schema(names)).groupBy("tree", "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *[F.min(f"lo{k}").alias(f"lo{k}") for k in range(n)], *[F.max(f"hi{k}").alias(f"hi{k}") for k in range(n)]
        )
        return {(r[0], r[1]): (np.array(r[2:4]), np.array(r[4 : 4 + n]), np.array(r[4 + n :])) for r in found.collect()}  # open nodes of a level

    def left_counts(cuts: dict[tuple[int, int], list[tuple[int, float]]], level: int) -> dict[tuple[int, int], np.ndarray]:
        feature, cut, _ = forest.arrays()
        shape = (trees, 1 << (level + 1), tried)
        try_f, try_cut = np.full(shape, -1, np.int32), np.zeros(shape)
        for (t, k), own in cuts.items():
            for j, (f, c) in enumerate(own):
                try_f[t, k, j], try_cut[t, k, j] = f, c
        columns = ["tree", "node", *[f"l{c}_{j}" for j in range(tried) for c in (0, 1)]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    x, y, out = _matrix(batch, n), batch.column(n).to_numpy().astype(np.int64), []
                    every = np.arange(len(x))
                    for t in range(trees):
                        at = walk(x, feature[t], cut[t], level)
                        keep = np.flatnonzero((at < shape[1]) & (try_f[t, np.minimum(at, shape[1] - 1), 0] >= 0))
                        if not len(keep):
                            continue
                        keys, place = np.unique(at[keep], return_inverse=True)
                        counts = np.zeros((len(keys), 2 * tried), np.int64)
                        for j in range(tried):
                            f = try_f[t, at[keep], j]
                            left = (f >= 0) & (x[every[keep], np.maximum(f, 0)] < try_cut[t, at[keep], j])
                            np.add.at(counts, (place[left], 2 * j + y[keep][left]), 1)
                        out.append(np.column_stack((np.full(len(keys), t), keys, counts)))
                    if out:
                        yield _batch(np.concatenate(out), columns)

        found = rows.mapInArrow(run, _schema(columns)).groupBy("tree", "node").agg(*[F.sum(c).alias(c) for c in columns[2:]])
        return {(r[0], r[1]): np.array(r[2:]).reshape(tried, 2) for r in found.collect()}  # open nodes of a level

    open_nodes = {(t, 1) for t in range(trees)}
    for level in range(depth + 1):
        seen = ranges(open_nodes, level)
        if level == 0 and seen:
            counts = next(iter(seen.values()))[0]
            forest.weights = counts.sum() / (np.count_nonzero(counts) * np.maximum(counts, 1))
        for (t, k), (counts, _, _) in seen.items():
            forest.nodes[t][k] = Node(counts)
        cuts = {at: draw(seed, *at, low, high, tried) for at, (counts, low, high) in seen.items() if level < depth and counts.min() > 0 and counts.sum() >= 2 * least}
        cuts = {at: own for at, own in cuts.items() if own}
        if not cuts:
            break
        open_nodes = set()
        for (t, k), left in left_counts(cuts, level).items():
            chosen = best_cut(cuts[t, k], left, seen[t, k][0], forest.weights, least)
            if chosen:
                forest.nodes[t][k].feature, forest.nodes[t][k].cut = chosen
                open_nodes |= {(t, 2 * k), (t, 2 * k + 1)}
        if not open_nodes:
            break
    return forest


def _schema(names: Sequence[str]) -> str:
    return ", ".join(f"{c} {'double' if c[:2] in ('lo', 'hi') else 'long'}" for c in names)


def _batch(table: np.ndarray, names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(table[:, k] if c[:2] in ("lo", "hi") else table[:, k].astype(np.int64)) for k, c in enumerate(names)], list(names))


def scored(forest: ExtraTrees, df: DataFrame, name: str = "score") -> DataFrame:
    """ML-55, ML-62: the mean score of the trees for every row, rounded to 9 digits; missing and NaN values are 0."""
    n, kept = len(forest.features), [c for c in df.columns if c != name]
    values = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_x{k}") for k, c in enumerate(forest.features)]
    feature, cut, score = forest.arrays()
    depth, trees = forest.depth, forest.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, n)
            total = sum(score[t][walk(x, feature[t], cut[t], depth)] for t in range(trees))
            yield pa.RecordBatch.from_arrays([*batch.columns[n:], pa.array(np.round(total / trees, 9))], [*kept, name])

    ship(df.sparkSession)
    own = df.select(*values, *[F.col(c) for c in kept])
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[n:]], f"`{name}` double"])
    return own.mapInArrow(run, fields)
