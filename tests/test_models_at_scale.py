"""Extra trees, stratified folds, one-class offsets, exact quantiles and vocabularies against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest

from cadenza.functions.lexicon import vocabulary
from cadenza.operators import models, retrieval, trees
from cadenza.operators.quantiles import exact_quantiles
from cadenza.operators.sampling import hard_negatives


def plain_trees(x, y, count, depth, least, tried, seed):
    """The same forest by recursion over arrays."""
    total = np.bincount(y, minlength=2)
    weights = total.sum() / (np.count_nonzero(total) * np.maximum(total, 1))

    def grow(t, k, rows, level, out):
        counts = np.bincount(y[rows], minlength=2)
        out[k] = (-1, 0.0, counts)
        if level == depth or counts.min() == 0 or len(rows) < 2 * least:
            return
        cuts = trees.draw(seed, t, k, x[rows].min(axis=0), x[rows].max(axis=0), tried)
        left = [np.bincount(y[rows][x[rows, f] < c], minlength=2) for f, c in cuts]
        chosen = trees.best_cut(cuts, left, counts, weights, least) if cuts else None
        if chosen:
            out[k] = (*chosen, counts)
            side = x[rows, chosen[0]] < chosen[1]
            grow(t, 2 * k, rows[side], level + 1, out)
            grow(t, 2 * k + 1, rows[~side], level + 1, out)

    forest = []
    for t in range(count):
        forest.append({})
        grow(t, 1, np.arange(len(y)), 0, forest[-1])
    return forest, weights


def test_extra_trees_equal_the_plain_version(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(600, 4)), 3)
    x[:, 3] = 1.0  # constant
    y = (x[:, 0] + 0.5 * rng.normal(size=600) > 0.7).astype(int)
    rows = [(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (-1, 9.0, 9.0, 9.0, 9.0, None), (-2, 9.0, 9.0, 9.0, 9.0, 7)], "id long, a double, b double, c double, d double, y int").repartition(5)
    found = trees.fit(df, "y", list("abcd"), trees=5, depth=6, least=5, seed=9)
    forest, weights = plain_trees(x, y, 5, 6, 5, 2, 9)
    got = [{k: (n.feature, n.cut, n.counts.tolist()) for k, n in tree.items()} for tree in found.nodes]
    assert got == [{k: (f, c, n.tolist()) for k, (f, c, n) in tree.items()} for tree in forest]
    assert max(len(t) for t in got) > 10

    def score(row):
        total = 0.0
        for tree in forest:
            k = 1
            while tree[k][0] >= 0:
                k = 2 * k + int(row[tree[k][0]] >= tree[k][1])
            w = tree[k][2] * weights
            total += w[1] / w.sum()
        return round(total / len(forest), 9)

    scores = {r.id: r.score for r in trees.scored(found, df).collect()}
    assert all(scores[i] == pytest.approx(score(x[i]), abs=1e-8) for i in range(600))
    assert np.mean([scores[i] for i in np.flatnonzero(y)]) > 0.25 + np.mean([scores[i] for i in np.flatnonzero(y == 0)])


def test_extra_trees_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 0), (2, float("nan"), 0)], "id long, a double, y int")
    one = trees.fit(df, "y", ["a"], trees=2, depth=3)
    assert [r.score for r in trees.scored(one, df).collect()] == [0.0, 0.0]  # one class
    none = trees.fit(df.where("false"), "y", ["a"], trees=2, depth=3)
    assert [r.score for r in trees.scored(none, df).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("slice_rows", [200_000, 7])
def test_folds_are_ranks_within_a_class(spark, slice_rows):
    rng = random.Random(1)
    rows = [(k, rng.choice([0, 0, 0, 1, None])) for k in range(200)]
    found = {r.id: r.fold for r in models.stratified_folds(spark.createDataFrame(rows, "id long, y int"), "id", "y", 5, 42, slice_rows).collect()}
    for label in (0, 1, None):
        own = sorted((hashlib.md5(f"42:{k}".encode()).hexdigest(), k) for k, y in rows if y == label)
        assert [found[k] for _, k in own] == [i % 5 for i in range(len(own))]


def test_out_of_fold_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v), int(v + rng.normal() > 0)) for k, v in enumerate(rng.normal(size=80))]
    df = spark.createDataFrame(rows, "id long, v double, y int")
    found = models.out_of_fold(df, "id", "y", ["v"])
    assert found.count() == 80 and found.columns == ["id", "v", "y", "score"]
    lone = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 0), (3, 2.0, 1)], "id long, v double, y int")
    assert models.out_of_fold(lone, "id", "y", ["v"]).count() == 3  # a class of one row: one model


def test_oneclass_scores_have_the_contamination_offset(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1000, 2))
    forest = retrieval.IsolationForest(sample=256).fit(x)
    over = (forest.oneclass(x) > 0.5).mean()
    assert 0.06 <= over <= 0.08  # as many training rows as the contamination says
    normality = -forest.anomaly(x)
    expected = 1 / (1 + np.exp(4 * (normality - np.percentile(normality, 8))))
    assert np.allclose(forest.oneclass(x), expected)


def test_oneclass_decisions(spark):
    rows = [(True, 0.55), (True, 0.5), (True, None), (False, 0.7), (False, 0.69), (None, 0.9)]
    df = spark.createDataFrame(rows, "main boolean, score double")
    got = [r[0] for r in df.select(retrieval.oneclass_decision(df.main, df.score)).collect()]
    assert got == ["high_confidence_error", "uncertain_review", "uncertain_review", "candidate_error_for_review", "likely_correct", "candidate_error_for_review"]


@pytest.mark.parametrize("limit", [1_000_000, 50, 1])
def test_quantiles_equal_percentile(spark, limit):
    """By ordering at once, by a bracket and buckets, and down to single values."""
    rng = random.Random(7)
    rows = [("even", float(k)) for k in range(501)] + [("skewed", math.exp(rng.gauss(0, 8))) for _ in range(700)] + [("ties", float(rng.choice([0, 0, 0, 1, 5]))) for _ in range(400)]
    rows += [("one", 3.5), (None, 1.0), (None, 2.0), ("none", None), ("nan", float("nan")), ("huge", -1.7e308), ("huge", 1.7e308), ("huge", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    wanted = {"q0": 0.0, "q25": 0.25, "half": 0.5, "q999": 0.999, "q1": 1.0}
    got = {r.k: [r[c] for c in wanted] for r in exact_quantiles(df, "v", wanted, ["k"], limit).collect()}
    assert set(got) == {"even", "skewed", "ties", "one", None, "huge"}
    for k, values in got.items():
        own = sorted(v for g, v in rows if g == k)
        for q, value in zip(wanted.values(), values):
            at = q * (len(own) - 1)
            low, high = own[math.floor(at)], own[math.ceil(at)]
            assert value == pytest.approx(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high, rel=1e-12)
    whole = exact_quantiles(df.where("k = 'even'"), "v", {"m": 0.5}, limit=limit).collect()
    assert [tuple(r) for r in whole] == [(250.0,)]
    assert exact_quantiles(df.where("false"), "v", {"m": 0.5}).count() == 0


def test_hard_negatives_without_negatives(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "y int, s double")
    assert [r.weight for r in hard_negatives(df, "s", "y", 0.1, 3.0).collect()] == [1.0, 1.0]


def test_vocabulary_by_ranges(spark):
    values = [f"t{k % 300:03d}" for k in range(900)] + ["<unk>", None, "", "é", "Z"]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    got = {r.token: r.id for r in vocabulary(df, "v").collect()}
    words = sorted({v for v in values if v is not None} - {"<unk>"}, key=lambda v: v.encode())
    assert got == {t: i for i, t in enumerate(["<pad>", "<unk>", *words])}
    assert {r.token: r.id for r in vocabulary(df.where("false"), "v").collect()} == {"<pad>": 0, "<unk>": 1}
