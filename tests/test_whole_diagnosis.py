"""Whole diagnoses against plain versions."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import diagnosis, retrieval, thresholds

SYMBOLS = {"S": ["s"], "Z": ["z"], "TH": ["θ"], "EY": ["e", "i"]}
VOCABULARY = {"_": 0, " ": 1, "s": 2, "z": 3, "θ": 4}


def plain_likelihood(logs, labels):
    """The sum over all paths that collapse to the labels."""
    total = 0.0
    for path in itertools.product(range(logs.shape[1]), repeat=len(logs)):
        collapsed = [p for i, p in enumerate(path) if p and (i == 0 or p != path[i - 1])]
        if collapsed == labels:
            total += math.exp(sum(logs[t, p] for t, p in enumerate(path)))
    return math.log(total) if total else None


def test_target_labels_mark_words_and_unknown_phones():
    labels, spans, known = diagnosis.target_labels(["S", "EY", "Z"], [0, 0, 1], SYMBOLS, VOCABULARY)
    assert labels == [2, 1, 3] and spans == [(0, 1), (1, 1), (2, 3)] and known == [True, False, True]


def test_phone_hypotheses_equal_the_sum_over_paths():
    rng = np.random.default_rng(4)
    logits = rng.normal(size=(5, 5))
    logs = logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)
    found = diagnosis.phone_hypotheses(logits, ["S", "Z"], [0, 1], SYMBOLS, VOCABULARY, 20.0)
    whole = plain_likelihood(logs, [2, 1, 3])
    for x, start, rivals in zip(found, (0, 2), ({"Z": 3, "TH": 4}, {"S": 2, "TH": 4})):
        labels = [2, 1, 3]
        without = plain_likelihood(logs, labels[:start] + labels[start + 1 :])
        swapped = {c: plain_likelihood(logs, labels[:start] + [i] + labels[start + 1 :]) for c, i in rivals.items()}
        assert math.isclose(x["ctc_reference_log_probability"], whole, rel_tol=1e-9)
        assert math.isclose(x["ctc_deletion_margin"], without - whole, rel_tol=1e-9)
        assert math.isclose(x["ctc_substitution_margin"], max(swapped.values()) - whole, rel_tol=1e-9)
        assert x["ctc_phone_model_available"] and x["ctc_end_ms"] > x["ctc_start_ms"]
        if x["ctc_substitution_margin"] > 0:
            assert x["recognized_phone"] == max(swapped, key=swapped.get)
    (nothing,) = diagnosis.phone_hypotheses(logits, ["EY"], [0], SYMBOLS, VOCABULARY, 20.0)
    assert not nothing["ctc_phone_model_available"] and math.isnan(nothing["ctc_deletion_margin"])


def test_phones_without_emissions_are_unavailable(spark):
    emissions = spark.createDataFrame([("a", t, [float(x) for x in np.random.default_rng(t).normal(size=5)]) for t in range(6)], "u string, frame int, logits array<double>")
    phones = spark.createDataFrame([("a", 0, 0, "S1"), ("a", 0, 1, "z"), ("b", 0, 0, "S"), ("b", None, 1, None)], "u string, word_index int, phone_index int, target_phone string")
    rows = {(r.u, r.phone_index): r for r in diagnosis.phones_ctc(emissions, phones, "u", SYMBOLS, VOCABULARY).collect()}
    assert len(rows) == 4 and rows["a", 0].ctc_phone_model_available and not rows["b", 0].ctc_phone_model_available
    assert rows["a", 0].target_phone == "S"
    assert diagnosis.phones_ctc(emissions, phones.limit(0), "u", SYMBOLS, VOCABULARY).count() == 0


def test_tuned_states_equal_the_search_over_all_pairs(spark):
    random.seed(6)
    states = diagnosis.STATES
    rows = [(round(random.random(), 2), round(random.random(), 2), random.choice(states), random.random() < 0.2, random.random() < 0.2) for _ in range(200)]
    rows += [(None, 0.9, "mispronounced", None, None), (0.9, None, "deleted", None, None)]
    schema = "probability_deleted double, probability_mispronounced double, gold_phone_state string, present boolean, equivalent boolean"

    def state(d, w, present, equivalent, i, j):
        if d is not None and d >= 0.3 + 0.01 * i and not present:
            return "deleted"
        return "mispronounced" if w is not None and w >= 0.3 + 0.01 * j and not equivalent else "correct"

    best = None
    for i, j in itertools.product(range(70), repeat=2):
        said = [state(d, w, p, e, i, j) for d, w, _, p, e in rows]
        gold = [r[2] for r in rows]
        f1 = sum(2 * sum(a == b == s for a, b in zip(said, gold)) / max(1, said.count(s) + gold.count(s)) for s in states) / 3
        alarm = sum(a != "correct" for a, b in zip(said, gold) if b == "correct") / gold.count("correct")
        value = (round(round(f1, 9) - 2 * max(round(alarm, 9) - 0.1, 0), 9), round(f1, 9), -round(alarm, 9), -i, -j)
        best = max(best or value, value)
    (got,) = diagnosis.tune_states(spark.createDataFrame(rows, schema)).collect()
    assert (got.objective, got.macro_f1, -got.false_alarm) == best[:3]
    assert (got.deletion_threshold, got.wrong_threshold) == (round(0.3 - 0.01 * best[3], 2), round(0.3 - 0.01 * best[4], 2))
    strict = spark.createDataFrame([(1.0, 1.0, "correct", False, False)] * 3, schema)
    assert diagnosis.tune_states(spark.createDataFrame(rows, schema), sanity=strict).count() == 0


def test_words_take_the_evidence_of_each_table(spark):
    phones = spark.createDataFrame([("u", 0, 0, "AH0", "AH", "x"), ("u", 0, 1, "T", "T", "x"), ("u", 1, 0, "S", "S", "y")], "u string, word_index int, phone_index int, target_phone string, recognized_phone string, word string")
    words = spark.createDataFrame([("u", 0, "x", "pass", 2.0, 300.0), ("u", 1, "y", "pass", 1.0, 50.0)], "u string, word_index int, word string, alignment_quality string, phone_count double, word_duration_ms double")
    heard = spark.createDataFrame([("u", 1, True, 0.9)], "u string, word_index int, asr_missing_word boolean, asr_missing_confidence double")
    found = {r.word_index: r.final_word_decision for r in diagnosis.diagnose_words(phones, words, ["u", "word_index"], recogniser=heard).collect()}
    assert found == {0: "correct", 1: "deletion"}


def test_final_columns_are_complete(spark):
    rows = spark.createDataFrame([("u", "failed", 0.9), ("v", "success", 0.9), ("w", None, 0.9)], "utterance_id string, g2p_status string, prob_correct double")
    found = {r.utterance_id: r for r in diagnosis.final_prediction(rows.withColumn("alignment_quality", F.lit("pass"))).collect()}
    assert found["u"].__fields__ == diagnosis.FINAL_COLUMNS and found["u"].word == ""
    assert [found[x].review_reason == "g2p_failed" for x in "uvw"] == [True, False, True] and found["u"].confidence == 0.0


def test_cells_of_the_grid_change_no_count(spark):
    random.seed(7)
    rows = [(random.choice([None, 0.1, 0.3, random.random()]), random.random(), random.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, gold int")
    grid = {"x": [0.1, 0.3, 0.7], "y": [0.2, 0.5], "z": [0.4]}

    def decide(row, s):
        return ((row["a"] >= s["x"]) & (row["b"] < s["y"])) | (row["b"] > s["z"])

    plain = thresholds.sweep(df, grid, decide, "gold", ["a", "b"])
    cells = thresholds.sweep(df, grid, decide, "gold", ["a", "b"], {"a": ["x"], "b": ["y", "z"]})
    assert sorted(map(str, plain.collect())) == sorted(map(str, cells.collect()))


def test_blocks_find_the_nearest_of_all(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 4)
    rng = np.random.default_rng(8)
    rows = [(i, i % 3 if i < 50 else 7, [float(x) for x in rng.normal(size=6)]) for i in range(51)] + [(60, None, [0.0] * 6), (61, 1, None)]
    df = spark.createDataFrame(rows, "i long, g int, v array<double>")
    found = {r.i: r for r in retrieval.top_similarities(df, df.withColumnRenamed("i", "item"), "i", "item", "g", "v", 4, others_only=True).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows[:51]}
    assert set(found) == set(range(50))
    for i, g, _ in rows[:50]:
        best = sorted((round(float(unit[i] @ unit[j]), 6) for j, h, _ in rows[:51] if h == g and j != i), reverse=True)[:4]
        assert math.isclose(found[i].top1, best[0], abs_tol=2e-6) and math.isclose(found[i].topk_mean, sum(best) / 4, abs_tol=2e-6)


def test_every_row_meets_its_model(spark):
    rng = np.random.default_rng(9)
    rows = [(f"k{i % 3}" if i % 10 else f"rare{i}", "g" if i % 2 else None, float(x), i) for i, x in enumerate(rng.normal(size=300))] + [(None, None, 50.0, 999), ("k1", "g", None, 1000)]
    df = spark.createDataFrame(rows, "k string, g string, x double, i int")
    found = {r.i: r for r in retrieval.anomaly_verifier(df.where("i < 300"), df, "k", "g", ["x"], fit_rows=60).collect()}
    assert len(found) == 302 and all(0 < r.anomaly_score < 1 for r in found.values())
    assert found[1].anomaly_model == "k:k1" and found[999].anomaly_model == "all" and found[10].anomaly_model in ("all", "g:g")
    assert found[999].anomaly_score > np.median([r.anomaly_score for r in found.values()])
