"""Scores of spans against the kernels of whole recordings."""

import numpy as np
import pytest

from cadenza.operators import sequences, spans


def test_pronunciation_scores_equal_the_scores_of_the_frames(spark):
    draw = np.random.default_rng(4)
    rows = [(int(i % 40), "ABC"[i % 3], *(float(x) for x in draw.normal(i % 3, 2.0, 2))) for i in range(900)]
    frames = spark.createDataFrame([*rows, (0, "rare", 1.0, 1.0), (0, None, 1.0, 1.0), (0, "A", None, 1.0)], "u int, phone string, x double, y double")
    models = sequences.fit_gaussians(frames.where("x IS NOT NULL"), "phone", ["x", "y"])
    plain = {r["phone"]: (np.array(r["mean"]), np.array(r["variance"])) for r in models.collect()}
    found = spans.pronunciation_scores(frames, ["u"], "phone", ["x", "y"], models).collect()
    assert sorted(plain) == ["A", "B", "C"] and len(found) == len({r[:2] for r in rows})
    for r in found:
        own = np.array([x[2:] for x in rows if x[:2] == (r["u"], r["phone"])])
        score, rival, target, other = sequences.pronunciation_score(own, r["phone"], plain)
        assert (r["frames"], r["competitor"]) == (len(own), rival)
        assert [r["gop_score"], r["target_log_likelihood"], r["competitor_log_likelihood"]] == pytest.approx([score, target, other], abs=1e-9)


def test_pronunciation_scores_without_competitors_models_or_room(spark, monkeypatch):
    frames = spark.createDataFrame([(1, "A", float(i)) for i in range(50)], "u int, phone string, x double")
    models = sequences.fit_gaussians(frames, "phone", ["x"])
    (only,) = spans.pronunciation_scores(frames, ["u"], "phone", ["x"], models).collect()
    assert only["gop_score"] is None and only["competitor"] is None and only["target_log_likelihood"] < 0
    assert spans.pronunciation_scores(frames, ["u"], "phone", ["x"], models.where("false")).count() == 0
    tied = models.union(models.replace("A", "C", "phone")).union(models.replace("A", "B", "phone"))
    assert spans.pronunciation_scores(frames, ["u"], "phone", ["x"], tied).first()["competitor"] == "B"
    monkeypatch.setattr(spans, "MOST_PHONES", 0)
    with pytest.raises(ValueError, match="phones"):
        spans.pronunciation_scores(frames, ["u"], "phone", ["x"], models)


def test_pooled_spans_equal_the_pooled_recording(spark):
    draw = np.random.default_rng(5)
    hidden = {k: draw.normal(size=(n, 3)) for k, n in (("a", 1), ("b", 17), ("c", 40))}
    asked = [(k, i, *sorted(float(x) for x in draw.uniform(-0.2, 2.4, 2)), 2.0) for i, k in enumerate("abcbcbcaac" * 3)] + [("none", 99, 0.0, 1.0, 2.0), ("b", 98, 0.0, 1.0, 0.0)]
    frames = spark.createDataFrame([(k, i, [float(v) for v in x]) for k, h in hidden.items() for i, x in enumerate(h)], "u string, i int, x array<double>")
    got = spans.pooled_spans(frames, spark.createDataFrame(asked, "u string, s int, a double, b double, d double"), "u", "i", "x", 3, "s", "a", "b", "d").collect()
    assert len(got) == len(asked)
    pooled = {r["s"]: r["pooled"] for r in got}
    assert pooled.pop(99) is None and pooled.pop(98) is None
    for k, i, a, b, d in asked[:-2]:
        assert pooled[i] == pytest.approx(list(sequences.pool_frames(hidden[k], a, b, d)), abs=1e-12)


def test_candidate_margins_equal_those_of_the_frames(spark):
    draw = np.random.default_rng(6)
    logits = {s: draw.normal(size=(n, 5)) for s, n in enumerate([1, 4, 9])}
    phones = {"T": [0, 1], "A": [2], "B": [3, 4], "C": [2]}  # A and C are equally good
    frames = spark.createDataFrame([(s, [float(v) for v in x]) for s, h in logits.items() for x in h], "s int, logits array<double>")
    rows = [(s, p, t, p == "T") for s in (0, 1, 2, 7) for p, t in phones.items()] + [(0, "none", [], False), (0, "far", [9], False), (0, "null", None, False), (8, "T", [1], True)]
    got = {r["s"]: r for r in spans.candidate_margins(frames, spark.createDataFrame(rows, "s int, phone string, tokens array<int>, target boolean"), "s", "logits", 5, "phone", "tokens", "target").collect()}
    for s, h in logits.items():
        margin, rival = sequences.span_margin(h, np.arange(len(h)), phones["T"], {p: t for p, t in phones.items() if p != "T"})
        assert got[s]["margin"] == pytest.approx(margin) and got[s]["rival"] == rival
    assert all(got[s]["margin"] is None and got[s]["rival"] is None for s in (7, 8)) and set(got) == {0, 1, 2, 7, 8}
