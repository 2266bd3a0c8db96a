import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import decisions, joins, metrics, retrieval, sampling, sequences, thresholds, windows
from cadenza.sources import corpora, sinks


def scored(spark, n=500, seed=1):
    random.seed(seed)
    rows = [(random.choice("abc"), round(random.random(), 2), random.random() < 0.3) for _ in range(n)]
    return rows, spark.createDataFrame([(g, s, int(y)) for g, s, y in rows], "g string, s double, y int")


def test_auc_and_average_precision(spark):
    rows, df = scored(spark)
    got = metrics.ranking_metrics(df, "s", "y").first()
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert got.auc == round(auc, 6)
    ap = last = 0.0
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        tp, n = sum(p >= t for p in pos), sum(s >= t for _, s, _ in rows)
        ap += (tp / len(pos) - last) * tp / n
        last = tp / len(pos)
    assert got.average_precision == pytest.approx(ap, abs=1e-6)
    assert metrics.ranking_metrics(df.where("y = 1"), "s", "y").first().auc == 0.5


def test_threshold_searches(spark):
    rows, df = scored(spark)
    points = []
    for t in sorted({s for _, s, _ in rows}):
        hit = [y for _, s, y in rows if s >= t]
        points.append((t, sum(hit) / len(hit), sum(hit) / sum(y for _, _, y in rows)))
    ok = [p for p in points if p[1] >= 0.31]
    want = max(ok, key=lambda p: (p[2], -p[0]))
    assert thresholds.recall_at_precision(df, "s", "y", 0.31).first().threshold == want[0]
    assert thresholds.recall_at_precision(df, "s", "y", 1.1).first().threshold is None
    fallback = thresholds.threshold_or_most_precise(df, "s", "y", 1.1).first()
    assert (fallback.threshold, fallback.found) == (max(points, key=lambda p: (round(p[1], 9), round(p[2], 9)))[0], False)


def test_joins(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    right = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, seq int, v string")
    got = {r.k: r.v for r in joins.evidence_join(left, right, ["k"], ["seq"], ["v"]).collect()}
    assert got == {1: "b", 2: None, 3: None}
    cover = {r.k: (r.w, r.covered) for r in joins.coverage_join(left, right.withColumnRenamed("v", "w"), ["k"], ["seq"], {"w": "none"}).collect()}
    assert cover == {1: ("b", True), 2: ("none", True), 3: ("none", False)}
    with pytest.raises(Exception, match="repeated key"):
        joins.validated_join(left, right.select("k", "seq"), ["k"]).collect()
    with pytest.raises(Exception, match="without partner"):
        joins.validated_join(left, right.select("k", "seq").where("seq = 1"), ["k"]).collect()


def test_overlaps_across_cells(spark):
    points = spark.createDataFrame([("u", 1, 0.5, 9.5), ("u", 2, 20.0, 20.5), ("u", 3, 30.0, 30.0)], "u string, p int, start double, end double")
    spans = spark.createDataFrame([("u", 10, 0.0, 2.0), ("u", 11, 2.0, 9.0), ("u", 12, 9.0, 19.0), ("u", 13, 19.9, 21.0)], "u string, s int, start double, end double")
    got = {r.p: (r.s, r.overlap) for r in joins.overlap_argmax(points, spans, ["u"], 1.0, "p", "s").collect()}
    assert got == {1: (11, 7.0), 2: (13, 0.5)}


def test_windows(spark):
    df = spark.createDataFrame([("u", i, w) for i, w in enumerate("aabba")], "u string, i int, w string")
    assert [r.run_index for r in windows.runs(df, "u", ["i"], "w").orderBy("i").collect()] == [0, 0, 1, 1, 2]
    got = windows.neighbour_support(df, "u", ["i"], F.col("w") == "a").orderBy("i").collect()
    assert [r.context_support for r in got] == [1.0, 0.5, 0.5, 0.5, 0.0]


def test_dev_units_match_the_hash_order(spark):
    import hashlib

    units = [f"s{i}" for i in range(10)]
    got = {r.u for r in sampling.dev_units(spark.createDataFrame([(u,) for u in units], "u string"), "u", 42).where("in_dev").collect()}
    assert got == set(sorted(units, key=lambda u: hashlib.sha256(f"42:{u}".encode()).hexdigest())[:2])


def test_word_stats_legacy_and_deletion_only(spark):
    schema = "word string, start_ms double, end_ms double, duration_ms double, prob_correct double"
    tight = [("W", 20.0 * i, 20.0 * i + 20, 20.0, 0.5) for i in range(4)]
    wide = [("V", s, s + d, d, 0.5) for s, d in zip((0.0, 40.0, 80.0, 200.0, 330.0), (20.0, 25.0, 20.0, 90.0, 100.0))]
    df = spark.createDataFrame(tight + wide, schema)
    got = {r.word: r for r in decisions.word_stats(df, ["word"], "legacy").collect()}
    assert "word_duration_lt_250ms" in got["W"].missing_word_reason and got["V"].missing_word_reason == "short_phone_ratio_ge_0.5"
    only = {r.word: r.deletion_trigger_source for r in decisions.word_stats(df, ["word"]).collect()}
    assert only == {"W": "none", "V": "none"}


def test_edit_operations():
    def kinds(a, b):
        return [(r["word"], r["status"], r["mismatch_score"]) for r in sequences.compare_words(a.split(), b.split(), {})]

    assert kinds("SHE SEES THE BLUE BIRD", "SHE THE BIRD")[1] == ("SEES", "missing", 0.95)
    assert kinds("SHE SEES BLUE", "SHE LIKES BLUE")[1] == ("SEES", "substituted", 0.85)
    rows = sequences.compare_words("DO NOT GO".split(), "DON'T GO".split(), {"DON'T": ("DO", "NOT")})
    assert [r["operation"] for r in rows] == ["equal"] * 3
    assert sequences.compare_words([], ["A"], {}) == []


def test_compare_texts(spark):
    df = spark.createDataFrame([(1, ["A", "B"], ["A"]), (2, ["A"], None)], "k long, t array<string>, h array<string>")
    got = {(r.k, r.word_index): r.operation for r in sequences.compare_texts(df, "k", "t", "h").collect()}
    assert got == {(1, 0): "equal", (1, 1): "delete", (2, 0): "delete"}


def test_segmental_viterbi():
    frames = np.array([[0.0, 0.0]] * 5 + [[5.0, 0.0]] * 5)
    models = {"A": (np.zeros(2), np.full(2, 0.1)), "B": (np.array([5.0, 0.0]), np.full(2, 0.1))}
    spans, _ = sequences.align_phones(frames, ["A", "B"], models, {"A": 50.0, "B": 50.0})
    assert spans == [(0.0, 50.0), (50.0, 115.0)]
    with pytest.raises(ValueError, match="No acoustic model"):
        sequences.align_phones(frames, ["A", "C"], models, {})


def test_ctc_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    logits = rng.normal(size=(5, 4))
    logs = logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)

    def collapse(path):
        out = [k for i, k in enumerate(path) if i == 0 or k != path[i - 1]]
        return [k for k in out if k]

    for labels in ([1, 2, 3], [1, 1], [2], []):
        paths = [p for p in product(range(4), repeat=5) if collapse(p) == labels]
        want = np.logaddexp.reduce([sum(logs[t, k] for t, k in enumerate(p)) for p in paths])
        assert sequences.ctc_log_probability(logs, labels) == pytest.approx(want)
        best = max(paths, key=lambda p: sum(logs[t, k] for t, k in enumerate(p)))
        states = sequences.ctc_best_path(logs, labels)
        extended = [0] + [x for label in labels for x in (label, 0)]
        assert [extended[s] for s in states] == list(best)
    assert sequences.ctc_log_probability(logs[:2], [1, 1, 1]) is None
    found = sequences.deletion_margins(logs, [1, 2, 3], [(1, 2)])[0]
    assert 0 < found["score"] < 1


def test_path_scores():
    logits = np.full((6, 4), -4.0)
    for frame, label in enumerate((1, 1, 0, 2, 2, 3)):
        logits[frame, label] = 4.0
    logs = logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)
    states = sequences.ctc_best_path(logs, [1, 2, 3])
    assert sequences.label_frames(states, 1, 2).tolist() == [3, 4]
    assert sequences.path_log_probability(logs, states, [1, 2, 3], 0, 3) > -0.01
    assert sequences.path_log_probability(logs, states, [1, 2, 3], 3, 3) is None
    assert sequences.span_margin(logits, np.array([3, 4]), [2], {"A": [1], "B": [3]})[0] == 8.0
    assert sequences.span_margin(logits, np.array([], int), [2], {"A": [1]}) is None


def test_word_deletions_ctc(spark):
    rng = np.random.default_rng(2)
    frames = [("u", t, rng.normal(size=4).tolist()) for t in range(8)]
    words = [("u", 0, [1, 2]), ("u", 1, [3]), ("v", 0, [1])]
    got = sequences.word_deletions_ctc(
        spark.createDataFrame(frames, "u string, frame int, logits array<double>"), spark.createDataFrame(words, "u string, word_index int, labels array<int>"), "u"
    )
    assert {(r.u, r.word_index): r.available for r in got.collect()} == {("u", 0): True, ("u", 1): True, ("v", 0): False}


def test_gop_and_audio():
    models = {"AA": (np.zeros(3), np.ones(3)), "T": (np.full(3, 5.0), np.ones(3))}
    score, rival, _, _ = sequences.pronunciation_score(np.zeros((4, 3)), "AA", models)
    assert score > 0 and rival == "T"
    tone = np.sin(np.arange(16_000) / 20).astype(np.float32) * 0.5
    back = sequences.read_pcm(sequences.write_pcm(tone))
    assert np.abs(back - tone).max() < 1e-3
    assert sequences.frame_features(tone, 16_000).shape == (98, 25)
    padded = np.concatenate((np.zeros(16_000), tone, np.zeros(16_000)))
    assert len(tone) <= len(sequences.trim_silence(padded, 16_000)) < 20_000
    assert len(sequences.cut_with_fade(tone, 16_000, 200, 400)) == 16_000 - 3200 - 128
    assert sequences.pool_frames(np.arange(10.0).reshape(10, 1), 0.2, 0.4, 1.0)[0] == 2.5


def test_isolation_forest_ranks_outliers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    forest = retrieval.IsolationForest().fit(x)
    assert forest.anomaly(np.full((1, 3), 8.0))[0] > np.quantile(forest.anomaly(x), 0.99)


def test_retrieval_falls_back_on_the_group(spark):
    bank = spark.createDataFrame([(1, "a", "v", [1.0, 0.0]), (2, "b", "v", [0.6, 0.8]), (3, "s", "f", [0.0, 1.0])], "item int, phone string, kind string, e array<double>")
    asked = spark.createDataFrame(
        [(10, "a", "v", [0.6, 0.8], 0), (11, "o", "v", [0.6, 0.8], 0), (12, "t", "p", [1.0, 0.0], 0), (13, "x", "", [1.0, 0.0], 0)],
        "id int, phone string, kind string, e array<double>, is_error int",
    )
    confusable = spark.createDataFrame([("a", "s")], "phone string, other string")
    found = retrieval.retrieval_verifier(asked, bank, confusable, "id", "item", "phone", "e", group="kind")
    assert {r.id: (r.proto_same_sim_top1, r.proto_same_sim_topk_mean) for r in found.collect()} == {10: (0.6, 0.6), 11: (1.0, 0.8), 12: (0.0, 0.0), 13: (0.0, 0.0)}


TEXTGRID = '''File type = "ooTextFile"
Object class = "TextGrid"
item []:
    item [1]:
        class = "IntervalTier"
        name = "words"
        intervals [1]:
            xmin = 0
            xmax = 0.5
            text = "say ""hi"""
        intervals [2]:
            xmin = 0.5
            xmax = 1.0
            text = ""
    item [2]:
        class = "IntervalTier"
        name = "phones"
        intervals [1]:
            xmin = 0.1
            xmax = 0.4
            text = "AE1"
'''


def test_textgrids(spark, tmp_path):
    (tmp_path / "a.TextGrid").write_text("﻿" + TEXTGRID, encoding="utf-8")
    want = [("phones", 0, 0.1, 0.4, "AE1"), ("words", 0, 0.0, 0.5, 'say "hi"'), ("words", 1, 0.5, 1.0, "")]
    for df in (corpora.read_textgrids(spark, str(tmp_path)),):
        assert [(r.tier, r.interval_index, r.start, r.end, r.text) for r in df.orderBy("tier", "interval_index").collect()] == want


def test_kaldi_and_scores(spark):
    lines = spark.createDataFrame([("u1  some text ",), ("",), ("u2\tx",)], "value string")
    assert {r.key: r.value for r in corpora.kaldi_map(lines).collect()} == {"u1": "some text", "u2": "x"}
    words = "utterance_id string, words array<struct<word:string,phones:array<string>,accuracies:array<double>>>"
    scores = spark.createDataFrame([("u1", [("A", ["AE1", "T"], [2.0, 0.5])])], words)
    meta = spark.createDataFrame([("u1", "s1")], "utterance_id string, speaker_id string")
    got = corpora.scored_phones(scores, meta).orderBy("place").collect()
    assert [(r.target_phone, r.gold_binary, r.gold_three_class, r.speaker_id) for r in got] == [("AE", 1, "correct", "s1"), ("T", 0, "incorrect", "s1")]
    with pytest.raises(Exception, match="mismatch"):
        corpora.scored_phones(spark.createDataFrame([("u1", [("A", ["AE1"], [2.0, 0.5])])], words), meta).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k int, x double")
    assert [r.value for r in sinks.json_rows(df).orderBy("value").collect()] == ['{"k":1,"x":null}', '{"k":2,"x":1.0}']
    with pytest.raises(ValueError):
        sinks.write_csv(df.where("k > 5"), str(tmp_path / "no"))
    former = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, " ", 3)], "k int, note string, seq int")
    got = {r.k: r.note for r in sinks.with_annotations(df, former, ["k"], ["note"], ["seq"]).collect()}
    assert got == {1: "new", 2: None}


def test_stream_of_phones(spark, tmp_path):
    from cadenza.streaming.diagnosis import diagnose

    source = tmp_path / "in"
    rows = [("u1", 0, "AH", 0.1, "pass"), ("u1", 0, "T", 0.9, "pass"), ("u1", 1, "R", 0.9, "pass")]
    spark.createDataFrame(rows, "utterance_id string, word_index int, target_phone string, prob_correct double, alignment_quality string").write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    diagnose(stream, ["utterance_id", "word_index"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.word_index: r.word_decision for r in got.collect()} == {0: "has_phone_error", 1: "correct"}
