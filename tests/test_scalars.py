from pyspark.sql import functions as F

from cadenza.functions import labels, scalars
from cadenza.operators import evidence, manifests


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_phones(spark):
    rows = [("ao1*",), (" AE1 ",), ("sil",), (None,), ("",)]
    assert values(spark, scalars.phone("x"), rows) == ["AO", "AE", "SIL", "", ""]
    assert values(spark, scalars.arpabet("x"), [("ao1*",), ("AE1",)]) == ["AO1*", "AE"]
    assert values(spark, scalars.phone_group("x"), [("ao1",), ("ch",), ("R",), ("sil",), ("QQ",)]) == ["vowel", "affricate", "liquid", "silence", "other"]
    assert values(spark, scalars.phone_sequence("x"), [("W, IY0 K",), ("",), (None,)]) == [["W", "IY", "K"], [], []]


def test_phone_labels(spark):
    got = values(spark, scalars.phone_label("x"), [("DH, D, s",), ("R, sil, d",), ("sil, T*, a",), ("AE1",)])
    assert [tuple(r) for r in got] == [("DH", "D", "substitution"), ("R", "SIL", "deletion"), ("SIL", "T", "addition"), ("AE", "AE", "correct")]


def test_reasons_are_an_ordered_union(spark):
    rows = [("b; a", "a;c"), (None, ";;x"), ("", None)]
    assert values(spark, scalars.reasons("x", "y"), rows, "x string, y string") == ["b;a;c", "x", ""]


def test_numbers_truth_and_clips(spark):
    assert values(spark, scalars.number("x", 0.5), [("1",), ("nan",), ("",), ("z",), (None,)]) == [1.0, 0.5, 0.5, 0.5, 0.5]
    assert values(spark, scalars.truthy("x"), [("Yes",), ("1",), ("0",), (None,), ("true",)]) == [True, True, False, False, True]
    assert values(spark, scalars.squashed_score(F.col("x")), [(0.5,), (1.5,), (-40.0,)], "x double")[:2] == [0.5, 0.75]
    assert values(spark, scalars.group_key("x"), [("Liquids",), ("vowel",), (None,)]) == ["liquid", "vowel", ""]
    assert values(spark, scalars.code_point_hash("x"), [("AB",)]) == [((65 + 66) % 29) / 29]
    assert values(spark, scalars.file_stem("x"), [("a b/c?.wav",)]) == ["a_b_c_.wav"]


def test_texts(spark):
    assert values(spark, scalars.tokens("x"), [("It’s  'fine', don't!",), (None,)]) == [["IT'S", "FINE", "DON'T"], []]
    got = values(spark, scalars.expand(F.split("x", " "), {"IT'S": ["IT", "IS"]}), [("IT'S OK",)])[0]
    assert [tuple(r) for r in got] == [("IT", 0), ("IS", 0), ("OK", 1)]


def test_label_polarity_and_scores(spark):
    df = spark.createDataFrame([(0, 0.9, "error"), (1, 0.2, "ok"), (None, None, None)], "gold_binary int, prob_correct double, verdict string")
    assert [r[0] for r in df.select(labels.error_label(df, "gold_binary")).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(labels.error_label(df, "verdict")).collect()] == [1, 0, 0]
    assert [round(r[0], 6) for r in df.select(labels.error_score(df)).collect()] == [0.1, 0.8, 0.0]
    scored = spark.createDataFrame([(0.7, 0), (0.7, 1)], "confidence double, prediction int")
    assert [round(r[0], 6) for r in scored.select(labels.error_score(scored)).collect()] == [0.7, 0.3]


def test_error_manifest(spark):
    rows = [("u1", "s1", "a.wav", "AH0", 0.0, 100.0, 1, "train", "PASS"), ("u2", "s2", "b.wav", "R", 100.0, 200.0, 0, "test", "pass"), ("u3", "s3", "c", "R", 5.0, 5.0, 0, "test", "pass"), ("u4", "s4", "d", "R", 5.0, 9.0, 0, "test", "review")]
    df = spark.createDataFrame(rows, "utterance_id string, speaker_id string, audio_path string, target_phone string, start_ms double, end_ms double, gold_binary int, split string, alignment_quality string")
    got = manifests.error_manifest(df).orderBy("utt_id").collect()
    assert [(r.utt_id, r.target_phone, r.label, r.duration) for r in got] == [("u1", "AH", 0, 0.1), ("u2", "R", 1, 0.1)]
    assert len(got[0]) == 14
    leak = spark.createDataFrame([("s1", "train"), ("s1", "dev"), ("s2", "dev")], "speaker_id string, split string")
    assert [r.speaker_id for r in manifests.leaking(leak, "speaker_id", "split").collect()] == ["s1"]


def test_votes_and_consensus(spark):
    rows = [("V", "fricative", 0.1, 0, "likely_error", "high_confidence_error", -0.2, 0.8), ("IY", "vowel", 0.9, 1, "likely_correct", "likely_correct", 0.2, 0.1)]
    schema = "target_phone string, phone_group string, prob_correct double, prediction int, retrieval_verifier_decision string, oneclass_verifier_decision string, proto_margin double, oneclass_anomaly_score double"
    df = spark.createDataFrame(rows, schema)
    assert [r.final_decision for r in evidence.aggregate_votes(df).orderBy("prob_correct").collect()] == ["high_confidence_error", "correct"]
    weak = spark.createDataFrame([("R", "liquid", 0.1, 0, 0.1, 0.3, 0.1)], "target_phone string, phone_group string, prob_correct double, prediction int, attribute_risk_score double, proto_margin double, oneclass_anomaly_score double")
    got = evidence.strict_consensus(evidence.aggregate_votes(weak)).first()
    assert (got.final_decision, got.evidence_pattern) == ("uncertain_review", "main_only")
