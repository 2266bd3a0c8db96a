import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import lexicon
from cadenza.operators import confusions, models, modes, three_state


def test_phone_states(spark):
    rows = [
        ("A", "AH", -10.0, -10.0, 8.0, "", None, None, False), ("A", "B", -10.0, 10.0, -8.0, "", None, None, False), ("A", "M", 10.0, -10.0, 0.0, "", None, None, False),
        ("A", "AA", -10.0, 10.0, -8.0, "AO", None, None, False), ("VERY", "V", -10.0, 10.0, -8.0, "F", None, None, False), ("OF", "V", -5.0, 8.0, -5.0, "F", None, None, False),
        ("A", "K", 10.0, -10.0, 0.0, "K", "K", 1.0, True), ("A", "W", 10.0, -10.0, 0.0, "V", "V", 10.0, True),
    ]
    schema = "word string, target_phone string, ctc_deletion_margin double, ctc_substitution_margin double, ctc_logit_margin double, recognized_phone string, reference_recognized_phone string, reference_ctc_deletion_margin double, reference_ctc_phone_model_available boolean"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).withColumn("ctc_phone_model_available", F.lit(True))
    got = [r.phone_state for r in three_state.phone_states(df).orderBy("i").collect()]
    assert got == ["correct", "mispronounced", "deleted", "correct", "mispronounced", "correct", "correct", "deleted"]
    off = three_state.phone_states(df.withColumn("ctc_phone_model_available", F.lit(False))).first()
    assert (off.phone_state, off.phone_decision, off.phone_error_type) == ("unavailable", "uncertain_review", "model_unavailable")


def test_presence_guard(spark):
    df = spark.createDataFrame([(70.0,), (40.0,), (None,)], "duration_ms double").withColumns(
        {"primary_target_match": F.lit(1), "reference_target_match": F.lit(1), "ctc_deletion_margin": F.lit(2.0), "reference_ctc_deletion_margin": F.lit(1.0)}
    )
    assert [r[0] for r in df.select(three_state.presence(df)).collect()] == [True, False, False]
    assert three_state.substitution_candidates("TH") == sorted(set(three_state.substitution_candidates("TH"))) and "TH" not in three_state.substitution_candidates("TH")


def test_confusions(spark):
    rows = [("TH", "S", "initial"), ("L", "", "final"), ("L", "", "initial"), ("B", "P", "medial"), ("T", "", "final"), ("AA", "AA", "final"), ("AA", "M", "final")]
    df = spark.createDataFrame(rows, "t string, p string, at string")
    got = [r[0].confusion_type for r in df.select(confusions.classify(F.col("t"), F.col("p"), F.col("at"))).collect()]
    assert got == ["th_fronting_or_stopping", "final_dark_l_error", "other_phone_difference", "voicing_confusion", "final_consonant_deletion", "none", "other_phone_difference"]
    words = spark.createDataFrame([("T IH P", "T IY", 0.2, 0.1), ("IH", "IY", 0.9, 0.9), ("K AE T", "K AE T", 0.9, 0.8), ("", "", None, None)], "target_phone_seq string, predicted_phone_seq string, avg_phone_score double, min_phone_score double")
    got = [(r.mispronunciation_decision, r.mandarin_confusion_type) for r in confusions.word_mispronunciation(words).collect()]
    assert got == [("mispronounced", "final_consonant_deletion"), ("acceptable_accent", "ih_iy_confusion"), ("correct", "none"), ("correct", "none")]


def test_modes(spark):
    schema = "alignment_quality string, prob_correct double, confidence double, manual_calibrated_error_probability double, calibration_available boolean, phonological_relation string, asr_missing_word boolean, possible_missing_word boolean, missing_word_reason string"
    rows = [
        ("pass", 0.9, 0.9, 0.9, True, "", False, False, ""), ("pass", 0.1, 0.9, 0.95, True, "likely_true_error", False, False, ""), ("bad", 0.9, 0.9, 0.1, True, "", False, False, ""),
        ("pass", 0.5, 0.9, 0.7, True, "", False, False, ""), ("pass", 0.9, 0.9, 0.1, True, "", True, True, "r"), ("pass", 0.9, 0.9, 0.1, True, "", False, True, "r"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    got = [(r.decision, r.error_type) for r in modes.apply_mode(df).orderBy("i").collect()]
    assert got == [("correct", "none"), ("true_error", "pronunciation_error"), ("uncertain_review", "bad_alignment"), ("uncertain_review", "uncertain"), ("true_error", "deletion"), ("uncertain_review", "possible_deletion")]
    assert modes.apply_mode(df).where("i = 5").first().review_reason == "possible_missing_word:r"
    assert modes.apply_mode(df, "hardset").where("i = 2").first().decision == "uncertain_review"
    with pytest.raises(ValueError):
        modes.apply_mode(df, "other")


def test_lexicon(spark):
    custom = lexicon.lexicon_frame(spark, {"tea": [["T", "IY1"], ["T", "IY0"]]}, "custom", 0)
    dictionary = lexicon.lexicon_frame(spark, {"TEA": [["X"]], "cup": [["K", "AH1", "P"]]}, "cmudict", 1)
    words = spark.createDataFrame([(0, "Tea"), (1, "CUP"), (2, "zzz")], "i int, word string")
    got = {r.i: (r.phones, r.lexicon_status, len(r.pronunciations)) for r in lexicon.pronounce(words, [dictionary, custom]).collect()}
    assert got == {0: (["T", "IY"], "custom", 1), 1: (["K", "AH", "P"], "cmudict", 1), 2: (["<UNK>"], "failed", 0)}
    spans = lexicon.target_words(spark.createDataFrame([("u", " It’s fine, don't!")], "u string, t string"), "u", "t").orderBy("word_index").collect()
    assert [(r.normalized_word, r.char_start, r.char_end) for r in spans] == [("IT'S", 1, 5), ("FINE", 6, 10), ("DON'T", 12, 17)]
    ipa = spark.createDataFrame([("ˈtʃiː",), ("q",)], "x string").select(lexicon.ipa_to_arpabet(F.col("x"), {"t": "T", "tʃ": "CH", "i": "IY", "ʃ": "SH"}))
    assert [r[0] for r in ipa.collect()] == [["CH", "IY"], []]
    ids = {r.token: r.id for r in lexicon.vocabulary(words, "word").collect()}
    assert ids == {"<pad>": 0, "<unk>": 1, "CUP": 2, "Tea": 3, "zzz": 4}


def test_models(spark):
    random.seed(9)
    rows = [(i, random.gauss(2.0 if i % 5 == 0 else 0.0, 0.5) if i % 11 else None, random.choice("ab"), int(i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, x double, g string, y int")
    for kind in ("logistic", "forest"):
        model = models.fit(df.where("i % 2 = 0"), "y", ["x"], ["g"], kind)
        got = models.scored(model, df.where("i % 2 = 1").withColumn("g", F.lit("new")), ["x"], ["g"])
        right = got.where("x IS NOT NULL").select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("int"))).first()[0]
        assert right > 0.9
    assert models.out_of_fold(df, "i", "y", ["x"], ["g"], 2).count() == 300
    assert models.calibrated(df, None, ["x"]).first().manual_calibrated_error_probability == 0.5
    assert df.select(models.majority(df, "y")).first()[0] == 0
