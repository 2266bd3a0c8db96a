from pyspark.sql import functions as F

from cadenza.operators import metrics, projections, reports
from cadenza.sources import config


def test_config_round_trip(tmp_path):
    path = str(tmp_path / "c.yaml")
    config.write_config({"b": 1, "a": {"x": [0.5, "ü"]}}, path)
    assert config.load_config(path) == {"b": 1, "a": {"x": [0.5, "ü"]}}
    (tmp_path / "e.json").write_text("")
    assert config.load_config(str(tmp_path / "e.json")) == {}


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", None)], "x string, y int")
    assert config.markdown_table(df) == "| x | y |\n|---|---|\n| a\\|b |  |"


def test_weak_vowels_count_rows_and_phones(spark):
    df = spark.createDataFrame([("AH", 40.0, 0.8), ("AH", 60.0, 0.2), ("T", 40.0, 0.9)], "target_phone string, duration_ms double, prob_correct double")
    got = reports.alarm_summary(df, F.lit(True)).first()
    assert (got.weak_vowel_rows, got.weak_vowel_phones, got.short_duration_count, got.high_prob_correct_count) == (2, 1, 2, 2)


def test_word_labels(spark):
    rows = [("a", 2.0), ("a", 1.8), ("a", 0.0), ("b", 1.0), ("b", 1.0), ("c", 0.0), ("c", 1.0), ("d", None)]
    got = {r.w: r.word_label for r in reports.word_label_from_scores(spark.createDataFrame(rows, "w string, s double"), ["w"], "s").collect()}
    assert got == {"a": "word_correct", "b": "acceptable_accent", "c": "mispronounced", "d": "alignment_issue"}


def test_downgrades(spark):
    df = spark.createDataFrame([("R", i % 4 == 0) for i in range(40)] + [("L", True)] * 40, "target_phone string, e boolean")
    rows = df.select("target_phone", F.col("e").cast("int").alias("manual_is_error"), F.lit("correct").alias("manual_review_label"), F.lit(0.5).alias("final_error_score"))
    table = reports.review_table(rows, "target_phone")
    assert [r.key for r in reports.downgrades(table, "target_phone", 10, 0.4).collect()] == ["R"]


def test_defaults_and_overrides(spark):
    df = spark.createDataFrame([(1, None)], "k int, x double")
    got = projections.with_defaults(df, {"x": 0.5, "y": ""}).first()
    assert (got.x, got.y) == (0.5, "")
    words = spark.createDataFrame([(1, "correct"), (2, "correct"), (3, "correct")], "k int, word_decision string")
    phones = spark.createDataFrame([(1, True, "correct", "none"), (2, False, "true_error", "missing_boundaries")], "k int, asr_missing_word boolean, decision string, deletion_trigger_source string")
    got = {r.k: (r.word_decision, r.deletion_trigger_source) for r in projections.overridden_words(words, phones, ["k"]).collect()}
    assert got == {1: ("true_error", "none"), 2: ("uncertain_review", "missing_boundaries"), 3: ("correct", "none")}


def test_calibration_rows_of_one_class_null_keys_and_scores(spark):
    rows = [(None, 1, 1, 0.9), (None, 1, 1, None), ("x", 0, 0, 0.2), ("y", 1, 1, 0.6), ("y", 0, 1, 0.7), ("y", 0, 0, 0.1)]
    found = {r["model"]: r for r in metrics.calibration_rows(spark.createDataFrame(rows, "model string, gold int, prediction int, p double"), ["model"], "gold", "prediction", "p").collect()}
    only, errors, both = found[None], found["x"], found["y"]
    assert (only["n"], only["macro_f1"], only["auc"], only["error_f1"]) == (2, 1.0, 0.5, 0.0)
    assert (errors["macro_f1"], errors["error_precision"], errors["precision_correct_class"], errors["balanced_accuracy"]) == (1.0, 1.0, 0.0, 1.0)
    assert (both["auc"], both["error_precision"], both["error_recall"], both["error_f1"], both["macro_f1"]) == (0.5, 1.0, 0.5, 0.666667, 0.666667)
    assert metrics.calibration_rows(spark.createDataFrame([], "model string, gold int, prediction int, p double"), ["model"], "gold", "prediction", "p").count() == 0
