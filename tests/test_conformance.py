"""Defaults, keys and small projections on hand-made rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadenza.operators import conformance, evaluation, windows


def test_row_keys(spark):
    rows = spark.createDataFrame([(" u ", None, 1.23456, "x"), (None, "w", None, None)], "utterance_id string, word string, start_ms double, end_ms string")
    assert [r.k for r in rows.select(conformance.row_key(rows).alias("k")).collect()] == ["u||||||||1.235||", "||||w||||||"]
    with pytest.raises(ValueError):
        conformance.row_key(rows, required=True)
    assert conformance.missing_columns(rows, ["word", "label"], ["end_ms", "split"]) == {"required": ["label"], "optional": ["split"]}


def test_attributes_and_confusions(spark):
    rows = spark.createDataFrame([("th1", True), ("AA", True), (None, False)], "p string, last boolean")
    known = {"TH": {"vowel_consonant": "consonant"}}
    got = [r.a for r in rows.select(conformance.serialised(conformance.attributes("p", known, ["voiced"], F.col("last"))).alias("a")).collect()]
    assert got[0] == '{"final_consonant":"true","phone":"TH","voiced":"false","vowel_consonant":"consonant"}'
    assert got[1] == '{"final_consonant":"false","phone":"AA","voiced":"false","vowel_consonant":"unknown"}' and '"phone":""' in got[2]
    assert [r.s for r in rows.select(conformance.phone_symbols("p", {"TH": ["θ", "x"]}).alias("s")).collect()] == [["θ", "x"], [], []]


def test_gates_and_frames(spark):
    rows = spark.createDataFrame([("1", None, "S", "S"), ("no", 4.0, "S", "Z")], "reference_ctc_phone_model_available string, reference_ctc_deletion_margin double, target_phone string, reference_recognized_phone string")
    gate = conformance.second_gate(rows)
    got = rows.select(*[c.alias(k) for k, c in gate.items()]).collect()
    assert [(r.second, r.second_margin, r.second_equivalent) for r in got] == [(True, float("-inf"), True), (False, 4.0, False)]
    assert conformance.second_gate(rows.select("target_phone")) == {}
    frame = conformance.model_frame(rows, {"x": "number", "reference_ctc_deletion_margin": "number", "word": "text"})
    assert [tuple(r) for r in frame.collect()] == [(None, None, ""), (None, 4.0, "")]


def test_exact_intervals_need_the_same_words(spark):
    annotated = spark.createDataFrame([("a", 1, "two"), ("a", 0, "One "), ("b", 0, "one")], "u string, i int, w string")
    texts = spark.createDataFrame([("a", "One, two!"), ("b", "one two")], "u string, t string")
    assert {r.u for r in conformance.exact_intervals(annotated, texts, "u", "i", "w", "t").collect()} == {"a"}


def test_stored_features_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"{tmp_path}/features"
    assert conformance.stored_or_made(spark, path, make).count() == conformance.stored_or_made(spark, path, make).count() == 3
    assert made == [1]


def test_reports_of_nothing(spark):
    empty = spark.createDataFrame([], "gold int, score double, decision string, manual_review_label string, alignment_quality string")
    assert evaluation.binary_report(empty, "gold", F.col("score") > 0).first()["f1"] == 0.0
    assert evaluation.headline_rates(empty).first()["review_rate"] == 0.0
    assert evaluation.correlation(empty.withColumn("b", F.col("score")), "score", "b").first()["pcc"] == 0.0
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert evaluation.correlation(one, "a", "b").first()["pcc"] == 0.0
    assert evaluation.sanity_report(spark.createDataFrame([("correct",), ("deleted",)], "s string"), "s").first()["counts"] == {"correct": 1, "deleted": 1}


@pytest.mark.parametrize("key", ["hot", None])
def test_places_of_a_key_that_holds_most_rows(spark, key):
    rows = [(key if i % 3 else f"k{i % 7}", (i * 7919) % 5003, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, x int, place_of int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = windows.placed(df, ["k"], [F.desc("x"), "place_of"])
        assert got.columns == ["k", "x", "place_of", "place"]
        found = {r["place_of"]: r["place"] for r in got.collect()}
        ranges = df.repartitionByRange("k", F.desc("x"), "place_of").select("k", F.spark_partition_id().alias("p")).where(F.col("k").eqNullSafe(key)).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen, expected = Counter(), {}
    for k, _, i in sorted(rows, key=lambda r: (str(r[0]), -r[1], r[2])):
        seen[k] += 1
        expected[i] = seen[k]
    assert found == expected and ranges > 1
    assert windows.placed(df.where("false"), ["k"], ["x"]).count() == 0
