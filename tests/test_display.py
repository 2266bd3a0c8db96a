"""Texts for learners, token spans of words and candidate scores against plain versions."""

import math

import pytest
from pyspark.sql import functions as F

from cadenza.functions import display
from cadenza.functions.lexicon import token_spans
from cadenza.operators.display import displayed_phones
from cadenza.operators.projections import candidate_scores


def test_final_and_phone_errors(spark):
    rows = [(0.804, "deletion"), (0.125, "possible_deletion"), (1.7, "alignment_issue"), (None, "text_audio_mismatch"), (0.9, ""), (0.9, None), (0.9, "g2p_issue"), (0.9, "other")]
    df = spark.createDataFrame(rows, "p double, t string")
    assert [r[0] for r in df.select(display.final_error(F.col("p"), F.col("t"))).collect()] == ["80% 漏读", "12% 疑似漏读", "100% 需复核", "0% 文本音频不一致", "0%", "0%", "无法判断", "90%"]
    rows = [(80.4, "mispronunciation"), (None, ""), (7.0, "alignment_issue"), (7.0, "x")]
    df = spark.createDataFrame(rows, "p double, t string")
    assert [r[0] for r in df.select(display.phone_error(F.col("p"), F.col("t"))).collect()] == ["80% 读错", "50%", "7% 对齐失败", "7%"]


def test_states_and_decisions(spark):
    df = spark.createDataFrame([("correct", 0.914), ("deleted", 0.5), ("unavailable", 0.1), (None, 0.1)], "phone_state string, phone_probability_correct double")
    assert [r[0] for r in df.select(display.phone_state(df)).collect()] == ["读对 91%", "漏读 0%", "无法判断", "无法判断"]
    rows = [("deletion", ""), ("", "possible_deletion"), ("substituted_word", ""), ("g2p_issue", None), ("uncertain_review", ""), ("mispronounced", ""), ("acceptable_accent", ""), ("correct", ""), (None, None), ("correct", "deletion")]
    df = spark.createDataFrame(rows, "d string, t string")
    assert [r[0] for r in df.select(display.final_decision(F.col("d"), F.col("t"))).collect()] == ["漏读", "疑似漏读/需复核", "文本音频不一致", "单词暂未收录", "需复核", "发音错误", "可接受口音", "正确", "正确", "漏读"]


def test_rows_as_shown(spark):
    rows = [
        ("", "", "", "", "true_error", "deletion", "pass"), ("", "", "", "", "uncertain_review", "possible_deletion", "pass"), ("", "", "", "", "correct", "", "FAILED"), ("", "", "", "", "correct", "", "pass"),
        ("", "", "", "", "other", "g2p_issue", "pass"), ("", "", "", "", "uncertain_review", "", "suspect"), ("40%", "", "", "", "", "", "pass"), ("", "", "bad", "", "", "", ""), ("x", "y", "z", "possible_deletion", "", "", ""),
    ]
    df = spark.createDataFrame(rows, "display_error string, display_decision string, display_align string, display_error_type string, decision string, error_type string, alignment_quality string")
    assert [tuple(r[0]) for r in df.select(display.shown(df)).collect()] == [
        ("漏读", "漏读", "pass"), ("疑似漏读", "疑似漏读/需复核", "pass"), ("对齐失败", "需复核", "bad"), ("0%", "正确", "pass"), ("无法判断", "单词暂未收录", "bad"), ("0%", "需复核", "suspect"),
        ("40%", "正确", "pass"), ("对齐失败", "需复核", "bad"), ("疑似漏读", "疑似漏读/需复核", "suspect"),
    ]


def test_displayed_phones(spark):
    phones = spark.createDataFrame(
        [(0, "AH", "true_error", 80.0, "mispronunciation", "pass", "own"), (1, "T", "correct", 3.0, "", None, None), (2, "<UNK>", "correct", 3.0, "", "pass", None), (3, "R", None, None, None, "pass", None)],
        "word_index int, target_phone string, phone_decision string, phone_error_percent double, phone_error_type string, alignment_quality string, evidence_summary string",
    )
    words = spark.createDataFrame(
        [("0", "", "possible_deletion", "", "old", 1), ("1", "deletion", "", "suspect", "gone", 2), ("1", "", "", "", "older", 1), ("2", "deletion", "", "", "", 1)],
        "word_index string, final_error_type string, deletion_decision string, alignment_quality string, evidence_summary string, seq int",
    )
    got = {r.word_index: r for r in displayed_phones(phones, words, order=["seq"]).collect()}
    show = lambda k: (got[k].display_decision, got[k].display_error, got[k].display_align, got[k].display_error_type, got[k].evidence_summary)
    assert show("0") == ("发音错误", "80% 读错", "pass", "mispronunciation", "own")
    assert show("1") == ("漏读", "漏读", "suspect", "deletion", "gone")
    assert show("2") == ("单词暂未收录", "无法判断", "pass", "g2p_issue", "Phone-level diagnosis is unavailable.")
    assert show("3") == ("需复核", "50%", "pass", "", "Phone-level diagnosis is unavailable.")
    assert got["1"].word_alignment_quality == "suspect" and got["1"].alignment_quality == "bad"
    bare = displayed_phones(phones.select("word_index").withColumn("phone_state", F.lit("deleted")))
    assert {r.display_error for r in bare.collect()} == {"无法判断"}  # no phone is known


def plain_spans(words, vocabulary, unknown):
    """The tokens of the words joined by delimiters, walked with a cursor."""

    def cut(word):
        out = []
        while word:
            size = next((n for n in range(len(word), 0, -1) if word[:n] in vocabulary), 1)
            out.append(vocabulary.get(word[:size], unknown))
            word = word[size:]
        return out

    full = []
    for k, word in enumerate(words):
        full += cut(word) + (["|"] if k < len(words) - 1 else [])
    spans, cursor = [], 0
    for k, word in enumerate(words):
        start, cursor = cursor, cursor + len(cut(word))
        if k < len(words) - 1:
            assert full[cursor] == "|"
            cursor += 1
        spans.append((cut(word), start, cursor))
    return spans


@pytest.mark.parametrize("vocabulary", [{"a": 1, "b": 2, "ab": 3, "aba": 4, ".*": 5, "c": 6}, {}])
def test_token_spans(spark, vocabulary):
    texts = {1: ["abab", "cab", "x", "a.*b"], 2: ["abaab"], 3: ["é", "a\nb"]}
    df = spark.createDataFrame([(u, k, w) for u, words in texts.items() for k, w in enumerate(words)], "u int, k int, w string")
    found = token_spans(df, ["u"], "k", "w", vocabulary, 0).orderBy("u", "k").collect()
    assert [(list(r.token_ids), r.token_start, r.token_end) for r in found] == [s for words in texts.values() for s in plain_spans(words, vocabulary, 0)]


def test_token_spans_of_words_without_characters(spark):
    df = spark.createDataFrame([(1, 0, ""), (1, 1, "ab"), (1, 2, None), (1, 3, "a"), (1, 4, ""), (2, 0, None)], "u int, k int, w string")
    found = token_spans(df, ["u"], "k", "w", {"a": 1, "b": 2}, 0).orderBy("u", "k").collect()
    assert [(r.token_start, r.token_end) for r in found] == [(0, 0), (0, 3), (3, 3), (3, 4), (4, 4), (0, 0)]


def test_candidate_scores(spark):
    df = spark.createDataFrame([("1", 1.0, 4.0), ("3", None, 1.0), ("x", 2.0, 2.5), (None, 2.0, None), ("8", 1.0, 2.0)], "gop_score string, target_log_likelihood double, competitor_log_likelihood double")
    assert [r.candidate_score for r in candidate_scores(df).collect()] == [-1, -3, -3, -3, -8]
    assert [r.candidate_score for r in candidate_scores(df, "gop_margin").collect()] == [3, 1, 0.5, 1, 1]
    none = df.where("gop_score = 'x'")
    assert [abs(r.candidate_score) for r in candidate_scores(none).collect()] == [0] and not math.isnan(candidate_scores(none).first().candidate_score)
    with pytest.raises(ValueError, match="unknown candidate strategy"):
        candidate_scores(df, "other")
