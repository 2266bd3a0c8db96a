"""Utterances that come in pieces: state over micro-batches, late rows, restarts, and the evaluation of a manifest."""

import os
import time
from datetime import datetime, timedelta

import pytest

from cadenza.operators.decisions import phone_decisions, phone_summary
from cadenza.streaming.diagnosis import diagnose, evaluate_manifest

SCHEMA = "utterance_id string, word_index int, target_phone string, prob_correct double, alignment_quality string, at timestamp, n_phones int"
START = datetime(2024, 1, 1)


def row(utterance, word, correct, second, n):
    return (utterance, word, "AH", correct, "pass", None if second is None else START + timedelta(seconds=second), n)


class Feed:
    """A folder that a stream reads, one file a micro-batch, in order."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "in").mkdir()

    def put(self, *rows):
        part = self.folder / f"part-{self.n}"
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(str(part))
        name = self.folder / "in" / f"{self.n}.parquet"
        os.rename(next(part.glob("part-*.parquet")), name)
        os.utime(name, (time.time() - 1000 + self.n, time.time() - 1000 + self.n))
        self.n += 1

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        found = diagnose(
            stream, ["utterance_id", "word_index"], str(self.folder / "words"), str(self.folder / "cp"), time="at", expected="n_phones", wait_ms=10_000, delay="5 seconds",
            phones_output=str(self.folder / "phones"),
        )
        assert found.awaitTermination(120) and found.exception() is None

    def read(self, what):
        return self.spark.read.parquet(str(self.folder / what))


@pytest.fixture
def feed(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    return Feed(spark, tmp_path)


def values(df, drop=("batch",)):
    return sorted(tuple(r) for r in df.drop(*drop).collect())


def test_an_utterance_in_three_batches_equals_the_batch_result(spark, feed):
    pieces = [
        [row("u1", 0, 0.1, 1, 5), row("u2", 0, 0.9, 1, 2)],
        [row("u1", 0, 0.9, 2, 5), row("u1", 1, 0.5, 2, 5), row("u2", 0, 0.2, 2, 2)],
        [row("u1", 1, 0.9, 3, 5), row("u1", 2, 0.9, 3, 5)],
    ]
    feed.put(*pieces[0])
    feed.put(*pieces[1])
    feed.run()
    assert {r.utterance_id for r in feed.read("words").collect()} == {"u2"}  # u1 is not whole yet
    feed.put(*pieces[2])
    feed.run()  # a restart from the checkpoint: the state of u1 is still there, u2 isn't decided again
    whole = spark.createDataFrame([r for p in pieces for r in p], SCHEMA)
    decided = phone_decisions(whole)
    assert values(feed.read("words")) == values(phone_summary(decided, ["utterance_id", "word_index"]))
    assert values(feed.read("phones"), ("batch", "utterance_complete")) == values(decided)
    assert {r.utterance_complete for r in feed.read("phones").collect()} == {True}


def test_timers_release_what_never_becomes_whole_and_late_rows_are_dropped(spark, feed):
    feed.put(row("u1", 0, 0.1, 1, 3), row(None, 0, 0.1, 1, 1))
    feed.put(row("u2", 0, 0.9, 60, 1))  # the watermark moves to 55 s, beyond the 11 s that u1 waits for
    feed.run()
    assert [(r.utterance_id, r.utterance_complete) for r in feed.read("phones").orderBy("utterance_id").collect()] == [("u1", False), ("u2", True)]
    feed.put(row("u1", 1, 0.2, 2, 3), row("u2", 1, 0.2, 61, 1))  # late for u1; u2 was released
    feed.run()
    assert [(r.utterance_id, r.word_index) for r in feed.read("words").orderBy("utterance_id").collect()] == [("u1", 0), ("u2", 0)]


def test_rows_without_a_time(spark, feed):
    feed.put(row("u1", 0, 0.1, None, 2), row("u1", 0, 0.1, 5, 2), row("u3", 0, 0.5, 5, None))
    feed.put(row("u2", 0, 0.9, 90, 1))
    feed.run()
    assert [(r.utterance_id, r.utterance_complete, r.n) for r in feed.read("phones").groupBy("utterance_id", "utterance_complete").count().withColumnRenamed("count", "n").orderBy("utterance_id").collect()] == [
        ("u1", True, 2), ("u2", True, 1), ("u3", False, 1),
    ]


def test_a_manifest_is_evaluated(spark):
    predictions = spark.createDataFrame([("u1", "correct"), ("u1", "true_error"), ("u2", "true_error"), ("u9", "true_error")], "utterance_id string, phone_decision string")
    manifest = spark.createDataFrame([("u1", None), ("u2", "wrong"), ("u3", ""), ("u1", None)], "utterance_id string, expected_label string")
    found = evaluate_manifest(manifest, predictions, "utterance_id")
    report = found["report"].first()
    assert (report.rows, report.false_alarm_rate, dict(report.counts)) == (2, 0.5, {"correct": 1, "true_error": 1})
    assert values(found["utterances"]) == [("u1", "correct", 2, 1, True, 0.5), ("u2", "wrong", 1, 1, True, 1.0), ("u3", "correct", 0, 0, False, 0.0)]
    assert found["rows"].count() == 3 and found["false_alarms"].count() == 1
