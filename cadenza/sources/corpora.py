"""Readers of speech corpora: TextGrid tiers, Kaldi maps, nested scores, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import phone, phone_group
from ..operators.manifests import conform

TIERS = "path string, tier string, interval_index int, start double, end double, text string"


def read_manifest(spark: SparkSession, path: str, schema: StructType | None = None, defaults: dict | None = None) -> DataFrame:
    """IO-01, IO-02: a CSV with header (a byte order mark is dropped), all text or conformed to a schema."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in rows.columns])
    return conform(rows, schema, defaults) if schema else rows


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    """IO-03, IO-19, SE-01: union of frames with different columns."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def tiers_of(texts: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """IO-05, JN-25: the intervals of TextGrid texts (long form), by regular expressions in the JVM."""
    parts = F.split(F.regexp_replace(F.col(text), "^\\ufeff", ""), r"(?m)^\s*item\s*\[\d+\]\s*:?\s*$")
    tier = texts.select(F.col(path).alias("path"), F.explode(parts).alias("body")).where(F.col("body").rlike(r'class\s*=\s*"IntervalTier"'))
    name = F.regexp_replace(F.regexp_extract("body", r'name\s*=\s*"((?:[^"]|"")*)"', 1), '""', '"')
    pattern = r'intervals\s*\[\d+\]\s*:?\s*xmin\s*=\s*([-+0-9.eE]+)\s*xmax\s*=\s*([-+0-9.eE]+)\s*text\s*=\s*"((?:[^"]|"")*)"'
    found = [F.regexp_extract_all("body", F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    rows = tier.select("path", name.alias("tier"), F.posexplode(F.arrays_zip(*[f.alias(n) for f, n in zip(found, "abc")])).alias("interval_index", "x"))
    return rows.select(
        "path", "tier", "interval_index", F.col("x.a").cast("double").alias("start"), F.col("x.b").cast("double").alias("end"), F.regexp_replace("x.c", '""', '"').alias("text")
    )


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """IO-05: TextGrid files, each read whole."""
    files = spark.read.format("binaryFile").load(path)
    return tiers_of(files.select("path", F.decode("content", "UTF-8").alias("value")))


def kaldi_map(lines: DataFrame, column: str = "value") -> DataFrame:
    """IO-06: key and value of 'key value' lines; blank lines go."""
    rows = lines.where(F.trim(column) != "")
    return rows.select(F.regexp_extract(F.trim(column), r"^(\S+)", 1).alias("key"), F.trim(F.regexp_extract(F.trim(column), r"^\S+\s+(.*)$", 1)).alias("value"))


def utterance_metadata(utt2spk: DataFrame, wav: DataFrame, text: DataFrame, gender: DataFrame, age: DataFrame) -> DataFrame:
    """IO-07: one row per utterance from Kaldi maps (key, value); absent speakers' facts are 'UNKNOWN' and ''."""
    base = utt2spk.select(F.col("key").alias("utterance_id"), F.col("value").alias("speaker_id"))

    def fact(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.select(F.col("key").alias(key), F.col("value").alias(name))

    joined = base.join(fact(wav, "utterance_id", "wav"), "utterance_id", "left").join(fact(text, "utterance_id", "transcript"), "utterance_id", "left")
    joined = joined.join(fact(gender, "speaker_id", "speaker_gender"), "speaker_id", "left").join(fact(age, "speaker_id", "speaker_age"), "speaker_id", "left")
    return joined.select(
        "utterance_id", "speaker_id", F.upper(F.coalesce("speaker_gender", F.lit("unknown"))).alias("speaker_gender"), F.coalesce("speaker_age", F.lit("")).alias("speaker_age"),
        F.coalesce("transcript", F.lit("")).alias("transcript"), F.translate("wav", "\\", "/").alias("wav"),
    )


def scored_phones(scores: DataFrame, metadata: DataFrame) -> DataFrame:
    """IO-08: phone rows of (utterance_id, words array of struct word, phones, accuracies); unequal lengths or unknown utterances fail the job."""
    words = scores.select("utterance_id", F.posexplode("words").alias("word_index", "w"))
    equal = F.assert_true(F.size("w.phones") == F.size("w.accuracies"), F.concat(F.lit("phone/score length mismatch in "), F.col("utterance_id")))
    words = words.withColumn("_ok", equal).where(F.col("_ok").isNull())
    rows = words.select("utterance_id", "word_index", F.col("w.word").alias("word"), F.posexplode(F.arrays_zip(F.col("w.phones").alias("p"), F.col("w.accuracies").alias("a"))).alias("place", "x"))
    score = F.col("x.a").cast("double")
    rows = rows.select(
        "utterance_id", "word_index", "word", "place", F.col("x.p").alias("target_phone_raw"), phone("x.p").alias("target_phone"), phone_group("x.p").alias("phone_group"),
        score.alias("source_score"), (score >= 1.0).cast("int").alias("gold_binary"), (score < 1.8).cast("int").alias("attention_binary"),
        F.when(score >= 1.8, "correct").when(score >= 1.0, "acceptable").otherwise("incorrect").alias("gold_three_class"),
    )
    known = rows.join(metadata.withColumn("_there", F.lit(True)), "utterance_id", "left")
    checked = F.assert_true(F.col("_there").isNotNull(), F.concat(F.lit("no metadata for "), F.col("utterance_id")))
    return known.withColumn("_ok", checked).where(F.col("_ok").isNull()).drop("_there", "_ok")
