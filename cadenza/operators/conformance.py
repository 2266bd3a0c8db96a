"""Checks, defaults, keys and small projections of prediction frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import CONFUSIONS, lookup, number, optional, phone, phone_group, text, tokens, truthy
from .three_state import equivalence
from .windows import placed

# The recogniser's columns and what they hold where nothing was recognised; names of a good alignment; the columns of a row key.
RECOGNISER = {
    "asr_word": "", "recognized_word": "", "asr_edit_op": "not_checked", "alignment_op": "not_checked", "asr_word_status": "not_checked", "asr_missing_word": False,
    "asr_substituted_word": False, "asr_inserted_nearby": False, "asr_confidence": 0.0, "text_audio_mismatch": False, "text_audio_mismatch_type": "none",
    "text_audio_mismatch_score": 0.0, "asr_context_support": 0.0, "asr_missing_confidence": 0.0,
}
GOOD_ALIGNMENT = ("good", "pass", "ok")
KEY_COLUMNS = ("utterance_id", "speaker_id", "word", "target_phone", "start_ms", "end_ms")


def _thousandths(column: str, default: str) -> Column:
    """A number with three decimals as text, or the default."""
    value = number(column)
    return F.when(value.isNull(), default).otherwise(F.format_string("%.3f", value))


def is_good_alignment(column: Column | str) -> Column:
    """PR-25: good, pass or ok in any case; null is not."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*GOOD_ALIGNMENT), F.lit(False))


def with_recogniser_columns(df: DataFrame, transcript: str | Column, available: bool) -> DataFrame:
    """PR-26: the recogniser's columns, added or filled, with the transcript and whether the texts were compared."""
    said = F.lit(transcript) if isinstance(transcript, str) else transcript
    filled = {c: F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d) for c, d in RECOGNISER.items()}
    return df.withColumns({**filled, "asr_available": F.lit(available), "asr_transcript": said, "text_audio_consistency_status": F.lit("checked" if available else "not_checked")})


def not_checked(texts: DataFrame, key: str, column: str) -> DataFrame:
    """PR-27: a neutral row per word of texts without a transcript."""
    words = texts.select(key, F.posexplode(tokens(column)).alias("word_index", "word"))
    return words.select("*", F.col("word").alias("target_word"), *[F.lit(d).alias(c) for c, d in RECOGNISER.items() if not c.endswith(("support", "missing_confidence"))])


def missing_columns(df: DataFrame, required: Sequence[str], known: Sequence[str] = ()) -> dict[str, list[str]]:
    """PR-29: which required and which known optional columns a frame lacks."""
    return {"required": [c for c in required if c not in df.columns], "optional": [c for c in known if c not in df.columns]}


def model_frame(df: DataFrame, features: Mapping[str, str]) -> DataFrame:
    """PR-28, PR-30, PR-31: exactly the features that a model was fitted on (name: number or text), in its order; what is absent is null or ''."""
    return df.select(*[(number(c) if c in df.columns else F.lit(None).cast("double")).alias(c) if kind == "number" else text(df, c).alias(c) for c, kind in features.items()])


def second_gate(df: DataFrame) -> dict[str, Column]:
    """PR-32: the second recogniser's gates for states_by_thresholds; none where the frame lacks it; a null margin supports nothing."""
    if "reference_ctc_phone_model_available" not in df.columns:
        return {}
    margin = number("reference_ctc_deletion_margin") if "reference_ctc_deletion_margin" in df.columns else F.lit(None).cast("double")
    return {
        "second": truthy("reference_ctc_phone_model_available"), "second_margin": F.coalesce(margin, F.lit(float("-inf"))),
        "second_equivalent": equivalence(df, "reference_recognized_phone"),
    }


def row_key(df: DataFrame, columns: Sequence[str] = KEY_COLUMNS, required: bool = False) -> Column:
    """JN-32, JN-33: the columns of a row as one text; times to a thousandth, texts trimmed, absent ones blank (or an error, if required)."""
    lacking = [c for c in columns if c not in df.columns]
    if required and lacking:
        raise ValueError(f"missing columns: {lacking}")
    shown = lambda c: _thousandths(c, "") if c.endswith("_ms") else F.trim(text(df, c))
    return F.concat_ws("||", *[F.lit("") if c in lacking else shown(c) for c in columns])


def side_by_side(left: DataFrame, right: DataFrame, order_left: Sequence[str], order_right: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """JN-31: rows of two tables put together by their places within a key; a place that one side lacks is left out. Neither side orders a whole key in one task."""
    return placed(left, keys, order_left, "_place").join(placed(right, keys, order_right, "_place"), [*keys, "_place"]).drop("_place")


def exact_intervals(annotated: DataFrame, texts: DataFrame, key: str, order: str, word: str, column: str) -> DataFrame:
    """JN-34: the annotated words of a key whose sequence equals that of its text."""
    said = annotated.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.upper(F.trim(word)).alias("w")))), lambda x: x["w"]).alias("_said"))
    same = texts.select(key, tokens(column).alias("_text")).join(said, key).where(F.col("_said") == F.col("_text")).select(key)
    return annotated.join(same, key, "left_semi")


def correct_rows(df: DataFrame) -> Column:
    """ML-04: rows without an error, by the first label column that the frame has (gold_binary 1, label 0, gold_label 0)."""
    for name, value in (("gold_binary", 1), ("label", 0), ("gold_label", 0)):
        if name in df.columns:
            return F.coalesce(number(name) == value, F.lit(False))
    raise ValueError("one of gold_binary, label, gold_label is needed")


def usable_phones(df: DataFrame, valid: str, score: str, duration: str, least_duration: float, phones: Sequence[str] | None = None, drop_ones: bool = True) -> Column:
    """ML-70: valid rows that are long enough, without the middle score on demand, and of some phones if these are given."""
    keep = F.col(valid) & (F.col(duration) >= least_duration)
    if drop_ones:
        keep = keep & (F.col(score) != 1)
    return F.coalesce(keep & phone("target_phone").isin(*phones) if phones else keep, F.lit(False))


def phone_symbols(column: Column | str, symbols: Mapping[str, Sequence[str]]) -> Column:
    """FN-15: the symbols of a phone; none for an unknown one."""
    return lookup(phone(column), {k: F.array(*[F.lit(s) for s in v]) for k, v in symbols.items()}, F.array().cast("array<string>"))


def attributes(column: Column | str, known: Mapping[str, Mapping[str, str]], flags: Sequence[str], final: Column | None = None) -> Column:
    """FN-17: the attributes of a phone as a map of texts; flags default to false, the class to unknown; a closing consonant is marked."""
    name = phone(column)
    own = lookup(name, {k: F.create_map(*[F.lit(x) for pair in v.items() for x in pair]) for k, v in known.items()}, F.expr("map('vowel_consonant', 'unknown')"))
    base = F.map_from_arrays(F.array(*[F.lit(f) for f in flags]), F.array(*[F.lit("false")] * len(flags))) if flags else F.expr("cast(map() AS map<string,string>)")
    consonant = F.coalesce(F.try_element_at(own, F.lit("vowel_consonant")) == "consonant", F.lit(False)) & (F.lit(False) if final is None else F.coalesce(final, F.lit(False)))
    marked = F.create_map(F.lit("phone"), name, F.lit("final_consonant"), consonant.cast("string"))
    parts = F.concat(F.map_entries(marked), F.map_entries(own), F.map_entries(base))  # the first entry of a name counts
    names = F.array_distinct(F.transform(parts, lambda x: x["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.filter(parts, lambda x: x["key"] == n)[0]))


def serialised(attributes_of: Column) -> Column:
    """FN-18: a map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attributes_of))))


def confusable(column: Column | str) -> Column:
    """FN-19: the phones that learners exchange with a phone, sorted; none for others."""
    return lookup(phone(column), {k: F.array(*[F.lit(x) for x in sorted(v)]) for k, v in CONFUSIONS.items()}, F.array().cast("array<string>"))


def evidence_text(df: DataFrame) -> Column:
    """FN-36: the evidence of a phone's state as text; margins to a thousandth, nan where there is none."""
    shown = lambda c: _thousandths(c, "nan") if c in df.columns else F.lit("nan")
    error = text(df, "ctc_phone_error")
    parts = [("state", text(df, "phone_state")), ("recognized", text(df, "recognized_phone")), ("reference_recognized", text(df, "reference_recognized_phone"))]
    parts += [(name, shown(c)) for name, c in (("deletion_margin", "ctc_deletion_margin"), ("reference_deletion_margin", "reference_ctc_deletion_margin"),
                                              ("substitution_margin", "ctc_substitution_margin"), ("logit_margin", "ctc_logit_margin"))]
    whole = F.concat_ws("; ", *[F.concat(F.lit(f"{name}="), value) for name, value in parts])
    failed = text(df, "phone_error_type") == "alignment_issue"
    return F.when(text(df, "phone_state") != "unavailable", whole).when(failed, F.concat(F.lit("Alignment failed; CTC phone model unavailable: "), error)).otherwise(
        F.when(error == "", "CTC phone model unavailable").otherwise(error)
    )


def insertion_word(unit: Column, words: Column) -> Column:
    """FN-42: the word of the unit before an insertion: the first for none before, the last beyond the end, 0 without units."""
    at = F.least(unit - 1, F.size(words) - 1)
    return F.when((F.size(words) == 0) | (unit <= 0), 0).otherwise(F.get(words, at))


def find_utterance(manifest: DataFrame, utterance: str | None = None, audio: str | None = None) -> DataFrame:
    """FI-10: the rows of an utterance, or of an audio path: equal, equal in any case, or of the same file name."""
    if utterance:
        return manifest.where(F.col("utterance_id").cast("string") == utterance)
    if not audio:
        return manifest.limit(0)
    path = F.lower(F.col("audio_path").cast("string"))
    return manifest.where((path == audio.lower()) | (F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1) == audio.lower().replace("\\", "/").rsplit("/", 1)[-1]))


# ---------------------------------------------------------------- feature and label tables


def feature_frame(vectors: DataFrame, meta: DataFrame, key: str, vector: str, width: int, least_duration: float = 0.0, prefix: str = "w2v_", defaults: Mapping[str, object] | None = None) -> DataFrame:
    """IO-13, IO-26, IO-27, IO-29: the rows of ``meta`` that are long enough, their label as an integer, and the vector as columns; by key, not by position."""
    rows = meta.where(F.coalesce(number("duration") >= least_duration, F.lit(False))).withColumn("label", F.col("label").cast("int"))
    rows = rows.fillna({c: d for c, d in (defaults or {}).items() if c in rows.columns})
    joined = rows.join(vectors.select(key, F.col(vector).alias("_v")), key)
    return joined.select(*rows.columns, *[F.get("_v", F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(width)])


def imported_features(official: DataFrame, template: DataFrame, keys: Sequence[str], names: Sequence[str] = ("numeric", "features", "gop_features"), carried: Sequence[str] = ()) -> DataFrame:
    """IO-14: ``template`` with the features of another table under the first known name, and its other columns where that has them."""
    found = next((n for n in names if n in official.columns), None)
    if found is None:
        raise ValueError(f"one of {list(names)} is needed")
    own = [c for c in carried if c in official.columns and c not in keys]
    brought = official.select(*keys, F.col(found).alias("numeric"), *own)
    return template.drop("numeric", *own).join(brought, list(keys))


def stored_or_made(spark: SparkSession, path: str, make) -> DataFrame:
    """IO-28: a Parquet table, made and written first if it isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        make().write.parquet(path)
    return spark.read.parquet(path)


def without_features(df: DataFrame, names: Sequence[str] = (), parts: Sequence[str] = ("gop", "likelihood")) -> DataFrame:
    """IO-34: columns of these names, or with one of these parts in their names, set to 0."""
    gone = [c for c in df.columns if c in names or any(p in c.lower() for p in parts)]
    return df.withColumns({c: F.lit(0.0) for c in gone})


def word_labels(words: DataFrame, scores: str = "scores") -> DataFrame:
    """IO-30: of words with an array of phone scores 0..2: the count, how many are good, middling and bad, and the scores as text."""
    value = F.transform(scores, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    count = lambda f: F.size(F.filter(value, f))
    shown = F.array_join(F.transform(value, lambda x: F.format_string("%.3f", x)), " ")
    return words.withColumns(
        {
            "phone_scores": shown, "phone_count": F.size(value), "score_2_count": count(lambda x: x >= 1.5), "score_1_count": count(lambda x: (x >= 0.5) & (x < 1.5)),
            "score_0_count": count(lambda x: x < 0.5),
        }
    )


def unlabelled_manifest(alignment: DataFrame, utterance: Column, speaker: Column, audio: Column) -> DataFrame:
    """IO-31: aligned phones as manifest rows that ask for a prediction (label -1)."""
    lacking = missing_columns(alignment, ["target_phone", "start", "end"])["required"]
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    name, start, end = F.upper(F.trim("target_phone")), F.col("start").cast("double"), F.col("end").cast("double")
    return alignment.select(
        utterance.alias("utt_id"), speaker.alias("speaker_id"), audio.alias("wav_path"), text(alignment, "word").alias("word"), name.alias("target_phone"), phone_group(name).alias("phone_group"),
        start.alias("start"), end.alias("end"), (end - start).alias("duration"), F.lit(-1).alias("label"), F.lit("predict").alias("split"), F.lit("user_input").alias("dataset_source"),
        optional(alignment, "phone_index", None).cast("int").alias("phone_index"), F.lit(None).cast("double").alias("gop_score"),
    )


def equal_segments(texts: DataFrame, key: str, phones: str, duration: str) -> DataFrame:
    """IO-32: the phones of a text at equal parts of a duration, in milliseconds; a text without phones has no row."""
    listed = F.filter(F.transform(F.split(F.col(phones), r"[,\s]+"), lambda p: phone(p)), lambda p: p != "")
    rows = texts.select(key, F.col(duration).alias("_d"), F.size(listed).alias("_n"), F.posexplode(listed).alias("phone_index", "target_phone"))
    step = F.col("_d") / F.col("_n")
    start, end = F.col("phone_index") * step, (F.col("phone_index") + 1) * step
    return rows.select(key, "phone_index", "target_phone", F.round(start, 3).alias("start_ms"), F.round(end, 3).alias("end_ms"), F.round(end - start, 3).alias("duration_ms"), phone_group("target_phone").alias("phone_group"))


def chosen_thresholds(table: DataFrame, model: str, calibration: str) -> DataFrame:
    """IO-33: (level, key, threshold) of one model and calibration, as apply_thresholds takes them; a global key is ''."""
    rows = table.where((F.col("model") == model) & (F.col("calibration") == calibration))
    return rows.select("level", F.when(F.col("level") == "global", "").otherwise(F.col("key").cast("string")).alias("key"), F.col("threshold").cast("double").alias("threshold"))


def candidates(df: DataFrame, threshold: float, strategy: str, score: str = "candidate_score") -> DataFrame:
    """IO-35: rows with the candidate label and its source; write them with partitionBy("split")."""
    return df.withColumns({"candidate_label": (F.col(score) >= threshold).cast("int"), "candidate_source": F.lit(strategy)})


def deletions_to_make(words: DataFrame, speaker: str, key: str, utterances: int, deletions: int, seed: int) -> DataFrame:
    """IO-36: of each speaker the utterances of least seeded hash, of each of these the words of least hash: (speaker, key, word_index) to be deleted."""
    of = lambda *columns: F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)
    own = words.select(speaker, key).distinct().withColumn("_u", F.row_number().over(Window.partitionBy(speaker).orderBy(of(key), key))).where(F.col("_u") <= utterances)
    picked = words.join(own.drop("_u"), [speaker, key]).withColumn("_w", F.row_number().over(Window.partitionBy(speaker, key).orderBy(of(key, "word_index"), "word_index")))
    return picked.where(F.col("_w") <= deletions).select(speaker, key, "word_index")
