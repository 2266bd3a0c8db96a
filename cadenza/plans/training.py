"""Queries of models, folds, votes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import audio, decisions, display, metrics, models, projections, reports, retrieval, trees, verifier
from ..storage import new_path, stored
from ..streaming.diagnosis import diagnose
from .registry import _DECISIONS, _VOTES, ORACLE_SQL, PHONES, phones, query, table


@query("stratified_folds", """SELECT l_orderkey, l_linenumber, l_returnflag, ((row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('42:' || l_orderkey || '-' || l_linenumber), l_orderkey || '-' || l_linenumber) - 1) % 5)::INTEGER AS fold
    FROM lineitem""")
def stratified_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return models.stratified_folds(rows, "id", "l_returnflag").drop("id")


@query("oneclass_decisions", f"""WITH {PHONES}, o AS (SELECT *, round(1 - prob_correct, 6) AS s FROM phones) SELECT utterance_id, word_index, phone_index, target_phone,
    CASE WHEN decision = 1 AND s >= 0.55 THEN 'high_confidence_error' WHEN decision = 1 THEN 'uncertain_review' WHEN s >= 0.7 THEN 'candidate_error_for_review' ELSE 'likely_correct' END AS oneclass_verifier_decision FROM o""")
def oneclass_decisions(spark, sf_dir):
    found = retrieval.oneclass_decision(F.col("decision") == 1, F.round(1 - F.col("prob_correct"), 6))
    return phones(spark, sf_dir).select("utterance_id", "word_index", "phone_index", "target_phone", found.alias("oneclass_verifier_decision"))


@query("extra_trees")
def extra_trees(spark, sf_dir):
    """The forest over the first two splits scores every phone; tested against a plain version."""
    rows = phones(spark, sf_dir).select("utterance_id", "word_index", "phone_index", "target_phone", "gold", "split", "duration_ms", "error_score", "prob_correct")
    forest = trees.fit(rows.where("split <> 2"), "gold", ["duration_ms", "error_score", "prob_correct"], trees=20, depth=6)
    return trees.scored(forest, rows).select("utterance_id", "word_index", "phone_index", "target_phone", F.round("score", 6).alias("score"))


@query("gated_verifier")
def gated_verifier(spark, sf_dir):
    """The verifier is fitted to the candidates (decision 1) of the first two splits and scores all; tested against a plain descent and held-out rows."""
    rows = phones(spark, sf_dir).select("utterance_id", "word_index", "phone_index", "target_phone", "phone_group", "gold", "split", "decision", "duration_ms", "error_score", "prob_correct")
    model = verifier.fit(rows.where("decision = 1 AND split <> 2"), "gold", ["duration_ms", "prob_correct"], ["error_score"], steps=20)
    return verifier.scored(model, rows.where("decision = 1"), "score").select("utterance_id", "word_index", "phone_index", "target_phone", F.round("score", 6).alias("score"))


@query("stream_diagnosis", f"""WITH {_DECISIONS}, s AS (SELECT phone_index AS supplier, * FROM e) SELECT supplier, word_index, count(*) AS phone_count,
    CASE WHEN bool_or(phone_decision = 'true_error') THEN 'has_phone_error' WHEN bool_or(phone_decision = 'uncertain_review') THEN 'needs_review' ELSE 'correct' END AS word_decision,
    CASE WHEN bool_or(alignment_quality = 'bad') THEN 'bad' ELSE 'pass' END AS alignment_quality, max(probability) AS max_phone_error_probability,
    count(*) FILTER (phone_decision = 'true_error') AS num_phone_true_error, count(*) FILTER (phone_decision = 'uncertain_review') AS num_phone_uncertain FROM s GROUP BY 1, 2""")
def stream_diagnosis(spark, sf_dir):
    """The rows of a supplier are an utterance; they come in micro-batches by line, so the stream holds every utterance over several of them."""
    still, pieces = table(spark, sf_dir, "lineitem"), new_path(spark, "stream-pieces")
    still.repartitionByRange(4, "l_linenumber").write.parquet(pieces)
    expected = still.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("expected"))
    stream = spark.readStream.schema(still.schema).option("maxFilesPerTrigger", 1).parquet(pieces).join(expected, "l_suppkey")
    rows = stream.select(
        F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("word_index"), F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 3), "bad").otherwise("pass").alias("alignment_quality"),
        F.when(F.col("l_quantity") > 3, F.round(1 - F.col("l_tax") / 0.08, 6)).alias("prob_correct"), F.timestamp_seconds("l_linenumber").alias("at"), "expected",
    )
    output = new_path(spark, "stream-words")
    diagnose(rows, ["supplier", "word_index"], output, new_path(spark, "stream"), time="at", expected="expected").awaitTermination()
    return spark.read.parquet(output).drop("batch", "avg_phone_error_probability")


_FLAGS = f"""{_VOTES}, m AS (SELECT target_phone, avg(duration_ms) AS mean, stddev_samp(duration_ms) AS sd FROM phones GROUP BY 1),
    f AS (SELECT v.*, (av = 'high_confidence_error' OR risk >= 0.55)::INTEGER AS attribute, (rv = 'likely_error' OR margin < 0)::INTEGER AS retrieval, (coalesce(abs((duration_ms - mean) / nullif(sd, 0)), 0) >= 2.5)::INTEGER AS outlier,
        CASE WHEN err = 1 AND error_score >= 0.35 AND votes >= 2 THEN 'high_confidence_error' WHEN err = 1 THEN 'uncertain_review' WHEN s >= 0.2 THEN 'acceptable_accent' ELSE 'correct' END AS voted FROM v JOIN m USING (target_phone))"""

ORACLE_SQL["evidence_patterns"] = f"""WITH {_FLAGS}, p AS (SELECT *, concat_ws('+', CASE WHEN err = 1 THEN 'main' END, CASE WHEN attribute = 1 THEN 'attribute' END, CASE WHEN retrieval = 1 THEN 'retrieval' END, CASE WHEN outlier = 1 THEN 'duration' END) AS pattern,
        concat_ws(' + ', CASE WHEN err = 1 THEN 'main_model_high_prob' END, CASE WHEN attribute = 1 THEN 'attribute_high_risk' END, CASE WHEN retrieval = 1 THEN 'retrieval_negative_margin' END, CASE WHEN outlier = 1 THEN 'duration_outlier' END) AS parts,
        attribute + retrieval + outlier AS few FROM f)
    SELECT CASE pattern WHEN 'main' THEN 'main_only' WHEN '' THEN 'none' ELSE pattern END AS evidence_pattern,
        CASE voted WHEN 'high_confidence_error' THEN CASE WHEN few = 0 THEN 'main_model_only_no_verifier_support' WHEN (error_score < 0.35 AND few < 2) OR parts = '' THEN 'weak_evidence_but_marked_error' ELSE parts END
            WHEN 'uncertain_review' THEN 'weak_or_conflicting_verifier_evidence' WHEN 'acceptable_accent' THEN 'non_error_with_moderate_error_score' ELSE 'likely_correct' END AS audit_reason, count(*) AS n FROM p GROUP BY 1, 2"""

ORACLE_SQL["strict_consensus"] = f"""WITH {_FLAGS}, g AS (SELECT *, CASE WHEN lower(phone_group) = 'standard' THEN 0.45 WHEN lower(phone_group) = 'economy' THEN 0.3 ELSE 0.35 END AS least, CASE WHEN lower(phone_group) = 'standard' THEN 1 ELSE 2 END AS evidence FROM f)
    SELECT phone_group, CASE WHEN (err = 1 OR error_score >= least) AND attribute + retrieval + outlier >= evidence AND round(s, 6) >= least THEN 'high_confidence_error' WHEN err = 1 THEN 'uncertain_review'
        WHEN round(s, 6) >= 0.2 THEN 'acceptable_accent' ELSE 'correct' END AS final_decision, count(*) AS n FROM g GROUP BY 1, 2"""

ORACLE_SQL["word_mispronunciation"] = """WITH k AS (SELECT ['TH', 'R', 'L', 'V', 'IH', 'IY', 'AE', 'EH', 'B', 'P', 'S', 'Z'] AS x), p AS (SELECT x[l_partkey % 12 + 1] AS t, x[l_orderkey % 12 + 1] AS h, l_quantity / 50 AS mean, l_quantity / 100 AS least FROM lineitem, k),
    c AS (SELECT *, mean < 0.45 AND least < 0.30 AS low, mean < 0.65 AS moderate, CASE WHEN t = h THEN 'none' WHEN t = 'TH' AND h IN ('S', 'Z') THEN 'th_fronting_or_stopping' WHEN t = 'R' AND h = 'L' THEN 'r_l_w_confusion'
        WHEN (t, h) IN (('IH', 'IY'), ('IY', 'IH')) THEN 'ih_iy_confusion' WHEN (t, h) IN (('AE', 'EH'), ('EH', 'AE')) THEN 'ae_eh_confusion'
        WHEN (t, h) IN (('P', 'B'), ('B', 'P'), ('S', 'Z'), ('Z', 'S')) THEN 'voicing_confusion' ELSE 'other_phone_difference' END AS kind FROM p),
    d AS (SELECT *, kind IN ('ih_iy_confusion', 'ae_eh_confusion') AS light, kind IN ('th_fronting_or_stopping', 'r_l_w_confusion') AS plain, kind = 'voicing_confusion' AS hard FROM c)
    SELECT CASE WHEN light AND low THEN 'uncertain_review' WHEN light THEN 'acceptable_accent' WHEN hard AND low THEN 'mispronounced' WHEN t <> h AND low THEN 'mispronounced' WHEN plain THEN 'acceptable_accent'
        WHEN t <> h OR moderate THEN 'uncertain_review' ELSE 'correct' END AS mispronunciation_decision, kind AS mandarin_confusion_type, count(*) AS n FROM d GROUP BY 1, 2"""


@query("token_spans", """WITH w AS (SELECT item_id, i - 1 AS word_index, x[i] AS word, len(regexp_extract_all(x[i], '(?s)ing|th|.')) AS n, len(x) AS k FROM (SELECT item_id, string_split(text, ' ') AS x FROM benchmark), unnest(range(1, len(x) + 1)) AS u(i)),
    l AS (SELECT *, max(CASE WHEN n > 0 THEN word_index END) OVER (PARTITION BY item_id) AS last FROM w), s AS (SELECT *, n + (n > 0 AND word_index < last)::INTEGER AS width FROM l)
    SELECT item_id, word_index::INTEGER AS word_index, word, (sum(width) OVER (PARTITION BY item_id ORDER BY word_index) - width)::INTEGER AS token_start, (sum(width) OVER (PARTITION BY item_id ORDER BY word_index))::INTEGER AS token_end FROM s""")
def token_spans(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("word_index", "word"))
    tokens = {t: i for i, t in enumerate(["ing", "th", *"abcdefghijklmnopqrstuvwxyz"])}
    return lexicon.token_spans(words, ["item_id"], "word_index", "word", tokens, 99).drop("token_ids")


@query("candidate_scores", f"""WITH {PHONES}, g AS (SELECT *, CASE WHEN duration_ms > 5 THEN prob_correct END AS gop FROM phones) SELECT utterance_id, word_index, phone_index, target_phone, -coalesce(gop, (SELECT median(gop) FROM g)) AS candidate_score FROM g""")
def candidate_scores(spark, sf_dir):
    rows = phones(spark, sf_dir).select("utterance_id", "word_index", "phone_index", "target_phone", F.when(F.col("duration_ms") > 5, F.col("prob_correct")).alias("gop_score"))
    return projections.candidate_scores(rows).drop("gop_score")


@query("audio_inspection", """WITH s AS (SELECT vec_id, list_transform(flatten([embedding for _ in range(40)]), lambda x: trunc(greatest(least(x::DOUBLE / 4, 1), -1) * 32767) / 32768) AS x, [8000, 16000, 44100][vec_id % 3 + 1] AS rate, vec_id % 2 + 1 AS channels FROM embeddings),
    r AS (SELECT vec_id, rate, channels, len(x) / rate AS d, list_avg(list_transform(x, lambda v: v * v)) AS m FROM s)
    SELECT vec_id, round(d, 6) AS duration_sec, rate::INTEGER AS sample_rate, channels::INTEGER AS channels, round(sqrt(m), 5) AS rms,
    concat_ws(',', CASE WHEN channels <> 1 THEN 'audio_not_mono' END, CASE WHEN rate <> 16000 THEN 'audio_sample_rate_not_16k' END, CASE WHEN d <= 0.05 THEN 'audio_duration_too_short' END) AS warnings FROM r""")
def audio_inspection(spark, sf_dir):
    """Vectors as sounds: their elements are samples of three rates in one or two channels."""
    rates = F.array(F.lit(8_000), F.lit(16_000), F.lit(44_100))
    samples = F.transform(F.flatten(F.array_repeat("embedding", 40)), lambda x: x.cast("double") / 4)
    files = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), audio.pcm16_wav(samples, rates[(F.col("vec_id") % 3).cast("int")], F.col("vec_id") % 2 + 1).alias("content"))
    found = audio.inspect_audio(stored(files, "sounds"))
    return found.select(F.col("path").cast("long").alias("vec_id"), "duration_sec", "sample_rate", "channels", F.round("rms", 5).alias("rms"), F.concat_ws(",", "warnings").alias("warnings"))


@query("prepared_audio")
def prepared_audio(spark, sf_dir):
    """The same sounds between silences, mixed, resampled and trimmed; tested against a plain version."""
    quiet = F.array_repeat(F.lit(0.0), 6_000)
    samples = F.concat(quiet, F.transform(F.flatten(F.array_repeat("embedding", 40)), lambda x: x.cast("double") / 4), quiet)
    rates = F.array(F.lit(8_000), F.lit(16_000), F.lit(44_100))
    files = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), audio.pcm16_wav(samples, rates[(F.col("vec_id") % 3).cast("int")]).alias("content"))
    done = audio.preprocess_audio(files, trim=True)
    return done.select(F.col("path").cast("long").alias("vec_id"), (F.octet_length("content") - 44).alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query("displayed_phones", """WITH p AS (SELECT l_orderkey, l_linenumber, round(l_discount * 1000, 0) AS percent, CASE l_returnflag WHEN 'R' THEN 'true_error' WHEN 'A' THEN 'uncertain_review' ELSE 'correct' END AS said,
        CASE l_returnflag WHEN 'R' THEN 'mispronunciation' WHEN 'A' THEN 'possible_mispronunciation' ELSE '' END AS kind, CASE WHEN l_quantity < 3 THEN '<UNK>' ELSE 'AH' END AS target_phone FROM lineitem),
    w AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'deletion' ELSE '' END AS final FROM orders), j AS (SELECT p.*, w.final, target_phone = '<UNK>' AS unknown, coalesce(w.final, '') = 'deletion' AS gone FROM p LEFT JOIN w ON o_orderkey = l_orderkey)
    SELECT l_orderkey, l_linenumber, CASE WHEN unknown THEN '单词暂未收录' WHEN gone THEN '漏读' WHEN said = 'true_error' THEN '发音错误' WHEN said = 'uncertain_review' THEN '需复核' ELSE '正确' END AS display_decision,
        CASE WHEN unknown THEN '无法判断' WHEN gone THEN '漏读' ELSE percent::INTEGER || '%' || CASE kind WHEN 'mispronunciation' THEN ' 读错' WHEN 'possible_mispronunciation' THEN ' 疑似错误' ELSE '' END END AS display_error,
        CASE WHEN gone AND NOT unknown THEN 'suspect' ELSE 'bad' END AS display_align, CASE WHEN unknown THEN 'g2p_issue' WHEN gone THEN 'deletion' ELSE kind END AS display_error_type FROM j""")
def displayed_phones(spark, sf_dir):
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 1000, 0).alias("phone_error_percent"), F.when(flag == "R", "true_error").when(flag == "A", "uncertain_review").otherwise("correct").alias("phone_decision"),
        F.when(flag == "R", "mispronunciation").when(flag == "A", "possible_mispronunciation").otherwise("").alias("phone_error_type"), F.when(F.col("l_quantity") < 3, "<UNK>").otherwise("AH").alias("target_phone"),
    )
    words = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", "deletion").otherwise("").alias("final_error_type"))
    shown = display.displayed_phones(rows, words, ["l_orderkey"]).withColumn("l_orderkey", F.col("l_orderkey").cast("long"))
    return shown.select("l_orderkey", "l_linenumber", "display_decision", "display_error", "display_align", "display_error_type")


@query("indexed_neighbours")
def indexed_neighbours(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 100, among all; the vectors are random, so few bits and many tables are needed. Its recall is tested."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.indexed_neighbours(rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "asked"), rows, "asked", "vec_id", "embedding", 10, bits=3, tables=16)


@query("threshold_summary", """WITH t AS (SELECT DISTINCT p_brand, l_discount + 0.5 AS t FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'), r AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY t) <= 5)
    SELECT g.p_brand, coalesce(string_agg(round(t, 6)::VARCHAR, ';' ORDER BY t), '') AS thresholds FROM (SELECT DISTINCT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) g LEFT JOIN r USING (p_brand) GROUP BY g.p_brand""")
def threshold_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return metrics.threshold_summary(rows.select("p_brand", F.when(F.col("l_returnflag") == "R", F.col("l_discount") + 0.5).alias("threshold")), ["p_brand"])


@query("three_state_words", f"""WITH {PHONES}, p AS (SELECT utterance_id, CASE WHEN duration_ms < 4 THEN 'unavailable' WHEN gold = 1 AND decision = 1 THEN 'deleted' WHEN gold = 1 THEN 'mispronounced' ELSE 'correct' END AS s FROM phones),
    c AS (SELECT utterance_id, count(*) AS phone_count, count(*) FILTER (s = 'correct') AS num_correct, count(*) FILTER (s = 'mispronounced') AS num_mispronounced, count(*) FILTER (s = 'deleted') AS num_deleted, count(*) FILTER (s = 'unavailable') AS num_unavailable FROM p GROUP BY 1)
    SELECT *, CASE WHEN phone_count = num_unavailable THEN 'unavailable' WHEN num_deleted = phone_count THEN 'deleted' WHEN num_mispronounced > 0 THEN 'mispronounced' WHEN num_deleted > 0 THEN 'partial_deletion' ELSE 'correct' END AS word_state FROM c""")
def three_state_words(spark, sf_dir):
    state = F.when(F.col("duration_ms") < 4, "unavailable").when((F.col("gold") == 1) & (F.col("decision") == 1), "deleted").when(F.col("gold") == 1, "mispronounced").otherwise("correct")
    return decisions.three_state_summary(phones(spark, sf_dir).withColumn("phone_state", state), ["utterance_id"])


@query("overridden_words", """WITH p AS (SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_quantity < 10) AS missing, count(*) FILTER (l_returnflag = 'A') AS errors, min(CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 'long' WHEN l_tax < 0.01 THEN 'free' END) AS source FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS l_orderkey, CASE WHEN missing THEN 'true_error' WHEN source IS NOT NULL THEN 'uncertain_review' ELSE 'correct' END AS word_decision, coalesce(source, 'none') AS deletion_trigger_source, coalesce(errors, 0) AS num_phone_true_error FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""")
def overridden_words(spark, sf_dir):
    source = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), "long").when(F.col("l_tax") < 0.01, "free").otherwise("none")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", ((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 10)).alias("asr_missing_word"), F.when(F.col("l_returnflag") == "A", "true_error").otherwise("correct").alias("decision"), source.alias("deletion_trigger_source")
    )
    words = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("correct").alias("word_decision"))
    return projections.overridden_words(words, rows, ["l_orderkey"])


@query("word_labels", """WITH s AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity / 25 >= 1.5) AS good, count(*) FILTER (l_quantity / 25 >= 0.5 AND l_quantity / 25 < 1.5) AS fair, count(*) FILTER (l_quantity / 25 < 0.5) AS poor, bool_or(l_returnflag = 'R') AS missing FROM lineitem GROUP BY 1)
    SELECT l_orderkey, n, good, fair, poor, CASE WHEN n = 0 THEN 'alignment_issue' WHEN 2 * good > n THEN 'word_correct' WHEN 2 * fair > n AND poor = 0 THEN 'acceptable_accent' WHEN poor > 0 AND missing THEN 'deletion_or_missing' WHEN poor > 0 THEN 'mispronounced'
        WHEN good > 0 THEN 'word_correct' ELSE 'acceptable_accent' END AS word_label FROM s""")
def word_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") / 25).alias("score"), (F.col("l_returnflag") == "R").alias("gone"))
    return reports.word_label_from_scores(rows, ["l_orderkey"], "score", F.col("gone"))
