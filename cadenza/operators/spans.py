"""Scores of time spans from their frames, as joins and aggregates: no recording is held in one task.

What a span's score needs of its frames is small: means and variances for a Gaussian, the peak of each token for
rivals of a phone, a mean for an embedding. It is aggregated first; models and rivals meet that, not the frames.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Phones whose models are sent to the tasks as one row.
MOST_PHONES = 10_000


def _mean_log_likelihood(mean: Column, variance: Column, model: Column, width: int) -> Column:
    """Of frames with these moments under a diagonal Gaussian: the spread of frames about a model is their variance and their mean's distance."""
    terms = [F.log(2 * math.pi * model["variance"][i]) + (variance[i] + (mean[i] - model["mean"][i]) ** 2) / model["variance"][i] for i in range(width)]
    return -0.5 * sum(terms[1:], terms[0])


def pronunciation_scores(frames: DataFrame, keys: Sequence[str], target: str, features: Sequence[str], models: DataFrame) -> DataFrame:
    """SQ-24, SQ-38: keys, target, frames, gop_score, competitor, target_log_likelihood, competitor_log_likelihood of each span.

    ``models`` is what fit_gaussians returns for the same features; its phones are at most MOST_PHONES. The score is the mean log likelihood of
    the target less that of its best competitor, of equal ones the first by name; null without a competitor. A span whose target has no
    model is left out, a null target too; so are frames that lack a feature.
    """
    named = models.select(F.col(target).alias("phone"), "mean", "variance").where("phone IS NOT NULL")
    found = named.count()
    if found > MOST_PHONES:
        raise ValueError(f"{found} phones have models, {MOST_PHONES} at most")
    inventory = named.agg(F.array_sort(F.collect_list(F.struct("phone", "mean", "variance"))).alias("_models"))
    whole = frames
    for f in features:
        whole = whole.where(F.col(f).isNotNull())
    moments = whole.groupBy(*keys, target).agg(
        F.count(F.lit(1)).alias("frames"), F.array(*[F.avg(f) for f in features]).alias("_mean"), F.array(*[F.var_pop(f) for f in features]).alias("_variance")
    )
    scored = F.transform("_models", lambda m: F.struct(m["phone"].alias("phone"), _mean_log_likelihood(F.col("_mean"), F.col("_variance"), m, len(features)).alias("value")))
    rows = moments.crossJoin(F.broadcast(inventory)).withColumn("_scores", scored)  # one row
    own = F.try_element_at(F.filter("_scores", lambda s: s["phone"] == F.col(target)), F.lit(1))
    rivals = F.filter("_scores", lambda s: s["phone"] != F.col(target))
    best = F.reduce(F.slice(rivals, 2, F.greatest(F.size(rivals) - 1, F.lit(0))), F.try_element_at(rivals, F.lit(1)), lambda a, b: F.when(b["value"] > a["value"], b).otherwise(a))
    out = rows.withColumns({"_own": own, "_best": best}).where(F.col("_own").isNotNull())
    return out.select(
        *keys, target, "frames", (F.col("_own.value") - F.col("_best.value")).alias("gop_score"), F.col("_best.phone").alias("competitor"),
        F.col("_own.value").alias("target_log_likelihood"), F.col("_best.value").alias("competitor_log_likelihood"),
    )


def pooled_spans(frames: DataFrame, spans: DataFrame, key: str, index: str, values: str, width: int, span: str, start: str, end: str, duration: str) -> DataFrame:
    """SQ-25, SQ-36, SQ-37: (key, span, pooled): the mean of the frames that each span touches, at least one; null if its recording has none.

    ``frames`` has the frames of a recording, numbered from 0, with arrays of ``width``; key and span identify a span. Frames and spans
    meet by key and number, so a long recording is spread over many tasks. Without a positive duration a span has no frames.
    """
    sizes = frames.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    placed = spans.select(key, F.col(span), *[F.col(c).cast("double").alias(n) for c, n in ((start, "_a"), (end, "_b"), (duration, "_d"))]).join(sizes, key, "left")
    low = F.least(F.greatest(F.floor(F.col("_a") / F.col("_d") * F.col("_n")), F.lit(0)), F.col("_n") - 1)
    high = F.greatest(F.col("_low") + 1, F.least(F.ceil(F.col("_b") / F.col("_d") * F.col("_n")), F.col("_n")))
    touched = placed.withColumn("_low", F.when(F.col("_d") > 0, low)).select(key, span, F.explode_outer(F.sequence(F.col("_low"), high - 1)).alias("_i"))
    own = frames.select(key, F.col(index).cast("long").alias("_i"), F.col(values).alias("_x"))
    means = touched.join(own, [key, "_i"], "left").groupBy(key, span).agg(F.count("_x").alias("_k"), F.array(*[F.avg(F.get("_x", F.lit(i))) for i in range(width)]).alias("_m"))
    return means.select(key, span, F.when(F.col("_k") > 0, F.col("_m")).alias("pooled"))


def candidate_margins(frames: DataFrame, candidates: DataFrame, span: str, logits: str, width: int, phone: str, tokens: str, is_target: str) -> DataFrame:
    """SQ-15, SQ-34: (span, target_score, rival_score, margin, rival) from the frames of spans and the phones that they are judged by.

    A phone's score is the mean over its tokens of the token's greatest logit in the span. ``candidates`` names the target and its
    rivals with their tokens; of equally good rivals the first by name. Scores are null without frames, without tokens or if a token isn't below ``width``.
    """
    peaks = frames.groupBy(span).agg(F.array(*[F.max(F.get(logits, F.lit(i)).cast("double")) for i in range(width)]).alias("_peaks"))
    own = F.transform(tokens, lambda t: F.get("_peaks", t))
    mean = F.reduce(own, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(tokens), F.lit(0))
    judged = candidates.select(span, phone, tokens, is_target).join(peaks, span, "left").withColumn("_s", F.when(F.col(tokens).isNotNull(), mean))
    rival = ~F.col(is_target) & F.col("_s").isNotNull()
    scores = judged.groupBy(span).agg(F.max(F.when(F.col(is_target), F.col("_s"))).alias("target_score"), F.max(F.when(rival, F.col("_s"))).alias("rival_score"))
    first = judged.where(rival).groupBy(span, "_s").agg(F.min(phone).alias("rival")).groupBy(span).agg(F.max_by("rival", "_s").alias("rival"))
    joined = scores.join(first, span, "left")
    return joined.select(span, "target_score", "rival_score", (F.col("target_score") - F.col("rival_score")).alias("margin"), "rival")
