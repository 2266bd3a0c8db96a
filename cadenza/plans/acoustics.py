"""Queries of scores of time spans. Vectors of `embeddings` stand for recordings, suppliers' phones for spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences, spans
from .registry import PHONES, phones, query, table

_FEATURES = ("duration_ms", "error_score", "prob_correct")


def _each(pattern: str, by: str) -> str:
    return by.join(pattern.format(f=f) for f in _FEATURES)


@query("pronunciation_scores", f"""WITH {PHONES}, m AS (SELECT target_phone AS phone, {_each("avg({f}) AS m_{f}, greatest(var_pop({f}), 0.25) AS v_{f}", ", ")} FROM phones GROUP BY 1 HAVING count(*) >= 40),
    s AS (SELECT phone_index, target_phone, count(*) AS frames, {_each("avg({f}) AS a_{f}, avg({f} * {f}) AS q_{f}", ", ")} FROM phones GROUP BY 1, 2),
    l AS (SELECT phone_index, target_phone, frames, phone, -0.5 * ({_each("ln(2 * pi() * v_{f}) + (q_{f} - 2 * m_{f} * a_{f} + m_{f} * m_{f}) / v_{f}", " + ")}) AS ll FROM s, m),
    r AS (SELECT phone_index, target_phone, phone AS competitor, ll AS other FROM l WHERE phone <> target_phone QUALIFY row_number() OVER (PARTITION BY phone_index, target_phone ORDER BY ll DESC, phone) = 1)
    SELECT phone_index, target_phone, frames, competitor, round(ll - other, 5) AS gop_score, round(ll, 5) AS target_log_likelihood, round(other, 5) AS competitor_log_likelihood
    FROM l LEFT JOIN r USING (phone_index, target_phone) WHERE phone = target_phone""")  # fmt: skip
def pronunciation_scores(spark, sf_dir):
    rows = phones(spark, sf_dir)
    models = sequences.fit_gaussians(rows, "target_phone", list(_FEATURES))
    found = spans.pronunciation_scores(rows, ["phone_index"], "target_phone", list(_FEATURES), models)
    scores = ("gop_score", "target_log_likelihood", "competitor_log_likelihood")
    return found.withColumns({c: F.round(c, 5) for c in scores})


@query("pooled_spans", """WITH f AS (SELECT vec_id, i - 1 AS frame, embedding[4 * i - 3 : 4 * i] AS x FROM embeddings, unnest(range(1, len(embedding) // 4 + 1)) AS u(i)), n AS (SELECT vec_id, count(*) AS n FROM f GROUP BY 1),
    s AS (SELECT vec_id, p AS span, p * 0.37::DOUBLE AS a, p * 0.37::DOUBLE + 0.05 * (vec_id % 20) AS b, 1.5::DOUBLE AS d FROM embeddings, unnest(range(0, 5)) AS u(p)),
    b AS (SELECT vec_id, span, least(greatest(floor(a / d * n), 0), n - 1) AS low, least(ceil(b / d * n), n) AS high FROM s JOIN n USING (vec_id))
    SELECT vec_id, span, round(avg(x[1]::DOUBLE), 6) AS x0, round(avg(x[2]::DOUBLE), 6) AS x1, round(avg(x[3]::DOUBLE), 6) AS x2, round(avg(x[4]::DOUBLE), 6) AS x3
    FROM b JOIN f USING (vec_id) WHERE frame >= low AND frame < greatest(low + 1, high) GROUP BY 1, 2""")  # fmt: skip
def pooled_spans(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    n = F.floor(F.size("embedding") / 4).cast("int")
    frames = vectors.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("embedding", 4 * i + 1, 4).cast("array<double>"))).alias("frame", "x"))
    start = F.col("span") * F.lit(0.37)
    asked = vectors.select("vec_id", F.explode(F.array(*[F.lit(p).cast("long") for p in range(5)])).alias("span"))
    asked = asked.select("vec_id", "span", start.alias("a"), (start + F.lit(0.05) * (F.col("vec_id") % 20)).alias("b"), F.lit(1.5).alias("d"))
    found = spans.pooled_spans(frames, asked, "vec_id", "frame", "x", 4, "span", "a", "b", "d")
    return found.select("vec_id", "span", *[F.round(F.col("pooled")[i], 6).alias(f"x{i}") for i in range(4)])


@query("candidate_margins", """WITH f AS (SELECT vec_id // 4 AS span, i - 1 AS token, max(embedding[i])::DOUBLE AS peak FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY 1, 2),
    c AS (SELECT span, 'p' || p AS phone, [(span * 7 + p * 5) % 64, (span + p * 11) % 64] AS tokens, p = span % 6 AS target FROM (SELECT DISTINCT vec_id // 4 AS span FROM embeddings), unnest(range(0, 6)) AS u(p)),
    s AS (SELECT c.span, phone, target, (a.peak + b.peak) / 2 AS score FROM c JOIN f a ON a.span = c.span AND a.token = tokens[1] JOIN f b ON b.span = c.span AND b.token = tokens[2]),
    r AS (SELECT span, phone AS rival, score AS rival_score FROM s WHERE NOT target QUALIFY row_number() OVER (PARTITION BY span ORDER BY score DESC, phone) = 1)
    SELECT span, round(score, 6) AS target_score, round(rival_score, 6) AS rival_score, round(score - rival_score, 6) AS margin, rival FROM s JOIN r USING (span) WHERE target""")  # fmt: skip
def candidate_margins(spark, sf_dir):
    frames = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("span"), "embedding")
    each = frames.select("span").distinct().select("span", F.explode(F.array(*[F.lit(p) for p in range(6)])).alias("p"))
    tokens = F.array((F.col("span") * 7 + F.col("p") * 5) % 64, (F.col("span") + F.col("p") * 11) % 64).cast("array<int>")
    asked = each.select("span", F.concat(F.lit("p"), "p").alias("phone"), tokens.alias("tokens"), (F.col("p") == F.col("span") % 6).alias("target"))
    found = spans.candidate_margins(frames, asked, "span", "embedding", 64, "phone", "tokens", "target")
    return found.withColumns({c: F.round(c, 6) for c in ("target_score", "rival_score", "margin")})
