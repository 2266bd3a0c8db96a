"""A verifier of candidates whose acoustic features are gated by the phone that the text expects.

    audio' = relu(audio Wa + ba)      text = [phone vector, group vector]      gate = sigmoid(text Wg + bg)
    logit  = relu([audio' * gate, audio', text, numbers] W1 + b1) w2 + b2

It is fitted by whole-table descent: every step is a job in which each task sums the gradient of its rows. The sums
are added in two levels, so the driver gets as many as the square root of the tasks. Parameters go to the tasks;
their number is checked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lexicon import vocabulary
from ..functions.scalars import number
from ..shipping import ship
from ..storage import stored

#: Parameters that are sent to the tasks in every step (32 MB).
MOST_PARAMETERS = 4_000_000

Parameters = dict[str, np.ndarray]


@dataclass(frozen=True)
class Sizes:
    audio: int = 16
    phone: int = 8
    group: int = 4
    hidden: int = 16


@dataclass(frozen=True)
class Verifier:
    """The fitted network, with what its inputs are read by."""

    parameters: Parameters
    audio: dict[str, tuple[float, float]]
    numeric: dict[str, tuple[float, float]]
    phone: str
    group: str
    phones: DataFrame
    groups: DataFrame
    gated: bool


def initial(sizes: Sizes, audio: int, numeric: int, phones: int, groups: int, seed: int) -> Parameters:
    """Random layers; the last one is zero, so a network without a step says 0.5. The padding (row 0 of the vectors) is zero."""
    draw, text = np.random.default_rng(seed), sizes.phone + sizes.group
    fused = 2 * sizes.audio + text + numeric
    layer = lambda rows, columns: draw.normal(0.0, 1.0 / math.sqrt(max(1, rows)), (rows, columns))
    out = {
        "Wa": layer(audio, sizes.audio), "ba": np.zeros(sizes.audio), "P": draw.normal(0.0, 1.0, (phones, sizes.phone)), "G": draw.normal(0.0, 1.0, (groups, sizes.group)),
        "Wg": layer(text, sizes.audio), "bg": np.zeros(sizes.audio), "W1": layer(fused, sizes.hidden), "b1": np.zeros(sizes.hidden), "w2": np.zeros(sizes.hidden), "b2": np.zeros(1),
    }
    out["P"][0] = out["G"][0] = 0.0
    return out


def forward(p: Parameters, audio: np.ndarray, numbers: np.ndarray, phone: np.ndarray, group: np.ndarray, gated: bool) -> tuple[np.ndarray, tuple]:
    """Logits of rows, and the layers that the gradient needs."""
    sound = np.maximum(audio @ p["Wa"] + p["ba"], 0.0)
    text = np.concatenate([p["P"][phone], p["G"][group]], axis=1)
    gate = 1.0 / (1.0 + np.exp(-(text @ p["Wg"] + p["bg"]))) if gated else np.ones_like(sound)
    fused = np.concatenate([sound * gate, sound, text, numbers], axis=1)
    hidden = np.maximum(fused @ p["W1"] + p["b1"], 0.0)
    return hidden @ p["w2"] + p["b2"][0], (sound, text, gate, fused, hidden)


def gradient(p: Parameters, audio, numbers, phone, group, label, positive: float, gated: bool) -> tuple[float, Parameters]:
    """Sums over rows of the weighted cross entropy, errors (label 1) by ``positive``, and of its gradient."""
    z, (sound, text, gate, fused, hidden) = forward(p, audio, numbers, phone, group, gated)
    weight = np.where(label == 1, positive, 1.0)
    loss = float((weight * (np.logaddexp(0.0, z) - label * z)).sum())
    dz = weight * (1.0 / (1.0 + np.exp(-z)) - label)
    dh = np.outer(dz, p["w2"]) * (hidden > 0)
    df = dh @ p["W1"].T
    d, t = sound.shape[1], text.shape[1]
    dtext = df[:, 2 * d : 2 * d + t]
    out = {"w2": hidden.T @ dz, "b2": np.array([dz.sum()]), "W1": fused.T @ dh, "b1": dh.sum(axis=0), "Wg": np.zeros_like(p["Wg"]), "bg": np.zeros_like(p["bg"])}
    if gated:
        dg = df[:, :d] * sound * gate * (1.0 - gate)
        out["Wg"], out["bg"] = text.T @ dg, dg.sum(axis=0)
        dtext = dtext + dg @ p["Wg"].T
    ds = (df[:, :d] * gate + df[:, d : 2 * d]) * (sound > 0)
    out["Wa"], out["ba"] = audio.T @ ds, ds.sum(axis=0)
    out["P"], out["G"] = np.zeros_like(p["P"]), np.zeros_like(p["G"])
    np.add.at(out["P"], phone, dtext[:, : p["P"].shape[1]])
    np.add.at(out["G"], group, dtext[:, p["P"].shape[1] :])
    out["P"][0] = out["G"][0] = 0.0
    return loss, out


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(values: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _arrays(batch: pa.RecordBatch, audio: int, numeric: int) -> tuple[np.ndarray, ...]:
    def matrix(name: str, width: int) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)

    return matrix("_audio", audio), matrix("_numbers", numeric), batch.column("_phone").to_numpy(), batch.column("_group").to_numpy()


def _inputs(df: DataFrame, kept: dict[str, Column], audio: dict, numeric: dict, phone: str, group: str, phones: DataFrame, groups: DataFrame) -> DataFrame:
    """The kept columns, _audio, _numbers (standardised; an absent audio value is the mean, an absent number 0) and the ids _phone and _group (1 if unknown)."""

    def scaled(columns: dict, absent: Column | None) -> Column:
        values = [(F.coalesce(number(c), F.lit(m) if absent is None else absent) - F.lit(m)) / F.lit(s) for c, (m, s) in columns.items()]
        return F.array(*values) if values else F.array().cast("array<double>")

    texts = [F.col(c).cast("string").alias(n) for n, c in (("_p", phone), ("_g", group))]
    rows = df.select(*[c.alias(n) for n, c in kept.items()], scaled(audio, None).alias("_audio"), scaled(numeric, F.lit(0.0)).alias("_numbers"), *texts)
    for text, name, ids in (("_p", "_phone", phones), ("_g", "_group", groups)):
        own = F.broadcast(ids.select(F.col("token").alias(text), F.col("id").alias(name)))  # MOST_PARAMETERS rows at most
        rows = rows.join(own, text, "left").drop(text).withColumn(name, F.coalesce(F.col(name), F.lit(1)))
    return rows


def _scales(df: DataFrame, columns: Sequence[str], absent: float | None) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1e-6 more) of each column, from one aggregate."""
    if not columns:
        return {}
    value = {c: number(c) if absent is None else F.coalesce(number(c), F.lit(absent)) for c in columns}
    row = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(value.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"] or 0.0, (row[f"s{i}"] or 0.0) + 1e-6) for i, c in enumerate(columns)}


def fit(
    df: DataFrame, label: str, audio: Sequence[str], numeric: Sequence[str], phone: str = "target_phone", group: str = "phone_group",
    sizes: Sizes = Sizes(), steps: int = 40, rate: float = 0.03, decay: float = 1e-4, gated: bool = True, seed: int = 42,
) -> Verifier:
    """ML-26: the network fitted to all labelled rows by ``steps`` of Adam with decoupled decay; no rows leave it at 0.5 for everything.

    Errors weigh as much in all as the others. Without ``gated`` the gate is one everywhere. There is no dropout: each step
    sees every row. Sums are added in the order of the partitions of a stored table, so a fit can be repeated.
    """
    spark = df.sparkSession
    ship(spark)
    labelled = df.where(F.col(label).isNotNull())
    scales = _scales(labelled, audio, None), _scales(labelled, numeric, 0.0)
    phones, groups = (stored(vocabulary(df, c), "tokens") for c in (phone, group))
    wide, narrow = phones.count(), groups.count()
    if wide * sizes.phone + narrow * sizes.group > MOST_PARAMETERS:
        raise ValueError(f"{wide} phones and {narrow} groups have more than {MOST_PARAMETERS} parameters")
    p = initial(sizes, len(audio), len(numeric), wide, narrow, seed)
    rows = stored(_inputs(labelled, {"_label": F.col(label).cast("double")}, *scales, phone, group, phones, groups), "candidates")
    parted = rows.select("_label", F.spark_partition_id().alias("part"))
    count = parted.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_label") == 1).alias("pos"), F.max("part").alias("last")).first()
    n, positives = count["n"], count["pos"]
    positive = max(n - positives, 1) / max(positives, 1)
    slots = max(1, math.isqrt(count["last"] or 0))
    m, v, widths = np.zeros(flat(p).size), np.zeros(flat(p).size), (len(audio), len(numeric))

    for step in range(1, steps + 1 if n else 1):
        sent = spark.sparkContext.broadcast(p)

        def summed(batches, sent=sent):
            total = None
            for batch in batches:
                if batch.num_rows:
                    _, own = gradient(sent.value, *_arrays(batch, *widths), batch.column("_label").to_numpy(), positive, gated)
                    total = flat(own) if total is None else total + flat(own)
            if total is not None:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["part", "sums"])

        parts = rows.mapInArrow(summed, "part int, sums array<double>")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "sums"))), lambda x: x["sums"])  # the root of the tasks
        added = F.reduce(F.slice(ordered, 2, F.size(ordered)), ordered[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        found = parts.groupBy((F.col("part") % slots).alias("slot")).agg(added.alias("sums")).orderBy("slot").toArrow()  # a row a slot
        g = np.sum([np.asarray(x) for x in found.column("sums").to_pylist()], axis=0) / n
        sent.destroy()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = flat(p)
        w = w - rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * w)
        p = shaped(w, p)
    return Verifier(p, *scales, phone, group, phones, groups, gated)


def scored(model: Verifier, df: DataFrame, name: str = "verifier_score") -> DataFrame:
    """ML-26: the probability of an error for every row; unknown and null phones share the unknown vector."""
    ship(df.sparkSession)
    kept = {f"c{i}": c for i, c in enumerate(c for c in df.columns if c != name)}
    rows = _inputs(df, {n: F.col(c) for n, c in kept.items()}, model.audio, model.numeric, model.phone, model.group, model.phones, model.groups)
    sent = df.sparkSession.sparkContext.broadcast(model.parameters)
    widths, gated = (len(model.audio), len(model.numeric)), model.gated

    def run(batches):
        for batch in batches:
            z = forward(sent.value, *_arrays(batch, *widths), gated)[0] if batch.num_rows else np.zeros(0)
            own = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(1.0 / (1.0 + np.exp(-z)))], [*kept, "score"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("score", "double")).withColumnsRenamed({**kept, "score": name})
