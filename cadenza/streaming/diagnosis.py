"""Diagnosis of a stream of phone rows: utterances are held in keyed state until they are whole, then decided once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.scalars import text
from ..operators.decisions import phone_decisions, phone_summary
from ..operators.evaluation import sanity_report
from ..operators.metrics import ratio
from ..shipping import ship


def first_of_each(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """ST-02: rows whose key was not seen within the watermark."""
    return stream.withColumn(time, stream[time].cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def whole_utterances(stream: DataFrame, utterance: str, time: str, expected: str, wait_ms: int = 30_000, delay: str = "30 seconds") -> DataFrame:
    """ST-01: the rows of each utterance, released together and once, with ``utterance_complete``.

    The state of an utterance holds its rows over micro-batches. They are released when as many have come as the column
    ``expected`` says (complete), or when the watermark passes the latest time of a row by ``wait_ms`` (not complete). What comes after the
    release is dropped: by the state as long as it remembers the utterance, then as late rows by the watermark. Rows without an utterance are dropped;
    rows without a time wait for the rows of their utterance that have one, and are released at once if none has. State of an utterance is as large as the utterance.
    """
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).where(F.col(utterance).isNotNull()).withWatermark(time, delay)
    columns = rows.columns
    held_type = StructType([f for f in rows.schema.fields])
    out_type = StructType([*held_type.fields, StructField("utterance_complete", BooleanType())])

    def release(rows: pd.DataFrame, complete: bool) -> pd.DataFrame:
        return rows.assign(utterance_complete=complete)[[*columns, "utterance_complete"]]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, released, until = state.get if state.exists else (None, False, 0)
        if state.hasTimedOut:
            state.remove()
            if not released and kept is not None:
                yield release(_unpacked(kept), False)
            return
        new = pd.concat(list(batches), ignore_index=True)
        times = new[time].dropna()
        if len(times):
            until = max(until, int(times.max().timestamp() * 1000) + wait_ms)
        watermark = state.getCurrentWatermarkMs()
        if not released:
            own = new if kept is None else pd.concat([_unpacked(kept), new], ignore_index=True)
            wanted = own[expected].dropna()
            complete = bool(len(wanted)) and len(own) >= int(wanted.max())
            if complete or until <= watermark:  # nothing left to wait for
                yield release(own, complete)
                kept, released = None, True
            else:
                kept = _packed(own)
        state.update((kept, released, until))
        state.setTimeoutTimestamp(max(until, watermark + 1))

    ship(stream.sparkSession)
    return rows.groupBy(utterance).applyInPandasWithState(step, out_type, "kept binary, released boolean, until long", "append", GroupStateTimeout.EventTimeTimeout)


def _packed(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(kept: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(kept).read_all().to_pandas()


def diagnose(
    stream: DataFrame, keys: Sequence[str], output: str, checkpoint: str, once: bool = True, time: str | None = None, expected: str | None = None, wait_ms: int = 30_000, delay: str = "30 seconds",
    phones_output: str | None = None,
) -> StreamingQuery:
    """ST-01: decide the phones of each utterance (the first key) and roll them up to words, each utterance once.

    Writes the words, and if a folder is named the phones, by micro-batch: a batch that is repeated after a restart replaces what it wrote.
    With ``time`` and ``expected`` an utterance may come in any number of micro-batches (see whole_utterances); without them it comes whole within one.
    """
    source = stream if expected is None else whole_utterances(stream, keys[0], time, expected, wait_ms, delay)

    def write(batch: DataFrame, number: int) -> None:
        phones = phone_decisions(batch)
        if phones_output:
            phones.write.mode("overwrite").parquet(f"{phones_output}/batch={number}")
            phones = batch.sparkSession.read.schema(phones.schema).parquet(f"{phones_output}/batch={number}")
        phone_summary(phones, keys).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def evaluate_manifest(manifest: DataFrame, predictions: DataFrame, utterance: str, decision: str = "phone_decision", expected: str = "expected_label") -> dict[str, DataFrame]:
    """ST-03: predictions of the utterances of a manifest, held against its labels ('correct' where it has none).

    rows: predictions of utterances in the manifest; report: one row of their number, false alarms and counts by decision, over
    utterances that should be correct; utterances: one row of each in the manifest, also of those that were never diagnosed; false_alarms: the rows that the report calls wrong.
    """
    label = text(manifest, expected, "correct")
    listed = manifest.select(F.col(utterance), F.when(label == "", "correct").otherwise(label).alias(expected)).dropDuplicates([utterance])
    rows = predictions.drop(expected).join(listed, utterance)
    sane = rows.where(F.col(expected) == "correct")
    alarm: Column = F.col(decision) == "true_error"
    counts = predictions.groupBy(utterance).agg(F.count(F.lit(1)).alias("phones"), F.count_if(alarm).alias("errors"))
    each = listed.join(counts, utterance, "left").withColumn("diagnosed", F.col("phones").isNotNull()).fillna(0, ["phones", "errors"])
    each = each.withColumn("error_rate", F.round(ratio(F.col("errors"), F.col("phones")), 6))
    return {"rows": rows, "report": sanity_report(sane, decision), "utterances": each, "false_alarms": sane.where(alarm)}
