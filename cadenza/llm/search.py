"""Ranked lexical search over a forward index in blocks, with block-max pruning.

The index stands in blocks of ``BLOCK`` neighbouring documents: their postings
(document, term, occurrences), and for each block and term the highest share of
a score that any of its documents can give. A query's bound of a block is the
sum of these maxima by the weights of its terms. The blocks of a query are
scored in the order of their bounds, in rounds of growing size; they end when
the next bound is below the k-th best score, so nothing that is left can enter
the result. Bounds are whole numbers like scores, so an equal bound is still
scored and ties by doc_id come out right.
"""

from __future__ import annotations

from itertools import chain, count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import arrow_map, materialize

#: Documents of a block, blocks of a query that the first round scores, and by how much rounds grow.
BLOCK, FIRST, GROWTH = 64, 4, 4
#: Distinct terms of the queries up to which the index holds only these (more: every term), and rows up to which a table is sent to all tasks (more: joined).
TERMS, SENT = 200_000, 500_000
#: Texts that a task reads at once.
ROWS = 500

_LETTERS = bytes(x if chr(x).isalnum() or x > 127 else 32 for x in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """ASCII letters and digits, and all other characters from U+0080 on, make terms; only A-Z are lower-cased."""
    return text.translate(_LETTERS).split()


def forward_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: frozenset[bytes] | None = None, block: int = BLOCK) -> DataFrame:
    """(block, doc, doc_id, n, terms, tfs): one row per document that has a term; n counts all of its terms, ``only`` restricts those that are listed.

    Blocks are ranges of neighbouring documents of a partition; doc numbers the documents of a block.
    """

    def run(batches):
        at, places = TaskContext.get().partitionId() << 32, count()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                blocks, docs_, ids, sizes, listed, tfs, ends = [], [], [], [], [], [], [0]
                for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    found = terms_of(text or b"")
                    if not found:
                        continue
                    tally = {}
                    for term in found if only is None else filter(only.__contains__, found):
                        tally[term] = tally.get(term, 0) + 1
                    place = next(places)
                    blocks.append(at + place // block), docs_.append(place % block), ids.append(row), sizes.append(len(found))
                    listed.append(tally.keys()), tfs.append(tally.values()), ends.append(ends[-1] + len(tally))
                offsets = pa.array(ends, pa.int32())
                terms = pa.array(list(chain.from_iterable(listed)), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blocks, pa.int64()),
                        pa.array(docs_, pa.int32()),
                        batch.column(0).take(pa.array(ids, pa.int64())),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(offsets, terms),
                        pa.ListArray.from_arrays(offsets, pa.array(list(chain.from_iterable(tfs)), pa.int64())),
                    ],
                    ["block", "doc", "doc_id", "n", "terms", "tfs"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"block long, doc int, doc_id {id_type}, n long, terms array<string>, tfs array<long>")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms_of(x or b""))) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            ids = pa.array([row for row, terms in enumerate(found) for _ in terms], pa.int64())
            terms = pa.array(list(chain.from_iterable(found)), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), terms], ["item_id", "term"])

    id_type = items.schema[id_col].dataType.simpleString()
    return arrow_map(items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")), run, f"item_id {id_type}, term string").distinct()


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK, sent: int = SENT) -> DataFrame:
    """(item_id, rank int, doc_id, score long): each item's ``k`` documents of the highest score above 0, equal scores by ascending doc_id.

    A term's weight is floor(1000 ln((2N + 2) / (2df + 1))); a document of n
    terms has m = 100 - 90 + (90 n N) div L and gives a term
    (1000000000 tf) div (1000 tf + 8 m) times its weight.

    Null texts are empty; a document without terms is not counted and a text
    of any length is taken whole. Each row of ``docs`` is a document of its own, so
    repeated rows have ranks of their own; null ids come first among equal
    scores. Items of one id are one item with the terms of all; an item without
    terms, or none that any document has, has no row. Empty tables give an
    empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = materialize(item_terms(items, item_col, item_text_col), "item-terms")
    wanted = asked.select("term").distinct().limit(TERMS + 1).collect()
    only = frozenset(x.term.encode() for x in wanted) if len(wanted) <= TERMS else None
    index = materialize(forward_index(docs, id_col, text_col, only, block), "forward-index")
    size = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()

    share = F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * (10L + (90L * n * {size.docs}L) div {max(size.terms, 1)}L))")
    postings = index.select("block", "doc", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    postings = postings.select("block", "doc", "doc_id", F.col("x.terms").alias("term"), "n", F.col("x.tfs").alias("tf")).withColumn("share", share)
    spread = materialize(postings.groupBy("block", "term").agg(F.max("share").alias("most"), F.count("*").alias("df")), "block-maxima")
    weight = F.floor(1000 * F.ln(F.lit(2.0 * size.docs + 2) / (2.0 * F.col("df") + 1)))
    weighted = asked.join(spread.groupBy("term").agg(F.sum("df").alias("df")), "term").select("item_id", "term", weight.alias("w"))
    queries = materialize(weighted.where("w > 0"), "weighted-terms")
    queries_sent = F.broadcast(queries) if queries.count() <= sent else queries

    bound = spread.join(queries_sent, "term").groupBy("item_id", "block").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))
    bounds = materialize(bound.where("bound > 0"), "block-bounds")
    best_first = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "block", "doc")
    highest_bound = Window.partitionBy("item_id").orderBy(F.desc("bound"), "block")

    best, left, take = None, bounds, FIRST
    while True:
        if best is not None:
            # what the k-th best score still lets in, beyond the blocks that were scored
            state = best.groupBy("item_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")).join(done, "item_id", "full")
            state = materialize(state, "state")
            same = bounds.item_id.eqNullSafe(state.item_id)
            open_ = (F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))) & ((F.col("bound") < F.col("last.bound")) | ((F.col("bound") == F.col("last.bound")) & (F.col("block") > F.col("last.block"))))
            left = bounds.join(F.broadcast(state) if state.count() <= sent else state, same).where(open_).select(bounds["*"])
        todo = materialize(left.withColumn("place", F.row_number().over(highest_bound)).where(F.col("place") <= take), "round")
        if todo.isEmpty():
            break
        done = todo.groupBy("item_id").agg(F.max_by(F.struct("bound", "block"), "place").alias("last"))
        terms = todo.select(F.col("item_id").alias("id"), "block").join(queries_sent, F.col("id").eqNullSafe(F.col("item_id"))).select("item_id", "block", "term", "w")
        terms = materialize(terms, "round-terms")
        scored = postings.join(F.broadcast(terms) if terms.count() <= sent else terms, ["block", "term"])
        scored = scored.groupBy("item_id", "block", "doc").agg(F.sum(F.col("w") * F.col("share")).alias("score"), F.first("doc_id").alias("doc_id"))
        scored = scored.where("score > 0")
        best = materialize((scored if best is None else scored.unionByName(best)).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).drop("rank"), "best")
        take *= GROWTH
    if best is None:
        best = spark.createDataFrame([], f"item_id {items.schema[item_col].dataType.simpleString()}, block long, doc int, score long, doc_id {docs.schema[id_col].dataType.simpleString()}")
    return best.withColumn("rank", F.row_number().over(best_first)).select("item_id", "rank", "doc_id", "score")
