"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the documents of the next stage. All but the last
return the columns of their input, of any names beside doc_id and text (n_chars
is counted again where it is there). Ids may be null or shared, texts null (empty) or
very long, rows repeated; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType

from cadenza.llm import packing, pii, queries, simhash, suffix_dedup, toxicity
from cadenza.llm.scratch import materialize

#: Bytes of a passage that repeats: one that over 50 words reach.
PASSAGE = suffix_dedup.PASSAGE


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names k0, k1 ... that clash with no operator's, and these names by the given ones."""
    names = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(found: DataFrame, names: dict[str, str], text: str | None = None) -> DataFrame:
    """The given names again; the text replaced by the column ``text``, and n_chars counted again."""
    changed = {"text": F.col(text), "n_chars": F.length(text).cast("long")} if text else {}
    return found.select(*[changed.get(c, F.col(k)).alias(c) for c, k in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models call toxic go; a text without words, null ones too, stays."""
    own, names = _numbered(docs)
    model = toxicity.train(own, queries.table(spark, sf_dir, "labels"), names["doc_id"], names["text"])
    return _named(toxicity.score(own, model, own.columns, names["text"]).where("score < 0.5"), names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of linked fingerprints: the least doc_id (null ids last), of equal ids the least hash of all columns.

    Texts without words are one group. Rows that are equal in all columns are interchangeable, one of them stays.
    """
    own, names = _numbered(docs)
    hashed = [names[f.name] for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    found = simhash.near_duplicates(own, names["doc_id"], names["text"], hashed=hashed)
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("x"))
    keep = materialize(least.select(F.col("x.doc_id").alias("keep_id"), F.col("x.th").alias("keep_hash")), "kept")
    marked = own.withColumn("th", F.xxhash64(*hashed))
    kept = marked.join(keep, F.col(names["doc_id"]).cast("long").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_hash")))
    return _named(kept.dropDuplicates(["keep_id", "keep_hash"]), names)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes that repeat go but for one copy; characters that a string's edge cuts go with it."""
    own, names = _numbered(docs)
    others = [k for c, k in names.items() if c != "text"]
    return _named(suffix_dedup.remove_repeats(own, others, names["text"], with_text=True, length=PASSAGE, keep=True), names, "kept_text")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    own, names = _numbered(docs)
    others = [k for c, k in names.items() if c != "text"]
    return _named(pii.personal_data(own, others, names["text"]), names, "redacted")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed; a row per piece."""
    return packing.pack(docs, queries.word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages call trained models and tokenizers, which SQL doesn't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
