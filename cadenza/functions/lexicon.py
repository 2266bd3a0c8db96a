"""Words to phones: lexicons with priorities, IPA, target words with their places."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..storage import stored
from .scalars import phone


def lexicon_frame(spark: SparkSession, words: Mapping[str, Sequence[Sequence[str]]], source: str, rank: int) -> DataFrame:
    """FN-14: word, variants, source, rank of a lexicon; phones are normalised, repeated variants dropped."""
    rows = [(w.upper(), [list(v) for v in variants], source, rank) for w, variants in words.items()]
    df = spark.createDataFrame(rows, "word string, variants array<array<string>>, source string, rank int")
    clean = F.transform("variants", lambda v: F.filter(F.transform(v, lambda p: phone(p)), lambda p: p != ""))
    return df.withColumn("variants", F.array_distinct(F.filter(clean, lambda v: F.size(v) > 0)))


def pronounce(words: DataFrame, lexicons: Sequence[DataFrame], word: str = "word") -> DataFrame:
    """FN-13, SE-05: the first variant of the lexicon of least rank that knows the word; <UNK> and failed where none does."""
    every = lexicons[0]
    for other in lexicons[1:]:
        every = every.unionByName(other)
    best = every.where(F.size("variants") > 0).groupBy("word").agg(F.min_by(F.struct("variants", "source"), "rank").alias("_x"))
    joined = words.join(best.withColumnRenamed("word", "_w"), F.upper(F.col(word)) == F.col("_w"), "left").drop("_w")
    return joined.select(
        *words.columns, F.coalesce(F.col("_x.variants")[0], F.array(F.lit("<UNK>"))).alias("phones"), F.coalesce("_x.variants", F.array().cast("array<array<string>>")).alias("pronunciations"),
        F.coalesce("_x.source", F.lit("failed")).alias("lexicon_status"),
    )


def phone_rows(words: DataFrame) -> DataFrame:
    """DM-05: a row per phone of pronounced words."""
    others = [c for c in words.columns if c not in ("phones", "pronunciations")]
    return words.select(*others, F.posexplode("phones").alias("phone_index", "target_phone"))


def target_words(texts: DataFrame, key: str, text: str) -> DataFrame:
    """FN-09: the words of each text with index and character span, end exclusive."""
    pattern = r"[A-Za-z]+(?:['’][A-Za-z]+)*"
    value = F.coalesce(F.col(text), F.lit(""))
    # the parts before each word and the words together give the spans by running length
    found = F.regexp_extract_all(value, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(value, pattern)

    def place(word: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda s, g: s + F.length(g)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda s, w: s + F.length(w))
        return F.struct(
            i.alias("word_index"), F.upper(word).alias("word"), F.translate(F.upper(word), "’", "'").alias("normalized_word"), word.alias("original_word"),
            before.alias("char_start"), (before + F.length(word)).alias("char_end"),
        )

    return texts.select(key, F.inline(F.transform(found, place)))


def ipa_to_arpabet(ipa: Column, table: Mapping[str, str]) -> Column:
    """FN-11: greedy longest symbols first; empty where a symbol is unknown. Stress and length marks are ignored."""
    clean = F.regexp_replace(ipa, "[ˈˌː.\\s]", "")
    symbols = sorted(table, key=lambda s: (-len(s), s))
    pattern = "|".join(f"\\Q{s}\\E" for s in symbols)
    found = F.regexp_extract_all(clean, F.lit(f"({pattern})"), F.lit(1))
    whole = F.array_join(found, "") == clean
    pairs = [F.lit(x) for s in symbols for x in (s, table[s])]
    return F.when(whole, F.transform(found, lambda s: F.element_at(F.create_map(*pairs), s))).otherwise(F.array().cast("array<string>"))


def vocabulary(values: DataFrame, column: str, special: Sequence[str] = ("<pad>", "<unk>")) -> DataFrame:
    """FN-37, FN-38: token and id (int) of the distinct values in order, after the special tokens; nulls are no tokens.

    Tokens are ordered by ranges: an id is the place in the range and the tokens of the ranges before it, so neither the driver nor a task orders all of them.
    """
    spark = values.sparkSession
    own = values.select(F.col(column).cast("string").alias("token")).where(F.col("token").isNotNull() & ~F.col("token").isin(*special)).distinct()
    ranged = stored(own.repartitionByRange("token").withColumn("_part", F.spark_partition_id()), "vocabulary")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    placed = ranged.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("token")) - 1 + F.col("_before") + len(special)
    first = spark.createDataFrame([(t, i) for i, t in enumerate(special)], "token string, id int")
    return first.unionByName(placed.select("token", rank.cast("int").alias("id")))


def token_ids(tokens: Column, ids: Mapping[str, int]) -> Column:
    """FN-39: the ids of an array of tokens; empty if one is missing."""
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    found = F.transform(tokens, lambda t: F.try_element_at(table, t))
    return F.when(F.exists(found, lambda x: x.isNull()), F.array().cast("array<int>")).otherwise(found)


def token_spans(words: DataFrame, keys: Sequence[str], index: str, word: str, vocabulary: Mapping[str, int], unknown: int, delimiter: bool = True) -> DataFrame:
    """SQ-20: adds token_ids, token_start and token_end of each word in the tokens of its utterance, end exclusive.

    A word is cut from the left into the longest tokens of the vocabulary (one of a model); a character that begins none is one unknown token. Between words
    stands a delimiter, which belongs to the word before it. A word without characters, a null one too, has an empty span and no delimiter.
    """
    known = "|".join(f"\\Q{t}\\E" for t in sorted((t for t in vocabulary if t), key=lambda t: (-len(t), t)))
    pattern = f"(?s)({known}|.)" if known else "(?s)(.)"
    table = F.create_map(*[F.lit(x) for t, i in vocabulary.items() if t for x in (t, i)]) if known else F.create_map().cast("map<string,int>")
    tokens = F.regexp_extract_all(F.coalesce(F.col(word), F.lit("")), F.lit(pattern), F.lit(1))
    rows = words.withColumn("token_ids", F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(unknown))))
    n, whole = F.size("token_ids"), Window.partitionBy(*keys)
    last = F.max(F.when(n > 0, F.col(index))).over(whole)
    width = n + (F.lit(delimiter) & (n > 0) & (F.col(index) < last)).cast("int")
    before = F.coalesce(F.sum("_width").over(whole.orderBy(index).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_width", F.coalesce(width, n)).withColumn("token_start", before.cast("int"))
    return placed.withColumn("token_end", F.col("token_start") + F.col("_width")).drop("_width")
