"""How far the vocabularies of sources lie apart, by integer arithmetic.

Texts are split into terms and counted by language and source. Each language
keeps the terms of at least ``LEAST_DOCS`` of its documents; every source of
the language, and the language itself, gives each kept term a smoothed share
p = 1 + floor(SCALE * (count + 1) / (N + V)), counts of zero included. Shares
are compared by f = floor((p - q)^2 / q).

Only the counts that occur are shuffled: a term's row, which holds its counts
by source, meets the sources of its language after the shuffle by language and
term, and both sides of the self-join stand on that one shuffle. A row grows
with the sources of a language, whose square is the size of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import materialize

SCALE, LEAST_DOCS, TERM_RANKS = 1_000_000_000, 3, 200
#: Rows of sources that are sent to all tasks; more are joined.
SENT = 100_000
#: What separates terms: the ASCII characters that are no letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term."""
    words = docs.select(
        F.coalesce(lang_col, F.lit("")).alias("lang"),
        F.coalesce(source_col, F.lit("")).alias("source"),
        F.transform(F.split(F.coalesce(text_col, F.lit("")), BETWEEN), ascii_lower).alias("words"),
    )
    # each word counts as an occurrence, each distinct word as a document
    both = F.array(F.struct(F.col("words"), F.lit(1).alias("once")), F.struct(F.array_distinct("words").alias("words"), F.lit(0).alias("once")))
    rows = words.select("lang", "source", F.explode(both).alias("x")).select("lang", "source", F.explode("x.words").alias("term"), "x.once")
    return rows.where("term <> ''").groupBy("lang", "source", "term").agg(F.sum("once").alias("n"), F.sum(1 - F.col("once")).alias("docs"))


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + size)) in whole numbers; counts that a long can't scale are scaled as decimals."""
    whole = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")).cast("decimal(38,0)")
    long = F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), total + size)
    return 1 + F.when(count < 9_000_000_000, long).otherwise(F.call_function("div", whole, (total + size).cast("decimal(38,0)")))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value long, rank int).

    Part ``pair``: every other source of the language with the sum of f over all
    kept terms, q its share (0 in a language that keeps none). Part ``term``:
    the up to ``ranks`` kept terms that the source uses more than its language
    does, q the language's share. Ranks start at 1 in each source and part, by
    value downwards, then item upwards by UTF-8 bytes.

    Null texts, languages and sources are empty strings; a source without terms
    has pairs all the same; repeated rows are documents of their own; texts are
    taken whole; an empty table gives an empty table. Other columns are
    ignored. Sums fit a long up to 8 * 10^9 kept terms of a language; beyond that
    Spark's arithmetic raises an error.
    """
    counted = materialize(term_counts(docs, lang_col, source_col, text_col), "term-counts")
    by_source = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    found = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), by_source.alias("counts"))
    terms = materialize(found.where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")

    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = terms.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    occurring = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source")).distinct()
    sized = occurring.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    sources = materialize(sized.withColumnRenamed("n", "source_n"), "sources")
    sent = F.broadcast(sources) if sources.count() <= SENT else sources

    placed = terms.repartition("lang", "term")
    count = F.coalesce(F.col("counts")[F.col("source")], F.lit(0).cast("long"))
    dense = placed.join(sent, "lang").select("lang", "term", "source", share(count, F.col("source_n"), F.col("v")).alias("p"))
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    pairs = dense.join(other, ["lang", "term"]).where(F.col("source") != F.col("item"))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum(apart(F.col("p"), F.col("q"))).alias("value"))
    bare = sources.where("v = 0").select("lang", "source")
    zeros = bare.join(bare.withColumnRenamed("source", "item"), "lang").where(F.col("source") != F.col("item"))
    pairs = pairs.unionByName(zeros.select("lang", "source", "item", F.lit(0).cast("long").alias("value")))

    used = terms.select("lang", F.col("term").alias("item"), "total", F.explode("counts").alias("source", "n")).join(sent, ["lang", "source"])
    shares = used.select("lang", "source", "item", share(F.col("n"), F.col("source_n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))
    over = shares.where("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    top = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    return ranked.select(*columns).unionByName(top.select(*columns))
