"""Quality rules judged with the help of the host.

Each document is measured and held against rules. The failures are summed by
host (the source of a document); a host's failure rate is shrunk towards the
rate of all hosts with a beta prior whose strength is estimated from the spread
of the hosts' rates, so a host with few documents says little. A document that
fails its base rules goes. One that fails another rule goes unless its host's
shrunk rate is clearly below the corpus, and all documents of a host go whose
shrunk rate leaves hardly any good one.

Everything is DataFrame expressions. Repeated three-word windows are found by
sorting 64-bit numbers (the upper bits of a window's hash above, its position
below), or pairs where these bits don't tell all hashes apart, not by comparing windows. Only measures, no texts, pass through the two shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import materialize

BLANK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Base rules, and the shares above which the further rules fail.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
MOST_SYMBOLS, MOST_DUP_LINES, LEAST_DUP_LINES, MOST_CAPITALS, SHORT_WORD, LONG_WORD = 0.10, 0.30, 3, 0.50, 2.0, 14.0
#: Shrunk rates: at most this share of the corpus rate excuses a failed rule; at least this rate condemns a host.
GOOD_HOST, BAD_HOST = 0.5, 0.9
#: Bits of a position inside a sorted number; texts with more words, or with two hashes equal in the other bits, are compared by pairs of hash and position.
POSITION_BITS = 20


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words which occurs more than once, the first included.

    Windows are equal if their xxHash64 are (2^-64 a pair).
    """
    n = F.size(words)
    windows = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[words[i + k] for k in range(size)]))).otherwise(
        F.array().cast("array<bigint>")
    )

    low = (1 << POSITION_BITS) - 1

    def covered(hashes: Column) -> Column:
        packed = F.array_sort(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        return _covered(packed, lambda x: x.bitwiseAND(F.lit(low)).cast("int"), hashes, size)

    def covered_as_pairs(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _covered(pairs, lambda x: x["i"], hashes, size)

    def count(hashes: Column) -> Column:
        def by_distinct(distinct: Column) -> Column:
            # the upper bits of a hash and a position make one number, if no two hashes share these bits
            told_apart = F.size(F.array_distinct(F.transform(distinct, lambda h: h.bitwiseAND(F.lit(~low))))) == F.size(distinct)
            return F.when(F.size(distinct) == F.size(hashes), F.lit(0)).when((F.size(hashes) < (1 << POSITION_BITS)) & told_apart, covered(hashes)).otherwise(covered_as_pairs(hashes))

        return let(F.array_distinct(hashes), by_distinct)

    return let(windows, count)


def _covered(ordered: Column, position, hashes: Column, size: int) -> Column:
    """Length of the union of the windows whose neighbour in the order has the same hash."""

    def total(order: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return hashes[position(order[i])] == hashes[position(order[j])]

        last = F.size(order) - 1
        again = F.filter(order, lambda x, i: F.when(i > 0, same(i, i - 1)).otherwise(False) | F.when(i < last, same(i, i + 1)).otherwise(False))
        starts = F.array_sort(F.transform(again, position))
        return let(
            starts,
            lambda s: F.aggregate(
                F.sequence(F.lit(0), F.size(s) - 1), F.lit(0),
                lambda sum_, i: sum_ + F.when(i == F.size(s) - 1, size).otherwise(F.least(F.lit(size), s[i + 1] - s[i])),
            ),
        )

    return let(ordered, total)


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, capitals, letters of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.col("text")
    words = let(F.filter(F.split(text, BLANK), lambda w: w != ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(without(x, " \t\x0b\x0c\r")) > 0)
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return base.select(
        "doc_id", "host", words.alias("w"), F.length(without(text, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"), F.size(lines).cast("long").alias("n_lines"),
        (F.length(text) - F.length(without(text, upper))).cast("long").alias("n_capitals"),
    ).select("doc_id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"), "n_lines", "n_capitals")


def judged(measured: DataFrame) -> DataFrame:
    """Add base_failed, failed (of base and further rules) and the host's verdict: kept."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))
    rules = (
        (F.col("n_symbols") > MOST_SYMBOLS * chars)
        | (F.col("n_symbols") > 0.5 * n)
        | ((F.col("n_dup_lines") >= LEAST_DUP_LINES) & (F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines")))
        | (F.col("n_capitals") > MOST_CAPITALS * chars)
        | (chars < SHORT_WORD * n)
        | (chars > LONG_WORD * n)
    )
    marked = measured.withColumns({"base_failed": base, "rule_failed": rules})
    marked = marked.withColumn("failed", F.col("base_failed") | F.col("rule_failed"))
    hosts = marked.groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("bad"))
    # stored, so that the join's shuffle of a host with very many rows can be split
    verdicts = materialize(host_rates(hosts).select("host", "rate", "corpus_rate"), "hosts")
    return marked.join(verdicts, "host").withColumn(
        "kept",
        ~F.col("base_failed")
        & (F.col("rate") < BAD_HOST)
        & (~F.col("rule_failed") | (F.col("rate") < GOOD_HOST * F.col("corpus_rate"))),
    )


def host_rates(hosts: DataFrame) -> DataFrame:
    """Add corpus_rate and rate = (bad + a) / (n + a + b), the beta prior (a, b) by moments over the hosts.

    With k hosts, corpus rate m and spread v of the rates, weighted by documents,
    binomial noise explains m (1 - m) k / N of v; what is left belongs to the
    prior, whose strength a + b = m (1 - m) / left - 1 is kept between 1 and 10^6.
    """
    total = hosts.agg(F.sum("n").alias("N"), F.sum("bad").alias("B"), F.count("*").alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s"))
    m = F.col("B") / F.col("N")
    spread = F.col("s") / F.col("N") - m * m
    left = F.greatest(spread - m * (1 - m) * F.col("k") / F.col("N"), F.lit(0.0))
    strength = F.when(left > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / left - 1))).otherwise(F.lit(1e6))
    prior = total.select(m.alias("corpus_rate"), strength.alias("strength"))
    return hosts.join(F.broadcast(prior)).select(  # one row
        "host", "n", "bad", "corpus_rate", ((F.col("bad") + F.col("corpus_rate") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("rate")
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures and verdict of every row.

    A null text is empty and fails, a text of any length is measured whole; null
    ids are kept; a null host is the host ""; repeated rows count each; an empty table gives an empty table; other columns are ignored.
    """
    return judged(materialize(measures(docs, id_col, text_col, host_col), "measures"))
