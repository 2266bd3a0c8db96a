"""Document fingerprints by one-permutation MinHash.

The shingles of a text are hashed once. The upper bits of a hash choose one of
BINS bins, and each bin keeps its least hash. Empty bins are filled by optimal
densification: bin i asks bins in an order of its own, the same for all texts,
and copies the first that isn't empty. Each bin's hash is hashed once more with
the bin's number, so that copies of one hash don't agree or differ all
together, and the STORED low-order bits of that are packed into the fingerprint; two texts of likeness J agree in a bin with
probability J + (1 - J) / 2^STORED, and the estimate takes this back.

All of it is expressions on arrays: split, sort, filter; no row is exploded and
the fingerprint needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quality import BLANK, let

SHINGLE, BINS, STORED = 5, 256, 4
#: Bins that an empty bin asks by arithmetic before all are looked through.
ASKED = 12
#: Documents between two boundaries of the order, and the most boundaries.
BLOCK, MOST_BLOCKS = 2_000, 20_000

_SHIFT = 64 - BINS.bit_length() + 1  # the bin is the upper bits of a hash


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """The sorted xxHash64 of the shingles of ``size`` words; of all words if there are fewer; none without words."""

    def of(words: Column) -> Column:
        n = F.size(words)
        hashed = F.transform(words, lambda w: F.xxhash64(w))

        def windows(h: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[h[i + k] for k in range(size)]))

        return (
            F.when(n >= size, let(hashed, windows))
            .when(n > 0, F.array(F.xxhash64(F.array_join(words, " "))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return F.sort_array(let(F.filter(F.split(F.lower(text), BLANK), lambda w: w != ""), of))


def bins(hashes: Column) -> Column:
    """Array of BINS values, each bin's least hash; null where a bin is empty."""
    nothing = F.lit(None).cast("long")

    def of(x: Column) -> Column:
        """The bin of a hash; grows with the hash."""
        return F.shiftright(x, _SHIFT).cast("int") + BINS // 2

    def first_of_bins(h: Column) -> Column:
        return F.filter(h, lambda x, i: F.when(i == 0, True).otherwise(of(x) != of(h[i - 1])))

    def spread(least: Column) -> Column:
        gaps = F.transform(
            least,
            lambda x, i: F.concat(
                F.array_repeat(nothing, of(x) - F.when(i == 0, -1).otherwise(of(least[i - 1])) - 1), F.array(x)
            ),
        )
        tail = F.array_repeat(nothing, F.when(F.size(least) == 0, BINS).otherwise(BINS - 1 - of(least[F.size(least) - 1])))
        return F.concat(F.flatten(gaps), tail)

    return let(let(hashes, first_of_bins), spread)


def densified(sparse: Column) -> Column:
    """Each empty bin filled from the first bin of its own order that isn't empty; all null without shingles."""
    numbers = F.sequence(F.lit(0), F.lit(BINS - 1))

    def asked(s: Column, i: Column) -> list[Column]:
        return [s[F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")] for k in range(ASKED)]

    def any_bin(s: Column, i: Column) -> Column:
        start = F.pmod(F.xxhash64(i, F.lit(ASKED)), F.lit(BINS)).cast("int")
        turned = F.concat(F.slice(s, start + 1, BINS), F.slice(s, 1, start))
        return F.filter(turned, lambda x: x.isNotNull())[0]

    def fill(s: Column) -> Column:
        some = F.exists(s, lambda x: x.isNotNull())
        return F.when(~F.exists(s, lambda x: x.isNull()), s).when(
            some, F.transform(numbers, lambda i: F.coalesce(s[i], *asked(s, i), any_bin(s, i)))
        )

    return let(sparse, fill)


def fingerprint_bins(text: Column) -> Column:
    """Array of BINS numbers below 2^STORED; null for a text without words."""
    low = F.lit((1 << STORED) - 1)
    return F.transform(densified(bins(shingle_hashes(text))), lambda x, i: F.xxhash64(x, i).bitwiseAND(low).cast("int"))


def packed(values: Column) -> Column:
    """Hexadecimal digits, one a bin (STORED is 4); empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(values, lambda v: F.substring(F.lit("0123456789abcdef"), v + 1, F.lit(1))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, 0 to 1; two texts without words are alike, one with and one without are not."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("double") / BINS
    chance = 1.0 / (1 << STORED)
    estimate = F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(estimate)


def in_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, doc_id, text, block, ghost): rows in blocks of neighbouring ids, each block with a copy of its successor's first.

    The order is by descending id, null ids last, equal ids by text. The
    boundaries are ids of the table (percentiles), so the first document of each block is
    known beforehand and joins the block before it as a ghost; the very first
    joins the last block. Windows over a block then see every next document.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.count()
    blocks = max(1, min(MOST_BLOCKS, -(-n // BLOCK)))
    found = rows.agg(F.percentile_approx("k", [(i + 1) / blocks for i in range(blocks)], 20 * blocks).alias("at")).first()["at"] if n else None
    bounds = sorted(set(found or [0]))  # the highest id of each block, ascending
    listed = F.array(*[F.lit(b) for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    size = len(bounds)

    def block(bound: Column, k: Column) -> Column:
        """How many boundaries lie below k: a binary search."""
        return F.aggregate(
            F.array(*[F.lit(s) for s in steps]), F.lit(0),
            lambda low, s: F.when((low + s <= size) & (F.get(bound, low + s - 1) < k), low + s).otherwise(low),
        )

    placed = rows.withColumn("b", block(listed, F.col("k")))
    first = F.get(listed, F.col("b")) == F.col("k")
    plain, ghost = F.struct(F.col("b").alias("block"), F.lit(0).alias("ghost")), F.struct(((F.col("b") + 1) % size).alias("block"), F.lit(1).alias("ghost"))
    return placed.select("k", "doc_id", "text", F.inline(F.when(first, F.array(plain, ghost)).otherwise(F.array(plain))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many of the next document's. A null text is empty, a text of any
    length is taken whole; repeated rows have a row each; equal ids are ordered by text; null ids come last; an empty table gives an empty table;
    other columns are ignored.
    """
    # blocks stand in descending order of ids: ghosts (first of the block below) come last
    order = Window.partitionBy("block").orderBy("ghost", F.desc("k"), "text")
    rows = in_blocks(docs, id_col, text_col)
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - half)
    edited = F.concat(kept, F.substring(F.coalesce("next_text", "text"), F.lit(1), half))
    rows = rows.select("block", "ghost", "k", "doc_id", "text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select(
        "block", "ghost", "k", "doc_id", "n_chars", F.xxhash64("text").alias("tie"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_bins(F.col("text")).alias("f"), F.when(F.col("ghost") == 0, fingerprint_bins(F.col("edited"))).alias("e"), F.col("text"),
    )
    rows = rows.withColumn("next_f", F.lead(F.struct("f")).over(order))
    return rows.where("ghost = 0").select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("f")).alias("fingerprint"), packed(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next_f.f")).alias("near_next"),
    )
