"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles, each a 64-bit hash; equal
sets are one class. All sets are ordered alike: shingles that repeat among
neighbouring documents come last, the others by their hashes. Two sets of
similarity t share one of their first n - ceil(t n) + 1 shingles (their
prefixes), and the sizes and the places of the first shared shingle bound what
they can share. Classes of one size and prefix are one group; groups that meet
in a shingle are filtered as groups, their members by bitmaps of their shingles,
which bound what two sets share, and what is left is verified on texts.

Only what holds components together is verified. First every group is
compared with one pivot, the group that stands first where they meet (the one
with the fewest shingles of its own, which near copies have in common); then
all pairs that pass the filters and don't stand in one component yet. The groups
of a very common shingle are dealt out in tiles of bounded size, so no task
holds all of them.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .scratch import arrow_map, materialize

SHINGLE, PERCENT = 4, 85
#: Hashes among which repeats are counted at once, repeats from which a shingle goes to the end, and how many such shingles are sent (the order changes no result).
WINDOW, REPEATS, FREQUENT = 1 << 20, 8, 500_000
#: Groups of a tile's side, and rows up to which a table is sent to all tasks (more: joined).
TILE, SENT = 2000, 1_000_000
#: Texts that a task reads at once, words whose hashes it keeps, and flags by which it knows shingles that go to the end.
ROWS, WORDS, FLAGS = 500, 1 << 20, 1 << 22
#: Rows of a tile up to which many tiles are compared at once.
SMALL = 64
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = _WordHashes()


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of all its words if they are fewer than ``width``, none without words."""
    words = text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0d separate
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    found = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        found = (found + hashes[k : k + len(found)]) * _MIX[0]
        found ^= found >> np.uint64(29)
    found = (found ^ (found >> np.uint64(30))) * _MIX[1]
    found = (found ^ (found >> np.uint64(27))) * _MIX[2]
    return np.unique(found ^ (found >> np.uint64(31)))


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def bitmap(found: np.ndarray) -> bytes:
    """A bit for each shingle by its low bits, four to eight times as many bits as shingles."""
    bits = np.zeros(max(64, 1 << (4 * len(found)).bit_length()), bool)
    bits[(found & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def can_be_similar(a: bytes, n_a: int, b: bytes, n_b: int, percent: int = PERCENT) -> bool:
    """False only if sets of these bitmaps and sizes can't be similar: a bit that one lacks is a shingle that it lacks."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    both = min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
    return both > 0 and 100 * both >= percent * (n_a + n_b - both)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(a) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def sets_of(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE) -> DataFrame:
    """Two kinds of rows: (doc_id, n, key, th, bytes) per document, and (token, repeats) for shingles that repeat among the distinct sets of a window."""

    def run(batches):
        held, size, seen = [], 0, set()

        def repeated():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            tokens, counts = tokens[counts > 1].view(np.int64), counts[counts > 1]
            none = pa.nulls(len(tokens))
            arrays = [none.cast(t) for t in types] + [pa.array(tokens), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names)

        names, types = ["doc_id", "th", "bytes", "n", "key", "token", "repeats"], []
        for whole in batches:
            types = [*whole.schema.types[:1], pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                sizes, keys = [], []
                for text in batch.column(3).cast(pa.binary()).to_pylist():
                    found = shingles(text or b"", width)
                    key = set_key(found)
                    sizes.append(len(found)), keys.append(key)
                    if len(found) and key not in seen:
                        seen.add(key), held.append(found)
                        size += len(found)
                    if size >= WINDOW:
                        yield repeated()
                        held, size, seen = [], 0, set()
                none = pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), none, none], names)
        if held:
            yield repeated()

    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), *_address(text_col), F.col(text_col).alias("text"))
    return arrow_map(own, run, f"doc_id {id_type}, th long, bytes int, n long, key binary, token long, repeats long")


def _address(text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("th"), F.octet_length(text).alias("bytes")]


def prefixes(docs: DataFrame, text_col: str, tokens: np.ndarray, repeats: np.ndarray, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n, bits, prefix): a row per document with words; ``tokens`` (sorted, uint64) go to the end, by their ``repeats``."""
    low = np.uint64(FLAGS - 1)

    def run(batches):
        flags = np.zeros(FLAGS, bool)  # most shingles are seen not to be among the tokens here
        flags[(tokens & low).astype(np.int64)] = True
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                keys, sizes, bits, listed = [], [], [], []
                for text in whole.slice(start, ROWS).column(0).cast(pa.binary()).to_pylist():
                    found = shingles(text or b"", width)
                    if not len(found):
                        continue
                    length = prefix_length(len(found), percent)
                    if len(tokens):
                        perhaps = np.flatnonzero(flags[(found & low).astype(np.int64)])
                        at = np.minimum(np.searchsorted(tokens, found[perhaps]), len(tokens) - 1)
                        there = tokens[at] == found[perhaps]
                        late = np.zeros(len(found), bool)
                        late[perhaps[there]] = True
                        first = found[~late][:length]
                        if len(first) < length:
                            last = found[late]
                            order = np.lexsort((last, repeats[at[there]]))
                            first = np.concatenate((first, last[order[: length - len(first)]]))
                    else:
                        first = found[:length]
                    keys.append(set_key(found)), sizes.append(len(found)), bits.append(bitmap(found)), listed.append(first)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in listed]))).astype(np.int32)
                flat = np.concatenate(listed).view(np.int64) if listed else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "n", "bits", "prefix"])

    return arrow_map(docs.select(F.col(text_col).alias("text")), run, "key binary, n long, bits binary, prefix array<long>")


def _within(n: Column, pos: Column, other_n: Column, other_pos: Column, percent: int) -> Column:
    """Sizes and places that similar sets can have, if this is the first shingle that they share."""
    sizes = 100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)
    return sizes & ((100 + percent) * F.least(n - pos, other_n - other_pos) >= percent * (n + other_n))


def possible(pairs: DataFrame, bits: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes that their bitmaps (key, n, bits) don't rule out."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array([can_be_similar(*row, percent) for row in rows], pa.bool_()))

    with_b = pairs.join(bits.select(F.col("key").alias("b"), F.col("bits").alias("bits_b"), F.col("n").alias("n_b")), "b")
    both = with_b.join(bits.select(F.col("key").alias("a"), F.col("bits").alias("bits_a"), F.col("n").alias("n_a")), "a")
    return arrow_map(both.select("a", "b", "bits_a", "n_a", "bits_b", "n_b"), run, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes whose texts are similar."""

    def run(batches):
        last, known = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k in range(batch.num_rows):
                if a[k] != last:
                    last, known = a[k], shingles(batch.column(2)[k].as_py().encode(), width)
                keep.append(similar(known, shingles(batch.column(3)[k].as_py().encode(), width), percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return arrow_map(both.select("a", "b", "text_a", "text_b"), run, "a binary, b binary")


def _tile_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): groups of different components that meet in a tile and pass the filters; ``rows`` has token, i, j, side, gid, n, pos, part."""
    placed = rows.select("token", "i", "j", "side", "gid", "n", "pos", "part")
    placed = placed.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def solve(tile):
        i, j, side, gid, n, pos, part = tile
        inner = i[0] == j[0]
        left = np.flatnonzero(side == 0)
        right = left if inner else np.flatnonzero(side == 1)
        found_a, found_b = [], []
        step = max(1, 2_000_000 // max(1, len(right)))
        for at in range(0, len(left), step):
            x = left[at : at + step]
            nx, ny = n[x][:, None], n[right][None, :]
            near = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
            near &= (100 + percent) * np.minimum(nx - pos[x][:, None], ny - pos[right][None, :]) >= percent * (nx + ny)
            near &= part[x][:, None] != part[right][None, :]
            p, q = np.nonzero(near)
            a, b = gid[x[p]], gid[right[q]]
            found_a.append(np.minimum(a, b)), found_b.append(np.maximum(a, b))
        if not found_a:
            return np.zeros((0, 2), np.int64)
        return np.unique(np.column_stack((np.concatenate(found_a), np.concatenate(found_b))), axis=0)

    def small(tiles, sizes):
        """All pairs of many small tiles: every row with the row so many places further on, as long as they stand in one tile."""
        _, i, j, side, gid, n, pos, part = tiles
        number = np.repeat(np.arange(len(sizes)), sizes)
        found = []
        for step in range(1, int(sizes.max())):
            x = np.flatnonzero(number[step:] == number[:-step])
            y = x + step
            near = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            near &= (100 + percent) * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= percent * (n[x] + n[y])
            near &= (part[x] != part[y]) & ((i[x] == j[x]) | (side[x] != side[y]))
            a, b = gid[x[near]], gid[y[near]]
            found.append(np.column_stack((np.minimum(a, b), np.maximum(a, b))))
        return np.unique(np.concatenate(found), axis=0)

    def run(batches):
        held = [np.zeros(0, np.int64) for _ in range(8)]
        for batch in batches:
            held = [np.concatenate((x, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64))) for k, x in enumerate(held)]
            yield from cut(held, False)
            held = [x[held_from[0] :] for x in held]
        if len(held[0]):
            yield from cut(held, True)

    held_from = [0]

    def cut(held, whole):
        token, i, j = held[:3]
        starts = np.concatenate(([0], np.flatnonzero((np.diff(token) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1))
        stops = np.concatenate((starts[1:], [len(token)]))
        done = len(starts) if whole else len(starts) - 1  # the last tile may go on in the next batch
        held_from[0] = 0 if whole or not len(starts) else int(starts[-1])
        sizes = (stops - starts)[:done]
        found = [solve([x[starts[k] : stops[k]] for x in held[1:]]) for k in np.flatnonzero(sizes > SMALL).tolist()]
        few = (sizes > 1) & (sizes <= SMALL)
        if few.any():
            kept = np.repeat(few, sizes)
            found.append(small([x[: len(kept)][kept] for x in held], sizes[few]))
        if found:
            ab = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    return arrow_map(placed, run, "a long, b long").distinct()


def _tiles(met: DataFrame, part: DataFrame, tile: int) -> DataFrame:
    """Rows of the shingles whose groups stand in several components, dealt to pairs of blocks; blocks of a shingle's largest component don't meet each other."""
    rows = met.join(part, "gid")
    by_part = materialize(rows.groupBy("token", "part").agg(F.count("*").alias("m")), "parts")
    tokens = by_part.groupBy("token").agg(F.sum("m").alias("all"), F.max(F.struct("m", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    tokens = materialize(tokens.select("token", F.col("main.part").alias("main"), F.ceil(F.col("main.m") / tile).alias("mains"), F.ceil((F.col("all") - F.col("main.m")) / tile).alias("others")), "tokens")
    rows = rows.join(tokens, "token")
    salt = F.when(F.col("part") == F.col("main"), F.pmod(F.xxhash64("gid"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("gid"), "others"))
    rows = rows.withColumn("own", salt)
    # a block of the largest component meets all others; another block meets every block, itself once
    first = F.when(F.col("part") == F.col("main"), F.col("mains")).otherwise(F.lit(0))
    rows = rows.withColumn("other", F.explode(F.sequence(first, F.col("mains") + F.col("others") - 1)))
    return rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "gid", "n", "pos", "part")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, tile: int = TILE, sent: int = SENT) -> DataFrame:
    """(doc_id, n_shingles long, component_id): a row per row of ``docs``.

    component_id is the least doc_id that links reach, the document's own
    included; documents link when 100 * common shingles >= ``percent`` * shingles of
    both. A text without words, null ones too, has no shingle and no link: its
    component is its own id. Fewer than ``width`` words are one shingle. Equal
    sets are linked, repeated rows too; a component whose ids are all null has a
    null id; texts of any length are taken whole; an empty table gives an empty
    table. Other columns are ignored. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    both = materialize(sets_of(docs, id_col, text_col, width), "shingle-sets")
    frequent = both.where("token is not null").groupBy("token").agg(F.sum("repeats").alias("repeats")).where(F.col("repeats") >= REPEATS)
    late = frequent.orderBy(F.desc("repeats"), "token").limit(FREQUENT).toArrow()
    tokens, repeats = late.column(0).to_numpy().view(np.uint64), late.column(1).to_numpy()
    order = np.argsort(tokens)
    marked = both.where("key is not null")
    classes = materialize(marked.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.min(F.struct("th", "bytes")).alias("at")), "classes")

    firsts = prefixes(docs, text_col, tokens[order], repeats[order], width, percent).withColumn("gid", F.xxhash64("n", "prefix"))
    # copies bring the same row, so it doesn't matter which one stays
    members = materialize(firsts.groupBy("key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("gid").alias("gid"), F.first("bits").alias("bits")), "prefixes")
    groups = members.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    places = groups.select(F.posexplode("prefix").alias("pos", "token"), "gid", "n")
    shared = materialize(places.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1").select("token"), "shared")
    met = materialize(places.join(F.broadcast(shared) if shared.count() <= sent else shared, "token"), "met")
    sized = members.groupBy("gid").agg(F.min("key").alias("rep"), F.count("*").alias("m"))
    reps = materialize(sized.join(met.select("gid").distinct().withColumn("meets", F.lit(True)), "gid", "left").where("meets or m > 1"), "groups")
    placed = materialize(members.select("gid", "key", "n", "bits").join(reps.select("gid"), "gid"), "members")
    own, bits = placed.select("gid", "key"), placed.select("key", "n", "bits")
    wanted = own.join(classes, "key").select("key", "at.th", "at.bytes").dropDuplicates(["th", "bytes"])
    wanted = materialize(wanted, "wanted")
    texts = docs.where(F.col(text_col).isNotNull()).select(*_address(text_col), F.col(text_col).alias("text")).join(F.broadcast(wanted) if wanted.count() <= sent else wanted, ["th", "bytes"])
    texts = materialize(texts.groupBy("key").agg(F.first("text").alias("text")), "texts")

    pivots = materialize(met.groupBy("token").agg(F.min(F.struct("pos", "n", "gid")).alias("p")), "pivots")
    stars = met.join(pivots, "token").where((F.col("gid") != F.col("p.gid")) & _within(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), percent))
    stars = stars.groupBy("gid", F.col("p.gid").alias("pivot")).agg(F.count("*").alias("tokens"))
    stars = stars.groupBy("gid").agg(F.max_by("pivot", F.struct("tokens", "pivot")).alias("pivot"))
    named = stars.join(reps.select("gid", F.col("rep").alias("b")), "gid").join(reps.select(F.col("gid").alias("pivot"), F.col("rep").alias("a")), "pivot").select("a", "b")
    inside = own.join(reps.select("gid", F.col("rep").alias("a")), "gid").select("a", F.col("key").alias("b")).where("a <> b")
    near = materialize(possible(named.unionByName(inside), bits, percent), "pairs")
    links = materialize(verified(near, texts, width, percent), "links")

    roots = materialize(connected_components(links), "roots")
    parts = own.join(roots.withColumnRenamed("node", "key"), "key", "left").select("gid", "key", F.coalesce("root", "key").alias("part"))
    parts = materialize(parts, "parts-of-members")
    whole = parts.groupBy("gid").agg(F.min("part").alias("least"), F.max("part").alias("most"))
    # a group in several components differs from every other group
    part = F.when(F.col("least") == F.col("most"), F.xxhash64("least")).otherwise(F.xxhash64("gid", F.lit("several")))
    by_group = materialize(whole.select("gid", part.alias("part"), (F.col("least") != F.col("most")).alias("several")), "parts-of-groups")
    group_pairs = _tile_pairs(_tiles(met, by_group.select("gid", "part"), tile), percent)
    group_pairs = group_pairs.unionByName(by_group.where("several").select(F.col("gid").alias("a"), F.col("gid").alias("b")))
    group_pairs = materialize(group_pairs, "group-pairs")
    left = parts.select(F.col("gid").alias("a"), F.col("key").alias("ka"), F.col("part").alias("pa"))
    right = parts.select(F.col("gid").alias("b"), F.col("key").alias("kb"), F.col("part").alias("pb"))
    pairs = group_pairs.join(left, "a").join(right, "b").where("pa <> pb and (a <> b or ka < kb)").select(F.col("ka").alias("a"), F.col("kb").alias("b")).distinct()
    more = materialize(verified(materialize(possible(pairs, bits, percent), "pairs"), texts, width, percent), "links")

    roots = connected_components(links.unionByName(more))
    linked = materialize(classes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root")), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = materialize(linked.join(least, "root").select("key", "component_id"), "components-of-classes")
    found = marked.where("n > 0").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(marked.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
