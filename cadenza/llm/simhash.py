"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint has bit j set if more than half of the hashes of its
word shingles have it set. Two fingerprints are linked if they differ in at
most ``radius`` bits. The tables of the search are the covering masks: each bit
position i carries a vector m(i) of ``radius + 1`` bits, and the table of a
nonzero vector v keeps the positions with <m(i), v> = 1. The at most ``radius``
positions in which a linked pair differs give as many linear equations in
``radius + 1`` unknowns, so some nonzero v solves them all, and the pair agrees
on all bits that this table keeps: no link can be missed.

Equal fingerprints are merged before the search. Inside a bucket a breadth-first
search keeps one spanning tree of each linked group, so a bucket of n copies
gives n - 1 edges and not n * (n - 1) / 2. Very large buckets are divided by the
covering masks of a second map first, again without losing a link.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .scratch import arrow_map, materialize

BITS, SEED, SHINGLE, RADIUS = 64, 42, 4, 4
#: Shingles whose bits are counted at once, texts that are read at once, and fingerprints in a bucket that is searched undivided.
CHUNK, ROWS, LARGE_BUCKET = 1 << 15, 500, 20_000
#: The maps of the masks that divide large buckets, one after another; fingerprints that still stand together differ in a few bits only.
SHIFTS = (3, 5, 9)

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text; 0 if it has no word."""
    words = text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0d separate
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return _hash(joined)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    hashes = np.fromiter(map(_hash, map(joined.__getitem__, map(slice, starts, ends))), np.uint64, len(ends))
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << j for j in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: list[str] | None = None) -> DataFrame:
    """(doc_id, fp long, th long): the SimHash of each text, and a hash of it or of the columns ``hashed``. A null text is empty."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                fps = np.array([fingerprint(x or b"") for x in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], ["doc_id", "fp", "th"])

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(*[F.col(c) for c in hashed] if hashed else [F.coalesce(F.col(text_col), F.lit(""))]).alias("th"),
    )
    return arrow_map(source, run, "doc_id long, fp long, th long")


def covering_masks(radius: int, shift: int = 0) -> list[int]:
    """The 2^(radius+1) - 1 masks; ``shift`` chooses the map from positions to vectors."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + (i * 11 + shift * (i // 7) + shift) % size for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() % 2) for v in range(1, size + 1)]


def spanning_edges(values: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the distinct uint64 ``values`` linked within ``radius``."""
    rest, found = values, []
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            size = max(1, 2_000_000 // len(rest))
            block, frontier = frontier[:size], frontier[size:]
            near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                found.append((block[near.argmax(axis=0)[hit]], rest[hit]))
                frontier, rest = np.concatenate((frontier, rest[hit])), rest[~hit]
    return found


def bucket_edges(values: np.ndarray, radius: int, level: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that hold the linked groups of a bucket together; a large bucket is divided, and so are its parts, by the masks of another map."""
    if len(values) <= LARGE_BUCKET or level == len(SHIFTS):
        return spanning_edges(values, radius)
    found = []
    for mask in covering_masks(radius, SHIFTS[level]):
        keys = values & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        for part in np.split(values[order], np.flatnonzero(np.diff(keys[order])) + 1):
            if len(part) > 1:
                found += bucket_edges(part, radius, level + 1)
    return found


def covering_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges between distinct long fingerprints ``fp`` that hold every linked group together."""
    masks = covering_masks(radius)
    signed = [m - (1 << BITS) if m >> 63 else m for m in masks]
    table = F.array(*[F.lit(m) for m in signed])
    rows = fps.select("fp", F.posexplode(table).alias("t", "mask"))
    bucket = F.col("fp").bitwiseAND(F.col("mask"))
    rows = rows.repartition("t", bucket).sortWithinPartitions("t", bucket, "fp").select("t", "fp")
    by_table = np.array(masks, np.uint64)

    def run(batches):
        def solve(t, fp):
            key = fp & by_table[t]
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
            sizes = stops - starts
            first = starts[sizes == 2]
            close = np.bitwise_count(fp[first] ^ fp[first + 1]) <= radius
            found = [(fp[first][close], fp[first + 1][close])]
            for i in np.flatnonzero(sizes > 2).tolist():
                found += bucket_edges(fp[starts[i] : stops[i]], radius)
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        t, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            t = np.concatenate((t, batch.column(0).to_numpy().astype(np.int64)))
            fp = np.concatenate((fp, batch.column(1).to_numpy().view(np.uint64)))
            if not len(fp):
                continue
            key = fp & by_table[t]
            open_run = np.flatnonzero((t != t[-1]) | (key != key[-1]))
            cut = open_run[-1] + 1 if len(open_run) else 0  # the last bucket may go on in the next batch
            if cut:
                yield solve(t[:cut], fp[:cut])
                t, fp = t[cut:], fp[cut:]
        if len(fp):
            yield solve(t, fp)

    return arrow_map(rows, run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, hashed: list[str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, fp, component_id, root.

    component_id is the least doc_id that can be reached over links, root the
    least fingerprint, which names a component whatever its ids; th is a hash of the text or
    of the columns ``hashed``. Null or wordless texts have fingerprint 0 and are
    linked like any other, a text of any length is hashed whole, in parts; repeated rows are linked; a component whose ids are
    all null has a null id; an empty table gives an empty table. Other columns
    of ``docs`` are ignored, whatever their names.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, hashed), "simhash")
    # tables that are joined with are stored, so that joins can split a fingerprint or root with very many rows
    groups = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprints")
    roots = connected_components(covering_links(groups.select("fp"), radius))
    linked = materialize(
        groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots"
    )
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    return marked.join(linked.select("fp", "root").join(least, "root"), "fp").select("doc_id", "th", "fp", "component_id", "root")
