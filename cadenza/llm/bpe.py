"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

A task collects the distinct words of its texts (a word is a match of the
splitting pattern) and hands those that it hasn't met to an in-process DuckDB.
There a word is a set of rows (word, position, token), at first one a byte. One
round of the recursive query joins each pair of neighbouring tokens to the merge
table and contracts, in every word, the leftmost pair of minimum rank; words
without a pair leave, and the recursion ends when none is left. Decoding joins
the tokens to the vocabulary and aggregates their bytes in order. Documents are
put together from their words' ids and bytes.

A round handles every row of a word to contract one pair and the query keeps the rows of all rounds, so a
word costs the square of its length in memory: words are put into queries of ROWS such
rows. Words over LONG_WORD bytes, few of which would fill a query, are contracted by the same rule with a heap of pairs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .scratch import arrow_map

#: Bytes of the longest word that the recursive query takes, rows of all rounds a query (about 50 MB), and words that a worker remembers, of so many bytes at most.
LONG_WORD, ROWS, CACHED_WORDS, CACHED_BYTES = 1_024, 2_000_000, 300_000, 64
#: Bytes of text whose words are looked up at once.
PORTION = 4 << 20
#: The characters that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

ENCODE = """
WITH RECURSIVE state(word, position, token, next_position, next_token, round) AS (
    SELECT word, position, token, next_position, next_token, 0 FROM start
    UNION ALL
    (
        WITH best AS (
            SELECT word, min(merges.token::BIGINT * 65536 + position) AS chosen
            FROM state JOIN merges ON merges.head = state.token AND merges.tail = state.next_token
            GROUP BY word
        ), gone AS (
            SELECT best.word, (chosen % 65536)::INTEGER AS kept, (chosen // 65536)::INTEGER AS merged, taken.position AS removed,
                taken.next_position AS next_position, taken.next_token AS next_token
            FROM best
            JOIN state AS held ON held.word = best.word AND held.position = chosen % 65536
            JOIN state AS taken ON taken.word = best.word AND taken.position = held.next_position
        )
        SELECT word, position,
            CASE WHEN position = kept THEN merged ELSE token END,
            CASE WHEN position = kept THEN gone.next_position ELSE state.next_position END,
            CASE WHEN position = kept THEN gone.next_token WHEN state.next_position = kept THEN merged ELSE state.next_token END,
            round + 1
        FROM state JOIN gone USING (word)
        WHERE position <> removed
    )
)
SELECT word, position, token FROM state JOIN (SELECT word, max(round) AS round FROM state GROUP BY word) USING (word, round)
"""
DECODE = "SELECT word, string_agg(hex, '' ORDER BY position) AS bytes FROM encoded JOIN vocabulary USING (token) GROUP BY word ORDER BY word"

_coders: dict[str, "Coder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks = read_ranks(path)
        own = pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
        self.split = regex.compile(own).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        pairs = [
            (self.ranks[token[:i]], self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        merges = pa.table(dict(zip(("head", "tail", "token"), (pa.array(c, pa.int32()) for c in zip(*pairs)))))  # noqa: F841
        vocabulary = pa.table({"token": pa.array(self.ranks.values(), pa.int64()), "hex": pa.array([t.hex() for t in self.ranks])})  # noqa: F841
        self.engine = duckdb.connect()
        # no temporary folder: nothing is spilled to the worker's disk
        self.engine.execute("SET threads = 1; SET memory_limit = '250MB'; SET temp_directory = ''; SET preserve_insertion_order = false")
        self.engine.execute("CREATE TABLE merges AS SELECT * FROM merges; CREATE TABLE vocabulary AS SELECT * FROM vocabulary")

    def words(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded bytes) of each distinct word."""
        data = [w.encode() for w in words]
        whole = list(map(self.ranks.get, data))  # a word that is a token is not contracted
        single = np.array([0 if r is None else r for r in whole], "<u4").tobytes()
        ids: list = [None if r is None else single[4 * i : 4 * i + 4] for i, r in enumerate(whole)]
        for i, (x, d) in enumerate(zip(ids, data)):
            if x is None and len(d) > LONG_WORD:
                ids[i] = np.array(contract(d, self.ranks), "<u4").tobytes()
        short = [i for i, x in enumerate(ids) if x is None]
        rows = np.cumsum([len(data[i]) ** 2 // 2 + 1 for i in short])
        at = 0
        while at < len(short):
            stop = max(at + 1, int(np.searchsorted(rows, (rows[at - 1] if at else 0) + ROWS, "right")))
            part = short[at:stop]
            at = stop
            for i, x in zip(part, self.encode([data[i] for i in part])):
                ids[i] = x
        return list(zip(ids, self.decode(ids)))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes, by the recursive query."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        position = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        token = self.single[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
        last = position == np.repeat(sizes, sizes) - 1
        start = pa.table(  # noqa: F841
            {
                "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
                "position": position.astype(np.int32),
                "token": token,
                "next_position": np.where(last, -1, position + 1).astype(np.int32),
                "next_token": np.where(last, -1, np.roll(token, -1)).astype(np.int32),
            }
        )
        found = self.engine.sql(ENCODE + " ORDER BY word, position").to_arrow_table()
        stops = (4 * np.cumsum(np.bincount(found["word"].to_numpy(), minlength=len(words)))).tolist()
        ids = found["token"].to_numpy().astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def decode(self, sequences: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences)) // 4
        encoded = pa.table(  # noqa: F841
            {
                "word": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes),
                "position": np.arange(sizes.sum()),
                "token": np.frombuffer(b"".join(sequences), "<u4").astype(np.int64),
            }
        )
        found = self.engine.sql(DECODE).to_arrow_table().combine_chunks()
        out = [b""] * len(sizes)
        if found.num_rows:
            column = found["bytes"].chunk(0)
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), "\n")[0].as_py()
            for i, data in zip(found["word"].to_pylist(), map(bytes.fromhex, whole.split("\n"))):
                out[i] = data
        return out

    def texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each text."""
        split = [self.split(x) for x in texts]
        known = self.known
        coded = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = list(map(known.get, words))
        missing = [i for i, v in enumerate(found) if v is None]
        new = dict(zip([words[i] for i in missing], self.words([words[i] for i in missing]))) if missing else {}
        for i, v in zip(missing, new.values()):
            found[i] = v
        at, edges = coded.indices.to_numpy(), np.concatenate(([0], np.cumsum(list(map(len, split)), dtype=np.int64)))
        parts = [gathered([v[k] for v in found], at, edges) for k in (0, 1)]
        out = list(zip(*parts))
        known.update((w, v) for w, v in new.items() if len(w) <= CACHED_BYTES)
        if len(known) > CACHED_WORDS:  # the older half goes; frequent words come back at once
            for w in list(islice(known, len(known) // 2)):
                del known[w]
        return out


def gathered(values: list[bytes], at: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """For each i the values at the places edges[i]..edges[i + 1] of ``at``, one after another."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    data = np.frombuffer(b"".join(values), np.uint8)
    own = sizes[at]
    stops = np.cumsum(own)
    shift = (np.cumsum(sizes) - sizes)[at] - (stops - own)
    whole = data[np.repeat(shift, own) + np.arange(stops[-1] if len(stops) else 0)].tobytes()
    cuts = np.concatenate(([0], stops))[edges].tolist()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def contract(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by the same rule, in the order of a heap of (rank, place) of its pairs."""
    ends = list(range(1, len(data) + 1))  # by start of a token, where it ends
    left = list(range(-1, len(data) - 1))  # by start, where the token before starts
    heap: list[tuple[int, int, int]] = []

    def offer(start: int):
        if start >= 0 and ends[start] < len(data):
            stop = ends[ends[start]]
            rank = ranks.get(data[start:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, start, stop))

    for start in range(len(data)):
        offer(start)
    while heap:
        _, start, stop = heapq.heappop(heap)
        middle = ends[start]
        if middle <= 0 or middle >= len(data) or ends[middle] != stop:
            continue  # one of the two tokens has changed
        ends[start], ends[middle] = stop, -1
        if stop < len(data):
            left[stop] = start
        offer(start)
        offer(left[start])
    out, at = [], 0
    while at < len(data):
        out.append(ranks[data[at : ends[at]]])
        at = ends[at]
    return out


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode_documents(
    docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and ids (unsigned 32-bit) on demand.

    A null text is empty and has no token; a text of any length is encoded whole, word by word;
    null ids are kept; special tokens' names are ordinary text; repeated rows are encoded each; an empty table gives an empty table;
    other columns are ignored; no shuffle.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches):
        own = coder(ranks, pattern)
        for whole in batches:
            ends = np.cumsum(pc.binary_length(whole.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < whole.num_rows:
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + PORTION, "right")))
                batch = whole.slice(at, stop - at)
                at = stop
                found = own.texts(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(x) // 4 for x, _ in found], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x, _ in found], pa.string()),
                        pa.array([hashlib.sha256(y).hexdigest() for _, y in found], pa.string()),
                        *[pa.array([x for x, _ in found], pa.binary())] * with_ids,
                    ],
                    names,
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return arrow_map(source, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
