"""Mixture-controlled packing of token sequences by deficit round-robin.

Each source is a queue of tokens. A round gives every queue its share of
``round_tokens`` tokens by the target proportions; what the share has in
fractions of a token is carried as the queue's deficit to the next round, so
after r rounds queue s has been served floor(share_s * round_tokens * r) tokens,
whatever documents, windows or partitions these came from. The rounds one after
another are the stream, and each ``length`` tokens of the stream are one window.
A queue that runs dry leaves, and the others share its part from then on (a new
phase). Windows are thus full but for the last, and follow the target to within
a token a queue.

The schedule depends on the lengths of the queues only, so every document finds
its place by arithmetic, with no walk over the corpus: tasks note running
lengths by queue while they tokenize, a small table adds them up over the
partitions, and the plan of the phases (a number a queue and phase) goes to all
tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Mapping
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import arrow_map, materialize

LENGTH, END_ID = 2048, 1
#: Proportions are counted in units of 1 / UNITS; beyond MAX_QUEUES sources those without a target share queues by hash.
UNITS, MAX_QUEUES = 1 << 20, 1024
#: A worker's memory of encoded pieces, in pieces and in characters a piece.
CACHED_PIECES, LONG_ENTRY = 300_000, 64
#: Bytes of text that are encoded at once.
PORTION = 12 << 20
#: The steps before the merges that allow texts to be cut (of the tokenizer's file).
LOWERED = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: A character that is a token of its own between blanks.
MARK = "\x00"

_encoders: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """Encodes texts piece by piece between blanks, for tokenizers that drop white space before they merge."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        steps = json.loads(self.tokenizer.to_str())
        if (steps["normalizer"], steps["pre_tokenizer"]) != (LOWERED, SPLIT) or not steps["model"]["end_of_word_suffix"]:
            raise ValueError(f"{path}: its texts can't be cut at blanks and after letters")
        # for words of lowered letters, which the steps before the merges leave as they are
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary, suffix = self.tokenizer.get_vocab(), steps["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}  # of words between blanks
        self.parts: dict[str, bytes] = {}  # of their parts
        self.none = np.array([np.iinfo(self.kind).max], self.kind)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text starts and the last one stops."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        own = self._looked_up(pc.binary_join(words, "\n")[0].as_py().split("\n") if len(coded) else [])
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // self.kind.itemsize
        data = np.frombuffer(b"".join(own), self.kind)
        at = coded.indices.to_numpy()
        stops = np.cumsum(sizes[at])
        shift = (np.cumsum(sizes) - sizes)[at] - (stops - sizes[at])
        ids = data[np.repeat(shift, sizes[at]) + np.arange(stops[-1] if len(stops) else 0)]
        edges = split.offsets.to_numpy()
        return ids, np.concatenate(([0], stops))[edges - edges[0]]

    def _looked_up(self, words: list[str]) -> list[bytes]:
        out = list(map(self.known.get, words))
        missing = [i for i, v in enumerate(out) if v is None]
        if missing:
            new = [words[i] for i in missing]
            found = self._joined(new)
            self.known.update(zip(new, found))
            for i, v in zip(missing, found):
                out[i] = v
            for word, v in zip(new, found):
                if len(v) > LONG_ENTRY or len(word) > LONG_ENTRY:
                    del self.known[word]
            _shrink(self.known)
        return out

    def _joined(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from those of its parts; a line end between words becomes an id that no token has."""
        parts = pieces("\n".join([*words, ""]))
        known = self.parts
        new = [p for p in dict.fromkeys(parts) if p not in known]
        plain = [p for p in new if p.isalpha() and _latin(p)]
        other = [p for p in new if not (p.isalpha() and _latin(p))]
        found = dict(zip(plain, self._letters(plain))) | dict(zip(other, self._tokenized(other)))
        if any(len(p) > LONG_ENTRY for p in new):
            known = {**known, **found}
        known.update(found)
        stop = self.none.tobytes()
        known["\n"] = stop
        data = b"".join(map(known.__getitem__, parts))
        stops = (np.flatnonzero(np.frombuffer(data, self.kind) == self.none[0]) * self.kind.itemsize).tolist()
        _shrink(self.parts)
        return [data[a:b] for a, b in zip([0, *[x + len(stop) for x in stops]], stops)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters; the last id of a word, and no other, is one that ends words."""
        (whole,) = self.letters.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(whole.ids, self.kind)
        data, stops = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
        if len(stops) != len(words):
            return self._tokenized(words)
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def _tokenized(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; all are encoded as one text, with a mark between them."""
        if any(MARK in x for x in texts):
            return [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, self.kind).tobytes() for x in texts]
        (whole,) = self.tokenizer.encode_batch_fast([f" {MARK} ".join([*texts, ""])], add_special_tokens=False)
        ids = np.array(whole.ids, self.kind)
        (mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        stops = np.flatnonzero(ids == mark)
        data, size = ids.tobytes(), self.kind.itemsize
        starts = np.concatenate(([0], stops[:-1] + 1))
        return [data[a:b] for a, b in zip((starts * size).tolist(), (stops * size).tolist())]


def _shrink(cache: dict[str, bytes]) -> None:
    """Drop the older half of a cache that is full; frequent entries come back at once."""
    if len(cache) > CACHED_PIECES:
        for p in list(islice(cache, len(cache) // 2)):
            del cache[p]


_PIECE = re.compile("\n|[^\\W\\d_]+|(?:[^\\w\\n\x85\xa0]|[\\d_])+[^\\W\\d_]*")


def _latin(word: str) -> bool:
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces(lines: str) -> list[str]:
    """Parts of words (a word a line) whose tokens one after another are those of the word, and the line ends.

    The tokenizers served here lower case, drop white space, and never join a
    letter with a following other character. Words of Latin-1 characters have no
    combining marks and are lowered letter by letter, so they are cut there as
    well and lowered first; other words stay whole.
    """
    try:
        lines.encode("latin-1")
    except UnicodeEncodeError:
        return [p for line in lines.split("\n")[:-1] for p in (*(_PIECE.findall(line.lower()) if _latin(line) else [line]), "\n")]
    return _PIECE.findall(lines.lower())


def _portions(batch: pa.RecordBatch, column: int):
    """The batch in slices of about PORTION bytes of a text column, a row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + PORTION, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class Plan:
    """The schedule: for each phase the queues' units, what each was served before, and where it starts."""

    def __init__(self, totals: list[int], targets: list[float], round_tokens: int):
        self.round = round_tokens
        self.phases: list[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]] = []
        left, served, start = np.array(totals, np.int64), np.zeros(len(totals), np.int64), 0
        while left.any():
            wanted = np.where(left > 0, np.array(targets, float), 0)
            wanted = wanted if wanted.any() else left.astype(float)
            units = np.where(wanted > 0, np.maximum(1, np.rint(wanted / wanted.sum() * UNITS)), 0).astype(np.int64)
            scale = int(units.sum())
            rounds = min(-(-int(t) * scale // (int(u) * round_tokens)) for t, u in zip(left, units) if u)
            self.phases.append((units, served.copy(), left.copy(), scale, start))
            taken = self._served(units, left, scale, max(1, rounds))
            served, left, start = served + taken, left - taken, start + int(taken.sum())

    def _served(self, units, left, scale, rounds):
        share = units * self.round
        return np.minimum(left, share // scale * rounds + share % scale * rounds // scale)

    def place(self, queue: int, at: int, n: int, length: int, memory: dict, add) -> None:
        """Call add(start, size, position in the stream) for the pieces of the tokens at..at+n of a queue."""
        x, end = at, at + n
        for k, (units, before, left, scale, base) in enumerate(self.phases):
            first = int(before[queue])
            last = int(self.phases[k + 1][1][queue]) if k + 1 < len(self.phases) else first + int(left[queue])
            if x >= last or last == first:
                continue
            share = int(units[queue]) * self.round
            while x < end and x < last:
                r = (x - first) * scale // share
                while True:
                    row = memory.get((k, r))
                    if row is None:
                        if len(memory) > 8192:
                            memory.clear()
                        low, high = self._served(units, left, scale, r), self._served(units, left, scale, r + 1)
                        place = base + low.sum() + np.cumsum(high - low) - (high - low)
                        row = memory[k, r] = ((first_of := before + low).tolist(), (before + high).tolist(), (place - first_of).tolist())
                    if row[1][queue] > x:
                        break
                    r += 1
                position = row[2][queue] + x
                size = min(end, row[1][queue], x + length - position % length) - x
                add(x - at, size, position)
                x += size
            if x >= end:
                return


def tokenized(docs: DataFrame, tokenizer: str, own: list[str] | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, queue, part, at, n, ids): ids end with END_ID; at counts the queue's tokens before, in this partition.

    A source is a queue (s and its name); if ``own`` is given, only these are, and the others share MAX_QUEUES by hash (h and a number).
    """
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    queue = F.concat(F.lit("s"), name)
    if own is not None:
        queue = F.when(name.isin(own), queue).otherwise(F.concat(F.lit("h"), F.pmod(F.xxhash64(name), F.lit(MAX_QUEUES)).cast("string")))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), name.alias("source"), queue.alias("queue"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        part, seen, coder = TaskContext.get().partitionId(), {}, encoder(tokenizer)
        end, wide = np.array([END_ID], coder.kind).tobytes(), coder.kind.itemsize
        for whole in batches:
            for batch in _portions(whole, 3):
                flat, edges = coder.encode(batch.column(3))
                data, edges = flat.tobytes(), (edges * wide).tolist()
                ids = [data[a:b] + end for a, b in zip(edges, edges[1:])]
                at, sizes = [], [len(x) // wide for x in ids]
                for name, n in zip(batch.column(2).to_pylist(), sizes):
                    at.append(seen.get(name, 0))
                    seen[name] = at[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([part] * len(ids), pa.int32()), pa.array(at, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "queue", "part", "at", "n", "ids"],
                )

    return arrow_map(source, run, "doc_id long, source string, queue string, part int, at long, n long, ids binary")


def pack(
    docs: DataFrame,
    tokenizer: str,
    targets: Mapping[str, float] | None = None,
    length: int = LENGTH,
    round_tokens: int | None = None,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Place every token of ``docs`` in a sequence of ``length`` tokens.

    ``targets`` gives proportions by source (default: those of the corpus);
    sources without one follow when the others have run dry. Beyond MAX_QUEUES
    sources those without a target share queues, so what holds for a source holds for its
    queue; targets hold whatever the number of sources (the plan grows with the square of the targets). Returns a row per
    piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, source, and ids (unsigned 32-bit) on demand. All sequences but the last are
    full. A null text is empty and packs as its end id, a text of any length is cut over as many
    sequences as it fills; null ids are kept; a null source is the
    queue ""; repeated rows are packed each; an empty table gives an empty
    table; other columns are ignored.
    """
    spark = docs.sparkSession
    sources = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit(""))).distinct().limit(MAX_QUEUES + 1).count()
    own = sorted(targets or ()) if sources > MAX_QUEUES else None
    tokens = materialize(tokenized(docs, tokenizer, own, id_col, text_col, source_col), "tokens")
    parts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    totals = {x["queue"]: x["n"] for x in bases.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # MAX_QUEUES rows and the targets
    names = sorted(totals)
    wanted = [totals[q] if targets is None else targets.get(q[1:], 0.0) if q[0] == "s" else 0.0 for q in names]
    plan = spark.sparkContext.broadcast(Plan([totals[q] for q in names], wanted, round_tokens or length))
    index = {q: i for i, q in enumerate(names)}
    placed = tokens.join(bases.select("queue", "part", "base"), ["queue", "part"]).select("doc_id", "source", "queue", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    wide = (encoder(tokenizer).kind.itemsize == 2 and "<u2") or "<u4"
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", *["ids"] * with_ids]

    def run(batches):
        memory: dict = {}
        crc = zlib.crc32
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                rows, starts, sizes, crcs, places, own = [], [], [], [], [], []
                for row, (queue, at, n, ids) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
                    ids = np.frombuffer(ids, wide).astype("<u4").tobytes()

                    def add(start, size, position):
                        data = ids[4 * start : 4 * (start + size)]
                        rows.append(row)
                        starts.append(start)
                        sizes.append(size)
                        crcs.append(crc(data))
                        places.append(position)
                        if with_ids:
                            own.append(data)

                    plan.value.place(index[queue], at, n, length, memory, add)
                if rows:
                    rows = pa.array(rows, pa.int64())
                    places = np.array(places, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(rows), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                            pa.array(crcs, pa.int64()), batch.column(4).take(rows), pa.array(places // length), pa.array(places % length), batch.column(1).take(rows),
                            *[pa.array(own, pa.binary())] * with_ids,
                        ],
                        fields,
                    )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return arrow_map(placed, run, schema + ", ids binary" * with_ids)
