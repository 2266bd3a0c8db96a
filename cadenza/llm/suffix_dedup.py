"""Removal of byte strings that repeat anywhere in a corpus.

A byte goes if it lies in a string of ``length`` bytes that also starts
elsewhere, in the same text or another; on demand the string at the least place
(by the hash of its text, then by position) stays. The search is a sparse suffix
sort:

* **Sampled suffixes.** A difference cover of fixed residues would keep 2/3 of
  all suffixes (dozens of bytes a byte of text). Here the cover is given by the content: of
  each window of ``span`` positions the position with the least hash of its
  ``GRAM`` bytes is sampled. Windows with equal bytes sample the same place, so
  every string of length bytes owns exactly one sampled suffix at a distance
  below span, and equal strings own it at the same distance.
* **Names.** A sampled suffix is named by the hash of the ``core`` bytes that all
  strings owning it have in common; a name that occurs once ends the search for
  its strings (nearly all text goes here). The recursion is one level: suffixes
  with a repeated name are named again by the bytes of all the strings they
  own, and a repeated second name means that all of these strings repeat.
* **Remaining suffixes.** Where a first name repeats and a second name doesn't
  (edges of shared passages, edits in near copies), each owned string is
  compared with the strings at the same distance of the other suffixes of that
  name.

Names are counted by ``groupBy`` with partial aggregation, so a passage that a
third of all documents share costs a task one row. Groups with many different
second names are compared by counting the names of their single strings, also
by ``groupBy``; other groups are sorted and compared inside a task.

Strings of a second, greater length are sought only where strings of the lesser
length repeat one after another, since these hold all of them.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .scratch import arrow_map, materialize, read_back, remove, store

GRAM = 16
#: String starts that are hashed at once; second names of a group that are compared by a dictionary of their strings,
#: those that one task sorts (a few MB), and string starts that are put together to runs at once.
PIECE, FEW, SMALL_GROUP, TOGETHER = 1 << 20, 48, 2_000, 4_096
#: Suffixes of a name that is joined in SALTS parts.
MANY, SALTS = 1_000, 64
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Cover:
    """Strings of ``length`` bytes, of which each owns one of the ``span`` (a power of two) suffixes from its start on.

    With ``residues``, a difference cover modulo span, the suffixes at these residues are sampled instead, and a string owns all
    of them among the span suffixes from its start on: two equal strings have one at the same distance.
    """

    length: int
    span: int
    residues: tuple[int, ...] = ()

    @property
    def core(self) -> int:
        """The bytes from a sampled suffix on that all strings owning it have."""
        return self.length - self.span + 1


def cover(length: int) -> Cover:
    """The greatest span of at most two thirds of the length."""
    if length < 3 * GRAM:
        raise ValueError(f"strings of {3 * GRAM} bytes at least")
    return Cover(length, 1 << ((2 * length // 3).bit_length() - 1))


def residue_cover(length: int, r: int) -> Cover:
    """The cover by 6 r + 4 residues modulo 24 r^2 + 36 r + 13: the steps between marks of a ruler that measures every distance."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    marks = [0]
    for step in steps:
        marks.append(marks[-1] + step)
    return Cover(length, 24 * r * r + 36 * r + 13, tuple(marks))


#: Bytes of a string that goes, and of one that a passage of over 50 words reaches (51 words have 330 bytes or so, short ones 200).
LENGTH, PASSAGE = 400, 200

ANCHOR = "h1 long, h2 long, key long, ctx long, q int, lo int, hi int"


def sampled(text: bytes, by: Cover):
    """Yield (q, lo, hi): the sampled position q owns the strings that start in lo..hi."""
    last = len(text) - by.length
    if by.residues:
        for start in range(0, len(text), by.span):
            for q in (start + x for x in by.residues):
                if q + by.core <= len(text) and q - by.span < last:
                    yield q, max(0, q - by.span + 1), min(q, last)
        return
    for at in range(0, last + 1, PIECE):
        owners = _owners(text[at : min(at + PIECE - 1, last) + by.length], by)
        cuts = np.flatnonzero(np.diff(owners)) + 1
        lows = np.concatenate(([0], cuts))
        highs = np.concatenate((cuts - 1, [len(owners) - 1]))
        yield from zip((owners[lows] + at).tolist(), (lows + at).tolist(), (highs + at).tolist())


def _owners(piece: bytes, by: Cover) -> np.ndarray:
    """The sampled position of each string that starts in ``piece``."""
    data = np.frombuffer(piece, np.uint8)
    words = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        words |= data[i : len(data) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    grams = (words[:-8] * np.uint64(0x9E3779B97F4A7C15)) ^ ((words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(7))
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)  # ties go to the first position
    width = 1
    while 2 * width <= by.span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return (least & _LOW).astype(np.int64)[: len(data) - by.length + 1]


def identity(text: bytes) -> tuple[int, int]:
    """128 bits that name a text, as two signed longs."""
    digest = xxhash.xxh3_128_digest(text)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _texts(batch, column: int = 0) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _batches(rows, names, types, size: int = 20_000):
    """Record batches of at most ``size`` rows from an iterator of tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


_I64, _I32 = pa.int64(), pa.int32()


def _anchors(texts: DataFrame, by: Cover) -> DataFrame:
    xx = xxhash.xxh64_intdigest

    def rows(batches):
        for batch in batches:
            for text in _texts(batch):
                if len(text) >= by.length:
                    h1, h2 = identity(text)
                    for q, lo, hi in sampled(text, by):
                        yield (h1, h2, _signed(xx(text[q : q + by.core])), _signed(xx(text[lo : hi + by.length], q - lo)), q, lo, hi)

    names, types = ["h1", "h2", "key", "ctx", "q", "lo", "hi"], [_I64] * 4 + [_I32] * 3
    return arrow_map(texts, lambda batches: _batches(rows(batches), names, types), ANCHOR)


def _with_identity(docs: DataFrame, carried: str, distinct: bool = False) -> DataFrame:
    """Add h1 and h2 of the column text to (carried columns, text); if distinct, each text once a task."""

    def run(batches):
        seen: set[tuple[int, int]] = set()  # of one task's input
        for batch in batches:
            names = batch.schema.names
            pairs = [identity(x) for x in _texts(batch, names.index("text"))]
            if distinct:
                first = [p not in seen and not seen.add(p) for p in pairs]
                batch, pairs = batch.filter(pa.array(first, pa.bool_())), [p for p, f in zip(pairs, first) if f]
            columns = [*batch.columns, pa.array([p[0] for p in pairs], _I64), pa.array([p[1] for p in pairs], _I64)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "h1", "h2"])

    return arrow_map(docs, run, f"{carried}, h1 long, h2 long")


def _contexts(texts: DataFrame, wanted: DataFrame, by: Cover) -> DataFrame:
    """The bytes of the strings that unresolved suffixes own, with what ``wanted`` says of them; one row a suffix."""
    asked = wanted.groupBy("h1", "h2").agg(
        F.collect_list(F.struct("key", "ctx", "n", "names", "q", "lo", "hi")).alias("asked")
    )
    kind = texts.schema["text"].dataType.simpleString()
    found = _with_identity(texts, f"text {kind}", distinct=True).join(asked, ["h1", "h2"])

    def rows(batches):
        before = None
        for batch in batches:
            h1, h2, texts, asked = (batch.column(n) for n in ("h1", "h2", "text", "asked"))
            for a, b, text, items in zip(h1.to_pylist(), h2.to_pylist(), texts.cast(pa.binary()).to_pylist(), asked.to_pylist()):
                if (a, b) == before:
                    continue  # copies of a text meet here
                before = (a, b)
                for x in items:
                    yield (x["key"], x["ctx"], x["n"], x["names"], a, b, x["q"], x["lo"], x["hi"], text[x["lo"] : x["hi"] + by.length])

    names = ["key", "ctx", "n", "names", "h1", "h2", "q", "lo", "hi", "bytes"]
    types = [_I64, _I64, _I64, _I64, _I64, _I64, _I32, _I32, _I32, pa.binary()]
    schema = "key long, ctx long, n long, names long, h1 long, h2 long, q int, lo int, hi int, bytes binary"
    return arrow_map(found, lambda batches: _batches(rows(batches), names, types, 2_000), schema)


def _runs(starts: list[int]):
    """Maximal runs of consecutive ints of a sorted list, as (first, last)."""
    first = last = None
    for p in starts:
        if last is not None and p == last + 1:
            last = p
            continue
        if first is not None:
            yield first, last
        first = last = p
    if first is not None:
        yield first, last


SPAN_ROW = "h1 long, h2 long, lo int, hi int"


def _repeated_few(group: list[dict], by: Cover, keep: bool):
    """For each suffix of a group, which of its strings go: booleans by distance, from lo on."""
    count, least, names = defaultdict(int), {}, []
    for x in group:
        at, place = x["q"] - x["lo"], (x["h1"], x["h2"], x["q"])
        own = [(at - i, xxhash.xxh3_128_digest(x["bytes"][i : i + by.length])) for i in range(x["hi"] - x["lo"] + 1)]
        for name in own:
            count[name] += x["n"]
            least[name] = min(least.get(name, place), place)
        names.append((place, own))
    return [[least[name] != place if keep else count[name] > 1 for name in own] for place, own in names]


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of a byte matrix, and the length that each shares with its successor."""
    order = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel().argsort(kind="stable")
    ordered = rows[order]
    differ = ordered[1:] != ordered[:-1]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def _repeated_many(group: list[dict], by: Cover, keep: bool):
    """As _repeated_few, by suffix sorting: suffixes after the sampled place, and reversed prefixes before it.

    Two strings at distance a are equal if the suffixes share length - a bytes
    and the prefixes share a; the shared lengths of neighbours in both orders
    give the classes of all suffixes at each distance.
    """
    q, lo, hi, n = (np.array([x[k] for x in group]) for k in ("q", "lo", "hi", "n"))
    place = np.empty(len(group), np.int64)
    place[sorted(range(len(group)), key=lambda i: (group[i]["h1"], group[i]["h2"], group[i]["q"]))] = np.arange(len(group))
    after = np.zeros((len(group), by.length), np.uint8)
    before = np.zeros((len(group), by.span), np.uint8)
    for i, x in enumerate(group):
        data, cut = np.frombuffer(x["bytes"], np.uint8), x["q"] - x["lo"]
        after[i, : len(data) - cut] = data[cut:]
        before[i, :cut] = data[:cut][::-1]
    (right, shared_right), (left, shared_left) = _classes(after), _classes(before)
    out = [np.zeros(h - l + 1, bool) for l, h in zip(lo.tolist(), hi.tolist())]
    class_right, class_left = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    for a in range(int((q - hi).min()), int((q - lo).max()) + 1):
        own = np.flatnonzero((q - hi <= a) & (a <= q - lo))
        class_right[right[1:]] = np.cumsum(shared_right < by.length - a)
        class_left[left[1:]] = np.cumsum(shared_left < a)
        class_right[right[0]] = class_left[left[0]] = 0
        _, at = np.unique(class_right[own] * len(group) + class_left[own], return_inverse=True)
        if keep:
            least = np.full(len(own), len(group), np.int64)
            np.minimum.at(least, at, place[own])
            goes = place[own] > least[at]
        else:
            goes = np.bincount(at, weights=n[own])[at] > 1
        for i in own[goes].tolist():
            out[i][q[i] - a - lo[i]] = True
    return out


def _compare_small(contexts: DataFrame, by: Cover, keep: bool) -> DataFrame:
    """Repeated strings of the groups that one task can hold."""
    grouped = contexts.repartition("key").sortWithinPartitions("key", "ctx")

    def solve(group):
        if len(group) < 2:
            return
        for x, flags in zip(group, (_repeated_few if len(group) <= FEW else _repeated_many)(group, by, keep)):
            if keep or x["n"] == 1:
                for first, last in _runs([x["lo"] + i for i, again in enumerate(flags) if again]):
                    yield (x["h1"], x["h2"], first, last)

    def rows(batches):
        group, seen = [], None
        for batch in batches:
            for x in batch.to_pylist():
                if group and x["key"] != group[0]["key"]:
                    yield from solve(group)
                    group, seen = [], None
                if x["ctx"] != seen or not group:
                    group.append(x)
                    seen = x["ctx"]
        if group:
            yield from solve(group)

    return arrow_map(
        grouped, lambda batches: _batches(rows(batches), ["h1", "h2", "lo", "hi"], [_I64, _I64, _I32, _I32]), SPAN_ROW
    )


def _compare_large(contexts: DataFrame, by: Cover, keep: bool) -> DataFrame:
    """Repeated strings of the groups with many second names, by counting the names of single strings.

    A group's strings are dealt out by their own names, so none of its size meets in a task.
    """

    def rows(batches):
        for batch in batches:
            for x in batch.to_pylist():
                for i in range(x["hi"] - x["lo"] + 1):
                    w1, w2 = identity(x["bytes"][i : i + by.length])
                    yield (w1, w2, x["h1"], x["h2"], x["lo"] + i, x["n"])

    names, types = ["w1", "w2", "h1", "h2", "p", "n"], [_I64] * 4 + [_I32, _I64]
    strings = arrow_map(contexts, lambda batches: _batches(rows(batches), names, types), "w1 long, w2 long, h1 long, h2 long, p int, n long")
    place = F.struct("h1", "h2", "p")
    repeated = materialize(
        strings.groupBy("w1", "w2").agg(F.max("n").alias("n"), F.min(place).alias("least"), F.max(place).alias("most")).where("n > 1 or least <> most").select("w1", "w2", "least"),
        "strings",  # a join with a stored table can be split where one string is in very many texts
    )
    goes = place != F.col("least") if keep else F.col("n") == 1
    found = strings.join(repeated, ["w1", "w2"]).where(goes).select("h1", "h2", "p")
    together = found.groupBy("h1", "h2", F.floor(F.col("p") / TOGETHER).alias("part")).agg(F.sort_array(F.collect_set("p")).alias("p"))  # TOGETHER places at most

    def merged(batches):
        for batch in batches:
            for h1, h2, places in zip(*(c.to_pylist() for c in batch.columns)):
                for first, last in _runs(places):
                    yield (h1, h2, first, last)

    return arrow_map(together.select("h1", "h2", "p"), lambda batches: _batches(merged(batches), ["h1", "h2", "lo", "hi"], [_I64, _I64, _I32, _I32]), SPAN_ROW)


def repeated_strings(texts: DataFrame, by: Cover, keep: bool = False, small_group: int = SMALL_GROUP) -> DataFrame:
    """(h1, h2, lo, hi): in the text named h1, h2 the strings that start in lo..hi are repeated.

    With ``keep`` the string at the least place (h1, h2, start) isn't in it,
    and rows with equal texts count as one text.
    """
    # tables that are joined with are stored, so that joins can split a name with very many suffixes
    all_anchors = _anchors(texts, by)
    path = store(all_anchors, "anchors")
    anchors = read_back(texts.sparkSession, path, all_anchors)
    names = materialize(anchors.groupBy("key").agg(F.count("*").alias("suffixes")).where("suffixes > 1"), "names")
    again = materialize(anchors.join(names, "key"), "repeated-names")
    remove(texts.sparkSession, path)
    second = materialize(
        again.groupBy("key", "ctx").agg(F.first("suffixes").alias("suffixes"), F.count("*").alias("n"), F.min(F.struct("h1", "h2", "q", "lo", "hi")).alias("x"))
        .select("key", "ctx", "suffixes", "n", "x.*"),
        "second-names",
    )
    sizes = materialize(second.groupBy("key").agg(F.count("*").alias("names")).where("names > 1"), "name-counts")
    contexts = materialize(_contexts(texts, second.join(sizes, "key"), by), "contexts")
    place = F.struct("h1", "h2", "q")
    # a name of many suffixes is dealt out to SALTS tasks
    salts = F.when(F.col("suffixes") > MANY, SALTS).otherwise(1)
    equal = second.where("n > 1").select("key", "ctx", place.alias("least"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    copies = again.withColumn("salt", F.pmod(F.xxhash64(place), salts).cast("int")).join(equal, ["key", "ctx", "salt"])
    spans = (
        copies.where(place != F.col("least")) if keep else copies,
        _compare_small(contexts.where(f"names <= {small_group}"), by, keep),
        _compare_large(contexts.where(f"names > {small_group}"), by, keep),
    )
    whole = spans[0].select("h1", "h2", "lo", "hi")
    for part in spans[1:]:
        whole = whole.unionByName(part.select("h1", "h2", "lo", "hi"))
    return whole


def covered(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end exclusive) of the bytes covered by the strings that start in the spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def starts(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of the starts in the spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _by_text(spans: DataFrame, tag: str) -> DataFrame:
    """(h1, h2, spans): a row a text, whose spans are merged where one task sees them."""
    grouped = spans.distinct().groupBy("h1", "h2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return materialize(grouped, tag)


def _within(marked: DataFrame, lesser: DataFrame, by: Cover, length: int, keep: bool) -> DataFrame:
    """The spans of strings of ``length`` bytes, sought where the strings of ``by`` (spans in ``lesser``) repeat one after another."""

    def pieces(batches):
        names, types = ["h1", "h2", "at", "text", "p1", "p2"], [_I64, _I64, _I32, pa.binary(), _I64, _I64]

        def rows():
            for batch in batches:
                for h1, h2, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                    for lo, hi in starts([(x["lo"], x["hi"]) for x in spans]):
                        if hi - lo >= length - by.length:
                            piece = text[lo : hi + by.length]
                            yield (h1, h2, lo, piece, *identity(piece))

        return _batches(rows(), names, types, 500)

    texts = marked.join(lesser, ["h1", "h2"]).select("h1", "h2", F.col("text").cast("binary").alias("text"), "spans")
    found = materialize(arrow_map(texts, pieces, "h1 long, h2 long, at int, text binary, p1 long, p2 long"), "pieces")
    spans = materialize(repeated_strings(found.select("text"), cover(length), keep).distinct().select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), "lo", "hi"), "piece-spans")
    places = materialize(found.select("h1", "h2", "at", "p1", "p2").distinct(), "places")
    return places.join(spans, ["p1", "p2"]).select("h1", "h2", (F.col("lo") + F.col("at")).alias("lo"), (F.col("hi") + F.col("at")).alias("hi"))


def remove_repeats(
    docs: DataFrame, carried: list[str], text_col: str = "text", with_text: bool = False, length: int = LENGTH, keep: bool = False, passage: int | None = None, by: Cover | None = None
) -> DataFrame:
    """The ``carried`` columns of every row, with n_bytes, n_removed, n_spans, kept_sha256.

    with_text adds kept_text, which leaves out characters of which a removed
    string took some bytes; ``passage`` (below length) adds n_passage, the bytes
    that lie in repeated strings of so many bytes and do not go by that. ``by`` is another cover for ``length``.

    A null text is empty. Equal texts of at least ``length`` bytes are removed
    whole, all copies; with ``keep`` one copy of each string stays, that of the
    least place, and equal texts count as one. Matches never cross texts; a text of any
    length is read in pieces. Shorter texts and an empty table need no search; repeated
    rows are judged alike. Carried columns keep their names and may be called
    like those of this operator, except for those that it returns.
    """
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    texts = docs.select(text)
    if passage is None:
        spans = _by_text(repeated_strings(texts, by or cover(length), keep), "spans").select("h1", "h2", "spans", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("more"))
    else:
        by = cover(passage)
        lesser = _by_text(repeated_strings(texts, by), "passages")
        greater = _by_text(_within(_with_identity(texts, "text string"), lesser, by, length, keep), "spans")
        spans = lesser.withColumnRenamed("spans", "more").join(greater, ["h1", "h2"], "left")
    columns = [f"c{i} {kinds[c]}" for i, c in enumerate(carried)]
    marked = _with_identity(docs.select(*own, text), ", ".join([*columns, "text string"]))
    joined = marked.join(spans, ["h1", "h2"], "left").select(*[f"c{i}" for i in range(len(carried))], "text", "spans", "more")
    more = [*["n_passage"] * (passage is not None), *["kept_text"] * with_text]

    def run(batches):
        for batch in batches:
            out = []
            for text, spans, lesser in zip(_texts(batch, len(carried)), batch.column("spans").to_pylist(), batch.column("more").to_pylist()):
                gone = covered([(x["lo"], x["hi"]) for x in spans or []], length)
                at, kept = 0, []
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                whole = b"".join(kept)
                row = [len(text), len(text) - len(whole), len(gone), hashlib.sha256(whole).hexdigest()]
                if passage is not None:
                    row.append(sum(b - a for a, b in covered([(x["lo"], x["hi"]) for x in lesser or []], passage)))
                if with_text:
                    row.append("".join(part.decode(errors="ignore") for part in kept))
                out.append(row)
            types = [_I64, _I64, _I64, pa.string(), *[_I64] * (passage is not None), *[pa.string()] * with_text]
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carried)], *[pa.array(c, t) for c, t in zip(columns, types)]],
                [*[f"c{i}" for i in range(len(carried))], "n_bytes", "n_removed", "n_spans", "kept_sha256", *more],
            )

    kind = {"n_passage": "long", "kept_text": "string"}
    schema = ", ".join([*columns, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *[f"{m} {kind[m]}" for m in more]])
    return arrow_map(joined, run, schema).withColumnsRenamed({f"c{i}": c for i, c in enumerate(carried)})
