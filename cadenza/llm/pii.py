"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed formats recognise: emails, IP addresses, payment cards,
phone numbers, and quoted credentials behind an assignment. Every token with a
digit or an at sign is a mention, neighbouring groups of digits are one; its patterns are the words around it, up to
the next mention, together with whether it has letters. Spark holds the graph of patterns and instances (distinct
values) as a table and scores it in rounds: a pattern's confidence in a kind is
the smoothed mean confidence of its distinct instances, an instance's is what
its patterns give it jointly, and seeds stay certain. Patterns that end with
enough confidence and enough distinct instances that are certain or believed
(found by other patterns) then discover mentions that no format recognises.

The graph grows with the number of mentions, not of words; it is counted by
``groupBy`` with partial aggregation, so a pattern or value with a third of all
mentions costs a task one row. Up to SENT trusted patterns go to the tasks; more
stay a table that the mentions are joined with. No pattern is dropped.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import arrow_map, materialize

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Rounds of scoring; what a pattern needs.
ROUNDS, SUPPORT, CONFIDENCE = 3, 5, 0.8
#: Trusted patterns that are sent to the tasks (about 200 MB); more are joined.
SENT = 1_000_000
#: Weight of an unseen counterexample in a pattern's mean.
DOUBT = 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"\d+")
_SECRET = re.compile(r"""[A-Za-z_]{3,20} ?[=:] ?(["'])([A-Za-z0-9+/_-]{16,}+)\1""")
_MARK = re.compile(r"[0-9@]")
_AROUND = re.compile(r"\S+")
_GROUP, _GROUPS = re.compile(r"[(+]*[0-9][0-9()./-]*"), re.compile(r"(?: [0-9][0-9./-]*)+")
_LETTER = re.compile(r"[^\W\d_]")
_NEXT = re.compile(r"\s*(\S+)")
#: Punctuation that stands beside a mention and doesn't belong to it.
_TRIM = "\"'`.,;:!?()[]{}<>*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        n += n * (i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of LOCAL+ followed by the domain part, found from their at signs; linear, as no character is walked from two at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The formats' spans (kind, start, end), by kind as listed, then by start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
    return found


def seeds(text: str) -> list[tuple[str, int, int]]:
    found = base_spans(text)
    if '"' in text or "'" in text:
        for m in _SECRET.finditer(text):
            value = m[2]
            if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                found.append(("secret", *m.span(2)))
    return found


def mentions(text: str, known: list[tuple[str, int, int]]):
    """(kind or '', start, end, patterns) of the seeds and of the other tokens with a digit or an at sign; linear in the text."""
    if not known and not _MARK.search(text):
        return
    taken, others = sorted((a, b) for _, a, b in known), []
    i = at = 0
    while m := _MARK.search(text, at):
        p = m.start()
        while i < len(taken) and taken[i][1] <= p:
            i += 1
        if i < len(taken) and taken[i][0] <= p:
            at = taken[i][1]
            continue
        left = p
        while left > at and not text[left - 1].isspace():
            left -= 1
        limit = taken[i][0] if i < len(taken) else len(text)
        stop = _AROUND.match(text, p, limit).end()
        if _GROUP.fullmatch(text, left, stop) and (more := _GROUPS.match(text, stop, limit)):
            stop = more.end()
        at = stop
        token = text[left:stop]
        a = left + len(token) - len(token.lstrip(_TRIM))
        b = left + len(token.rstrip(_TRIM))
        if b - a >= 5:
            others.append(("", a, b))
    every = [*known, *others]
    starts, stops = sorted(a for _, a, _ in every), sorted(b for _, _, b in every)
    for kind, a, b in every:
        before, after = bisect_right(stops, a), bisect_left(starts, b)
        yield kind, a, b, patterns(text, a, b, stops[before - 1] if before else 0, starts[after] if after < len(starts) else len(text))


def patterns(text: str, a: int, b: int, low: int, high: int) -> list[str]:
    """Lexical patterns of a mention: one and two words to its left, and its neighbours; @ is another mention, which ends at low or starts at high."""
    left = text[low:a].rsplit(None, 2)[-2:]
    left = (["^"] * (low == 0) or ["@"]) * (len(left) < 2) + [_DIGITS.sub("9", w.lower()) for w in left]
    right = _NEXT.match(text, b, high)
    right = _DIGITS.sub("9", right[1].lower()) if right else "$" if high == len(text) else "@"
    own = "9a" if _LETTER.search(text, a, b) else "9"
    return [f"L {left[-1]} | {own}", f"LL {' '.join(left)} | {own}", f"LR {left[-1]} _ {right} | {own}"]


def patterns_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, kind, p): the patterns that are trusted, and their confidence. Null texts hold nothing."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                for kind, a, b, found in mentions(text, seeds(text)):
                    name = hashlib.blake2b(text[a:b].encode(), digest_size=12).hexdigest()
                    out += [(kind, name, p) for p in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["kind", "instance", "pattern"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    edges = materialize(
        arrow_map(texts, run, "kind string, instance string, pattern string").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")),
        "mentions",
    )
    # tables of patterns are stored, so that joins can split a pattern with very many instances
    frequent = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("pattern"), "frequent")
    graph = materialize(edges.join(frequent, "pattern", "left_semi"), "graph")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    own = graph.select("pattern", "instance", F.explode(kinds).alias("kind"), F.col("kind").alias("seed"))
    own = own.withColumn("sure", (F.col("seed") == F.col("kind")).cast("double"))
    belief = own.withColumn("c", F.col("sure"))
    for _ in range(ROUNDS):
        by_pattern = materialize(
            belief.groupBy("pattern", "kind").agg((F.sum("c") / (F.count("*") + F.lit(DOUBT))).alias("p")).where("p > 0.05"), "scores"
        )
        joint = materialize(
            own.where("seed = ''").join(by_pattern, ["pattern", "kind"])
            .groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("p"), F.lit(0.999)))))).alias("c")),
            "beliefs",
        )
        belief = own.join(joint, ["instance", "kind"], "left").select(
            "pattern", "instance", "kind", "seed", "sure",
            F.when(F.col("seed") != "", F.col("sure")).otherwise(F.coalesce("c", F.lit(0.0))).alias("c"),
        )
    sure = F.sum((F.col("c") >= CONFIDENCE).cast("long"))
    final = belief.groupBy("pattern", "kind").agg((F.sum("c") / (F.count("*") + F.lit(DOUBT))).alias("p"), sure.alias("sure"))
    # CONFIDENCE is above one half, so a pattern has one kind at most
    return materialize(final.where((F.col("p") >= CONFIDENCE) & (F.col("sure") >= SUPPORT)).select("pattern", "kind", "p"), "patterns")


def candidates(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, patterns) of the mentions that no format recognises."""
    return [(a, b, own) for kind, a, b, own in mentions(text, seeds(text)) if not kind]


def find_spans(text: str, trusted: dict[str, tuple[str, float]]) -> list[tuple[str, int, int]]:
    """The spans of mentions that no format recognises and a pattern of which is trusted: of the most confident pattern, then of the greatest kind."""
    found = []
    for a, b, own in candidates(text):
        best = max(((trusted[p][1], trusted[p][0]) for p in own if p in trusted), default=None)
        if best:
            found.append((best[1], a, b))
    return found


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlaps joined, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, carried: list[str], text_col: str = "text") -> DataFrame:
    """The ``carried`` columns, n_email, n_ip, n_card, n_phone, base_sha256, spans and redacted of every row.

    Spans are kind:start:end in code points, end exclusive. A null text is
    empty and has no span; repeated rows are judged alike, and their values count
    once as evidence; a text of any length is read whole, in linear time; of equally
    confident patterns the greatest kind counts; an empty table gives an empty table. Carried
    columns may be called like those of this operator, except for those that it returns.
    """
    trusted = patterns_table(docs, text_col)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], text.alias("own_text"))
    names, sent = [f"c{i}" for i in range(len(carried))], None
    if trusted.count() <= SENT:
        own = trusted.toArrow()  # SENT rows
        sent = docs.sparkSession.sparkContext.broadcast({pattern: (kind, p) for pattern, kind, p in zip(*(c.to_pylist() for c in own.columns))})
    else:
        source = source.withColumn("own_key", F.sha2("own_text", 256)).join(_joined(docs.select(text.alias("text")), trusted), "own_key", "left").drop("own_key")

    def run(batches):
        types = [*[pa.int64()] * 4, *[pa.string()] * 3]
        for batch in batches:
            out = []
            texts = batch.column("own_text").to_pylist()
            more = [[(x["kind"], x["a"], x["b"]) for x in found or []] for found in batch.column("found").to_pylist()] if sent is None else (find_spans(t, sent.value) for t in texts)
            for text, found in zip(texts, more):
                spans = sorted([*seeds(text), *found], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
                base = base_spans(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE]
                out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(text, spans)))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carried)], *[pa.array(c, t) for c, t in zip(columns, types)]],
                [*names, *[f"n_{k}" for k in BASE], "base_sha256", "spans", "redacted"],
            )

    schema = ", ".join([*[f"{n} {kinds[c]}" for n, c in zip(names, carried)], *[f"n_{k} long" for k in BASE], "base_sha256 string, spans string, redacted string"])
    return arrow_map(source, run, schema).withColumnsRenamed(dict(zip(names, carried)))


def _joined(texts: DataFrame, trusted: DataFrame) -> DataFrame:
    """(own_key, found): by the hash of a text the spans of find_spans, by a join with the trusted patterns. Equal texts have equal spans."""

    def run(batches):
        for batch in batches:
            out = [(k, a, b, p) for k, t in zip(*(c.to_pylist() for c in batch.columns)) for a, b, own in candidates(t) for p in own]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.string()))], ["own_key", "a", "b", "pattern"])

    asked = arrow_map(texts.select(F.sha2("text", 256).alias("own_key"), "text"), run, "own_key string, a int, b int, pattern string").distinct()
    best = asked.join(trusted, "pattern").groupBy("own_key", "a", "b").agg(F.max(F.struct("p", "kind")).alias("best"))
    return materialize(best.groupBy("own_key").agg(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "a", "b")).alias("found")), "found")
