"""Licence scans: phrases and identifier tags by Aho-Corasick, expressions by shunting-yard.

One automaton holds the words of all notice phrases, between blanks, and runs
once over the words of a text. A second pass, only where the tag's words were
found, reads the licence expression behind an identifier tag; a shunting-yard
parser turns and/or/with and parentheses into postfix order, which evaluates to
the set of licences and to a degree of freedom: the least of what is joined by
and, the greatest of what is joined by or.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import arrow_map

#: Base phrases: label by phrase.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further phrases.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How freely a text under each label may be used, 0 to 1.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "bsl": 1.0, "apache": 0.9, "cc-by": 0.9, "mpl": 0.7, "epl": 0.6,
    "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.5, "agpl": 0.4, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.3

#: Bytes A-Z lowered, other ASCII than letters and digits blank; bytes of other characters stay.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_TAGGED = re.compile(r"spdx-license-identifier\s*[:=]\s*([^\n]+)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**MORE, **BASE}.items():
        found.add_word(f" {phrase} ", (label, len(phrase), phrase in BASE))
    found.add_word(f" {TAG} ", (None, len(TAG), False))
    found.make_automaton()
    return found


_machine: list[ahocorasick.Automaton] = []


def label_of(identifier: str) -> str:
    """The label of a licence identifier such as GPL-2.0-or-later or BSD-3-Clause."""
    name = identifier.lower()
    for known in ("agpl", "lgpl", "gpl", "apache", "mpl", "epl", "bsd", "isc", "bsl", "cc0", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "mit"):
        if name == known or name.startswith(known + "-"):
            return known
    return {"unlicense": "public-domain"}.get(name, name)


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard; raises ValueError where parentheses or operators don't fit."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # what may come next
    for token in tokens:
        word = token.lower()
        if word in _PRECEDENCE:
            if operand:
                raise ValueError(token)
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif token == "(":
            if not operand:
                raise ValueError(token)
            stack.append(token)
        elif token == ")":
            if operand:
                raise ValueError(token)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError(token)
            stack.pop()
        else:
            if not operand:
                raise ValueError(token)
            out.append(token)
            operand = False
    if operand or "(" in stack:
        raise ValueError("unfinished expression")
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """(labels, freedom) of a licence expression: and takes the less free, or the freer, with keeps the licence.

    An expression may be followed by other words: the longest beginning that
    parses counts; none gives no label.
    """
    tokens: list[str] = []
    for m in _TOKEN.finditer(expression):
        if tokens and not _joins(tokens[-1], m[0]):
            break
        tokens.append(m[0])
    tokens = tokens[: _parsable(tokens)]
    if not tokens:
        return set(), 1.0
    order = postfix(tokens)
    values: list[tuple[set[str], float]] = []
    for token in order:
        if token in _PRECEDENCE:
            right, left = values.pop(), values.pop()
            if token == "with":
                values.append(left)
            else:
                less, most = sorted((left[0], right[0]), key=len)
                most |= less  # in place: long expressions stay linear
                values.append((most, (min if token == "and" else max)(left[1], right[1])))
        else:
            label = label_of(token)
            values.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return values[0]


def _parsable(tokens: list[str]) -> int:
    """How many tokens the longest beginning that parses has."""
    depth, operand, best = 0, True, 0
    for i, token in enumerate(tokens, 1):
        closes = token == ")"
        if closes or token.lower() in _PRECEDENCE:
            if operand or (closes and not depth):
                break
            depth, operand = depth - closes, not closes
        elif not operand:
            break
        else:
            depth, operand = depth + (token == "("), token == "("
        if not operand and not depth:
            best = i
    return best


def _joins(left: str, right: str) -> bool:
    """Whether two neighbouring tokens can belong to one expression."""
    ends = left.lower() not in _PRECEDENCE and left != "("
    starts = right.lower() not in _PRECEDENCE and right != ")"
    return not (ends and starts)


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    if not _machine:
        _machine.append(_automaton())
    words = text.encode().translate(_WORDS).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, more, starts, tagged = set(), set(), [], False
    for end, (label, size, is_base) in _machine[0].iter(line):
        if label is None:
            tagged = True
        elif is_base:
            base.add(label)
            starts.append(end - size)  # of the first letter in line
        else:
            more.add(label)
    labels, freedom = base | more, [FREEDOM[x] for x in base | more]
    if more & {"cc-by-nc", "cc-by-nd", "cc-by-sa"} and "cc-by" in base:
        freedom = [FREEDOM[x] for x in labels if x != "cc-by"]
    if tagged:
        for m in _TAGGED.finditer(text):
            own, value = evaluate(m[1])
            labels |= own
            freedom += [value] if own else []
    places = [line.count(" ", 0, p) - 1 for p in (min(starts), max(starts))] if starts else [None, None]
    join = lambda x: ",".join(sorted(x))
    return len(words), len(starts), *places, join(base), join(labels), min(freedom, default=0.0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    score is how freely the text may be used by the licences it names (all of
    them hold); 0 if it names none. A null text is empty, a text of any length is
    scanned whole; null ids are kept; repeated rows are scanned each; an empty table
    gives an empty table; other columns are ignored; no shuffle.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        for batch in batches:
            columns = list(zip(*map(scan, batch.column(1).to_pylist()))) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return arrow_map(
        source, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
