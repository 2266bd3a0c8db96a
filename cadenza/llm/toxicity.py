"""Toxicity by class-conditional Kneser-Ney language models.

Two interpolated Kneser-Ney models spell the words of toxic and of ordinary
labelled texts. A class has counts of its own for strings of ORDER characters (a
word starts with ORDER - 1 marks, so its beginnings are such strings too). Below
them stand the continuation counts, how many different characters precede a
shorter string, of both classes together: what is rare in a class falls back on
counts that the classes share and says little, while a new form of a known stem
is recognised by its beginning.

A word's gain is the difference of its two log-likelihoods. Most words of a toxic
text are ordinary, so the toxic likelihood of a word in a text is a mixture,
SHARE of it from the toxic model; the difference of the text's two
log-likelihoods, every word as often as it occurs, is divided by the square root
of the number of words, and a logistic curve (slope and offset), fitted on
labelled rows that no count saw, turns it into a probability.

Counting is a distributed ``groupBy`` over all training rows, and the model is a
stored table that grows with the corpus; no count is cut.
A model of up to STRINGS strings goes to the tasks as sorted arrays. A larger one
stays a table that the distinct words of the texts are joined with, and then the
gains of the SENT most frequent words go to the tasks, those of all other words
are joined with the texts that hold them. The scores are the same.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import arrow_map, materialize

#: Labelled rows for the curve at most (those with the least hash of their id); all others are counted.
CURVE_ROWS = 20_000
#: Characters of the strings that a class counts, the discount of any count, and the share of a toxic text's words that the toxic model spells.
ORDER, DISCOUNT, SHARE = 5, 0.75, 0.03
#: The strings of a model that is sent to the tasks (a larger one is joined), and then the words whose gains are sent (others are joined).
STRINGS, SENT = 2_000_000, 400_000
#: The labels that go to all tasks (about 100 MB); more are joined with the texts by a shuffle.
LABELS = 4_000_000
FOLDS, CURVE_FOLD, CACHED_WORDS = 5, 1, 100_000
CLASSES = ("toxic", "ordinary")

_WORD = re.compile(r"[^\W\d_]+")
_MARKS = "^" * (ORDER - 1)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str) -> list[str]:
    """The strings of ORDER characters that end at each character of a word and at its end."""
    padded = f"{_MARKS}{word}$"
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(codes: np.ndarray, size: int) -> np.ndarray:
    """The 64-bit hashes of the strings of ``size`` characters that end at each character (from the size-th on)."""
    key = np.full(len(codes), size, np.uint64)
    for i in range(size):
        key[size - 1 :] = _mixed(key[size - 1 :] + (codes[i : len(codes) - size + 1 + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return key


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the strings one after another, and the length of each string."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4"), np.fromiter(map(len, strings), np.int64, len(strings))


def mixture(gains: np.ndarray) -> np.ndarray:
    """Log ratio of the mixture's likelihood to the ordinary one."""
    return np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + gains)


class Strings:
    """A model as arrays sorted by hash: a string of ORDER characters has its log ratio, one of ORDER - 1 that of the weights behind it."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value, self.known = key[order], value[order], {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def _found(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, self.value[at], np.nan)

    def gains(self, words: list[str]) -> np.ndarray:
        """Difference of the log-likelihoods of each word."""
        if not words:
            return np.zeros(0)
        codes, sizes = _codes([f"{_MARKS}{w}$" for w in words])
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(place >= ORDER - 1)
        total = self._found(_keys(codes, ORDER)[at])
        absent = np.flatnonzero(np.isnan(total))
        total[absent] = np.nan_to_num(self._found(_keys(codes, ORDER - 1)[at[absent] - 1]))
        return np.bincount(np.repeat(np.arange(len(words)), sizes)[at], total, len(words))

    def look_up(self, words: list[str]) -> None:
        """Put what the words add to a text into ``known``, which forgets when it is full."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = words
        self.known.update(zip(new, mixture(self.gains(new)).tolist()))


@dataclass
class Model:
    strings: DataFrame  # s, value: of ORDER characters, or of ORDER - 1 (see Strings)
    curve: tuple[float, float] = (0.0, 0.0)  # offset and slope

    def arrays(self) -> Strings | None:
        """The model for the tasks; none if it has more than STRINGS strings."""
        if self.strings.count() > STRINGS:
            return None
        own = self.strings.toArrow()  # STRINGS rows
        strings, value = own.column(0).to_pylist(), own.column(1).to_numpy()
        key = np.zeros(len(strings), np.uint64)
        for size in (ORDER, ORDER - 1):
            at = [i for i, s in enumerate(strings) if len(s) == size]
            if at:
                key[at] = _keys(_codes([strings[i] for i in at])[0], size)[size - 1 :: size]
        return Strings(key, value)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (constant first) of a logistic regression by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _fold(column):
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def _summed(source: DataFrame, add) -> DataFrame:
    """Rows (s, toxic, ordinary): what ``add`` puts into a table of counts, in parts of bounded size."""

    def flush(own):
        return pa.RecordBatch.from_arrays(
            [pa.array(own.keys(), pa.string()), *[pa.array([n[i] for n in own.values()], pa.int64()) for i in (0, 1)]], ["s", *CLASSES]
        )

    def run(batches):
        own = defaultdict(lambda: [0, 0])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                add(own, row)
                if len(own) > 200_000:
                    yield flush(own)
                    own.clear()
        if own:
            yield flush(own)

    parts = arrow_map(source, run, "s string, toxic long, ordinary long")
    return parts.groupBy("s").agg(*[F.sum(c).alias(c) for c in CLASSES])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled rows of ``docs`` whose fold is not 0; with one class only, every score is that class's share."""
    marked = labels.where("doc_id is not null and toxic is not null").where(_fold("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = F.xxhash64("doc_id")
    known = marked.where(_fold("doc_id") == CURVE_FOLD).join(rows.select("doc_id"), "doc_id", "left_semi")
    aside = materialize(known.orderBy(place, "doc_id").limit(CURVE_ROWS), "curve")  # CURVE_ROWS rows
    marked = materialize(marked.join(F.broadcast(aside.select("doc_id")), "doc_id", "left_anti"), "labels")
    counted = rows.join(F.broadcast(marked) if marked.count() <= LABELS else marked, "doc_id").select("text", "toxic")

    def add_words(own, row):
        for w in words(row[0]):
            own[w][row[1] != 1] += 1

    def add_grams(own, row):
        for g in grams(row[0]):
            own[g][0] += row[1]
            own[g][1] += row[2]

    model = Model(_estimate(materialize(_summed(_summed(counted, add_words), add_grams), "counts")))
    held = rows.join(F.broadcast(aside), "doc_id").select("text", F.col("toxic").alias("y"), place.alias("place"))
    sample = _measured(held, model, ["y", "place"], "text").orderBy("place", "x", "y").limit(CURVE_ROWS).select("y", "x").toArrow()  # CURVE_ROWS rows
    y, x = (sample.column(i).to_numpy().astype(float) for i in (0, 1))
    if 0 < y.sum() < len(y):
        model.curve = tuple(logistic(x[:, None], y).tolist())
    else:
        share = (y.sum() + 0.5) / (len(y) + 2)  # without labels nothing is called toxic
        model.curve = (float(np.log(share / (1 - share))), 0.0)
    return model


def _estimate(counts: DataFrame) -> DataFrame:
    """(s, value) from all ``counts`` (s of ORDER characters; how often either class has it): see Strings.

    P_c(s) = (max(n_c(s) - d, 0) + d k_c(h) P(s without its first character)) / n_c(h) for the context h before the
    last character, k_c(h) the different strings behind it; P alone where the class lacks h. P is the same with
    the continuation counts of both classes, down to the even distribution. A string that both lack keeps only
    the ratio of the weights d k_c(h) / n_c(h): P is the same for both.
    """
    context, lower = F.expr("left(s, length(s) - 1)"), F.expr("substring(s, 2)")
    discount = lambda n: F.greatest(n - DISCOUNT, F.lit(0.0))

    def following(found: DataFrame, names: tuple[str, ...]) -> DataFrame:
        """By context h: the counts of all strings behind it, and the weight of what is below."""
        sums = found.groupBy(context.alias("h")).agg(
            *[F.sum(c).alias(f"all_{c}") for c in names], *[F.sum(F.when(F.col(c) > 0, DISCOUNT).otherwise(0.0)).alias(f"kinds_{c}") for c in names]
        )
        return sums.select("h", *[f"all_{c}" for c in names], *[F.try_divide(f"kinds_{c}", f"all_{c}").alias(f"w_{c}") for c in names])

    continued = []  # the strings of ORDER - 1 characters and fewer, and the characters that precede each
    for _ in range(ORDER - 1):
        longer = continued[-1] if continued else counts
        continued.append(materialize(longer.select(lower.alias("s")).groupBy("s").agg(F.count("*").alias("n")), "continued"))
    single = continued[-1]
    total = single.agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    even = F.lit(DISCOUNT) * F.col("kinds") / F.col("all") / (F.col("kinds") + 1)
    shared = materialize(single.crossJoin(F.broadcast(total)).select("s", (discount(F.col("n")) / F.col("all") + even).alias("p")), "shared")
    for found in reversed(continued[:-1]):
        below = shared.select(F.col("s").alias("low"), F.col("p").alias("below"))
        level = found.withColumn("h", context).withColumn("low", lower).join(following(found, ("n",)), "h").join(below, "low")
        shared = materialize(level.select("s", (discount(F.col("n")) / F.col("all_n") + F.col("w_n") * F.col("below")).alias("p")), "shared")
    contexts = materialize(following(counts, CLASSES), "contexts")

    def spelled(c: str) -> Column:
        return F.when(F.col(f"all_{c}") > 0, discount(F.col(c)) / F.col(f"all_{c}") + F.col(f"w_{c}") * F.col("p")).otherwise(F.col("p"))

    top = counts.withColumn("h", context).join(contexts, "h").join(shared.withColumnRenamed("s", "low"), lower == F.col("low"))
    weight = [F.when(F.col(f"all_{c}") > 0, F.col(f"w_{c}")).otherwise(1.0) for c in CLASSES]
    return materialize(
        top.select("s", F.log(spelled("toxic") / spelled("ordinary")).alias("value")).unionByName(contexts.select(F.col("h").alias("s"), F.log(weight[0] / weight[1]).alias("value"))),
        "strings",
    )


def _gains(texts: DataFrame, model: Model) -> DataFrame:
    """(word, n, gain) of the distinct words of a column of texts: how often they occur, and the difference of their log-likelihoods."""

    def count(batches):
        own = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own.update(words(text))
                if len(own) > 200_000:
                    yield flush()
                    own.clear()
        if own:
            yield flush()

    def cut(batches):
        out = []
        for batch in batches:
            for w in batch.column(0).to_pylist():
                for g, n in Counter(grams(w)).items():
                    out.append((w, g, n))
                    if len(out) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["word", "s", "times"])
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["word", "s", "times"])

    types = [pa.string(), pa.string(), pa.int64()]
    vocabulary = materialize(arrow_map(texts, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    parts = arrow_map(vocabulary.select("word"), cut, "word string, s string, times long")
    whole = model.strings.where(F.length("s") == ORDER)
    behind = model.strings.where(F.length("s") == ORDER - 1).select(F.col("s").alias("h"), F.col("value").alias("weight"))
    found = parts.join(whole, "s", "left").withColumn("h", F.left("s", F.lit(ORDER - 1))).join(behind, "h", "left")
    # sums in any order are equal once rounded
    summed = found.groupBy("word").agg(F.round(F.sum(F.col("times") * F.coalesce("value", "weight", F.lit(0.0))), 9).alias("gain"))
    return materialize(vocabulary.join(summed, "word").select("word", "n", "gain"), "gains")


def _joined(docs: DataFrame, source: DataFrame, model: Model, text_col: str):
    """What the SENT most frequent words add to a text, and ``source`` with more: what the other words of own_text add."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mixed = F.log(F.lit(1 - SHARE) + F.lit(SHARE) * F.exp(F.least("gain", F.lit(700.0))))
    gains = materialize(_gains(docs.select(text.alias("text")), model).select("word", "n", mixed.alias("gain")), "mixed")
    frequent = materialize(gains.orderBy(F.desc("n"), "word").limit(SENT), "frequent")
    rest = materialize(gains.join(frequent.select("word"), "word", "left_anti").select("word", "gain"), "rest")
    own = frequent.select("word", "gain").toArrow()  # SENT rows
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(own.column(0).to_pylist(), own.column(1).to_pylist())))

    def others(batches):
        for batch in batches:
            out = [(k, w, n) for k, t in zip(*(c.to_pylist() for c in batch.columns)) for w, n in Counter(words(t)).items() if w not in sent.value]
            if out:
                k, w, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(w, pa.string()), pa.array(n, pa.int64())], ["own_key", "word", "times"])

    # equal texts have equal words, so the key of a row is its text's hash
    held = arrow_map(docs.select(F.sha2(text, 256).alias("own_key"), text.alias("text")), others, "own_key string, word string, times long").distinct()
    more = held.join(rest, "word").groupBy("own_key").agg(F.round(F.sum(F.col("times") * F.col("gain")), 9).alias("more"))
    return sent, source.withColumn("own_key", F.sha2("own_text", 256)).join(materialize(more, "more"), "own_key", "left").drop("own_key")


def _measured(docs: DataFrame, model: Model, carried: list[str], text_col: str) -> DataFrame:
    """The ``carried`` columns of every row, and x: the normalised difference of its text's log-likelihoods; 0 without words."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    source = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], F.coalesce(F.col(text_col), F.lit("")).alias("own_text"))
    names, arrays = [f"c{i}" for i in range(len(carried))], model.arrays()
    if arrays is None:
        sent, source = _joined(docs, source, model, text_col)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(arrays)

    def from_words(batch):
        for t, more in zip(batch.column("own_text").to_pylist(), batch.column("more").to_pylist()):
            own = words(t)
            yield (sum(n * sent.value.get(w, 0.0) for w, n in Counter(own).items()) + (more or 0.0)) / max(1, len(own)) ** 0.5

    def from_strings(batch):
        texts = batch.column("own_text").to_pylist()
        for i in range(0, len(texts), 64):
            own = [words(t) for t in texts[i : i + 64]]
            sent.value.look_up(list({w: None for ws in own for w in ws}))
            add = sent.value.known.__getitem__
            yield from (sum(map(add, ws)) / max(1, len(ws)) ** 0.5 for ws in own)

    measure = from_words if arrays is None else from_strings
    del arrays

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array([*measure(batch)], pa.float64())], [*names, "x"])

    schema = ", ".join([*[f"{n} {kinds[c]}" for n, c in zip(names, carried)], "x double"])
    return arrow_map(source, run, schema).select(*[F.col(n).alias(c) for n, c in zip(names, carried)], "x")


def score(docs: DataFrame, model: Model, carried: list[str], text_col: str = "text") -> DataFrame:
    """The ``carried`` columns of every row, and score: the probability that its text is toxic.

    A null text is empty; a text without words gets the score of no evidence;
    a text of any length is judged whole. Carried columns may have any name but score.
    """
    renamed = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(carried)], F.col(text_col).alias("own_text"))
    measured = _measured(renamed, model, [f"k{i}" for i in range(len(carried))], "own_text")
    weighed = F.lit(float(model.curve[0])) + F.col("x") * float(model.curve[1])
    score = 1 / (1 + F.exp(-F.greatest(F.least(weighed, F.lit(30.0)), F.lit(-30.0))))
    return measured.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(carried)], score.alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Labels are learnt only where crc32 of the id as text is not divisible by
    FOLDS; null labels and unlabelled rows teach nothing; repeated labels of an
    id count once, as toxic if any is. A null id is not held out; repeated rows
    are scored alike, and equal scores stand side by side. Empty tables give an
    empty table. Other columns are ignored, whatever their names.
    """
    scored = score(docs, train(docs, labels, id_col, text_col), [id_col], text_col)
    held = F.coalesce(_fold(id_col) == 0, F.lit(False))
    return scored.select(
        F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
