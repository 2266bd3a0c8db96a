"""Source divergence, ranked search and the Jaccard join against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from cadenza.llm import divergence, jaccard, oracles, search

WORDS = [f"w{k}" for k in range(400)] + ["Été", "été", "ÉTÉ", "Straße", "日本"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, n int, score string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Null columns, empty and repeated texts, ties, a very long text, a language and a source without terms."""
    rng = random.Random(3)
    rows = [(k, sentence(rng, rng.randint(1, 60)), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", None])) for k in range(60)]
    rows += [(60, "The the THE tea-time 12", "en", "a"), (61, "the the the tea time", "en", "b"), (62, "The tea", "en", "b"), (63, None, "en", "c"), (64, "", "fr", "a"), (65, "9 9", "fr", "b")]
    rows += [(66, sentence(rng, 20_000), "de", "a"), (None, "the tea", None, None), (1, rows[1][1], "en", "a"), (1, rows[1][1], "en", "a")]
    return rows


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    relation = con.sql(sql)
    return relation.columns, sorted(tuple(r) for r in relation.fetchall())


def frame(rows, columns):
    found = pd.DataFrame(rows, columns=columns)
    return found.astype({c: "Int64" for c in columns if c.endswith("_id")} | {c: "string" for c in columns if not c.endswith("_id")})


def test_divergence_equals_its_sql(spark, table, odd_rows):
    columns, expected = by_sql(oracles.OP11, documents=frame(odd_rows, ["doc_id", "text", "lang", "source"]))
    found = divergence.divergence(table(odd_rows, SCHEMA))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.select(*columns).collect()) == expected
    pairs = {(r.lang, r.source, r.item): r.value for r in found.where("part = 'pair'").collect()}
    assert pairs[("fr", "a", "b")] == 0 and ("en", "c", "a") in pairs  # a language that keeps no term, a source without one


def test_divergence_of_no_documents(table):
    assert divergence.divergence(table([], SCHEMA)).count() == 0


def test_shares_are_whole_numbers_beyond_a_long(spark):
    rows = spark.createDataFrame([(9_000_000_001_000, 9_000_000_002_000, 5), (3, 7, 2)], "c long, n long, v long")
    found = [r[0] for r in rows.select(divergence.share(rows.c, rows.n, rows.v)).collect()]
    assert found == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in [(9_000_000_001_000, 9_000_000_002_000, 5), (3, 7, 2)]]


def plain_ranks(docs, items, k=10):
    terms = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").encode().lower())
    tallies = [(i, Counter(terms(t))) for i, t in docs]
    tallies = [(i, c) for i, c in tallies if c]
    n_docs, total = len(tallies), sum(sum(c.values()) for _, c in tallies)
    df = Counter(t for _, c in tallies for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for doc, tally in tallies:
            m = 100 - 90 + (90 * sum(tally.values()) * n_docs) // total
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * ((10**9 * tally[t]) // (1000 * tally[t] + 8 * m)) for t in own if t in tally)
            if score > 0:
                scored.append((-score, -1 if doc is None else doc))
        out += [(item, rank + 1, None if d < 0 else d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("terms, sent", [(200_000, 500_000), (0, 0)])
def test_search_equals_scoring_every_document(spark, table, odd_rows, monkeypatch, terms, sent):
    """With a restricted index and tables that are sent, and with every term indexed and tables that are joined."""
    monkeypatch.setattr(search, "TERMS", terms)
    monkeypatch.setattr(search, "FIRST", 1)
    rng = random.Random(5)
    items = [(k, sentence(rng, 8)) for k in range(6)] + [(7, None), (8, "zzz ---"), (9, "THE tea"), (9, "w1"), (None, "été w3 w3")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = search.search(table(odd_rows, SCHEMA), asked, block=4, sent=sent)
    assert sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_ranks([r[:2] for r in odd_rows], items)


def test_search_leaves_blocks_unscored(spark, table, monkeypatch):
    """Blocks whose bound is below the threshold are not scored; equal scores are ordered by id."""
    rows = [(k, "common words everywhere" + (" rare" if 20 <= k < 40 else "")) for k in range(400)]
    rounds = []
    stored = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, tag: rounds.append(stored(df, tag)) or rounds[-1] if tag == "round" else stored(df, tag))
    found = search.search(table(rows, SCHEMA), spark.createDataFrame([(1, "rare common")], "item_id long, text string"), block=4)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == list(range(20, 30))
    assert sum(r.count() for r in rounds) < 100


def test_search_of_nothing(spark, table):
    none = spark.createDataFrame([], "item_id long, text string")
    assert search.search(table([], SCHEMA), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert search.search(table([(1, "a")], SCHEMA), none).count() == 0


def plain_components(rows, width=4, percent=85):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        least[find(k)] += [] if doc is None else [doc]
    return sorted(((doc, len(sets[k]), min(least[find(k)], default=None)) for k, (doc, _) in enumerate(rows)), key=str)


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"e{rng.randint(0, 10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_rows():
    """Chains and stars of near copies, copies, a line that many documents share, short and empty texts."""
    rng = random.Random(11)
    rows, base = [], [f"b{k}" for k in range(150)]
    rows += [edited(rng, base, n) for n in (0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8) for _ in range(4)]
    chain = [f"c{k}" for k in range(100)]
    for k in range(8):
        chain[12 * k % 100] = f"d{k}"
        rows.append(" ".join(chain))
    line = " ".join(f"l{k}" for k in range(40))
    rows += [f"{line} {sentence(rng, rng.randint(1, 30))}" for _ in range(40)] + [line, line.upper(), f"{line} x"]
    rows += ["one two", "One  two", "one two three", "one two three four", None, "", " \t\n", "a b c d a b c d a b c d", "a b c d a b c d"]
    rows += [sentence(rng, 4000), rows[0], rows[0]]
    rng.shuffle(rows)
    return [(None if k % 17 == 5 else 3 * k % 101 + 200 * (k // 101), text) for k, text in enumerate(rows)]


@pytest.mark.parametrize("tile, sent, window", [(2000, 1_000_000, 1 << 20), (3, 0, 500)])
def test_jaccard_equals_all_pairs(spark, table, near_rows, monkeypatch, tile, sent, window):
    """With tables that are sent and one tile a shingle, and with joins, tiles of three groups and many windows of repeats."""
    monkeypatch.setattr(jaccard, "WINDOW", window)
    found = jaccard.jaccard_components(table(near_rows, SCHEMA), tile=tile, sent=sent)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_components(near_rows)


@pytest.mark.parametrize("tile, small", [(2, 64), (2, 1), (2000, 64), (2000, 1)])
def test_tiles_meet_every_pair_of_components(spark, monkeypatch, tile, small):
    """Groups of one shingle: each pair of different components that passes the filters, once, however many blocks there are."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(2)
    groups = [(k, rng.choice([10, 11, 12]), 0, 7, rng.choice([1, 1, 1, 2, 3, 4])) for k in range(30)]
    met = spark.createDataFrame([g[:4] for g in groups], "gid long, n long, pos int, token long")
    part = spark.createDataFrame([(g[0], g[4]) for g in groups], "gid long, part long")
    found = [tuple(r) for r in jaccard._tile_pairs(jaccard._tiles(met, part, tile), 85).collect()]
    near = lambda x, y: 100 * min(x, y) >= 85 * max(x, y) and 185 * min(x, y) >= 85 * (x + y)
    assert sorted(found) == [(a[0], b[0]) for a in groups for b in groups if a[0] < b[0] and a[4] != b[4] and near(a[1], b[1])]


def test_bitmaps_rule_out_no_similar_pair():
    rng = np.random.default_rng(8)
    out = 0
    for n in (1, 2, 7, 40, 300, 2000):
        for share in (0.5, 0.7, 0.8, 0.9, 0.95, 1.0):
            for _ in range(20):
                whole = rng.integers(0, 1 << 63, n, np.int64).view(np.uint64)
                a, b = (np.unique(np.concatenate((whole[: int(share * n)], rng.integers(0, 1 << 63, n - int(share * n), np.int64).view(np.uint64)))) for _ in range(2))
                possible = jaccard.can_be_similar(jaccard.bitmap(a), len(a), jaccard.bitmap(b), len(b))
                assert possible or not jaccard.similar(a, b)
                out += not possible
    assert out > 200


def test_jaccard_of_nothing(table):
    assert jaccard.jaccard_components(table([], SCHEMA)).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_components(table([(4, None)], SCHEMA)).collect()] == [(4, 0, 4)]


def test_shingles_are_distinct_word_sequences():
    assert len(jaccard.shingles(b"a b c d a b c d")) == 4 and len(jaccard.shingles(b" a\tB ")) == 1
    assert np.array_equal(jaccard.shingles(b"A b"), jaccard.shingles(b"a  B"))
    assert not set(jaccard.shingles(b"a b c").tolist()) & set(jaccard.shingles(b"a b c d").tolist())
