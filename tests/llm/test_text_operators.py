"""Packing, fingerprints, quality, encoding, toxicity, personal data, pages and licences against plain versions."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from cadenza.llm import bpe, fingerprints, html_text, licenses, packing, pii, quality, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " \n\t ", "x" * 30_000, "naïve café — 東京 H̱ Σς", "it's  <|endoftext|> DON'T 12²½_\x1c\x85", "word " * 3000]


def texts(n=40, seed=1):
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdeéñ", k=random.randint(1, 7))) for _ in range(80)]
    made = [". ".join(" ".join(random.choices(vocabulary, k=random.randint(1, 30))) for _ in range(random.randint(1, 9))) for _ in range(n)]
    return made + [made[0], made[0]] + ODD


def by_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# ---------------------------------------------------------------- packing


def test_pieces_of_words_have_the_tokens_of_the_text():
    own, plain = packing.PieceEncoder(WORDS), Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    random.seed(3)
    alphabet = "aBé'sßÀ².,!_1 \t\n\x1c\xa0\x85½ªİΣσ中́H̱tTdlLREvm<|>"
    import pyarrow as pa

    made = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(2000)] + [x or "" for x in texts()]
    ids, edges = own.encode(pa.array(made))
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [e.ids for e in plain.encode_batch(made, add_special_tokens=False)]


@pytest.mark.parametrize("targets", [None, {"a": 3.0, "b": 1.0}])
def test_every_token_is_packed_once(spark, table, targets):
    made = texts()
    rows = [(i % 30 if i else None, t, "en", random.choice(["a", "a", "b", None])) for i, t in enumerate(made)]
    pieces = packing.pack(table(rows), WORDS, targets=targets, length=256, with_ids=True).collect()
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    want = Counter()
    for i, t, _, _ in rows:
        want[i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    sequences, parts = defaultdict(list), defaultdict(list)
    for x in pieces:
        ids = np.frombuffer(bytes(x.ids), "<u4")
        assert len(ids) == x.length > 0 and zlib.crc32(bytes(x.ids)) == x.ids_crc32
        sequences[x.sequence_id].append(x)
        parts[x.doc_id, x.doc_tokens].append((x.start, tuple(ids)))
    fill = {}
    for s, own in sequences.items():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        fill[s] = at
    assert sorted(fill) == list(range(len(fill)))
    assert all(n == 256 for s, n in fill.items() if s != max(fill))
    assert sum(fill.values()) == sum(len(k[1]) * n for k, n in want.items())
    for (doc, n), own in parts.items():
        if len({i for i, _ in want if i == doc}) and sum(c for (i, t), c in want.items() if i == doc and len(t) == n) == 1:
            assert (doc, tuple(x for _, p in sorted(own) for x in p)) in want
    shares = Counter()
    for x in pieces:
        if x.sequence_id < 3:
            shares[x.source] += x.length
    if targets:
        assert shares["a"] == pytest.approx(3 * shares["b"], abs=8)
    assert packing.pack(table([]), WORDS).count() == 0


def test_targets_hold_for_many_sources(spark, table, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 8)
    random.seed(12)
    rows = [(i, " ".join(random.choices(["one", "two", "three"], k=40)), "en", "a" if i % 3 == 0 else "b" if i % 3 == 1 else f"s{i}") for i in range(150)]
    pieces = packing.pack(table(rows), WORDS, targets={"a": 3.0, "b": 1.0}, length=256).collect()
    assert pieces[0].__fields__[:8] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    assert all(x.source == rows[x.doc_id][3] for x in pieces) and {x.doc_id for x in pieces} == set(range(150))
    shares = Counter()
    for x in pieces:
        if x.sequence_id < 5:
            shares[x.source] += x.length
    assert set(shares) == {"a", "b"} and shares["a"] == pytest.approx(3 * shares["b"], abs=8)
    assert sum(x.length for x in packing.pack(table(rows), WORDS, length=256).collect()) == sum(x.length for x in pieces)


# ---------------------------------------------------------------- fingerprints and quality


def test_fingerprints_estimate_likeness(spark, table):
    made = [(i * 7 % 1000, t) for i, t in enumerate(texts(60))] + [(None, "no id here at all"), (3, "one two"), (3, "one three")]
    got = fingerprints.fingerprints(table(made)).collect()
    assert len(got) == len(made)
    key = lambda r: (r[0] is None, -(r[0] or 0), (r[1] or ""))
    ordered = [(i, t or "") for i, t in sorted(made, key=key)]
    want, alike = Counter(), defaultdict(set)

    def shingles(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    true = {}
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        want[i, len(text), sha] += 1
        a, b = shingles(text), shingles(edited)
        true[i, sha] = len(a & b) / len(a | b) if a | b else 1.0
        alike[text].add(i)
    assert want == Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got)
    errors = [r.near_edited - true[r.doc_id, r.edited_sha256] for r in got]
    assert np.abs(errors).mean() < 0.03 and max(map(abs, errors)) < 0.25
    prints = defaultdict(set)
    for r in got:
        prints[r.doc_id].add(r.fingerprint)
    assert all(len(set.union(*(prints[i] for i in ids))) == 1 for t, ids in alike.items() if t and len(ids) > 1 and all(len(prints[i]) == 1 for i in ids))
    assert fingerprints.fingerprints(table([])).count() == 0
    assert fingerprints.fingerprints(table([(5, "a b c d e f")])).first().near_next == 1.0


def plain_fingerprint(text):
    """One-permutation MinHash and its densification by the definition, with the hash that Spark's xxhash64 is."""
    number = lambda v, size, seed=42: xxhash.xxh64_intdigest((v % (1 << 8 * size)).to_bytes(size, "little"), seed)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    words = [w for w in re.split(fingerprints.BLANK, text.lower()) if w]
    hashes = []
    for i in range(len(words) - 4):
        h = 42
        for w in words[i : i + 5]:
            h = number(xxhash.xxh64_intdigest(w.encode(), 42), 8, h)
        hashes.append(signed(h))
    if not hashes and words:
        hashes = [signed(xxhash.xxh64_intdigest(" ".join(words).encode(), 42))]
    if not hashes:
        return ""
    least = {}
    for h in hashes:
        least[(h >> 56) + 128] = min(h, least.get((h >> 56) + 128, h))
    out = []
    for i in range(256):
        order = [signed(number(k, 4, number(i, 4))) % 256 for k in range(fingerprints.ASKED + 1)]
        asked = [i, *order[:-1], *[(order[-1] + j) % 256 for j in range(256)]]
        found = next(least[b] for b in asked if b in least)
        out.append(number(i, 4, number(found, 8)) & 15)
    return "".join(f"{v:x}" for v in out)


def test_fingerprints_equal_their_definition(spark, table):
    random.seed(18)
    made = [" ".join(random.choices(["Ab", "cd", "ef", "é", "gh", "ij"], k=n)) for n in (0, 1, 3, 4, 5, 6, 12, 40, 200, 3000)]
    rows = list(enumerate(made))
    got = {r.doc_id: r for r in fingerprints.fingerprints(table(rows)).collect()}
    for i, text in rows:
        assert got[i].fingerprint == plain_fingerprint(text)
        follower = made[i - 1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        assert got[i].edited_fingerprint == plain_fingerprint(edited) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = got[i].fingerprint, plain_fingerprint(follower)
        agree = sum(x == y for x, y in zip(a, b)) / 256
        want = 1.0 if not a and not b else 0.0 if not a or not b else max(0.0, (agree - 1 / 16) / (1 - 1 / 16))
        assert got[i].near_next == pytest.approx(want)


def test_quality_measures_and_verdicts(spark, table):
    lines = "good line of plain words here\n" * 4 + "ends\n\n \t\n"
    junk = " ".join(f"w{i}###" for i in range(200))
    made = texts() + [lines, junk, "a b c a b c a b c d", " ".join(f"word{i}" for i in range(200))]
    rows = [(i, t, "en", "hot" if i % 3 else None) for i, t in enumerate(made)]
    got = {r.doc_id: r for r in quality.quality(table(rows)).collect()}
    for i, t in enumerate(made):
        words, seen, dup = by_words(t or ""), set(), 0
        count = Counter(zip(words, words[1:], words[2:]))
        near = {k for p in range(len(words) - 2) if count[words[p], words[p + 1], words[p + 2]] > 1 for k in (p, p + 1, p + 2)}
        for line in (t or "").split("\n"):
            if by_words(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(near),
        )
        assert r.base_failed == (len(words) < 50 or 100 * len(near) > 50 * len(words))
        assert not (r.kept and r.base_failed)
    assert got[len(made) - 1].kept and not got[len(made) - 3].kept
    assert quality.quality(table([])).count() == 0


def test_host_rates_shrink(spark):
    hosts = spark.createDataFrame([("small", 2, 2), ("bad", 1000, 950), *[(f"h{i}", 1000, 100 + i) for i in range(8)]], "host string, n long, bad long")
    rate = {r.host: r.rate for r in quality.host_rates(hosts).collect()}
    assert rate["small"] < 0.9 < rate["bad"] < 0.96


def test_sorting_by_position_equals_sorting_pairs(spark, monkeypatch):
    df = spark.createDataFrame([(" ".join(random.choices("abc", k=60)).split(),) for _ in range(20)], "w array<string>")
    packed = [r[0] for r in df.select(quality.repeated_words(df.w)).collect()]
    for bits in (1, 61):  # too many words, and hashes that the other bits don't tell apart
        monkeypatch.setattr(quality, "POSITION_BITS", bits)
        assert packed == [r[0] for r in df.select(quality.repeated_words(df.w)).collect()]


# ---------------------------------------------------------------- byte-level BPE


def test_bpe_equals_the_library(spark, table):
    ranks = bpe.read_ranks(RANKS)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made = texts() + ["a" * 700, " " * 300 + "x", "thethe" * 9]
    got = {r.doc_id: r for r in bpe.encode_documents(table(list(enumerate(made))), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, t in enumerate(made):
        ids = np.array(plain.encode_ordinary(t or ""), "<u4")
        assert bytes(got[i].ids) == ids.tobytes() and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(table([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_words_are_contracted_by_the_same_rule():
    coder = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    random.seed(4)
    words = [bytes(random.choices(b"abtheing ", k=random.randint(2, 60))) for _ in range(300)]
    words += [bytes(random.choices(b"abtheing", k=n)) for n in (65, 300, 1000)]
    words = [w for w in words if w not in coder.ranks]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(words)] == [bpe.contract(w, coder.ranks) for w in words]


# ---------------------------------------------------------------- toxicity


def test_toxicity_learns_from_the_other_folds_only(spark, table):
    random.seed(5)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        words = random.choices(vocabulary, k=random.randint(10, 120))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(random.randint(2, 5)):
                words[random.randrange(len(words))] = "zuvox" + random.choice(["", "ed", "ing", "ab", "oc"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "new zuvoxish zuvoxal words")]
    docs = table(rows)
    marks = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in range(1500))
    right = sum(got[i].predicted == labels[i][1] for i in held) / len(held)
    assert right > 0.97 and got[2002].predicted == 1 and 0 <= got[2000].score == got[2001].score < 0.5
    wrong = marks.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, wrong).collect()}
    assert all(again[i] == pytest.approx(got[i].score) for i in held)
    assert toxicity.toxicity(table([]), marks).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, marks.where("toxic = 0")).collect()} == {0}


def plain_gain(word, counts):
    """The gain of a word by the definition: two Kneser-Ney models over the continuation counts of both."""
    d, size = toxicity.DISCOUNT, toxicity.ORDER
    continued = {size - 1: Counter(g[1:] for g in counts)}
    for k in range(size - 2, 0, -1):
        continued[k] = Counter(u[1:] for u in continued[k + 1])

    def shared(u):
        if not u:
            return 1 / (len(continued[1]) + 1)
        behind = {v: n for v, n in continued[len(u)].items() if v[:-1] == u[:-1]}
        if not behind:
            return shared(u[1:])
        return (max(behind.get(u, 0) - d, 0) + d * len(behind) * shared(u[1:])) / sum(behind.values())

    def probability(g, c):
        behind = {v: n[c] for v, n in counts.items() if v[:-1] == g[:-1] and n[c]}
        if not behind:
            return shared(g[1:])
        return (max(behind.get(g, 0) - d, 0) + d * len(behind) * shared(g[1:])) / sum(behind.values())

    padded = "^" * (size - 1) + word + "$"
    return sum(np.log(probability(g, 0) / probability(g, 1)) for g in (padded[i : i + size] for i in range(len(word) + 1)))


def test_model_keeps_all_counts_and_all_words(spark, table, monkeypatch):
    random.seed(15)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(120)]
    rows, labels = [], []
    for i in range(600):
        words = random.choices(vocabulary, k=30)
        rows.append((i, " ".join(words + ["zuvox"] * (i % 6 == 0))))
        labels.append((i, int(i % 6 == 0)))
    docs, marks = table(rows + [(700, rows[1][1]), (701, "zuvoxy québec 東京 " + "ab" * 40)]), spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "CURVE_ROWS", 50)
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    model = toxicity.train(docs, marks)
    curve = sorted((i for i, _ in labels if crc(i) == 1))
    counts = defaultdict(lambda: [0, 0])
    asked = spark.createDataFrame([(i,) for i in curve], "i long").selectExpr("i", "xxhash64(i) h").orderBy("h").limit(50).collect()
    aside = {r.i for r in asked}
    assert len(curve) > 50
    for i, text in rows:
        if crc(i) and i not in aside:
            for w in text.split():
                for g in toxicity.grams(w):
                    counts[g][i % 6 != 0] += 1
    assert {r.s for r in model.strings.collect()} == set(counts) | {g[:-1] for g in counts}
    some = ["zuvox", "zuvoxy", "québec", "東京", "ab" * 40, *vocabulary[:10]]
    want = {w: plain_gain(w, counts) for w in {*some, *rows[0][1].split()}}
    gains = {r.word: r.gain for r in toxicity._gains(docs.selectExpr("text"), model).collect()}
    for w, sent in zip(some, model.arrays().gains(some)):
        assert gains[w] == pytest.approx(want[w], abs=1e-6) and sent == pytest.approx(want[w], abs=1e-6)
    scores = {(r.doc_id, round(r.score, 6)) for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    own = rows[0][1].split()
    x = sum(np.log(1 - toxicity.SHARE + toxicity.SHARE * np.exp(want[w])) for w in own) / len(own) ** 0.5
    assert (0, round(1 / (1 + np.exp(-np.clip(model.curve[0] + model.curve[1] * x, -30, 30))), 6)) in scores
    monkeypatch.setattr(toxicity, "STRINGS", 0)
    monkeypatch.setattr(toxicity, "SENT", 20)
    assert scores == {(r.doc_id, round(r.score, 6)) for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert len(scores) == 602


# ---------------------------------------------------------------- personal data


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_formats_match_plain_patterns():
    random.seed(6)
    alphabet = "ab1.2@+-_ 5(0)é"
    for _ in range(20_000):
        text = "".join(random.choices(alphabet, k=random.randint(1, 40)))
        assert plain_spans(text) == pii.base_spans(text)
    cards = ["4532 0151 1283 0366", "4532015112830366", "4532015112830367", "4532-0151-1283-0366 1", "+1 (504) 555-2652", "1.2.3.4.5.6.7.8", "300.1.1.1", "007.1.1.1"]
    for text in cards:
        assert plain_spans(text) == pii.base_spans(text)
    assert pii.base_spans("1" * 200_000 + "." * 1000 + "a" * 200_000) == []


def test_at_signs_take_linear_time():
    for part in ("x@ ", "@", "a", "x@y", "x@y.", "aa@a.b "):
        text = part * (10_000_000 // len(part)) + "@"
        began = time.perf_counter()
        list(pii.emails(text))
        assert time.perf_counter() - began < 15  # quadratic: hours


def test_patterns_find_identifiers_that_no_format_knows(spark, table):
    random.seed(7)
    filler = lambda: " ".join(random.choices(["lorem", "ipsum", "dolor", "sit"], k=8))
    rows = [(i, f"{filler()} mail: user{i}@example{i}.com {filler()}") for i in range(40)]
    rows += [(100 + i, f"{filler()} mail: user{i}@localhost {filler()}") for i in range(3)]
    rows += [(200 + i, f"{filler()} chapter {1000 + i} {filler()}") for i in range(40)] + [(300, None), (301, ""), (302, filler())]
    got = {r.doc_id: r for r in pii.personal_data(table(rows), ["doc_id"]).collect()}
    for i, t in rows:
        base = plain_spans(t or "")
        assert got[i].n_email == sum(k == "email" for k, _, _ in base)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert all("email:" in got[100 + i].spans and "<EMAIL>" in got[100 + i].redacted for i in range(3))
    assert all(got[200 + i].spans == "" and got[200 + i].redacted == rows[43 + i][1] for i in range(40))
    assert got[300].spans == "" and pii.personal_data(table([]), ["doc_id"]).count() == 0


def test_no_trusted_pattern_is_dropped(spark, table):
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    n = 3400  # three patterns each
    rows = [(i, "\n".join(f"w{letters(i)} q{letters(i)} u{i}x{k}@example.com z{letters(i)}" for k in range(6))) for i in range(n)]
    trusted = {r.pattern: r.kind for r in pii.patterns_table(table(rows)).collect()}
    assert len(trusted) > 10_000
    assert all(f"LR q{letters(i)} _ z{letters(i)} | 9a" in trusted for i in range(n))


def plain_trusted(texts):
    """The trusted patterns by the definition: dictionaries in place of tables."""
    kind_of, own = {}, defaultdict(set)
    for text in texts:
        for kind, a, b, found in pii.mentions(text or "", pii.seeds(text or "")):
            for p in found:
                kind_of[p, text[a:b]] = max(kind, kind_of.get((p, text[a:b]), ""))
                own[p].add(text[a:b])
    own = {p: values for p, values in own.items() if len(values) >= pii.SUPPORT}
    edges = [(p, v, kind_of[p, v]) for p, values in own.items() for v in values]
    belief = {(p, v, k): float(seed == k) for p, v, seed in edges for k in pii.KINDS}

    def means():
        return {(p, k): sum(belief[p, v, k] for v in values) / (len(values) + pii.DOUBT) for p, values in own.items() for k in pii.KINDS}

    for _ in range(pii.ROUNDS):
        score, joint = means(), defaultdict(lambda: 1.0)
        for p, v, seed in edges:
            for k in pii.KINDS:
                if not seed and score[p, k] > 0.05:
                    joint[v, k] *= 1 - min(score[p, k], 0.999)
        belief = {(p, v, k): float(seed == k) if seed else 1 - joint[v, k] for p, v, seed in edges for k in pii.KINDS}
    score = means()
    sure = lambda p, k: sum(belief[p, v, k] >= pii.CONFIDENCE for v in own[p])
    return {p: (k, score[p, k]) for p in own for k in pii.KINDS if score[p, k] >= pii.CONFIDENCE and sure(p, k) >= pii.SUPPORT}


def test_patterns_equal_their_definition(spark, table):
    random.seed(19)
    number = lambda: "".join(random.choices("0123456789", k=9))
    made = [f"{random.choice(['call', 'ring'])} {random.choice(['me', 'us'])} {random.choice(['at', 'on'])} {random.choice(['+' + number(), number(), '020 ' + number()[:4] + ' 0958'])} today" for _ in range(150)]
    made += [f"id {number()} of {random.choice(['x', 'y'])}" for _ in range(40)] + [f"write to u{i}@mail.example.com now" for i in range(12)] + [None, ""]
    trusted = pii.patterns_table(table(list(enumerate(made))))
    got = {r.pattern: (r.kind, r.p) for r in trusted.collect()}
    want = plain_trusted(made)
    assert got.keys() == want.keys() and len(want) > 5
    assert all(got[p][0] == want[p][0] and got[p][1] == pytest.approx(want[p][1]) for p in want)


def test_patterns_that_are_joined_find_the_same(spark, table, monkeypatch):
    random.seed(20)
    made = [f"Dial the number +{random.randint(10**9, 10**10)} for x." for _ in range(30)] + ["Dial the number 5550-12345 for x.", "Dial the number 020 7946 0958 for x.", None, "", "Dial the number 5550-12345 for x."]
    docs = table([(i % 31 if i else None, t) for i, t in enumerate(made)])
    sent = sorted(map(str, pii.personal_data(docs, ["doc_id", "lang"]).collect()))
    assert sum("phone:" in x for x in sent) == 33 and any("<PHONE> for" in x for x in sent)
    monkeypatch.setattr(pii, "SENT", 0)
    assert sent == sorted(map(str, pii.personal_data(docs, ["doc_id", "lang"]).collect()))


def test_long_neighbours_are_read_whole():
    x, y, z, w = ("x" * 300, "y" * 300, "z" * 100, "w" * 90)
    text = f"{x} {y} {z} a1@b.cd {w} 020 7946 0958 e"
    found = [(text[a:b], own) for _, a, b, own in pii.mentions(text, pii.seeds(text))]
    assert found == [("a1@b.cd", [f"L {z} | 9a", f"LL {y} {z} | 9a", f"LR {z} _ {w} | 9a"]), ("020 7946 0958", [f"L {w} | 9", f"LL @ {w} | 9", f"LR {w} _ e | 9"])]
    assert pii.seeds("password = '" + "a1" * 500 + "'")[0][2] > 1000
    began = time.perf_counter()
    for part in ("a@b.cd,", "1" * 9 + " ", "x1@", "+1 2 3 4 5 6 7 8 ", "p='a1" + "b" * 20 + "' "):
        pii.find_spans(part * 30_000, {"L x | 9": ("phone", 0.9)})
    assert time.perf_counter() - began < 30  # quadratic: hours


def test_redaction_joins_overlaps():
    assert pii.redact("ab12345cd", [("card", 2, 5), ("phone", 3, 7)]) == "ab<CARD>cd"


# ---------------------------------------------------------------- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href=/x>Menu</a></ul></nav><div class="cookie-notice">Accept</div>
<div id=main><article><h1>Head &amp; line</h1><p>First  <b>bold</b>
text<br>next.<p>Second &lt;p&gt; &eacute; 1 < 2.</p><!-- gone > --><form>Ask<input></form><div class="share">Share</div>
<ul><li>One<li>Two</ul><table><tr><td>A<td>B</table><section class="comments"><p>Nice post, really, yes.</p></section></article></div>
<aside>Other</aside><footer>End</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line First bold text next. Second <p> é 1 < 2. One Two A B"
    plain = "<div class=menu><a href=a>x</a></div><div class=c><p>Long text, with some words. And more.</p><p>Short</p></div><div><a href=b>Link one</a> <a>two</a></div>"
    assert html_text.main_text(plain) == "Long text, with some words. And more. Short"
    for broken in ("", "<", "<p", "<p>x", "<!-- x", "<script>a", "</p>", "&#xZZ;", "<p attr='>x", "<" * 5000, "<div>" * 3000 + "x"):
        html_text.main_text(broken)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout has-sidebar"><nav>m</nav><article><p>A text, and more.</p></article></div>', "A text, and more."),
        ('<article class="post ad-free"><p>A text, and more.</p></article>', "A text, and more."),
        ("<p>Some <label>word</label> here", "Some word here"),
        ("<form><nav>x</nav><div><h1>T</h1><p>A text, in a form around everything.</p></div></form>", "T A text, in a form around everything."),
        ("<p>1 < 2 <", "1 < 2 <"),
        ("<nav><a href=x>Home</a></nav><div class=ad>Buy it, now.</div><article></article>", ""),
        ("<div><p>" + "Words, of a page. " * 20 + "</p></div><div class=comments>" + "<article><p>A comment, rather long. And more of it.</p></article>" * 30 + "</div>", ("Words, of a page. " * 20).strip()),
        ("<article><p>" + "Words, of a page. " * 9 + "</p><p class=share-price>" + "Shares rose, they say. " * 9 + "</p><p class=share>Share</p></article>", ("Words, of a page. " * 9 + "Shares rose, they say. " * 9).strip()),
    ],
)
def test_words_of_classes_do_not_decide(page, text):
    assert html_text.main_text(page) == text


ARTICLE = "".join(f"<p>Sentence {k} of the article, with words, commas, and a stop. Another one, a little longer.</p>" for k in range(22))
TEXT = " ".join(f"Sentence {k} of the article, with words, commas, and a stop. Another one, a little longer." for k in range(22))
ABOUT = "<div class=about><p>" + "About this site, and what it is. " * 7 + "</p></div>"


@pytest.mark.parametrize("name", ["sidebar-right", "container comments-open", "menu-open", "cookie-banner-shown", "single-nav", "ad", "comments"])
def test_words_around_an_article_never_remove_it(name):
    assert html_text.main_text(f"<div class='{name}'><article>{ARTICLE}</article></div>{ABOUT}").startswith(TEXT)


def test_articles_in_containers_with_any_words():
    """Generated layouts: whatever the containers of the only article call themselves, it stays, and what lies beside it goes."""
    rng = random.Random(23)
    words = sorted(html_text.STRONG) + sorted(html_text.WEAK) + ["right", "open", "single", "has", "grid", "row"]
    for _ in range(200):
        inner = f"<article class='{rng.choice(['', 'post', 'recipe-menu', 'story ad-free'])}'>{ARTICLE}</article>"
        for _ in range(rng.randint(1, 4)):
            name = "-".join(rng.sample(words, 2))  # another path than those of what is beside
            beside = rng.choice(["", "<div class=comments><p>A comment, of a reader.</p></div>", "<div class=ad>Buy now.</div>", "<nav><a href=x>Home</a></nav>"])
            inner = rng.choice([f"<div class='{name}'>{inner}{beside}</div>", f"<section id='{name}'>{beside}{inner}</section>"])
        assert html_text.main_text(f"<body>{inner}</body>") == TEXT


def test_blocks_of_an_article_stay():
    inner = (
        "<p class='ad-hoc'>An ad hoc remark.</p><h2 class='menu-title'>Starters</h2><p class=notice-board>On the board.</p><h2>References</h2>"
        "<ul><li><a href=x>First work, 1999</a></li><li><a href=y>Second work</a></li></ul><p>Press <button>OK</button> to go on.</p>"
    )
    gone = "<div class=ad>Buy now!</div><div class=ad-slot>Buy.</div><div class=comments><p>Nice one.</p></div><div class=user-comments><p>Mine.</p></div><form><button>Send</button></form>"
    found = html_text.main_text(f"<nav><a href=a>Home</a></nav><article>{ARTICLE}{inner}{gone}</article><div id=comments><article class=comment><p>I agree.</p></article></div>")
    assert found == TEXT + " An ad hoc remark. Starters On the board. References First work, 1999 Second work Press OK to go on."


def test_an_article_that_calls_itself_a_comment_is_none():
    page = "<div><p>" + "Words, of a page. " * 20 + "</p></div><div id=talk class=comments><article class=comment><p>" + "A comment, rather long, indeed. " * 40 + "</p></article></div>"
    assert html_text.main_text(page) == ("Words, of a page. " * 20).strip()


def test_long_pages_take_linear_time():
    for part in ("<b>x", "<a ", "<div>x", "<p>x", "</b>x<i>", '<a x="', "<!-- ", "<div class=ad>x", "<li>x<ul>"):
        began = time.perf_counter()
        html_text.main_text(part * 100_000)
        assert time.perf_counter() - began < 10  # quadratic: hours


def plain_text(page):
    """The selection by its definition, over tuples of (tag, class) and with no regard to time. For pages with plain markup only."""
    blocks, stack, times = [], [], Counter()
    for tag, name, text in re.findall(r"<(/?\w+)(?: class=(\w+))?>|([^<]+)", page):
        if text:
            path = tuple(x for x in stack if x[0] != "a")
            if not any(t == "nav" for t, _ in stack):
                if blocks and blocks[-1][3] and blocks[-1][0] == path:
                    blocks[-1][1] += text
                    blocks[-1][2] += len(text) * (stack[-1][0] == "a")
                else:
                    blocks.append([path, text, len(text) * (stack[-1][0] == "a"), True])
        elif tag[0] == "/":
            stack.pop()
        else:
            stack.append((tag, name))
            times[tuple(x for x in stack if x[0] != "a")] += tag != "a"
        if tag and tag.strip("/") != "a" and blocks:
            blocks[-1][3] = False
    order = list(dict.fromkeys(b[0] for b in blocks))
    of = lambda p: [b for b in blocks if b[0] == p]
    size = {p: sum(len(t) for _, t, _, _ in of(p)) for p in order}
    share = {p: sum(k for _, _, k, _ in of(p)) / size[p] for p in order}
    own = [sum(len(t) + 10 * sum(c in ".,;:!?" for c in t) for _, t, _, _ in of(p)) / len(of(p)) * (1 - share[p]) ** 2 for p in order]
    smooth = {p: max(0, own[i] + 0.25 * sum(own[j] - own[i] for j in (i - 1, i + 1) if 0 <= j < len(own))) for i, p in enumerate(order)}
    absolved = set()
    left_out = lambda p: any(p[k][1] == "comments" and p[: k + 1] not in absolved for k in range(len(p)))
    articles, outside, seen = Counter(), sum(smooth[p] * size[p] for p in order if not left_out(p)), list(times)
    stands = False
    for p in order:
        for k in range(len(p), 0, -1):
            if p[k - 1][1] == "comments":
                break
            if p[k - 1][0] == "article":
                stands = stands or not left_out(p)
                if times[p[:k]] == 1:
                    articles[p[:k]] += smooth[p] * size[p]
    if articles and not stands:
        chief = max(articles, key=lambda c: (articles[c], -seen.index(c)))
        if articles[chief] >= outside:
            absolved = {chief[:k] for k in range(1, len(chief) + 1)}
    low = lambda p: 0.4 ** sum(name == "notice" for _, name in p)
    rated = {p: 0 if left_out(p) else smooth[p] * low(p) for p in order}
    under = lambda c: [p for p in order if p[: len(c)] == c]
    weight = lambda c: sum(rated[p] * size[p] for p in under(c))
    chars = lambda c: sum(size[p] for p in under(c) if not left_out(p))
    children = lambda c: list(dict.fromkeys(p[: len(c) + 1] for p in order if len(p) > len(c) and p[: len(c)] == c and not left_out(p)))
    if sum(rated[p] * size[p] for p in order) <= 0.02 * sum(smooth[p] * size[p] for p in order):
        return None
    best = ()
    while not best or best[-1][0] != "article":
        inner = [c for c in children(best) if children(c)]
        below = max(inner, key=weight, default=None)
        if below is None or weight(below) < 0.8 * weight(best):
            break
        best = below
    ratio = lambda c: weight(c) / chars(c)
    beside = [c for k in range(len(best)) for c in children(best[:k]) if c != best[: k + 1] and c[-1][1] != "notice" and (ratio(c) >= 0.5 * ratio(best) or c[-1][0] == "h1")]

    def kept(p):
        inside = any(p[: len(c)] == c for c in [best, *beside]) or (p == best[: len(p)] and rated[p] >= 0.5 * ratio(best))
        linked = best and best[-1][0] == "article" and p[: len(best)] == best
        return inside and not left_out(p) and (share[p] <= 0.6 or linked) and (low(p) == low(best) or rated[p] >= 0.2 * ratio(best))

    return " ".join(b[1] for b in blocks if kept(b[0]))


def test_selection_equals_its_definition():
    random.seed(17)
    sentence = lambda: "".join(random.choices("abcdef", k=random.randint(3, 40))) + random.choice(["", ".", ", and x.", "!"])

    def part(depth):
        kind = random.random()
        if depth > 4 or kind < 0.45:
            text = sentence() if random.random() < 0.8 else f"<a>{sentence()}</a>"
            return f"<p>{text}</p>" if random.random() < 0.9 else f"<h1>{text}</h1>"
        tag = random.choice(["div", "div", "section", "article", "nav"])
        name = random.choice(["", "", "", " class=x", " class=comments", " class=notice"])
        return f"<{tag}{name}>{''.join(part(depth + 1) for _ in range(random.randint(1, 4)))}</{tag}>"

    compared = 0
    for _ in range(3000):
        page = "".join(part(0) for _ in range(random.randint(1, 4)))
        want = plain_text(page)
        if want is not None:
            assert html_text.main_text(page) == want, page
            compared += bool(want)
    assert compared > 1000


def test_pages_frame(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 6), (1, "u", PAGE, 5), (None, "", "<p>x</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- licences


def test_licence_places(spark, table):
    made = texts() + [
        "Under the GNU  General-Public_License; MIT license, Mit LICENSE.", "cc by cc by-nc", "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nx",
        "admit license", "gnu general public apache license", "// SPDX-License-Identifier: Foo-1.0 WITH",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(list(enumerate(made)))).collect()}
    for i, t in enumerate(made):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places, found = [], set()
        for phrase, label in licenses.BASE.items():
            own = phrase.split()
            for p in range(len(words) - len(own) + 1):
                if words[p : p + len(own)] == own:
                    places.append(p)
                    found.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)),
        )
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1
    n = len(made) - 6
    assert got[n + 2].labels == "apache,gpl,mit" and got[n + 2].score == 0.9 and got[n + 5].labels == "foo-1.0"
    assert licenses.scan_licenses(table([])).count() == 0


@pytest.mark.parametrize(
    ("text", "labels", "freedom"),
    [("MIT", {"mit"}, 1.0), ("MIT AND (GPL-3.0-or-later OR Apache-2.0)", {"mit", "gpl", "apache"}, 0.9), ("GPL-2.0 WITH Classpath-exception-2.0 */", {"gpl"}, 0.5),
     ("MIT OR", {"mit"}, 1.0), ("AND", set(), 1.0), ("", set(), 1.0), ("LGPL-2.1 and MIT or CC0-1.0", {"lgpl", "mit", "cc0"}, 1.0)],
)
def test_expressions(text, labels, freedom):
    assert licenses.evaluate(text) == (labels, freedom)


def test_long_expressions_are_read_whole():
    names = [f"Foo-{i}" for i in range(20_000)]
    found = licenses.scan(f"SPDX-License-Identifier: {' OR '.join(names)} AND (MIT OR GPL-2.0) see below MPL-2.0\nISC")
    assert set(found[5].split(",")) == {*map(str.lower, names), "mit", "gpl"}
    assert licenses.scan(f"SPDX-License-Identifier: {' AND '.join(['MIT'] * 300)} AND GPL-2.0")[5:] == ("gpl,mit", 0.5)


def test_longest_beginning_that_parses():
    random.seed(16)
    for _ in range(5000):
        tokens = random.choices(["(", ")", "and", "or", "with", "mit"], k=random.randint(0, 9))

        def parses(n):
            try:
                return bool(licenses.postfix(tokens[:n]))
            except ValueError:
                return False

        assert licenses._parsable(tokens) == max((n for n in range(1, len(tokens) + 1) if parses(n)), default=0)
