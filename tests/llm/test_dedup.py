"""SimHash near-duplicates, components and repeat removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

from cadenza.llm import simhash, suffix_dedup
from cadenza.llm.components import connected_components


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_fingerprint(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def test_every_pair_within_the_radius_meets_in_a_table():
    random.seed(1)
    for shift in (0, 3):
        masks = simhash.covering_masks(4, shift)
        assert len(masks) == 31
        for _ in range(3000):
            differ = sum(1 << i for i in random.sample(range(64), random.randint(1, 4)))
            assert any(differ & m == 0 for m in masks)


def test_large_buckets_keep_their_groups():
    random.seed(2)
    centre = random.getrandbits(64)
    near = {centre ^ sum(1 << i for i in random.sample(range(64), random.randint(0, 3))) for _ in range(400)}
    far = {random.getrandbits(64) for _ in range(200)}
    values = np.array(sorted(near | far), np.uint64)
    want = roots([(a, b) for a in values.tolist() for b in values.tolist() if (a ^ b).bit_count() <= 4], values.tolist())
    edges = [(int(a), int(b)) for x, y in simhash.spanning_edges(values, 4) for a, b in zip(x, y)]
    assert len(edges) < len(values)
    assert roots(edges, values.tolist()) == want
    old, simhash.LARGE_BUCKET = simhash.LARGE_BUCKET, 10
    try:
        edges = [(int(a), int(b)) for x, y in simhash.bucket_edges(values, 4) for a, b in zip(x, y)]
    finally:
        simhash.LARGE_BUCKET = old
    assert roots(edges, values.tolist()) == want


def test_components_of_chains_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links for n in (a, b)}
    assert found == roots(links, nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(spark, table):
    random.seed(3)
    vocabulary = ["".join(random.choices("abcdefg", k=4)) for _ in range(60)]
    texts = [" ".join(random.choices(vocabulary, k=random.randint(1, 60))) for _ in range(40)]
    for t in list(texts[:20]):
        words = t.split()
        for _ in range(3):
            copy = list(words)
            copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "", None, " \n\t", "É a b", "x" * 50_000]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, texts[0]), (1, texts[0])]
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(table(rows)).collect()]
    assert len(got) == len(rows)
    prints = [(i, brute_fingerprint(t or "")) for i, t in rows]
    assert Counter(prints) == Counter((i, f) for i, f, _ in got)
    fps = {f for _, f in prints}
    root = roots([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4], fps)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(c == least.get(root[f]) for _, f, c in got)
    assert simhash.near_duplicates(table([])).count() == 0


def brute_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(x[p : p + length] for x in data for p in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if count[x[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def planted_texts():
    random.seed(4)
    fresh = lambda n: "".join(random.choices("abcdé fghij\n", k=n))
    passage, page = fresh(450), fresh(3000)
    texts = [fresh(random.randint(0, 2000)) + passage + fresh(random.randint(0, 900)) for _ in range(25)]
    for _ in range(25):  # near copies: groups of many names
        copy = list(page)
        for _ in range(random.randint(1, 3)):
            copy[random.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    texts += [page, page, page, None, "", "a" * 399, "b" * 400, "b" * 400, "c" * 401, "d" * 5000, fresh(399) * 2, fresh(400) * 3, "é" * 300]
    return texts + [fresh(6000) for _ in range(5)]


def test_repeats_match_brute_force(spark, table):
    texts = planted_texts()
    want = brute_removal(texts, suffix_dedup.LENGTH)
    found = suffix_dedup.remove_repeats(table(list(enumerate(texts))), ["doc_id", "fp"], with_text=True)
    rows = {r.doc_id: r for r in found.collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (rows[i] for i in range(len(texts)))] == want
    assert sum(x[1] for x in want) > 10_000
    assert all(len(r.kept_text.encode()) <= r.n_bytes - r.n_removed for r in rows.values())
    assert suffix_dedup.remove_repeats(table([]), ["doc_id"]).count() == 0


def test_two_lengths_at_once(spark, table):
    texts = planted_texts()
    want, lesser = brute_removal(texts, suffix_dedup.LENGTH), brute_removal(texts, suffix_dedup.PASSAGE)
    found = suffix_dedup.remove_repeats(table(list(enumerate(texts))), ["doc_id", "source"], passage=suffix_dedup.PASSAGE)
    assert found.columns == ["doc_id", "source", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"]
    rows = {r.doc_id: r for r in found.collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (rows[i] for i in range(len(texts)))] == want
    assert [rows[i].n_passage for i in range(len(texts))] == [x[1] for x in lesser]
    assert suffix_dedup.remove_repeats(table([]), ["doc_id"], passage=200).count() == 0


def kept_copies(texts, length):
    """What is left of each text if of equal strings only the one at the least (hash of the text, start) stays."""
    data = {(t or "").encode() for t in texts}
    first = {}
    for x in data:
        for p in range(len(x) - length + 1):
            place = (*suffix_dedup.identity(x), p)
            first[x[p : p + length]] = min(first.get(x[p : p + length], place), place)
    out = {}
    for x in data:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if first[x[p : p + length]] != (*suffix_dedup.identity(x), p):
                gone[p : p + length] = True
        out[x] = hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()
    return [out[(t or "").encode()] for t in texts]


def test_one_copy_stays(spark, table):
    texts = planted_texts()
    for length in (200, 400):
        found = suffix_dedup.remove_repeats(table(list(enumerate(texts))), ["doc_id"], length=length, keep=True)
        rows = {r.doc_id: r.kept_sha256 for r in found.collect()}
        assert [rows[i] for i in range(len(texts))] == kept_copies(texts, length)


def test_both_ways_to_compare_agree(spark, table):
    source = table(list(enumerate(planted_texts()))).selectExpr("coalesce(text, '') AS text")

    def starts(found):
        return {(r.h1, r.h2, p) for r in found.collect() for p in range(r.lo, r.hi + 1)}

    for length, keep in ((400, False), (200, True)):
        by = suffix_dedup.cover(length)
        assert starts(suffix_dedup.repeated_strings(source, by, keep)) == starts(suffix_dedup.repeated_strings(source, by, keep, small_group=0))


def test_sorting_a_group_equals_counting_its_strings():
    random.seed(5)
    base = bytes(random.choices(b"abcdef ", k=700))
    group = []
    for i in range(60):
        data = bytearray(base)
        for _ in range(random.randint(0, 3)):
            data[random.randrange(700)] = random.choice(b"xyz")
        a = random.randint(0, 255)
        b = random.randint(a, 255)
        lo, hi = 256 - b, 256 - a
        group.append({"h1": random.randrange(9), "h2": i, "q": 256, "lo": lo, "hi": hi, "n": random.choice([1, 1, 2]), "bytes": bytes(data[lo : hi + 400])})
    for keep in (False, True):
        few, many = (f(group, suffix_dedup.cover(400), keep) for f in (suffix_dedup._repeated_few, suffix_dedup._repeated_many))
        assert all(x == y.tolist() for x, y in zip(few, many))


def test_long_texts_are_sampled_alike_in_pieces():
    random.seed(6)
    text, by = bytes(random.choices(range(97, 123), k=5000)), suffix_dedup.cover(400)
    old, suffix_dedup.PIECE = suffix_dedup.PIECE, 700
    try:
        pieces = [(q, p) for q, lo, hi in suffix_dedup.sampled(text, by) for p in range(lo, hi + 1)]
    finally:
        suffix_dedup.PIECE = old
    assert pieces == [(q, p) for q, lo, hi in suffix_dedup.sampled(text, by) for p in range(lo, hi + 1)]
    assert [p for _, p in pieces] == list(range(len(text) - by.length + 1))


def test_a_cover_by_residues_finds_the_same(spark, table):
    for r in (0, 1, 2):
        by = suffix_dedup.residue_cover(400, r)
        assert {(a - b) % by.span for a in by.residues for b in by.residues} == set(range(by.span))
    texts = planted_texts()
    found = suffix_dedup.remove_repeats(table(list(enumerate(texts))), ["doc_id"], by=suffix_dedup.residue_cover(400, 2))
    rows = {r.doc_id: r for r in found.collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (rows[i] for i in range(len(texts)))] == brute_removal(texts, 400)
