"""SimHash components and language-model scores against plain forms of their definitions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from facetloom.llm import lm_scoring, simhash
from facetloom.llm.lm_scoring import op7_kneser_ney
from facetloom.llm.simhash import op2_simhash_components


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in distinct}


def test_simhash(spark, sf_dir, documents):
    fps = [(d, plain_fingerprint(t)) for d, t, *_ in documents]
    of = plain_components([f for _, f in fps])
    ids = {}
    for d, f in fps:
        if d is not None:
            ids[of[f]] = min(d, ids.get(of[f], d))
    expected = sorted(repr((d, f"{f:016x}", ids.get(of[f]))) for d, f in fps)
    rows = op2_simhash_components(spark, sf_dir).collect()
    assert sorted(repr(tuple(r)) for r in rows) == expected
    assert any(r.component_id != r.doc_id for r in rows)


@pytest.mark.parametrize("heavy", [2048, 7])
def test_links_of_close_fingerprints(spark, heavy):
    rng = np.random.default_rng(5)
    fps = set()
    for center in rng.integers(0, 2**64, 12, dtype=np.uint64).tolist():
        for _ in range(25):
            x = center
            for bit in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                x ^= 1 << bit
            fps.add(x)
    expected = plain_components(fps)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = [(signed[r.u], signed[r.v]) for r in simhash.link_edges(df, heavy).collect()]
    root = {f: f for f in fps}
    for _ in fps:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert root == expected


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=6, unique=True))
def test_pigeonring_is_complete(bits):
    x = np.asarray([sum(1 << b for b in bits)], dtype=np.uint64)
    starts = [i for i in range(5) if len(simhash.within_budgets(x, np.asarray([i])))]
    assert bool(starts) == (len(bits) <= 4)
    for i in starts:  # the first segment and a half of the second are equal
        second = int(x[0]) >> simhash.OFFSETS[(i + 1) % 5] & (1 << simhash.WIDTHS[(i + 1) % 5]) - 1
        assert not int(x[0]) >> simhash.OFFSETS[i] & (1 << simhash.WIDTHS[i]) - 1
        assert not second & 127 or not second >> 7


def plain_kneser_ney(texts):
    """Training texts as lists of words; returns log10 P(word | previous)."""
    pairs = Counter(p for w in texts for p in zip([" begin", *w], [*w, " end"]))
    words = Counter(x for w in texts for x in [*w, " end"])
    after, first = Counter(w for _, w in pairs), Counter()
    follow = {}
    for (v, _), c in pairs.items():
        first[v] += c
        follow.setdefault(v, [0, 0, 0])[min(c, 3) - 1] += 1

    def discounts(counts):
        t = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if not (t[0] and t[1]):
            return [0.5] * 3
        y = t[0] / (t[0] + 2 * t[1])
        raw = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2] if t[2] else 3 * y]
        return [min(max(r, 0.01), m) for r, m in zip(raw, (1, 2, 3))]

    high, low = discounts(pairs.values()), discounts(after.values())
    back = sum(low[min(c, 3) - 1] for c in after.values()) / len(pairs)

    def p(v, w):
        a = after[w]
        p1 = max(a - (low[min(a, 3) - 1] if a else 0), 0) / len(pairs) + back / (len(words) + 1)
        if v not in first:
            return p1
        c = pairs[v, w]
        weight = sum(n * d for n, d in zip(follow[v], high)) / first[v]
        return max(c - (high[min(c, 3) - 1] if c else 0), 0) / first[v] + weight * p1

    return words, p


def test_kneser_ney(spark, sf_dir, documents):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in documents]
    texts = [(t or "").encode().lower().decode().replace("\x85", "\x85").encode().split() for _, t, *_ in documents]
    texts = [[w.decode() for w in t] for t in texts]
    words, p = plain_kneser_ney([t for t, h in zip(texts, held) if not h])
    n, v = sum(words.values()), len(words)
    expected = {}
    for (d, *_), t, h in zip(documents, texts, held):
        tokens = [*t, " end"]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        score = sum(math.log10(p(a, b)) for a, b in zip([" begin", *t], tokens))
        expected.setdefault(d, []).append((h, len(tokens), sum(words[w] > 0 for w in tokens), n, base, score))
    got = {}
    for r in op7_kneser_ney(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got.keys() == expected.keys() and any(held)
    for d, rows in expected.items():
        for a, b in zip(sorted(rows), sorted(got[d]), strict=True):
            assert a == pytest.approx(b, rel=1e-9)


def test_kneser_ney_sums_to_one():
    """Over the known words, the end and one unknown, after a known, an unknown and the begin token."""
    words, p = plain_kneser_ney([t.split() for t in ("a b a c a b", "b b d", "a b", "e f a a")])
    for before in ("a", "b", "f", "zzz", " begin"):
        assert sum(p(before, w) for w in [*words, "unknown"]) == pytest.approx(1)


def test_many_buckets(spark, sf_dir, documents, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one = lm_scoring.score(docs, lm_scoring.train(docs), ["doc_id"]).collect()
    monkeypatch.setattr(lm_scoring, "WORD_BUCKET", 40_000)
    monkeypatch.setattr(lm_scoring, "PAIR_BUCKET", 3_000)
    monkeypatch.setattr(lm_scoring, "BLOCK", 30_000)
    many = lm_scoring.score(docs, lm_scoring.train(docs), ["doc_id"]).collect()
    for a, b in zip(sorted(one, key=repr), sorted(many, key=repr), strict=True):
        assert tuple(a)[1:] == pytest.approx(tuple(b)[1:], rel=1e-9)


def test_few_buckets_and_mappings(spark, sf_dir, documents, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = [None if t is None else t.encode() for _, t, *_ in documents]
    whole = lm_scoring.Scorer(lm_scoring.train(docs))(texts)
    for name, value in (("WORD_BUCKET", 40_000), ("WORD_BUCKETS", 3), ("PAIR_BUCKET", 3_000), ("MAPS", 1)):
        monkeypatch.setattr(lm_scoring, name, value)
    model = lm_scoring.train(docs)
    assert len(model.base) == 3
    for a, b in zip(whole, lm_scoring.Scorer(model)(texts), strict=True):
        assert a == pytest.approx(b, rel=1e-9)


@pytest.mark.parametrize("query", [op2_simhash_components, op7_kneser_ney])
def test_empty(spark, empty_dir, query):
    assert query(spark, empty_dir).collect() == []
