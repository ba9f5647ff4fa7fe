"""The pipeline's near-duplicates against brute force over all pairs of shingle sets."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetloom.llm import near_copies


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_links(sets):
    """Pairs of distinct sets at 0.8 or more."""
    sets = list(dict.fromkeys(sets))
    where, out = defaultdict(list), []
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        for j, c in Counter(j for x in s for j in where[x] if j < i).items():
            if 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                out.append((sets[j], s))
    return out


def plain_firsts(rows):
    sets = [plain_set(t) for _, t in rows]
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in plain_links(sets):
        root[find(a)] = find(b)
    best = {}
    for (d, _), s in zip(rows, sets):
        if d is not None:
            best[find(s)] = min(d, best.get(find(s), d))
    return sorted(best.values()), len({id(find(s)) for s in sets})


def edited(words, n, rng):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"edit{rng.integers(1 << 40)}"
    return " ".join(words)


def test_stage_drops_copies_with_edited_words(spark):
    import corpus_pipeline as pipeline

    rng = np.random.default_rng(2)
    rows = []
    for i, n in enumerate((60, 100, 200, 400) * 5):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, edited(words, n // 50, rng)), (3 * i + 2, edited(words, n // 5, rng))]
    expected, _ = plain_firsts(rows)
    assert expected == [d for d in range(60) if d % 3 != 1]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, df, "").collect()) == expected


@pytest.mark.parametrize("heavy", [2048, 5])
def test_firsts(spark, documents, heavy):
    rng = np.random.default_rng(4)
    rows = [(d, t) for d, t, *_ in documents]
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 120)]
    rows += [(30_000 + i, edited(base, int(rng.integers(0, 6)), rng)) for i in range(40)]
    ids, n = plain_firsts(rows)
    got = near_copies.firsts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ["doc_id"], heavy=heavy).collect()
    assert len(got) == n and sorted(r.doc_id for r in got if r.doc_id is not None) == ids


def links_at(x, y, least=0.8):
    """The links that a segment in which two sets agree gives them."""
    (a, some_a), (b, some_b) = near_copies.ring(x), near_copies.ring(y)
    shared = set(near_copies.ring_keys(a, some_a)) & set(near_copies.ring_keys(b, some_b))
    rows = np.asarray([[i, 0, i, len(s), *r.view("<i8")] for i, (s, r) in enumerate(((x, a), (y, b)))])
    return [near_copies.links_of(k >> 32, rows, lambda _, i, n: (x, y)[i], least) for k in shared]


def test_recall(spark):
    """Every pair of a real table meets in a segment, and keeps within the budgets there."""
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    by_set = {plain_set(t): near_copies.shingles((t or "").encode()) for t in texts}
    links = plain_links(by_set)
    assert len(links) > 2
    for a, b in links:
        assert ([1], [0]) in links_at(*sorted((by_set[a], by_set[b]), key=len))


@pytest.mark.parametrize("n", [9, 40, 150, 1000, 20_000])
def test_recall_at_the_limit(n):
    """Pairs of sets at 0.8 itself, short and long ones."""
    rng = np.random.default_rng(n)
    for _ in range(200):
        h = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        cut = n // 10
        if len(h) - 2 * cut < 0.8 * n:
            h = h[: len(h) - 1]
        x, y = np.unique(h[cut:]), np.unique(h[: len(h) - cut])
        assert near_copies.similar(x, y, 0.8)
        assert ([1], [0]) in links_at(*sorted((x, y), key=len))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 32), min_size=20, max_size=20), st.integers(0, 19))
def test_budgets(differ, start):
    x = np.asarray([[(1 << d) - 1 for d in differ]], dtype=np.uint32)
    chain = [sum(differ[(start + k) % 20] for k in range(n)) for n in range(1, 21)]
    assert bool(len(near_copies.within_budgets(x, start))) == all(20 * c <= 160 * n for n, c in enumerate(chain, 1))
    if sum(differ) <= 160:  # a ring within the whole budget has a chain that keeps it all along
        assert any(len(near_copies.within_budgets(x, s)) for s in range(20))


def test_exact_limit():
    a = np.arange(9, dtype=np.uint64)
    assert near_copies.similar(a[:8], a[:8], 0.8) and near_copies.similar(a[:4], a[:5], 0.8)
    assert not near_copies.similar(a[:7], a[:9], 0.8)
