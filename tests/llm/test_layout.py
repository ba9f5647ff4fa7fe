"""Packing and sharding against direct checks of their definitions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetloom.llm import packing, sharding
from facetloom.llm.packing import op9_best_fit_packing
from facetloom.llm.sharding import op10_hash_tree_shards


@pytest.fixture(scope="module")
def packed(spark, sf_dir):
    return op9_best_fit_packing(spark, sf_dir).collect()


def test_pieces_are_the_documents(packed, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for doc_id, text, *_ in documents:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(repr, (tuple(r)[:5] for r in packed))) == sorted(map(repr, expected))


def test_sequences_are_gapless(packed):
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= 1 + 1.02 * sum(r.length for r in packed) / 4096 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan(counts):
    rows = packing.plan(counts, 64)
    slots = defaultdict(list)
    for length, rank, n, first, each, offset in rows:
        for r in range(n):
            slots[first + r // each].append((offset + r % each * length, length))
    for length, n in counts.items():
        ranks = sorted(x for row in rows if row[0] == length for x in range(row[1], row[1] + row[2]))
        assert ranks == list(range(n))
    for parts in slots.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    # as many sequences as plain best-fit decreasing
    free = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [f for f in free if f >= length]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - length)
            else:
                free.append(64 - length)
    assert len(slots) == len(free)


@pytest.fixture(scope="module")
def shards(spark, sf_dir):
    return op10_hash_tree_shards(spark, sf_dir).collect()


def test_shard_rows(shards, documents):
    expected = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key") for d, t, *_ in documents]
    assert sorted(map(repr, (tuple(r)[:4] for r in shards))) == sorted(map(repr, expected))


def test_key_decides(shards, spark):
    of = defaultdict(set)
    for r in shards:
        of[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
    assert all(len(x) == 1 for x in of.values())
    slots = defaultdict(list)
    for r in shards:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shares_and_growth(spark):
    df = spark.range(40_000).selectExpr("id as doc_id", "cast(null as string) as text")
    rows = sharding.assign(df, 16).collect()
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 16 and all(abs(n - 2500) < 250 for n in counts.values())
    moved = sum(r.shard != r.grown_shard for r in rows)
    assert abs(moved - 40_000 / 17) < 250


def test_heavier_subtree_only_gains(spark):
    from dataclasses import replace

    tree = sharding.tree_of(16)
    first = tree.children[0]
    rack = first.children[0]
    heavier = replace(rack, children=(replace(rack.children[0], own=3.0), *rack.children[1:]))
    other = replace(tree, children=(replace(first, children=(heavier, *first.children[1:])), *tree.children[1:]))
    df = spark.range(20_000).selectExpr("cast(id as string) as key")
    rows = sharding.descend(sharding.descend(df, tree, "a"), other, "b").collect()
    assert all(r.b < 8 for r in rows if r.a != r.b)  # only towards the region whose weight rose
    assert all(r.b < 4 for r in rows if r.a != r.b and 4 <= r.a < 8)


@pytest.mark.parametrize("query", [op9_best_fit_packing, op10_hash_tree_shards])
def test_empty(spark, empty_dir, query):
    assert query(spark, empty_dir).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZé ßÅΣςİK.,'stm0½ ́Å \x1c\n\t-&漢ñ", max_size=12), max_size=6))
def test_word_tokenizer(texts):
    words = packing.WordTokenizer(packing.default_tokenizer())
    got = list(words([t.encode() for t in texts]))
    assert got == [words.whole(t) for t in texts]


MARKED = ["a… a….", "x-y x-y.", "é€ é€, É€.", "don' don't, don't.", "a***. a*** ÉA*** éa. 1. 1,", "'s. s' .s …. …", "ª. ªb* İ. ς."]


def test_words_before_marks():
    words = packing.WordTokenizer(packing.default_tokenizer())
    assert list(words([t.encode() for t in MARKED])) == [words.whole(t) for t in MARKED]


def test_memory_of_words_is_bounded(monkeypatch):
    """Words that are forgotten get the same ids again; what recurs is kept, and never more than a text beyond the bound."""
    monkeypatch.setattr(packing, "MEMO_BYTES", 40_000)
    words = packing.WordTokenizer(packing.default_tokenizer())
    texts = [f"often seldom{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]} Often, {i}" for i in range(1000)] * 2
    for text, ids in zip(texts, words([t.encode() for t in texts]), strict=True):
        assert ids == words.whole(text)
        held = sum(len(w) + len(x) + 160 for memo in (words.memo, words.old) for w, x in memo.items())
        assert held < 45_000 and b"often" in words.memo.keys() | words.old.keys()


def test_worker_keeps_its_tokenizer():
    path = packing.default_tokenizer()
    assert packing.word_tokenizer(path) is packing.word_tokenizer(path)


def test_pieces_are_sorted_once(spark, sf_dir, capsys):
    """No join: it sorted all pieces again, in pages of the executors' heaps."""
    op9_best_fit_packing(spark, sf_dir).explain()
    said = capsys.readouterr().out
    assert "Join" not in said and said.count("Sort ") == 1
