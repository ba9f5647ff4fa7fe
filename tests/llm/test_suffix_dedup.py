"""Removal of repeated strings against a dictionary of all strings of 50 bytes."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetloom.llm import suffix_dedup
from facetloom.llm.common import pack_sorted, unpack_sorted
from facetloom.llm.suffix_dedup import op8_suffix_dedup


def plain(documents):
    last = (1 << 63) - 1
    texts = [(last if d is None else d, (t or "").encode()) for d, t, *_ in documents]
    first = {}
    for d, t in texts:
        for i in range(len(t) - 49):
            s = t[i : i + 50]
            first[s] = min(d, first.get(s, d))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) > 0).sum())
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        out.append((None if d == last else d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_all_documents(spark, sf_dir, documents, same_rows):
    expected = plain(documents)
    assert sum(r[2] > 0 for r in expected) > 10
    same_rows(op8_suffix_dedup(spark, sf_dir), expected)


@pytest.mark.parametrize("block", [300, 5_000, 1 << 20])
def test_passages(spark, block, monkeypatch, same_rows):
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcd \x00", dtype=np.uint8)
    noise = lambda n: rng.choice(letters, n).tobytes().decode()
    passages = [noise(n) for n in (49, 50, 51, 60, 80, 200)]
    rows = []
    for i in range(60):
        parts = [noise(int(rng.integers(0, 90)))]
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(len(passages)))]
            cut = int(rng.integers(0, 12))
            parts += [p[cut:], noise(int(rng.integers(0, 30)))]
        rows.append((i // 2 * 2 if i % 9 == 0 else i, "".join(parts)))
    rows += [(None, "n" * 60), (None, "n" * 60), (None, passages[4] + "x"), (40, passages[4])]
    rows += [(100, "z" * 400), (101, "z" * 300), (102, "ab" * 200), (99, "ab" * 30)]
    for name in ("BLOCK", "BUCKET"):
        monkeypatch.setattr(suffix_dedup, name, block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    got = suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    same_rows(got, plain(rows))


def test_long_text_is_cut_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    text = rng.integers(97, 101, 5000, dtype=np.uint8).tobytes()
    whole = suffix_dedup.anchors([text])
    monkeypatch.setattr(suffix_dedup, "PART", 512)
    parts = suffix_dedup.anchors([text])
    assert np.array_equal(whole[1], parts[1]) and np.array_equal(whole[2], parts[2])


def test_block_begins_with_empty_texts():
    rng = np.random.default_rng(7)
    for _ in range(200):
        text = rng.integers(97, 101, 90, dtype=np.uint8).tobytes()
        _, *alone = suffix_dedup.anchors([text])
        for before in ([b""], [b"", b""], [b"", b"abc", b""]):
            of, *found = suffix_dedup.anchors([*before, text, b""])
            assert (of == len(before)).all() and all(np.array_equal(x, y) for x, y in zip(found, alone))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=4, max_size=4).map(lambda b: bytes(x & 3 for x in b)), max_size=8), min_size=1, max_size=6))
def test_loser_tree(lists):
    runs = []
    for strings in lists:
        rows = np.frombuffer(b"".join(sorted(strings)), dtype=np.uint8).reshape(-1, 4)
        lcp, rests = suffix_dedup.front_coded(rows)
        assert suffix_dedup.from_front_coded(lcp, rests, 4) == sorted(strings)
        runs.append((sorted(strings), lcp))
    order, shared = suffix_dedup.merged(runs, 4)
    got = [runs[r][0][i] for r, i in order]
    assert got == sorted(s for x in lists for s in x)
    for a, b, n in zip(got, got[1:], shared[1:]):
        assert n == next((i for i in range(4) if a[i] != b[i]), 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=20, unique=True), st.integers(1, 1000))
def test_packed_keys(keys, most):
    keys = np.sort(np.asarray(keys, dtype=np.uint64))
    counts = np.arange(len(keys), dtype=np.int64) % most + 1
    for part in (slice(None), slice(0, 1), slice(0, 0)):
        got = unpack_sorted(*pack_sorted(keys[part], counts[part]))
        assert np.array_equal(got[0], keys[part]) and np.array_equal(got[1], counts[part])


def test_coverage_from_shared_prefixes():
    side, length = suffix_dedup.SIDE, suffix_dedup.LENGTH
    for seed in range(20):
        rng = np.random.default_rng(seed)
        texts = [bytes(rng.integers(0, 2, int(rng.integers(60, 120)), dtype=np.uint8)) for _ in range(12)]
        base = bytes(rng.integers(0, 2, 90, dtype=np.uint8))
        texts += [bytes(c if rng.random() > 0.02 else 1 - c for c in base)[int(rng.integers(0, 20)) :] for _ in range(20)]
        of, place, _ = suffix_dedup.anchors(texts)
        rows = suffix_dedup.entries_of(texts, of, place)
        doc = np.asarray([int(i) // 2 for i in of])
        rows, doc = (x[np.lexsort(rows.T[::-1])] for x in (rows, doc))
        shared = np.frombuffer(suffix_dedup.front_coded(rows)[0], dtype=np.uint8).astype(np.int64)
        left, right = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
        got = suffix_dedup.covered(shared, rows[:, length:-2], left, right, doc)
        whole = np.concatenate((rows[:, length:-2][:, ::-1], rows[:, :length]), axis=1)
        for j in range(side + 1):
            fits = [i for i in range(len(rows)) if left[i] >= j and right[i] >= length - j]
            strings = {i: whole[i, side - j : side - j + length].tobytes() for i in fits}
            for i in range(len(rows)):
                assert got[i, j] == (i in strings and any(strings[i] == strings[k] and doc[k] < doc[i] for k in fits))


def test_empty(spark, empty_dir):
    assert op8_suffix_dedup(spark, empty_dir).collect() == []
