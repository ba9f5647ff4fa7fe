"""Quality rules, language identification and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from facetloom.llm import langid, quality
from facetloom.llm.langid import op3_byte_cnn_language
from facetloom.llm.quality import op5_mcd_quality

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    inside = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_counts(spark, sf_dir, documents):
    expected = []
    for d, t, *_ in documents:
        c = plain_counts(t)
        expected.append(repr((d, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])))
    rows = op5_mcd_quality(spark, sf_dir).collect()
    assert sorted(repr(tuple(r)[:7]) for r in rows) == sorted(expected)
    assert not any(r.kept and r.base_failed for r in rows)


def test_rejects_junk_and_keeps_the_clean(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.kept) for r in op5_mcd_quality(spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = ([k for q, k in rows if q == x] for x in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_estimate_resists_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (4000, 5)) @ np.diag([1, 2, 1, 1, 1])
    x[:, 1] += x[:, 0]
    x[:800] = rng.normal(30, 1, (800, 5))
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], ["gid", *quality.FEATURES])
    e = quality.fit(df).first()
    cov = np.linalg.inv(np.asarray(e.inverse).reshape(5, 5))
    assert np.abs(e.centre).max() < 0.25
    ratio = np.diag(cov) / np.diag(np.cov(x[800:].T))
    assert ratio.min() > 0.8 and ratio.max() < 1.5  # the kept share is more than its nominal share of the clean rows


def plain_mcd(x):
    """The least determinant over concentration from many starts, exact limits."""
    floor, best = np.diag(np.square(list(quality.FLOOR.values()))), None
    for seed in range(60):
        rows = np.random.default_rng(seed).choice(len(x), 12, replace=False)
        last = np.inf
        while True:
            centre, cov = x[rows].mean(axis=0), np.cov(x[rows].T, bias=True) * quality.CONSISTENCY + floor
            det = np.linalg.slogdet(cov)[1]
            if det > last - 1e-9 and len(rows) > 12:
                break
            last = det if len(rows) > 12 else np.inf
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            rows = np.flatnonzero(d <= np.sort(d)[math.ceil(quality.KEEP * len(x)) - 1])
        if best is None or last < best[0]:
            best = last, centre, cov
    return best


def test_least_determinant(spark):
    """Groups with a second cluster, with correlated and with constant features."""
    rng, groups = np.random.default_rng(6), {}
    for g, share in (("a", 0.0), ("b", 0.1), ("c", 0.2)):
        x = rng.normal(0, 1, (400, 5)) @ rng.normal(0, 1, (5, 5))
        x[: int(share * 400)] = rng.normal(12, 0.3, (int(share * 400), 5))
        groups[g] = x
    groups["d"] = np.concatenate((groups["b"][:, :3], np.zeros((400, 2))), axis=1)
    df = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], ["gid", *quality.FEATURES])
    got = {r.gid: r for r in quality.fit(df).collect()}
    for g, x in groups.items():
        det, centre, cov = plain_mcd(x)
        assert got[g].log_det == pytest.approx(det, abs=0.05)
        d = [np.einsum("ij,jk,ik->i", x - c, i, x - c) for c, i in ((centre, np.linalg.inv(cov)), (np.asarray(got[g].centre), np.asarray(got[g].inverse).reshape(5, 5)))]
        assert np.array_equal(d[0] > 60, d[1] > 60) and (d[1] > 60).sum() == {"a": 0, "b": 40, "c": 80, "d": 40}[g]


def test_verdict(spark):
    """``kept`` against the estimates of a plain search, in small groups."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        n, junk = int(rng.integers(30, 90)), i % 11 == 0
        words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) + ("$$$" if junk else "") for _ in range(n)]
        rows.append((i, " ".join(words), "ab"[i % 2], "s"))
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"])
    got = {r.doc_id: r for r in judged.collect()}
    for lang in "ab":
        ids = [r[0] for r in rows if r[2] == lang]
        x = []
        for i in ids:
            w, chars, symbols, dup, repeats, lines, digits = quality.count(rows[i][1].encode())
            x.append([math.log(chars / w), math.sqrt(symbols / w), math.sqrt(dup / lines), math.sqrt(repeats / w), math.sqrt(digits / chars)])
        x = np.asarray(x)
        _, centre, cov = plain_mcd(x)
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        assert [got[i].kept for i in ids] == (d <= quality.CUTOFF).tolist() and 0 < (d > quality.CUTOFF).sum() < 20


def test_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, text, "en", "s", "x", "y", "z") for i in range(60)], "doc_id long, text string, lang string, source string, digits string, centre string, kept string")
    rows = quality.judge(df, df.columns).collect()
    assert len(rows) == 60 and all((r.digits, r.centre, r.text, r.kept) == ("x", "y", text, True) for r in rows)


def test_chi_squared():
    assert quality.chi2_cdf(2.0, 2) == pytest.approx(1 - math.exp(-1))
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_small_groups_are_pooled(spark):
    rows = [("vx", f"v{i % 3}") for i in range(120)] + [("vy", f"v{i}") for i in range(60)] + [("vz", "n")] * 3 + [("n", "n")] * 49
    found = {(r[0], r[1]): r.gid for r in quality._groups(spark.createDataFrame(rows, "__lang string, __source string")).collect()}
    assert {g for (lang, _), g in found.items() if lang == "vx"} == {"1\x1fvx"}
    assert {g for (lang, _), g in found.items() if lang == "vy"} == {"1\x1fvy"}
    assert found["vz", "n"] == found["n", "n"] == "0"


def test_language_accuracy_on_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_byte_cnn_language(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.98 * len(held)


def test_language_odd_texts(spark, sf_dir, documents):
    rows = op3_byte_cnn_language(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    by = {r.doc_id: r for r in rows}
    for i in (10_000, 10_001, 10_002, 10_013):  # null, empty, blanks, digits
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("de", "en", "es", "fr", "und") for r in rows)
    assert all(r.held_out is False for r in rows if r.doc_id is None)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(docs, langid.fit(docs), ["doc_id"]).collect()] == [(1, "und", 0.0)]


def exact_network(labels):
    net = langid.Network(labels)
    for name in ("mask", "filters", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    return net


def test_gradient():
    """Every kind of parameter against differences of the loss."""
    net = exact_network(["a", "b", "c"])
    x, _ = langid.windows_of([b"the quick brown fox", b"der schnelle fuchs", b"el zorro"])
    y = np.asarray([0, 1, 2])
    loss = lambda: -np.log(net.probabilities(net.pool(x, net.tables())[0])[np.arange(3), y]).mean()
    rng, seen = np.random.default_rng(1), 0
    for param, grad in zip((net.filters, net.out, net.bias), net.gradients(x, y)):
        busy = np.argwhere(grad != 0)
        for at in map(tuple, rng.permutation(busy)[:40]):
            held = param[at]
            param[at] = held + 1e-6
            up = loss()
            param[at] = held - 1e-6
            down = loss()
            param[at] = held
            seen += 1
            assert (up - down) / 2e-6 == pytest.approx(grad[at], rel=1e-3, abs=1e-7)
    assert seen > 80


def plain_prediction(net, text):
    """Probabilities by sliding every filter over every window, byte by byte."""
    letters = langid.letters_of(text)
    total = np.zeros(len(net.labels))
    for begin in range(0, max(1, len(letters)), langid.WINDOW):
        w = [langid._CLASS[b] for b in letters[begin : begin + langid.WINDOW].ljust(langid.WINDOW)]
        best = np.max([sum(net.filters[k, w[t + k]] for k in range(langid.LONGEST)) for t in range(langid.WINDOW - langid.LONGEST + 1)], axis=0)
        e = np.exp(np.maximum(best, 0) @ net.out + net.bias)
        total += e / e.sum() * (sum(c != 0 for c in w) + 1e-9)
    return total / total.sum()


def test_predictions(spark, documents, monkeypatch):
    """Against the plain form, whole texts, also those that are run in parts; ties go to the first language."""
    net = exact_network(["a", "b", "c"])
    rows = [(i, t) for i, (_, t, *_) in enumerate(documents) if t is None or len(t) < 3000][-70:] + [(1000, "word " * 700), (1001, "漢字" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(langid, "RUN", 3)
    monkeypatch.setattr(langid, "LONG", 200)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, net, ["doc_id"]).collect()}
    for i, t in rows:
        text = (t or "").encode()
        if not any(c.isalpha() for c in t or ""):
            assert got[i] == ("und", 0.0)
            continue
        p = plain_prediction(net, text)
        assert got[i][1] == pytest.approx(p.max(), abs=1e-9) and got[i][0] == net.labels[int(p.argmax())]
    net.out[:] = net.bias[:] = 0
    assert {r.lang_pred for r in langid.identify(df, net, ["doc_id"]).collect()} == {"a", "und"}


@pytest.mark.parametrize("query", [op3_byte_cnn_language, op5_mcd_quality])
def test_empty(spark, empty_dir, query):
    assert query(spark, empty_dir).collect() == []


def test_pipeline(spark, sf_dir, documents):
    """Each stage against a plain form of its decision on its own input."""
    import corpus_pipeline as pipeline
    from test_layout import packing
    from test_near_copies import plain_firsts
    from test_scans import plain_contamination

    from facetloom.llm import secrets

    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*pipeline.COLUMNS)
    given = [tuple(r) for r in docs.collect()]
    judged = Counter((r.doc_id, r.kept) for r in op5_mcd_quality(spark, sf_dir).collect())

    def stage(i, rows):
        df = spark.createDataFrame(rows, docs.schema) if i else docs
        out = pipeline.STAGES[i][1](spark, df, sf_dir)
        assert i == 4 or out.columns == pipeline.COLUMNS
        return [tuple(r) for r in out.collect()]

    kept = stage(0, None)
    assert Counter(r[0] for r in kept) == Counter({d: n for (d, k), n in judged.items() if k})
    assert not Counter(kept) - Counter(given)
    ids, n = plain_firsts([r[:2] for r in kept])
    one = stage(1, kept)
    assert sorted(r[0] for r in one if r[0] is not None) == ids
    assert len(one) == n < len(kept) and not Counter(one) - Counter(kept)
    hit = [c[2] > 0 for c in plain_contamination(one, bench)]
    clean = stage(2, one)
    assert any(hit) and Counter(clean) == Counter(r for r, h in zip(one, hit) if not h)
    masked = stage(3, clean)
    assert len(masked) == len(clean)
    assert not any(x for x in secrets.Index(secrets.RULES).scan([r[1].encode() for r in masked]))
    same = {r[0]: r[1] for r in clean}
    assert all(t == same[d] or "[SECRET]" in t and n == len(t) for d, t, _, _, n in masked)
    packed = stage(4, masked)
    ids = packing.WordTokenizer(packing.default_tokenizer())
    assert sum(r[3] for r in packed) == sum(len(x) // 4 + 1 for x in ids([r[1].encode() for r in masked]))
    assert pipeline.run(spark, sf_dir).count() == len(packed)


def test_pipeline_of_nothing(spark, empty_dir):
    import corpus_pipeline as pipeline

    assert pipeline.run(spark, empty_dir).collect() == []
