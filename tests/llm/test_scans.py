"""Decontamination, personal data and secrets against plain forms of their definitions."""

import hashlib
import re

import duckdb
import pytest

from facetloom.llm import decontamination, pii, secrets
from facetloom.llm.decontamination import op1_aho_corasick_decontamination
from facetloom.llm.pii import op4_pii
from facetloom.llm.secrets import op6_trigram_secret_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_contamination(documents, bench):
    items = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in bench]
    windows = {}
    for i, w in items:
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(i)
    out = []
    for doc_id, text, *_ in documents:
        w, hit, ids = WORD.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    ids |= {str(x) for x in found if x is not None}
        out.append((doc_id, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), len(ids) >= 2))
    return out


@pytest.fixture(scope="module")
def bench(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]


def test_decontamination(spark, sf_dir, documents, bench, same_rows):
    expected = plain_contamination(documents, bench)
    assert sum(r[-1] for r in expected) and any(r[3] == 1 for r in expected)
    same_rows(op1_aho_corasick_decontamination(spark, sf_dir), expected)


def test_decontamination_in_blocks(spark, sf_dir, documents, bench):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one, many = (decontamination.scan(docs.select("doc_id", "text"), items, block_chars=n).select("doc_id", "found") for n in (1 << 20, 4000))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))


def test_decontamination_offsets(spark, sf_dir, documents):
    found = decontamination.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    for r in found:
        text = (r.text or "").translate(LOWER)
        assert sum(len(WORD.findall(text[s.start : s.end])) for s in r.found.hit_spans) == r.found.n_hit
        assert all(WORD.match(text[s.start]) and WORD.match(text[s.end - 1]) for s in r.found.hit_spans)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15),
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
}


def plain_spans(text, kinds):
    out = []
    for rank, k in enumerate(kinds):
        if len(text) > 20_000 and k == "email" and "@" not in text:
            continue  # the plain form takes the square of the run's length
        out += [(m.start(), rank, m.end(), k) for m in re.finditer(PLAIN[k][0], text) if PLAIN[k][1](m)]
    return sorted(out)


@pytest.mark.parametrize("query, kinds", [(op4_pii, ["email", "ip", "card", "phone"]), (op6_trigram_secret_scan, ["assign", "access", "hex"])])
def test_base_spans(spark, sf_dir, documents, query, kinds):
    rows = query(spark, sf_dir).collect()
    got = sorted((repr(r.doc_id), *r[1 : len(kinds) + 1], r.base_sha256) for r in rows)
    expected = []
    for doc_id, text, *_ in documents:
        spans = plain_spans(text or "", kinds)
        counts = [sum(s[3] == k for s in spans) for k in kinds]
        expected.append((repr(doc_id), *counts, sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans))))
    assert got == sorted(expected)
    for r in rows:  # base spans stay, in order, among all spans
        base = [s for s in r.spans.split(",") if s.split(":")[0] in kinds]
        assert sha(",".join(base)) == r.base_sha256


def spans_of(query, spark, sf_dir):
    return {r.doc_id: r.spans for r in query(spark, sf_dir).collect()}


def test_confirmed_and_context(spark, sf_dir):
    spans = spans_of(op4_pii, spark, sf_dir)[10_010].split(",")
    assert [s for s in spans if s.startswith("iban")] == ["iban:5:32"]  # the second fails mod-97
    assert [s for s in spans if s.startswith("ssn")] == ["ssn:70:81"]  # the second has no such word before it


def test_more_secret_rules(spark, sf_dir):
    assert spans_of(op6_trigram_secret_scan, spark, sf_dir)[10_011] == "private_key:0:31,github:32:72,google:75:114"


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] is True
    assert q["access"] == ("and", (b"aki", b"kia"))
    assert {b"pas", b"tok", b"api", b"_ke"} <= secrets.trigrams_of(q["assign"])
    assert secrets.trigram_query(rb"(foo|ba)x*") is True  # "ba" has no trigram
    assert secrets.trigram_query(rb"(?:abc)+[0-9]*def") == ("and", (b"abc", b"def"))


def test_index_leaves_no_match_out(documents):
    texts = [(t or "").encode() for _, t, *_ in documents]
    found = secrets.Index(secrets.RULES).scan(texts)
    for text, spans in zip(texts, found, strict=True):
        full = [(m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, text) if m.end(r.group) - m.start(r.group) >= r.least]
        assert spans == full


def test_masking():
    assert secrets.masked(b"abcdefgh", [(1, 0, 3), (2, 2, 5), (6, 1, 7)]) == b"a[SECRET]f[SECRET]h"


def test_luhn_and_mod97(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"), ("4111111111111112", "GB82WEST12345698765433")], "a string, b string")
    from pyspark.sql import functions as F

    assert [tuple(r) for r in df.select(pii.luhn(F.col("a")), pii.mod97(F.col("b"))).collect()] == [(True, True), (False, False)]


@pytest.mark.parametrize("query", [op1_aho_corasick_decontamination, op4_pii, op6_trigram_secret_scan])
def test_empty(spark, empty_dir, query):
    assert query(spark, empty_dir).collect() == []


def test_decontamination_sql(spark, sf_dir, same_rows):
    duckdb.sql(f"create or replace view documents as from '{sf_dir}/documents.parquet/*.parquet'")
    duckdb.sql(f"create or replace view benchmark as from '{sf_dir}/benchmark.parquet/*.parquet'")
    same_rows(op1_aho_corasick_decontamination(spark, sf_dir), duckdb.sql(decontamination.OP1_SQL).fetchall())
