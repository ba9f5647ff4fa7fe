"""Language identification by a byte convolutional network, trained and run in numpy.

A text's letters (A-Z lower-cased, everything that is no letter a single gap) are cut into
windows of ``WINDOW`` bytes, all of the text. Filters of widths 2, 3 and 4 run over a
window, each filter's largest response is kept, and a softmax layer gives the languages'
probabilities; a text's are the mean over its windows, weighted by their letters.

A filter's response is a sum over its bytes, so the responses to all pairs of bytes are
tabulated once and a position costs two look-ups for all filters together.

The network is trained on the driver on a bounded sample: ``SAMPLE`` documents of each
language on average, by hash, and ``PER_DOC`` windows of each, from anywhere in the text.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every
text if nothing can be learned; a null doc_id is not held out; ties go to the language
that is first in order; rows that repeat get equal rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm.common import blocks, map_arrow, remainder, table, utf8

FOLDS, HELD_OUT = 4, 2
SAMPLE, PER_DOC = 500, 4
WINDOW, LONGEST = 256, 4
WIDTHS, FILTERS = (2, 3, 4), 16
EPOCHS, BATCH, RATE = 8, 128, 0.01
#: Windows that are run at once, and bytes from which a text is not taken apart into words.
RUN, LONG = 1024, 1 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Gap and padding 0, a-z 1 to 26, bytes of non-ASCII characters from 27.
_CLASS = np.asarray([b - 96 if 97 <= b <= 122 else b - 101 if b >= 128 else 0 for b in range(256)], dtype=np.int32)
CLASSES = 155
_LETTER = re.compile(rb"[A-Za-z]")


def letters_of(text: bytes) -> bytes:
    letters = text.translate(_LETTERS)
    return b" ".join(letters.split()) if len(letters) < LONG else re.sub(rb" {2,}", b" ", letters).strip()


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or not text.isascii() and any(c.isalpha() for c in text.decode()))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as classes of bytes, and each window's text."""
    counts = [max(1, -(-len(t) // WINDOW)) for t in texts]
    data = b"".join(t.ljust(n * WINDOW) for t, n in zip(texts, counts, strict=True))
    return _CLASS[np.frombuffer(data, dtype=np.uint8)].reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts)


class Network:
    """Filters [4, CLASSES, filters] with zeros beyond a filter's width, and a softmax layer."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.labels = labels
        self.mask = np.zeros((LONGEST, 1, n), dtype=np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.filters = rng.normal(0, 0.3, (LONGEST, CLASSES, n)).astype(np.float32) * self.mask
        self.out = rng.normal(0, 0.1, (n, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), dtype=np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        f = self.filters
        return tuple((f[i][:, None] + f[i + 1][None]).reshape(CLASSES * CLASSES, -1) for i in (0, 2))

    def pool(self, x: np.ndarray, tables, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Every filter's largest response in each window, and its position."""
        pairs = np.ascontiguousarray((x[:, :-1] * CLASSES + x[:, 1:]).T)
        head, tail = tables
        best = head.take(pairs[0], axis=0) + tail.take(pairs[2], axis=0)
        at = np.zeros(best.shape, dtype=np.int32) if where else None
        z, y = np.empty_like(best), np.empty_like(best)
        for t in range(1, WINDOW - LONGEST + 1):
            head.take(pairs[t], axis=0, out=z, mode="clip")
            tail.take(pairs[t + 2], axis=0, out=y, mode="clip")
            z += y
            if where:
                at[z > best] = t
            np.maximum(best, z, out=best)
        return best, at

    def probabilities(self, best: np.ndarray) -> np.ndarray:
        logits = np.maximum(best, 0) @ self.out + self.bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over windows ``x`` of languages ``y``: by the filters, the softmax weights and their bias."""
        n = self.filters.shape[2]
        best, at = self.pool(x, self.tables(), where=True)
        p = self.probabilities(best)
        p[np.arange(len(x)), y] -= 1
        p /= len(x)
        back = (p @ self.out.T) * (best > 0)
        grad = np.empty_like(self.filters)
        for k in range(LONGEST):
            cls = np.take_along_axis(x, at + k, axis=1)
            grad[k] = np.bincount((cls * n + np.arange(n)).ravel(), weights=back.ravel(), minlength=CLASSES * n).reshape(CLASSES, n)
        return [grad * self.mask, np.maximum(best, 0).T @ p, p.sum(axis=0)]

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        params = [self.filters, self.out, self.bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for begin in range(0, len(order), BATCH):
                rows = order[begin : begin + BATCH]
                batch = x[rows].copy()
                short = rng.random(len(rows)) < 0.3  # short texts are padded windows
                lengths = np.where(short, rng.integers(4, WINDOW, len(rows)), WINDOW)
                batch[np.arange(WINDOW)[None] >= lengths[:, None]] = 0
                step += 1
                for q, g, m, v in zip(params, self.gradients(batch, y[rows]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def predict(self, texts: list[bytes], tables) -> np.ndarray:
        """Probabilities of each text's languages; texts are given as their letters."""
        total = np.zeros((len(texts), len(self.labels)))
        most = RUN * WINDOW
        for a, b in blocks([max(len(t), WINDOW) for t in texts], most):
            for at in range(0, max(1, len(texts[a]) if b == a + 1 else 1), most):  # a longer text in parts
                part, of = windows_of([texts[a][at : at + most]] if b == a + 1 else texts[a:b])
                weight = (part != 0).sum(axis=1) + 1e-9
                np.add.at(total, of + a, self.probabilities(self.pool(part, tables)[0]) * weight[:, None])
        return total / total.sum(axis=1, keepdims=True)


def sampled_windows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, bytes]]:
    """(lang, letters of a window) from ``docs`` (with columns text and lang): about
    ``sample`` documents of each language, ``PER_DOC`` windows at most of each."""
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, bytes]] = []
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                letters = letters_of(text)
                if letters:
                    rng = np.random.default_rng(zlib.crc32(text))
                    starts = rng.integers(0, max(1, len(letters) - WINDOW + 1), PER_DOC if len(letters) > WINDOW else 1)
                    out += [(lang, letters[s : s + WINDOW]) for s in starts.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["lang", "letters"])

    rows = map_arrow(drawn, cut, "lang string, letters binary").collect()
    return sorted((r.lang, bytes(r.letters)) for r in rows)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network trained on the rows of ``docs`` that have a language; None if none has."""
    rows = sampled_windows(docs, sample)
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    network = Network(labels)
    x, _ = windows_of([t for _, t in rows])
    network.train(x, np.asarray([labels.index(lang) for lang, _ in rows]))
    return network


def identify(docs: DataFrame, network: Network | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score."""
    kinds = ", ".join(f"{c} {t}" for c, t in docs.select(*keep).dtypes)
    held = docs.sparkSession.sparkContext.broadcast(network)  # a fixed number of filters; a few columns for each language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        tables = net.tables() if net else None
        for batch in batches:
            texts = utf8(batch.column(len(keep)))
            ask = [i for i, t in enumerate(texts) if net and has_letter(t)]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            for a in range(0, len(ask), 512):
                part = ask[a : a + 512]
                p = net.predict([letters_of(texts[i]) for i in part], tables)
                for i, row in zip(part, p, strict=True):
                    pred[i], score[i] = net.labels[int(row.argmax())], float(row.max())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return map_arrow(docs.select(*keep, "text"), work, f"{kinds}, lang_pred string, score double")


def op3_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    return identify(docs, fit(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])
