"""Quality rules: fixed limits, and robust multivariate outliers within each language and source.

Every text gives a few counts. Their transforms (``FEATURES``) form a vector, and each
language and source has a minimum-covariance-determinant estimate of where its vectors lie.
The search begins at three deterministic estimates: medians and absolute deviations, the
covariance of the spatial signs, and the half of the rows that is nearest to the medians.
From each, concentration steps take the ``KEEP`` share of the rows that are nearest to the
centre and estimate mean and covariance anew, until a step lowers the determinant no more;
each group keeps the settled estimate of the least determinant. A text whose squared
Mahalanobis distance is beyond the chi-squared quantile ``1 - TAIL`` is rejected.

All rows take part in every step, whatever their number. A step is two aggregates over the
narrow table of vectors for all starts together, both combined before they are exchanged, so
a source with a third of the rows is no single task's work. The estimates are one row for
each group, written to the shared folder; they are broadcast only if that table's size is
under the session's threshold.

Groups of fewer than ``LEAST_ROWS`` rows are pooled within their language, and pools that
are still small over all languages; a pool that is small even then rejects nothing.
``FLOOR`` is the standard deviation that every feature has at least, so that a group of
uniform texts does not reject one that differs by a hair; it is part of every determinant.

Defined cases: a null text has no words and fails; nulls in lang or source are values like
others; rows that repeat are judged each; rows whose distances tie at a step's limit are all
taken; a distance at the quantile itself is kept; of starts with equal determinants the
first counts; an empty table gives no rows; columns of the input that are named like the
operator's own give way to them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.llm.common import map_arrow, table, utf8
from facetloom.shared import materialize

LEAST_WORDS, MOST_REPEATED = 10, 20
REPEAT = 5
KEEP, TAIL = 0.75, 1e-9
LEAST_ROWS = 50
#: A concentration step counts if it lowers the logarithm of the determinant by this, so that every search ends.
SETTLED = 1e-3
#: Feature and the least standard deviation that it is given.
FLOOR = {"word_length": 0.10, "symbols": 0.08, "dup_lines": 0.20, "repeats": 0.20, "digits": 0.15}
FEATURES = list(FLOOR)
P = len(FEATURES)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits")


def repeated_words(words: list[bytes], size: int = REPEAT) -> int:
    """Words inside windows that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0  # words before ``covered`` are counted
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + size - max(i, covered)
            covered = i + size
    return total


def count(text: bytes | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for a text."""
    text = text or b""
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(joined) if joined.isascii() else len(joined.decode()),
        len(text) - len(text.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, b"0123456789")),
    )


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text) and the columns ``COUNTS``."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray([count(t) for t in utf8(batch.column(at))], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v) for v in values.T)], names=[*batch.schema.names, *(f"__{c}" for c in COUNTS)])

    return map_arrow(docs, work, T.StructType([*docs.schema.fields, *(T.StructField(f"__{c}", T.LongType()) for c in COUNTS)]))


def features() -> list[Column]:
    """The transforms of the counts: a logarithm of the mean word length, and roots of shares."""
    c = {n: F.col(f"__{n}").cast("double") for n in COUNTS}
    words, chars, lines = (F.greatest(c[n], F.lit(1.0)) for n in ("n_words", "word_chars", "n_lines"))
    return [
        F.log(chars / words).alias("word_length"),
        F.sqrt(c["n_symbols"] / words).alias("symbols"),
        F.sqrt(c["n_dup_lines"] / lines).alias("dup_lines"),
        F.sqrt(c["n_repeat_words"] / words).alias("repeats"),
        F.sqrt(c["n_digits"] / chars).alias("digits"),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """The chi-squared distribution function, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


#: What the covariance of the kept share of a normal sample is to be multiplied by.
CONSISTENCY = KEEP / chi2_cdf(chi2_quantile(KEEP, P), P + 2)
CUTOFF = chi2_quantile(1 - TAIL, P)
ESTIMATES = "gid string, k int, centre array<double>, inverse array<double>, log_det double"


def _distance(centre: Column, inverse: Column) -> Column:
    """The squared Mahalanobis distance of a row's features from a centre."""
    d = [F.col(f) - centre[i] for i, f in enumerate(FEATURES)]
    terms = [inverse[i * P + j] * d[i] * d[j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    return sum(terms[1:], terms[0])


def _invert(moments: DataFrame) -> DataFrame:
    """Rows gid, k (number of the start), centre and covariance (flat) as estimates; every variance is raised by the floor's square."""
    floor = np.square(list(FLOOR.values()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cov = np.asarray(batch.column(3).to_pylist(), dtype=float).reshape(-1, P, P) + np.diag(floor)
            inverse = np.linalg.inv(cov).reshape(-1, P * P).tolist()
            columns = [*batch.columns[:3], pa.array(inverse, pa.list_(pa.float64())), pa.array(np.linalg.slogdet(cov)[1], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["gid", "k", "centre", "inverse", "log_det"])

    return materialize(map_arrow(moments, work, ESTIMATES), "estimates")


def _moments(take: Column, around: list[Column], scale: float = 1.0) -> tuple[Column, Column]:
    """Mean and covariance (flat) of the rows for which ``take`` holds, summed as differences from near the mean."""
    u = [F.when(take, F.col(f) - around[i]) for i, f in enumerate(FEATURES)]
    n = F.count(F.when(take, 1))
    mean = [F.sum(x) / n for x in u]
    second = {(i, j): F.sum(u[i] * u[j]) / n for i in range(P) for j in range(i, P)}
    centre = F.array(*[F.first(around[i]) + mean[i] for i in range(P)])
    return centre, F.array(*[(second[min(i, j), max(i, j)] - mean[i] * mean[j]) * scale for i in range(P) for j in range(P)])


def _starts(points: DataFrame) -> DataFrame:
    """The estimates from which the search begins."""
    middle = materialize(points.groupBy("gid").agg(*[F.percentile_approx(f, 0.5, 1000).alias(f"m_{f}") for f in FEATURES]), "medians")
    apart = [(F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{f}")), 0.5, 1000) * 1.4826).alias(f"s_{f}") for f in FEATURES]
    scale = points.join(middle, "gid").groupBy("gid").agg(*[F.first(f"m_{f}").alias(f"m_{f}") for f in FEATURES], *apart)
    scale = materialize(scale, "scales")
    z = {f: (F.col(f) - F.col(f"m_{f}")) / F.greatest(F.col(f"s_{f}"), F.lit(FLOOR[f])) for f in FEATURES}
    scaled = points.join(scale, "gid").withColumn("norm", sum(F.pow(z[f], F.lit(2)) for f in FEATURES))
    half = materialize(scaled.groupBy("gid").agg(F.percentile_approx("norm", 0.5, 1000).alias("half")), "halves")
    centre = F.array(*[F.first(f"m_{f}") for f in FEATURES])
    single = F.array(*[F.first(F.pow(f"s_{f}", F.lit(2))) if f == g else F.lit(0.0) for f in FEATURES for g in FEATURES])
    apart = lambda f: F.col(f) - F.col(f"m_{f}")
    sign = F.array(*[F.coalesce(F.avg(F.when(F.col("norm") > 0, apart(f) * apart(g) / F.col("norm"))) * P, F.lit(0.0)) for f in FEATURES for g in FEATURES])
    near, spread = _moments(F.col("norm") <= F.col("half"), [F.col(f"m_{f}") for f in FEATURES])
    found = scaled.join(half, "gid").groupBy("gid").agg(F.array(*[F.struct(c.alias("centre"), v.alias("cov")) for c, v in ((centre, single), (centre, sign), (near, spread))]).alias("e"))
    return _invert(found.select("gid", F.posexplode("e").alias("k", "e")).select("gid", "k", "e.*"))


def concentrated(points: DataFrame, now: DataFrame) -> DataFrame:
    """An estimate from the rows that are nearest by each of the estimates ``now``."""
    measured = points.join(now, "gid").withColumn("d2", _distance(F.col("centre"), F.col("inverse")))
    limit = materialize(measured.groupBy("gid", "k").agg(F.percentile_approx("d2", KEEP, 1000).alias("limit")), "limits")
    centre, cov = _moments(F.col("d2") <= F.col("limit"), [F.col("centre")[i] for i in range(P)], CONSISTENCY)
    return _invert(measured.join(limit, ["gid", "k"]).groupBy("gid", "k").agg(centre.alias("new"), cov.alias("cov")))


def fit(points: DataFrame) -> DataFrame:
    """The estimate (centre, inverse of the covariance, log_det) for each ``gid`` of ``points``, which has the columns gid and ``FEATURES``."""
    now = concentrated(points, _starts(points)).withColumn("moved", F.lit(True))
    while True:
        new = concentrated(points, now.where("moved").drop("moved")).select("gid", "k", F.struct("centre", "inverse", "log_det").alias("new"))
        moved = F.coalesce(F.col("new.log_det") < F.col("log_det") - SETTLED, F.lit(False))
        best = F.when(moved, F.col("new")).otherwise(F.struct("centre", "inverse", "log_det"))
        now = materialize(now.join(new, ["gid", "k"], "left").select("gid", "k", best.alias("best"), moved.alias("moved")).select("gid", "k", "best.*", "moved"), "estimates")
        if now.where("moved").isEmpty():
            break
    least = F.min_by(F.struct("centre", "inverse", "log_det"), F.struct("log_det", "k"))
    return now.groupBy("gid").agg(least.alias("best")).select("gid", "best.*")


def _groups(rows: DataFrame) -> DataFrame:
    """The group (null: none) of every language and source; small ones are pooled."""
    sizes = materialize(rows.groupBy("__lang", "__source").count().withColumn("own", F.col("count") >= LEAST_ROWS), "sizes")
    pools = sizes.groupBy("__lang").agg(F.coalesce(F.sum(F.when(~F.col("own"), F.col("count"))), F.lit(0)).alias("pooled"))
    level = F.when(F.col("own"), 2).when(F.col("pooled") >= LEAST_ROWS, 1).otherwise(0)
    named = materialize(sizes.join(pools, "__lang").withColumn("level", level), "groups")
    rest = named.where("level = 0").agg(F.sum("count")).first()[0] or 0
    gid = F.when(F.col("level") == 2, F.concat_ws("\x1f", F.lit("2"), "__lang", "__source")).when(F.col("level") == 1, F.concat_ws("\x1f", F.lit("1"), "__lang")).when(F.lit(rest >= LEAST_ROWS), F.lit("0"))
    return named.select("__lang", "__source", gid.alias("gid"))


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (which has text, lang and source) with the columns
    ``COUNTS`` (named with two underscores), base_failed, distance (null: not measured) and kept."""
    own = [*[f"__{c}" for c in COUNTS], "base_failed", "distance", "kept"]
    given = F.struct(*[F.col(c) for c in keep if c not in own]).alias("__given")
    named = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")).alias(f"__{c}") for c in ("lang", "source")]
    rows = counted(docs.select(given, "text", *named)).drop("text")
    rows = materialize(rows, "counts")
    groups = materialize(_groups(rows), "groups")
    points = materialize(rows.select("__lang", "__source", *features()).join(groups, ["__lang", "__source"]).where("gid is not null").select("gid", *FEATURES), "points")
    estimates = materialize(groups.join(fit(points), "gid").select("__lang", "__source", "centre", "inverse"), "estimates")
    failed = (F.col("__n_words") < LEAST_WORDS) | (100 * F.col("__n_repeat_words") > MOST_REPEATED * F.col("__n_words"))
    measured = rows.select("*", *features()).join(estimates, ["__lang", "__source"], "left")
    measured = measured.select("__given.*", *[f"__{c}" for c in COUNTS], failed.alias("base_failed"), _distance(F.col("centre"), F.col("inverse")).alias("distance"))
    return measured.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))


def op5_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", *[F.col(f"__{c}").alias(c) for c in COUNTS[:5]], "base_failed", "kept")
