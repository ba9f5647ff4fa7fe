"""The library's functions for use in SQL, as expressions of the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from facetloom.functions import text


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replace(value: str, pattern: str, by: str) -> str:
    return f"regexp_replace({value}, {_quoted(pattern)}, {_quoted(by)})"


def _squeeze(value: str) -> str:
    return f"trim({_replace(value, '(?U)' + chr(92) + 's+', ' ')})"


def register(spark: SparkSession) -> list[str]:
    """Makes ``fl_ngrams(tokens, n)``, ``fl_simple_tokens(text)``, ``fl_tokenize(text)``, ``fl_jaccard(a, b)`` and ``fl_dice(a, b)`` known to SQL."""
    edges = _replace(_replace(_squeeze("t"), rf"(\s|^)({text.EDGE}+)([a-zA-Z0-9])", "$1$2 $3"), rf"([a-zA-Z0-9])({text.EDGE}+)(\s|$)", "$1 $2$3")
    tokens = _replace(_squeeze(_replace(edges, text.PROTECT, " $0 ")), r"(\S)('s)(?= |$)", "$1 $2")
    common = "size(array_intersect(a, b))"
    functions = {
        "fl_ngrams(t ARRAY<STRING>, n INT) RETURNS ARRAY<STRING>": "CASE WHEN size(t) >= n THEN transform(sequence(1, size(t) - n + 1), i -> array_join(slice(t, i, n), ' ')) ELSE array() END",
        "fl_simple_tokens(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(lower(t), {_quoted(text.SIMPLE)}, 0)",
        "fl_tokenize(t STRING) RETURNS ARRAY<STRING>": f"filter(split({tokens}, ' '), x -> x <> '')",
        "fl_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": f"{common} / size(array_union(a, b))",
        "fl_dice(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": f"2 * {common} / (size(array_distinct(a)) + size(array_distinct(b)))",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in functions]
