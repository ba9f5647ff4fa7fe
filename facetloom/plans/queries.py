"""The operators as queries over the tables, and their SQL.

SQL engines have no look-ahead, so queries with SQL work on simple tokens; the whole
tokenizer has queries of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetloom.functions import rendering, sequences, text
from facetloom.operators import dedupe, neardup, ngrams, topics
from facetloom.operators import language_model as lm
from facetloom.plans import cache, sql_functions
from facetloom.plans.engine import Engine, QueryOptions, tokens_of
from facetloom.shared import materialize, new_path
from facetloom.sources import messages
from facetloom.streaming import counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL pieces -------------------------------------------------------------------------

TOK = "regexp_extract_all(lower(text), '[a-z0-9_@#'']+')"


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_JUNK, _EDGE, _PB = "'^[^a-zA-Z0-9_@]+$'", "'^[''\"“”‘’<>«»{}()\\[\\]]+$'", "'^([.,“\"''?!:;|-]+|&(amp|lt|gt|quot);)$'"
_HAS = lambda a, p: f"regexp_matches({a}, {p})"
_UNI = f"g[1] NOT IN ({_list(ngrams.SUPER + ngrams.NORMAL + ngrams.ONLY_AS_UNIGRAMS + ngrams.LEFTSIDE + ngrams.RIGHTSIDE)}) AND NOT {_HAS('g[1]', _PB)} AND NOT {_HAS('g[1]', _EDGE)}"
_SUP = _list(ngrams.SUPER)
_LONG = "NOT list_bool_or(list_transform(g, lambda x: starts_with(x, '#'))) AND len(list_filter(g, lambda x: starts_with(x, '@'))) <= 1"
_BI = f"g[1] NOT IN ({_SUP}) AND g[2] NOT IN ({_SUP}) AND NOT {_HAS('g[1]', _EDGE)} AND NOT {_HAS('g[2]', _EDGE)} AND NOT {_HAS('g[1]', _JUNK)} AND NOT {_HAS('g[2]', _JUNK)} AND {_LONG}"
_TRI = f"g[1] NOT IN ({_list(ngrams.SUPER + ngrams.LEFTSIDE)}) AND g[3] NOT IN ({_list(ngrams.SUPER + ngrams.RIGHTSIDE)}) AND NOT {_HAS('g[1]', _JUNK)} AND NOT {_HAS('g[3]', _JUNK)} AND NOT list_bool_or(list_transform(g, lambda x: {_HAS('x', _PB)})) AND {_LONG}"
#: tokens from the first that is no mention
_REST = "list_filter(t, lambda x, i: i >= coalesce(list_position(list_transform(t, lambda y: NOT starts_with(y, '@')), true), len(t) + 1))"

DOCS = f"d AS MATERIALIZED (SELECT doc_id, lang, source, text, coalesce({TOK}, []) AS t FROM documents)"


def _grams(n: int, of: str = "d", name: str = "") -> str:
    """A CTE g<n> of (doc_id, n, ngram) with every filtered n-gram."""
    keep = {1: _UNI, 2: _BI, 3: _TRI}[n]
    toks = "t" if n == 1 else _REST
    return f"g{n}{name} AS (SELECT doc_id, {n} AS n, array_to_string(g, ' ') AS ngram FROM (SELECT doc_id, t[i : i + {n - 1}] AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM (SELECT doc_id, {toks} AS t FROM {of}) WHERE len(t) >= {n})) WHERE {keep})"


def _all(of: str = "d", name: str = "") -> str:
    return ", ".join(_grams(n, of, name) for n in (1, 2, 3)) + f", g{name} AS MATERIALIZED (FROM g1{name} UNION ALL FROM g2{name} UNION ALL FROM g3{name})"


Q = "with"
_FG = f"""{DOCS}, f AS (SELECT * FROM d WHERE lang = 'en' AND list_contains(t, '{Q}')), b AS (SELECT * FROM d WHERE NOT (lang = 'en' AND list_contains(t, '{Q}'))),
{_all('f', 'f')}, {_all('b', 'b')},
fc AS MATERIALIZED (SELECT n, ngram, count(DISTINCT doc_id) AS cnt FROM gf GROUP BY ALL), bc AS MATERIALIZED (SELECT n, ngram, count(*) AS bg_cnt FROM gb GROUP BY ALL),
fi AS (SELECT (SELECT sum(len(t)) FROM f) AS big_n, count(*) FILTER (n = 1) AS t1, count(*) FILTER (n = 2) AS t2, count(*) FILTER (n = 3) AS t3 FROM fc),
bi AS (SELECT (SELECT sum(len(t)) FROM b) AS b_big_n, count(*) FILTER (n = 1) AS b1, count(*) FILTER (n = 2) AS b2, count(*) FILTER (n = 3) AS b3 FROM bc),
j AS (SELECT fc.n, fc.ngram, cnt, coalesce(bg_cnt, 0) AS bg_cnt, big_n::DOUBLE AS big_n, b_big_n::DOUBLE AS b_big_n,
      CASE fc.n WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END AS ty, CASE fc.n WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END AS bty
      FROM fc LEFT JOIN bc ON fc.n = bc.n AND fc.ngram = bc.ngram, fi, bi WHERE cnt >= 3)"""
_P = {
    "mle": ("cnt / big_n", "bg_cnt / b_big_n"),
    "laplace": ("(cnt + 1) / (big_n + ty)", "(bg_cnt + 1) / (b_big_n + bty)"),
    "lidstone": ("(cnt + 0.5::DOUBLE) / (big_n + 0.5::DOUBLE * ty)", "(bg_cnt + 0.5::DOUBLE) / (b_big_n + 0.5::DOUBLE * bty)"),
}


def _ratio(kind: str) -> str:
    p, q = _P[kind]
    return f"round(CASE WHEN {q} = 0 THEN 0::DOUBLE ELSE ({p}) / ({q}) END, 9)"


_CMP = {k: f"{_FG}, c AS (SELECT n, ngram, cnt, bg_cnt, {_ratio(k)} AS ratio FROM j)" for k in _P}
_NORM = "CASE WHEN length(regexp_replace({x}, '^[^a-zA-Z0-9_@]+', '')) >= 1 THEN regexp_replace({x}, '^[^a-zA-Z0-9_@]+', '') ELSE {x} END"
_WORDS = f"list_transform(string_split(ngram, ' '), lambda x: {_NORM.format(x='x')})"
_T1 = f"{_CMP['lidstone']}, r AS MATERIALIZED (SELECT * FROM c WHERE len(list_filter({_WORDS}, lambda x: x <> '{Q}')) > 0 AND NOT (n > 1 AND list_last({_WORDS}) IN ({_list([w for w in ngrams.NORMAL if w != Q])})))"
_T2 = f"""{_T1}, dom AS (SELECT n - 1 AS n, cnt, unnest([array_to_string(w[1 : len(w) - 1], ' '), array_to_string(w[2 : len(w)], ' ')]) AS ngram FROM (SELECT n, cnt, string_split(ngram, ' ') AS w FROM r WHERE n > 1)),
top AS MATERIALIZED (SELECT * FROM r ANTI JOIN dom ON r.n = dom.n AND r.ngram = dom.ngram AND r.cnt = dom.cnt)"""
_PAIRS = f"""{DOCS}, {_grams(3)}, s AS (SELECT DISTINCT doc_id, ngram FROM g3), z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.ngram = b.ngram AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, common, 2 * common / (x.size + y.size)::DOUBLE AS dice FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE common >= 2 AND 2 * common / (x.size + y.size)::DOUBLE >= 0.65)"""
_COMP = f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT u, u AS v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
grp AS (SELECT documents.doc_id, coalesce(min(reach.v), documents.doc_id) AS group_id FROM documents LEFT JOIN reach ON reach.u = documents.doc_id GROUP BY documents.doc_id)"""


# ---- Spark pieces -----------------------------------------------------------------------


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as messages with their simple tokens, and ``low``, the text in lower case, which workers split into the same tokens."""
    df = messages.from_documents(spark, d).withColumn("toks", F.coalesce(text.simple_tokens("text"), F.array().cast("array<string>")))
    return df.withColumn("low", F.lower("text"))


def _models(spark: SparkSession, d: str) -> tuple[lm.LanguageModel, lm.LanguageModel]:
    df, hit = _docs(spark, d), _hit()
    return lm.foreground(df.where(hit), "low", urls=False), lm.background(df.where(~F.coalesce(hit, F.lit(False))), "low", urls=False)


def _hit() -> Column:
    """Whether a message of ``_docs`` is English and has the query's one word."""
    return (F.col("iso_language_code") == "en") & text.has_simple("low", Q)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("ratio", F.round("ratio", 9))


# ---- text -------------------------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed FROM documents")
def squeeze_ws(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.squeeze("text").alias("squeezed"))


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(html, '(\s|^)([''"“”‘’<>«»{}()\[\]]+)([a-zA-Z0-9])', '\1\2 \3', 'g'), '([a-zA-Z0-9])([''"“”‘’<>«»{}()\[\]]+)(\s|$)', '\1 \2\3', 'g') AS munged FROM pages"""
)
def edge_munge(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.munge_edges("html").alias("munged"))


@query(f"SELECT doc_id, array_to_string({TOK}, ' ') AS toks, len({TOK}) AS n_toks FROM documents")
def tokenize_simple(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join("toks", " ").alias("toks"), F.size("toks").cast("long").alias("n_toks"))


@query()
def tokenize_full(spark, d):
    toks = text.tokenize("text")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(toks, " ").alias("toks"))


@query()
def tokenize_html(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.size(text.tokenize("html")).alias("n_toks"))


@query(
    r"""SELECT conv_id, turn, CASE WHEN h AND s THEN 'BOTH_HS' WHEN h THEN 'HAPPY' WHEN s THEN 'SAD' ELSE 'NA' END AS sentiment
    FROM (SELECT conv_id, turn, regexp_matches(text, '\^_\^|[:=](|o|O|-)[D)\]]') AS h, regexp_matches(text, '[:=](|o|O|-)[(\[]') AS s FROM conversations)"""
)
def emoticon_sentiment(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.sentiment("text").alias("sentiment"))


@query(f"SELECT DISTINCT w AS token, {_NORM.format(x='w')} AS norm FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w FROM documents)")
def tok_norm(spark, d):
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)))
    return spark.read.parquet(f"{d}/documents.parquet").select(words.alias("token")).distinct().select("token", text.norm_token("token").alias("norm"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '\bhttp://', '', 'g'), '\bwww[0-9]?\.', '', 'g') AS label FROM pages")
def nice_label(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.nice_label("url").alias("label"))


@query()
def linkify(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.link_mentions(text.link_urls("url")).alias("html"))


@query("SELECT conv_id, turn, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS safe FROM conversations")
def html_escape(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.escape_html("text").alias("safe"))


@query(
    """SELECT event_id, CASE WHEN day > 0 THEN day || ' day' || CASE day WHEN 1 THEN '' ELSE 's' END WHEN rest > 3600 THEN rest // 3600 || ' hour' || CASE rest // 3600 WHEN 1 THEN '' ELSE 's' END
    WHEN rest > 60 THEN rest // 60 || ' minute' || CASE rest // 60 WHEN 1 THEN '' ELSE 's' END ELSE rest || ' second' || CASE rest WHEN 1 THEN '' ELSE 's' END END AS ago
    FROM (SELECT event_id, s // 86400 AS day, s % 86400 AS rest FROM (SELECT event_id, epoch((SELECT max(ts) FROM events))::BIGINT - epoch(ts)::BIGINT AS s FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)))"""
    .replace("(SELECT max(ts) FROM events)", "(SELECT date_trunc('second', max(ts)) FROM events)")
)
def nice_timedelta(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.date_trunc("second", "ts").cast("timestamp").alias("ts"))
    last = events.agg(F.max("ts").alias("last"))
    return events.crossJoin(F.broadcast(last)).select("event_id", text.nice_timedelta(F.unix_seconds("last") - F.unix_seconds("ts")).alias("ago"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) % 60 || 'm:' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s // 3600 || ':' || lpad(((s // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS clock FROM (SELECT l_orderkey, l_linenumber, l_partkey::BIGINT * 7 AS s FROM lineitem)")
def clock_format(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", text.clock(F.col("l_partkey").cast("long") * 7).alias("clock"))


@query()
def si_number_format(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.si_number("o_totalprice").alias("shown"))


@query("SELECT DISTINCT n_name AS name, CASE WHEN len(regexp_split_to_array(n_name, ' +')) > 1 THEN '\"' || n_name || '\"' ELSE n_name END AS simple_query FROM nation")
def trends_simple_query(spark, d):
    names = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name")).distinct()
    return messages.with_simple_query(names)


@query(
    """SELECT p_name AS label, CASE WHEN p_name = '**EXTRAS**' THEN NULL ELSE 'some query ' || CASE WHEN NOT junk AND len(w) > 1 THEN '"' || array_to_string(w, ' ') || '"' ELSE array_to_string(w, ' ') END END AS refined
    FROM (SELECT p_name, w, coalesce(list_bool_or(list_transform(w, lambda x: regexp_matches(x, '^[^a-zA-Z0-9@_-]+$'))), false) AS junk FROM (SELECT p_name, list_filter(regexp_split_to_array(regexp_replace(p_name, '["/]', '', 'g'), '\\s+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT p_name FROM part)))"""
)
def query_refinement(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("label")).distinct().withColumn("refined", text.query_refinement("some query", "label"))


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def levenshtein_pairs(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    a, b = n.select("n_regionkey", F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"))


# ---- arrays -----------------------------------------------------------------------------


@query(f"SELECT doc_id, coalesce((SELECT min(i) - 1 FROM (SELECT unnest(range(1, len(t))) AS i) WHERE t[i] = 'of' AND t[i + 1] = 'the'), -1) AS at FROM (SELECT doc_id, {TOK} AS t FROM documents)")
def kmp_index(spark, d):
    return _docs(spark, d).select("doc_id", sequences.index_of(F.array(F.lit("of"), F.lit("the")), "toks").cast("long").alias("at"))


@query()
def align_offsets(spark, d):
    df = spark.read.parquet(f"{d}/conversations.parquet").withColumn("squeezed", text.squeeze("text")).withColumn("toks", text.tokenize("squeezed"))
    return df.select("conv_id", "turn", F.size("toks").alias("n_toks"), F.array_join(F.transform(sequences.align("toks", "squeezed"), lambda i: i.cast("string")), ",").alias("offsets"))


@query()
def highlight(spark, d):
    df = spark.read.parquet(f"{d}/conversations.parquet").withColumn("toks", text.simple_tokens("text"))
    return df.select("conv_id", "turn", rendering.message_html("toks", F.lower("text"), ["of", "the"], [["the"], ["in", "the"]]).alias("html"))


_SETS = "s AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_@#'']+'))) AS w FROM conversations)"


@query(f"WITH {_SETS} SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 9) AS jaccard, round(2 * len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w)), 9) AS dice FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE len(a.w) + len(b.w) > 0")
def jaccard_dice_turns(spark, d):
    w = F.array_distinct(text.simple_tokens("text"))
    s = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", w.alias("w"))
    b = s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return s.join(b, ["conv_id", "turn"]).where(F.size("w") + F.size("v") > 0).select("conv_id", "turn", F.round(sequences.jaccard("w", "v"), 9).alias("jaccard"), F.round(sequences.dice("w", "v"), 9).alias("dice"))


@query("SELECT user_id, min(k) AS first_k, max(k) AS last_k, count(*) AS n FROM (SELECT user_id, k, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS island FROM (SELECT DISTINCT user_id, (epoch(ts)::BIGINT // 3600) AS k FROM (SELECT user_id, date_trunc('hour', ts) AS ts FROM events))) GROUP BY user_id, island")
def runs_of_hours(spark, d):
    hours = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.floor(F.unix_seconds(F.date_trunc("hour", "ts").cast("timestamp")) / 3600).alias("k")).distinct()
    island = F.col("k") - F.row_number().over(Window.partitionBy("user_id").orderBy("k"))
    return hours.withColumn("island", island).groupBy("user_id", "island").agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.count("*").alias("n")).drop("island")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def argmax_order(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def histogram_uniq_c(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS key, string_agg(n_name, ',' ORDER BY n_name) AS vals FROM nation GROUP BY 1")
def full_group_by(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").groupBy(F.col("n_regionkey").alias("key")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("vals"))


# ---- messages ---------------------------------------------------------------------------


@query("SELECT doc_id, source AS from_user FROM documents WHERE lang = 'en'")
def english_filter(spark, d):
    return messages.english(messages.from_documents(spark, d)).select("doc_id", "from_user")


@query("SELECT doc_id, source AS from_user FROM documents ORDER BY doc_id DESC LIMIT 200")
def topk_by_id(spark, d):
    return messages.from_documents(spark, d).orderBy(F.desc("doc_id")).limit(200).select("doc_id", "from_user")


@query(f"WITH {DOCS} SELECT doc_id FROM d WHERE list_contains(t, '{Q}') AND (SELECT bool_or(t[i] = 'of' AND t[i + 1] = 'the') FROM (SELECT unnest(range(1, len(t))) AS i))")
def query_match(spark, d):
    df = messages.from_documents(spark, d)
    return messages.search(df, f'{Q} "of the"', pages=None).select("doc_id")


@query("SELECT max(doc_id) AS doc_id, text FROM documents GROUP BY text")
def hard_dedupe_text(spark, d):
    return dedupe.hard_dedupe(messages.from_documents(spark, d), "text").select("doc_id", "text")


@query("SELECT max(doc_id) AS doc_id, source AS from_user, sha256(text) AS digest FROM documents GROUP BY text, source")
def hard_dedupe_user_text(spark, d):
    return dedupe.hard_dedupe(messages.from_documents(spark, d)).select("doc_id", "from_user", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query()
def hard_dedupe_url_text(spark, d):
    return dedupe.hard_dedupe(messages.from_documents(spark, d), "text_url").select("doc_id", "from_user")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS ids, string_agg(source, ' ' ORDER BY doc_id) AS users, count(*) > 1 AS multi, min(1240000000 + doc_id) AS created_s FROM documents GROUP BY text")
def multitweet_merge(spark, d):
    m = dedupe.merge_same_text(messages.from_documents(spark, d))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return m.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), join("ids").alias("ids"), join("multi_from_user").alias("users"), "multi", F.unix_seconds("created_at").alias("created_s"))


@query("SELECT doc_id, strftime(make_timestamp((1240000000 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%S') AS created_at, source AS from_user, regexp_replace(text, '[\\r\\n\\t]', ' ', 'g') AS text FROM documents")
def tsv_projection(spark, d):
    return messages.tsv_rows(messages.from_documents(spark, d))


@query("SELECT epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT AS seconds FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def time_since_earliest(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.unix_seconds(F.date_trunc("second", "ts").cast("timestamp")).alias("s"))
    return e.agg((F.max("s") - F.min("s")).alias("seconds"))


@query("SELECT user_id, (SELECT max(epoch(ts)) FROM events) - max(epoch(ts)) > 60 AS expired FROM events GROUP BY user_id")
def ttl_expired(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts").alias("now"))
    return e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now)).select("user_id", cache.expired(F.col("last"), F.col("now")).alias("expired"))


@query("SELECT key FROM (SELECT user_id::VARCHAR AS key, max(epoch(ts)) FILTER (event_type = (SELECT min(event_type) FROM events)) AS last FROM events GROUP BY 1) WHERE last IS NULL UNION ALL SELECT key FROM (SELECT user_id::VARCHAR AS key, max(epoch(ts)) FILTER (event_type = (SELECT min(event_type) FROM events)) AS last FROM events GROUP BY 1 HAVING (SELECT max(epoch(ts)) FROM events) - max(epoch(ts)) FILTER (event_type = (SELECT min(event_type) FROM events)) > 10 ORDER BY last, key LIMIT 2)")
def prebake_selection(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    top = e.agg(F.max("ts").alias("now"), F.min("event_type").alias("kind"))
    entries = e.crossJoin(F.broadcast(top)).groupBy("key").agg(F.max(F.when(F.col("event_type") == F.col("kind"), F.col("ts"))).alias("last_update"), F.max("now").alias("now"))
    return cache.to_refresh(entries, F.col("now")).select("key")


# ---- n-grams and language model ---------------------------------------------------------


def _counted(n: int):
    def run(spark, d):
        return ngrams.counted(_docs(spark, d), (n,), "low", urls=False).select("ngram", "cnt", "docs")

    return run


for _n, _name in ((1, "unigrams_filtered"), (2, "bigrams_filtered"), (3, "trigrams_filtered")):
    QUERIES[_name] = _counted(_n)
    SQL[_name] = f"WITH {DOCS}, {_grams(_n)} SELECT ngram, count(*) AS cnt, count(DISTINCT doc_id) AS docs FROM g{_n} GROUP BY ngram"


@query(f"WITH {DOCS} SELECT doc_id, len({_REST}) AS n_left FROM d")
def kill_leading_ats(spark, d):
    return _docs(spark, d).select("doc_id", F.size(ngrams.drop_leading_mentions(F.col("toks"))).cast("long").alias("n_left"))


@query(f"WITH {DOCS}, {_all()} SELECT n, ngram, count(DISTINCT doc_id) AS cnt FROM g GROUP BY ALL")
def fg_df_counts(spark, d):
    return lm.foreground(_docs(spark, d), "low", urls=False).counts


@query(f"WITH {DOCS}, {_all()} SELECT n, ngram, count(*) AS cnt FROM g GROUP BY ALL")
def bg_tf_counts(spark, d):
    return lm.background(_docs(spark, d), "low", urls=False).counts


@query(f"WITH {DOCS}, {_all()}, c AS (SELECT DISTINCT n, ngram FROM g) SELECT (SELECT sum(len(t))::BIGINT FROM d) AS big_n, count(*) FILTER (n = 1) AS types_1, count(*) FILTER (n = 2) AS types_2, count(*) FILTER (n = 3) AS types_3 FROM c")
def lm_info(spark, d):
    return lm.background(_docs(spark, d), "low", urls=False).info


def _ratios(kind: str):
    return lambda spark, d: _rounded(lm.compare(*_models(spark, d), kind))


for _kind in lm.SMOOTHING:
    QUERIES[f"likelihood_ratio_{_kind}"] = _ratios(_kind)
    SQL[f"likelihood_ratio_{_kind}"] = f"WITH {_CMP[_kind]} SELECT * FROM c"


@query(f"WITH {_CMP['lidstone']} SELECT n, ngram, cnt, ratio FROM c ORDER BY ratio DESC, ngram DESC, n LIMIT 40")
def top_phrases(spark, d):
    return _rounded(lm.compare(*_models(spark, d))).select("n", "ngram", "cnt", "ratio").orderBy(F.desc("ratio"), F.desc("ngram"), "n").limit(40)


@query(f"WITH {_FG} SELECT n, ngram, round((cnt + 0.1::DOUBLE) / (bg_cnt + 0.1::DOUBLE), 9) AS ratio FROM j")
def pseudocount_ratio(spark, d):
    c = lm.compare(*_models(spark, d))
    return c.select("n", "ngram", F.round(lm.pseudocounted_ratio(F.col("cnt"), F.col("bg_cnt")), 9).alias("ratio"))


@query(f"WITH {DOCS}, {_grams(2)} SELECT 2 AS n, ngram, count(*) AS cnt, repeat('*', count(*)::INT) AS bar FROM g2 GROUP BY ngram HAVING count(*) >= 2")
def ngram_histogram(spark, d):
    return lm.histogram(ngrams.counted(_docs(spark, d), (2,), "low", urls=False).drop("docs"))


@query(f"WITH {DOCS}, {_grams(1)}, {_grams(2)}, u AS (SELECT doc_id, list(ngram) AS a FROM g1 GROUP BY 1), b AS (SELECT doc_id, list(replace(ngram, ' ', '_')) AS a FROM g2 GROUP BY 1) SELECT d.doc_id, coalesce(len(u.a), 0) + coalesce(len(b.a), 0) AS n_features, coalesce(array_to_string(list_sort(list_concat(u.a, b.a)), ' '), '') AS features FROM d LEFT JOIN u USING (doc_id) LEFT JOIN b USING (doc_id)")
def featurize(spark, d):
    found = ngrams.features(_docs(spark, d), urls=False)
    return found.select("doc_id", F.size("features").cast("long").alias("n_features"), F.array_join(F.sort_array("features"), " ").alias("features"))


@query(f"WITH {DOCS}, {_grams(2)} SELECT string_split(ngram, ' ')[1] AS first, count(DISTINCT ngram) AS followers, count(DISTINCT doc_id) AS docs FROM g2 GROUP BY 1")
def wildcard_bigrams(spark, d):
    return ngrams.followers(_docs(spark, d), "low", urls=False)


# ---- topics -----------------------------------------------------------------------------


@query(f"WITH {_T1} SELECT n, ngram, cnt, ratio FROM r")
def rejected_phrases(spark, d):
    return _rounded(topics.reject_phrases(lm.compare(*_models(spark, d)), [Q])).select("n", "ngram", "cnt", "ratio")


@query(f"WITH {_T2} SELECT n, ngram, cnt, ratio FROM top")
def weak_dominance_antijoin(spark, d):
    return _rounded(topics.extract_topics(*_models(spark, d), [Q])).select("n", "ngram", "cnt", "ratio")


@query(f"WITH {_PAIRS}, e AS (SELECT a AS doc_id FROM pairs UNION ALL SELECT b FROM pairs) SELECT documents.doc_id, count(e.doc_id) AS n_links FROM documents LEFT JOIN e USING (doc_id) GROUP BY documents.doc_id")
def neardup_links(spark, d):
    df = _docs(spark, d)
    return neardup.message_links(df, tokens="low")


@query(f"{_COMP} SELECT doc_id, group_id FROM grp")
def neardup_components(spark, d):
    df = _docs(spark, d)
    return neardup.message_groups(df, tokens="low")


@query(f"{_COMP} SELECT group_id, min(doc_id) AS head, count(*) AS n FROM grp GROUP BY 1")
def neardup_groups_head(spark, d):
    df = _docs(spark, d)
    groups = neardup.message_groups(df, tokens="low").join(df.select("doc_id", "created_at"), "doc_id")
    return groups.groupBy("group_id").agg(F.min_by("doc_id", F.struct("created_at", "doc_id")).alias("head"), F.count("*").alias("n"))


def _topic_members(spark, d):
    """Topics, and (n, ngram, group_id), a row for each message of theirs and hardly any others.

    A message gets its group before its n-grams are looked up, so that members are exchanged
    only where they are counted; what is no topic goes after that (``_of_topics``).
    """
    df = _docs(spark, d)
    found = materialize(topics.extract_topics(*_models(spark, d), [Q]).select("n", "ngram", "cnt", "ratio"), "topics")
    groups = neardup.message_groups(df, tokens="low")
    grouped = df.where(_hit()).select("doc_id", "low").join(groups, "doc_id").select("group_id", "low")
    return found, ngrams.occurrences(grouped, "low", ("group_id",), urls=False, once=True, only=ngrams.among(found))


def _of_topics(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.select("n", "ngram"), ["n", "ngram"], "left_semi")


_MEMBERS = f"{_COMP}, {_T2.replace(DOCS + ', ', '')}, mem AS (SELECT DISTINCT top.n, top.ngram, gf.doc_id, grp.group_id FROM top JOIN gf ON top.n = gf.n AND top.ngram = gf.ngram JOIN grp ON grp.doc_id = gf.doc_id)"


@query(f"{_MEMBERS} SELECT n, ngram, count(DISTINCT group_id) AS group_count, count(*) AS doc_count FROM mem GROUP BY n, ngram")
def topic_group_counts(spark, d):
    found, members = _topic_members(spark, d)
    return _of_topics(topics.topic_counts(members), found)


@query(f"{_MEMBERS} SELECT n, ngram FROM mem GROUP BY n, ngram HAVING count(DISTINCT group_id) > 1")
def singleton_topic_filter(spark, d):
    found, members = _topic_members(spark, d)
    return _of_topics(topics.topic_counts(members).where("group_count > 1").select("n", "ngram"), found)


@query()
def topic_merge_components(spark, d):
    found, members = _topic_members(spark, d)
    return topics.merge_components(materialize(_of_topics(members.distinct(), found), "members"))


_TURNS = f"d AS MATERIALIZED (SELECT conv_id * 1000 + turn AS doc_id, 'en' AS lang, role AS source, text, coalesce({TOK}, []) AS t FROM conversations)"


@query(f"WITH {_T2.replace(DOCS, _TURNS)}, shown AS (SELECT DISTINCT doc_id FROM gf JOIN top ON top.n = gf.n AND top.ngram = gf.ngram WHERE top.cnt >= 40) SELECT doc_id FROM f ANTI JOIN shown USING (doc_id)")
def leftovers(spark, d):
    """Short messages that none of the most frequent topics has."""
    df = messages.from_conversations(spark, d).withColumn("toks", F.coalesce(text.simple_tokens("text"), F.array().cast("array<string>")))
    hit = messages.matches(Q, F.col("toks"))
    found = topics.extract_topics(lm.foreground(df.where(hit), urls=False), lm.background(df.where(~hit), urls=False), [Q]).where("cnt >= 40")
    found = materialize(found, "topics")
    return topics.leftovers(df.where(hit), topics.topic_docs(found, ngrams.postings(df.where(hit), urls=False, only=ngrams.among(found)))).select("doc_id")


@query(f"WITH {_T2}, three AS (SELECT n, ngram, ratio FROM top ORDER BY ratio DESC, n DESC, ngram LIMIT 3) SELECT three.n, three.ngram, ratio, string_agg(DISTINCT doc_id::VARCHAR, ' ' ORDER BY doc_id::VARCHAR) AS ids FROM three JOIN gf ON three.n = gf.n AND three.ngram = gf.ngram GROUP BY ALL")
def facet_preload(spark, d):
    df = _docs(spark, d)
    found = materialize(topics.best(_rounded(topics.extract_topics(*_models(spark, d), [Q]))), "topics")
    top = topics.preloaded(found, ngrams.postings(df.where(_hit()), "low", urls=False, only=ngrams.among(found)))
    return top.select("n", "ngram", "ratio", F.array_join(F.sort_array(F.transform("doc_ids", lambda i: i.cast("string"))), " ").alias("ids"))


@query(f"WITH {_CMP['lidstone']} SELECT replace(ngram, ' ', '_') AS ngram, ratio FROM c WHERE n = 3")
def trigram_report(spark, d):
    return _rounded(lm.compare(*_models(spark, d))).where("n = 3").select(F.replace("ngram", F.lit(" "), F.lit("_")).alias("ngram"), "ratio")


def _search(spark, d):
    """A search over the whole tokenizer's tokens, against the messages that don't match."""
    corpus = messages.from_documents(spark, d)
    lines = materialize(ngrams.lines(corpus, ("doc_id", "iso_language_code"), tokens_of("text")), "lines")
    bg = lm.background(lines.where(~F.coalesce(messages.matches_line(Q, F.col("line")), F.lit(False))), "line")
    options = QueryOptions(q=Q)
    engine = Engine(corpus, bg, lines=lines)
    return engine, options, engine.search(options)


@query()
def topics_full(spark, d):
    return _search(spark, d)[2].merged.select("rank", "label", F.array_join("ngrams", "|").alias("ngrams"), "ratio", F.size("group_ids").alias("group_count"))


@query()
def extras_full(spark, d):
    return _search(spark, d)[2].shown.where("rank = -1").select("doc_id", "group_id")


@query()
def topics_json(spark, d):
    engine, options, results = _search(spark, d)
    return engine.to_json(results, options)


@query()
def drill_down(spark, d):
    engine, options, results = _search(spark, d)
    label = results.merged.where("rank = 0").first().label
    found = engine.search(replace(engine.refined(options, label), pages=1))
    return found.merged.select("rank", "label", "ratio", F.size("group_ids").alias("group_count"))


# ---- more functions of text -------------------------------------------------------------


@query(
    r"""SELECT conv_id, turn, regexp_matches(t, '\^_\^|[:=](|o|O|-)[D)\]]') AS happy, regexp_matches(t, '[:=](|o|O|-)[(\[]') AS sad, regexp_matches(t, ';(|o|O|-)[D)\]]') AS wink,
    regexp_matches(t, '[:=](|o|O|-)[pP]') AS tongue, regexp_matches(t, '([:=]|;)(|o|O|-)[doO/\\]') AS other FROM (SELECT conv_id, turn, replace(replace(replace(replace(text, '. ', ';-) '), 'e ', ':p '), 'que', '=D'), 'er', ':/') AS t FROM conversations)"""
)
def emoticon_kinds(spark, d):
    t = F.col("text")
    for a, b in ((". ", ";-) "), ("e ", ":p "), ("que", "=D"), ("er", ":/")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.emoticons(t).alias("e")).select("conv_id", "turn", "e.*")


@query("SELECT DISTINCT p_name AS name, replace(url_encode(p_name), '%20', '+') AS encoded FROM part")
def url_encoded(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name"), text.encode_url("p_name").alias("encoded")).distinct()


@query("SELECT conv_id, turn, lower(text) AS low FROM conversations")
def lower_tokens(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.array_join(text.lower_tokens(F.split("text", " ")), " ").alias("low"))


_SAID = "replace(replace(text, 'que ', chr(39) || 's '), 'er ', ' ' || chr(39) || ' t ')"


def _said() -> Column:
    return F.replace(F.replace("text", F.lit("que "), F.lit("'s ")), F.lit("er "), F.lit(" ' t "))


@query(f"SELECT conv_id, turn, regexp_replace({_SAID}, '(\\S)(''s)( |$)', '\\1 \\2\\3', 'g') AS split FROM conversations")
def clitics_split(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.split_clitics(_said()).alias("split"))


@query(f"SELECT conv_id, turn, array_to_string(list_filter(string_split(regexp_replace({_SAID}, '( |^)('') ([stm])( |$)', '\\1\\2\\3\\4', 'g'), ' '), lambda x: x <> ''), ' ') AS joined FROM conversations")
def clitics_rejoined(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.array_join(text.rejoin_clitics(F.split(_said(), " ")), " ").alias("joined"))


@query("SELECT conv_id, turn, regexp_replace(replace(text, ' de', ' @de'), '@([A-Za-z0-9_]+)', '<a class=\"at\" target=\"_blank\" href=\"http://twitter.com/\\1\">@\\1</a>', 'g') AS html FROM (SELECT * FROM conversations WHERE NOT regexp_matches(text, '@[A-Za-z0-9_]*[^\\x00-\\x7F]| de[a-z0-9]*[^\\x00-\\x7F]'))")
def mention_links(spark, d):
    """Over the turns whose mentions are of ASCII letters: SQL's patterns know no others."""
    said = spark.read.parquet(f"{d}/conversations.parquet").where(~F.rlike("text", F.lit("@[A-Za-z0-9_]*[^\\x00-\\x7F]| de[a-z0-9]*[^\\x00-\\x7F]")))
    return said.select("conv_id", "turn", text.link_mentions(F.replace("text", F.lit(" de"), F.lit(" @de"))).alias("html"))


@query(
    r"""SELECT DISTINCT p_name AS name, CASE WHEN regexp_matches(p_name, '([a-z]+) ([a-z]+)') THEN regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) END AS second, array_to_string(regexp_extract_all(p_name, '[aeiou]+'), '|') AS vowels,
    regexp_replace(p_name, '([a-z])\w*', '\1', 'g') AS initials, regexp_replace(p_name, '([aeiou]+)', '[[\1]]', 'g') AS shown FROM part"""
)
def pattern_helpers(spark, d):
    c = F.col("p_name")
    columns = [text.matched(c, "([a-z]+) ([a-z]+)", 2).alias("second"), F.array_join(text.all_matched(c, "[aeiou]+"), "|").alias("vowels"), text.replaced(c, r"([a-z])\w*", "$1").alias("initials"), text.shown_matches(c, "[aeiou]+").alias("shown")]
    return spark.read.parquet(f"{d}/part.parquet").select(c.alias("name"), *columns).distinct()


@query("SELECT event_id, agent, CASE WHEN regexp_matches(agent, 'Mobile.*Safari') THEN 10 ELSE 40 END AS max_topics FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Mobile/7A341 Safari/528' WHEN event_id % 3 = 1 THEN 'Safari/528 Mobile' ELSE event_type END AS agent FROM events)")
def phone_topics(spark, d):
    agent = F.when(F.col("event_id") % 3 == 0, "Mobile/7A341 Safari/528").when(F.col("event_id") % 3 == 1, "Safari/528 Mobile").otherwise(F.col("event_type"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", agent.alias("agent")).withColumn("max_topics", F.when(text.is_phone("agent"), 10).otherwise(40))


@query("SELECT DISTINCT p_name AS query, sha256('q=' || replace(url_encode(p_name), '%20', '+') || '&max_topics=40&format=json') AS key FROM part")
def cache_keys(spark, d):
    key = F.concat(F.lit("q="), text.encode_url("p_name"), F.lit("&max_topics=40&format=json"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("query"), cache.hashed_key(key).alias("key")).distinct()


@query("SELECT '<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>' AS html FROM nation")
def html_table(spark, d):
    return rendering.table_html(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name"))


@query("SELECT DISTINCT p_name AS label, CASE WHEN p_name = '**EXTRAS**' THEN '' ELSE replace(p_name, ' ', '&nbsp;') END AS phone, chr(27) || '[31m' || chr(27) || '[1m' || p_name || chr(27) || '[0m' AS red FROM part")
def label_markup(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("label"), text.label_html("p_name", True).alias("phone"), text.coloured("p_name", "bold", "red").alias("red")).distinct()


# ---- more functions of arrays and sets of messages --------------------------------------


@query(
    f"""SELECT conv_id, turn, array_to_string(list_transform(range(1, len(t) + 1), lambda i: (list_sum(list_transform(gaps[1 : i], lambda g: length(g))) + coalesce(list_sum(list_transform(t[1 : i - 1], lambda x: length(x))), 0))::BIGINT::VARCHAR), ',') AS offsets
    FROM (SELECT conv_id, turn, {TOK} AS t, regexp_split_to_array(lower(text), '[a-z0-9_@#'']+') AS gaps FROM conversations)"""
)
def align_simple(spark, d):
    at = sequences.align(text.simple_tokens("text"), F.lower("text"))
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.array_join(F.transform(at, lambda i: i.cast("string")), ",").alias("offsets"))


@query(f"SELECT conv_id, turn, array_to_string([t[3], t[1]], ' ') AS picked FROM (SELECT conv_id, turn, {TOK} AS t FROM conversations) WHERE len(t) >= 3")
def token_subset(spark, d):
    df = spark.read.parquet(f"{d}/conversations.parquet").withColumn("toks", text.simple_tokens("text")).where(F.size("toks") >= 3)
    return df.select("conv_id", "turn", F.array_join(text.subset("toks", F.array(F.lit(2), F.lit(0))), " ").alias("picked"))


@query(f"SELECT conv_id, turn, array_to_string(flatten([t[1 : 2], t[2 : 3], t[3 : 4]]), ' ') AS flat FROM (SELECT conv_id, turn, {TOK} AS t FROM conversations)")
def flatten_lists(spark, d):
    t = text.simple_tokens("text")
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.array_join(F.flatten(F.array(*[F.slice(t, i, 2) for i in (1, 2, 3)])), " ").alias("flat"))


@query("SELECT conv_id, count(*) AS n FROM (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN text END AS asked FROM conversations) WHERE asked IS NOT NULL GROUP BY conv_id")
def drop_nulls(spark, d):
    asked = F.when(F.col("turn") % 2 == 0, F.col("text")).alias("asked")
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", asked).dropna(subset=["asked"]).groupBy("conv_id").agg(F.count("*").alias("n"))


@query(f"WITH {DOCS} SELECT doc_id FROM d WHERE list_contains(t, '{Q}') ORDER BY doc_id DESC LIMIT 200")
def search_pages(spark, d):
    return messages.search(messages.from_documents(spark, d), Q).select("doc_id")


@query("SELECT doc_id, source AS from_user FROM documents WHERE lang = 'en'")
def saved_results(spark, d):
    path = new_path(spark, "saved")
    messages.save_results(messages.english(messages.from_documents(spark, d)).select("doc_id", "from_user"), path)
    return messages.load_results(spark, path)


@query(f"WITH {DOCS} SELECT doc_id FROM d WHERE list_contains(t, 'of') INTERSECT SELECT doc_id FROM d WHERE list_contains(t, 'from')")
def messages_in_both(spark, d):
    df = _docs(spark, d)
    one, two = (df.where(F.array_contains("toks", w)) for w in ("of", "from"))
    return topics.in_both(one, two, df).select("doc_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def excluded_ids(spark, d):
    return topics.excluding(messages.from_documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")).select("doc_id")


@query(
    f"""WITH s AS (SELECT conv_id AS topic, turn AS doc_id, list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS g FROM (SELECT conv_id, turn, {TOK} AS t FROM conversations)),
    small AS (SELECT topic FROM s GROUP BY 1 HAVING count(*) <= 100)
    SELECT a.topic, a.doc_id AS a, b.doc_id AS b, round(2 * len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g)), 9) AS dice FROM s a JOIN s b ON a.topic = b.topic AND a.doc_id < b.doc_id SEMI JOIN small ON a.topic = small.topic WHERE len(a.g) + len(b.g) > 0"""
)
def pair_report(spark, d):
    t = text.simple_tokens("text")
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.array_distinct(F.concat(t, sequences.ngrams(t, 2))).alias("grams"))
    rows = rows.select(F.col("conv_id").alias("topic"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "grams")
    found = topics.pair_report(rows.select("topic", "doc_id"), rows.select("doc_id", "grams")).where("dice is not null")
    turn = lambda c: (F.col(c) - F.col("topic") * 100_000).alias(c)
    return found.select("topic", turn("a"), turn("b"), F.round("dice", 9).alias("dice"))


@query(f"WITH {DOCS}, {_all()} SELECT n, ngram, count(*) AS cnt FROM g GROUP BY ALL")
def incremental_counts(spark, d):
    """The counts of two batches, stored one after the other, one of them twice."""
    df, folder = _docs(spark, d), new_path(spark, "counts")
    for epoch in (0, 1, 1):
        counts.add_counts(spark, ngrams.occurrences(df.where(F.col("doc_id") % 2 == epoch), "low", keep=(), urls=False, summed=True), folder, epoch)
    return counts.stored_counts(spark, folder)


@query(f"SELECT conv_id, turn, array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '|') AS grams FROM (SELECT conv_id, turn, {TOK} AS t FROM conversations)")
def sql_functions_ngrams(spark, d):
    sql_functions.register(spark)
    spark.read.parquet(f"{d}/conversations.parquet").createOrReplaceTempView("fl_turns")
    return spark.sql("SELECT conv_id, turn, array_join(fl_ngrams(fl_simple_tokens(text), 2), '|') AS grams FROM fl_turns")
