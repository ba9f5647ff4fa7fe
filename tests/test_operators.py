"""The library's own operators on small cases."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from facetloom.functions import sequences, text
from facetloom.operators import dedupe, neardup, ngrams, topics
from facetloom.operators import language_model as lm
from facetloom.operators.components import connected_components, with_least
from facetloom.plans import cache
from facetloom.plans.engine import QueryOptions
from facetloom.sources import messages


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "message, tokens",
    [
        ("hi :) there", ["hi", ":)", "there"]),
        ("at 10:30 for 3.50 or 1,234,567", ["at", "10:30", "for", "3.50", "or", "1,234,567"]),
        ("it's (so) good!!", ["it", "'s", "(", "so", ")", "good", "!!"]),
        ("see http://a.b/c. now", ["see", "http://a.b/c", ".", "now"]),
        ("a &amp; b -- c", ["a", "&amp;", "b", "--", "c"]),
        ("the U.S. too", ["the", "U.S.", "too"]),
        ("", []),
    ],
)
def test_tokenize(spark, message, tokens):
    assert one(spark, text.tokenize("t"), t=message) == tokens


def test_offsets_reproduce_tokens(spark):
    s = "it's (so) good!! http://a.b/c. x"
    toks = one(spark, text.tokenize("t"), t=s)
    assert [s[i : i + len(t)] for i, t in zip(one(spark, sequences.align(text.tokenize("t"), "t"), t=s), toks)] == toks


@pytest.mark.parametrize(
    "run, tokens",
    [
        ("1," * 20_000, ["1", ","] * 20_000),
        ("a" * 50_000, ["a" * 50_000]),
        ("http://x.com/" + "a" * 1100 + "!!!", ["http://x.com/" + "a" * 1100, "!!!"]),
        ("7" * 30_000 + ":5", ["7" * 30_000 + ":5"]),
        ("a.b" * 3000 + "'s", ["a.b" * 3000, "'s"]),
        ("ab." * 5_000, ["ab", "."] * 5_000),
        ("x-" * 10_000 + "y", ["x-" * 10_000 + "y"]),
        ("-" * 20_000, ["-" * 20_000]),
    ],
)
def test_long_runs_are_tokens_like_others(spark, run, tokens):
    assert one(spark, text.tokenize("t"), t=f"x {run} y") == ["x", *tokens, "y"]


def test_guards_change_nothing(spark):
    """The patterns behind guards against the same without: random strings of telling pieces."""
    import random

    rng = random.Random(11)
    pieces = "a b x. A. 1 12 345 , . ' 's - -- : ; ;p =o http:// www. .com .co.uk .org &amp; é ♫ ? ! < ( / www _ 3:4 5.6".split() + [" ", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    guards = [text._DIGITS, text._CHAIN, r"(?:(?<![a-z0-9.-])|\G|(?=[.-])|(?<=(?<![a-z0-9])-))", r"(?:(?<!\S)|\G)"]
    plain = text.PROTECT
    for g in guards:
        assert g in plain
        plain = plain.replace(g, "")
    plain = plain.replace(r"\S[^\s']*+'\S++", r"\S+'\S+").replace("++", "+").replace(r"{2,}+", "{2,}")
    mark = lambda p: F.regexp_replace("t", p, "[$0]")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mark(text.PROTECT).alias("a"), mark(plain).alias("b")).where("a <> b").collect()
    assert rows == []


def test_clitics_and_characters(spark):
    assert one(spark, text.rejoin_clitics("t"), t=["it", "'", "s", "don", "'", "t", "'", "x"]) == ["it", "'s", "don", "'t", "'", "x"]
    assert one(spark, ngrams.feature_line("t"), t=["It", "'", "s", "Big", "Dog"]) == "'s big dog it_'s 's_big big_dog"
    assert one(spark, text.plain_ascii("t"), t="aé♫") == "a&#233;&#9835;"
    assert one(spark, text.encode_url("t"), t="a b&c") == "a+b%26c"
    assert one(spark, text.subset("t", F.array(F.lit(2), F.lit(0))), t=["a", "b", "c"]) == ["c", "a"]
    kinds = one(spark, text.emoticons("t"), t="x ;) y :p")
    assert (kinds.happy, kinds.wink, kinds.tongue, kinds.sad, kinds.other) == (False, True, True, False, False)


def test_sql_functions(spark):
    from facetloom.plans import sql_functions

    assert len(sql_functions.register(spark)) == 5
    s = "it's (so) good!! see http://a.b/c. x :)"
    spark.createDataFrame([(s,)], "s string").createOrReplaceTempView("said")
    r = spark.sql("select fl_tokenize(s) a, fl_ngrams(fl_simple_tokens('a b c'), 2) b, fl_jaccard(array('x'), array('x', 'y')) c, fl_ngrams(array('x'), 2) d from said").first()
    assert (r.a, r.b, r.c, r.d) == (one(spark, text.tokenize("t"), t=s), ["a b", "b c"], 0.5, [])


def test_labels_on_pages(spark):
    assert [one(spark, text.label_html("t", p), t=t) for t, p in (("a <b>", False), ("a b", True), ("**EXTRAS**", False), ("**EXTRAS**", True))] == ["a &lt;b&gt;", "a&nbsp;b", "<i>more...</i>", ""]
    assert one(spark, text.coloured("t", "bold", "red"), t="x") == "\x1b[31m\x1b[1mx\x1b[0m"
    with pytest.raises(ValueError):
        text.coloured("t")


def test_patterns(spark):
    assert [one(spark, text.matched("t", "(b)(c)", 2), t=t) for t in ("abcd", "x")] == ["c", None]
    assert one(spark, text.all_matched("t", "[0-9]+"), t="a1b22") == ["1", "22"]
    assert one(spark, text.replaced("t", "([a-z])1", "$1"), t="a1b1") == "ab"
    assert one(spark, text.shown_matches("t", "b+"), t="abbc") == "a[[bb]]c"


def test_ngram_filters(spark):
    get = lambda toks, n: one(spark, ngrams.filtered("t", n), t=toks)
    assert get(["the", "big", ",", "up"], 1) == ["big"]
    assert get(["@a", "@b", "big", "#x", "dog", "of"], 2) == []
    assert get(["@a", "big", "dog"], 2) == ["big dog"]
    assert get(["big", "~", "dog"], 3) == ["big ~ dog"]
    assert get(["a"], 3) == []


def test_workers_count_as_columns_do(spark, monkeypatch):
    """N-grams counted by blocks of messages against the filters as columns."""
    import random
    from collections import Counter

    rng = random.Random(5)
    pieces = "big dog the of a @a @b #x ~ ' \" ( i you , . &amp; www.zoo.org/x a.com/ \u00e9 it's".split()
    said = [(i // 2 if i < 20 else i, [rng.choice(pieces) for _ in range(rng.randrange(12))]) for i in range(120)]
    df = spark.createDataFrame([*said, (None, ["big", "dog"]), (500, None)], "doc_id long, toks array<string>").repartition(2)
    for urls in (True, False):
        want = {}
        for n in (1, 2, 3):
            for doc, grams in df.select("doc_id", ngrams.filtered("toks", n, urls)).collect():
                for g in grams or ():
                    want.setdefault((n, g), []).append(doc)
        got = {(r.n, r.ngram): (r.cnt, r.docs) for r in ngrams.counted(df, (1, 2, 3), urls=urls).collect()}
        assert got == {k: (len(v), len(set(v) - {None})) for k, v in want.items()}
        assert Counter((r.n, r.ngram, r.doc_id) for r in ngrams.occurrences(df, urls=urls).collect()) == Counter((*k, d) for k, v in want.items() for d in v)
        first = {}
        for (n, g), v in want.items():
            if n == 2:
                a, b = first.setdefault(g.split(" ")[0], (set(), set()))
                a.add(g), b.update(set(v) - {None})
        assert {r["first"]: (r.followers, r.docs) for r in ngrams.followers(df, urls=urls).collect()} == {k: (len(a), len(b)) for k, (a, b) in first.items()}


def test_blocks_of_messages_are_summed(spark):
    """A block's repeats are one row; the columns before gave a row for each."""
    df = spark.createDataFrame([(i, ["big", "dog"]) for i in range(50)], "doc_id long, toks array<string>").coalesce(1)
    rows = ngrams.occurrences(df, keep=(), summed=True, totals=True).collect()
    assert sorted((r.n, r.ngram, r.times) for r in rows) == [(0, "", 100), (1, "big", 50), (1, "dog", 50), (2, "big dog", 50)]


def test_sums_are_exchanged_in_parts(spark):
    """N-grams are exchanged as parts of bytes, and models count only what is asked for; a row for each n-gram of a block, and a table of all, came before."""
    said = [["big", "dog", w, "\u00e9t\u00e9"] for w in "abcde"] + [["big", "dog", "big", "dog"], [], None]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, toks array<string>").repartition(3)
    want = {(r.n, r.ngram): (r.cnt, r.docs) for r in ngrams.occurrences(df, urls=False).groupBy("n", "ngram").agg(F.count("*").alias("cnt"), F.countDistinct("doc_id").alias("docs")).collect()}
    for model, at in ((lm.background(df, urls=False), 0), (lm.foreground(df, urls=False), 1)):
        assert {(r.n, r.ngram): r.cnt for r in model.counts.collect()} == {k: v[at] for k, v in want.items()}
        assert tuple(model.info.first()) == (24, *(sum(k[0] == n for k in want) for n in (1, 2, 3)))
        often = model.often(3)
        assert {(r.n, r.ngram): r.cnt for r in often.collect()} == {k: v[at] for k, v in want.items() if v[at] >= 3}
        some = often.where("n = 2 and ngram = 'big dog'")
        assert {(r.n, r.ngram) for r in model.of(some).collect()} == {(2, "big dog")}
        plan = model.counts._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "letters" in plan
    posts = ngrams.postings(df, urls=False, only=ngrams.among(often))
    assert {(r.n, r.ngram) for r in posts.collect()} == {k for k, v in want.items() if v[1] >= 3}


def test_workers_split_texts(spark, sf):
    """Texts go to workers as they are and are split there; arrays of tokens were made and sent before."""
    import pyarrow as pa

    from facetloom.plans import queries

    said = ["it's @a #b_9", None, "", "ab", "cd é ef", "K İx Straße, ÀB'", " .x. ", "日本 a日b", "z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, text string").select(F.lower("text").alias("low"), F.coalesce(text.simple_tokens("text"), F.array().cast("array<string>")).alias("toks"))
    low, toks = (list(c) for c in zip(*[(r.low, r.toks) for r in rows.collect()]))
    assert ngrams.split_simple(pa.array(low)).to_pylist() == toks
    assert ngrams.split_simple(pa.array(low, pa.large_string()).slice(3, 4)).to_pylist() == toks[3:7]
    assert [r.x for r in rows.select(text.has_simple("low", "a").alias("x")).collect()] == [None if t is None else "a" in k for t, k in zip(said, toks)]
    df = queries._docs(spark, sf)
    for kind in (lm.foreground, lm.background):
        one, two = kind(df, "toks", urls=False), kind(df, "low", urls=False)
        assert one.info.collect() == two.info.collect()
        assert one.counts.exceptAll(two.counts).isEmpty() and two.counts.exceptAll(one.counts).isEmpty()
    for name in ("fg_df_counts", "bigrams_filtered", "trigrams_filtered"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan, name
    with pytest.raises(ValueError):
        ngrams.sums(df, "low", urls=True)


def test_hashes_are_exchanged_as_steps():
    """A model's information is exchanged as hashes in order, by their differences; hashes and counts were before."""
    import numpy as np

    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    stored = ngrams._planes(h)
    assert (ngrams._from_planes(stored) == h).all() and stored.count(0) > len(h)
    assert len(ngrams._from_planes(ngrams._planes(h[:0]))) == 0


def test_features_are_found_by_workers(spark):
    """The features of a table's rows as those of ``feature_line``, without filters as columns on every token."""
    said = [["It", "'", "s", "Big", "Dog"], ["@a", "@b", "x", "@c", "the", "www.zoo.org/x", "cat"], [], ["of"], None, ["one", "Two", "one", "Two"]]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, toks array<string>").repartition(2)
    for urls in (True, False):
        got = ngrams.features(df, urls=urls)
        assert {r.doc_id: " ".join(r.features) for r in got.collect()} == {r.doc_id: r.line or "" for r in df.select("doc_id", ngrams.feature_line("toks", urls).alias("line")).collect()}
        assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_highlight(spark):
    x = sequences.highlight("t", "s", [(["to", "buy"], "[[", "]]"), (["buy", "sun"], "{{", "}}")])
    assert one(spark, x, t=["to", "buy", "sun"], s="to buy sun") == "[[to {{buy]] sun}}"


def test_smoothing(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"])], "doc_id int, toks array<string>")
    fg, bg = lm.foreground(df, urls=False), lm.background(df, urls=False)
    assert fg.info.first().big_n == 5
    rows = {r.ngram: r.ratio for r in lm.compare(fg, bg, "mle", 1).where("n = 1").collect()}
    assert rows["b"] == 1.0 and rows["c"] == 1.0
    with pytest.raises(ValueError):
        lm.smooth("other", F.lit(1), F.lit(1), F.lit(1))


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x", "y", "z"])], "doc_id int, toks array<string>")
    m = lm.background(df, urls=False)
    m.save(str(tmp_path))
    assert sorted(lm.LanguageModel.load(spark, str(tmp_path)).counts.collect()) == sorted(m.counts.collect())


def test_dedupe(spark):
    rows = [(1, "t", "u", 5), (1, "t", "u", 5), (2, "t", "u", 4), (3, "t", "v", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, from_user string, created_at int")
    assert sorted(r.doc_id for r in dedupe.hard_dedupe(df).collect()) == [2, 3]
    m = dedupe.merge_same_text(df.dropDuplicates()).collect()
    assert [(r.doc_id, r.ids, r.multi) for r in m] == [(1, [1, 2, 3], True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 45), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 45: 40, 50: 40}


def test_least_of_a_hot_key(spark):
    rows = [("hot", (i * 37) % 1000) for i in range(1000)] + [("one", 5), ("two", 9), ("two", 9), ("two", 4), (None, 1), ("none", None)]
    got = with_least(spark.createDataFrame(rows, "k string, v long"), "k", "v", "m", salts=7).collect()
    least = {"hot": 0, "one": 5, "two": 4, "none": None}
    assert sorted(map(str, got)) == sorted(str(Row(k=k, v=v, m=least[k])) for k, v in rows if k is not None)


def test_star_centre_is_dealt_over_parts(spark):
    edges = [(0, i) for i in range(1, 500)] + [(1000, i) for i in range(1001, 1100)] + [(1099, 1100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(500)} | {i: 1000 for i in range(1000, 1101)}


def test_similarity_join(spark):
    import random

    rng = random.Random(4)
    sets = {i: {f"g{rng.randrange(12)}" for _ in range(rng.randrange(1, 9))} for i in range(60)}
    df = spark.createDataFrame([(i, g) for i, s in sets.items() for g in s], "doc_id long, ngram string")
    links = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a != b and common >= 2 and 2 * common / (len(sets[a]) + len(sets[b])) >= 0.65:
                links[a] += 1
    docs = df.select("doc_id").distinct()
    assert {r.doc_id: r.n_links for r in neardup.neardup_links(docs, df).collect()} == links


def test_messages_link_as_sets_of_trigrams_do(spark, monkeypatch):
    """By files of hashes, without an exchange of trigrams, as by rows (doc_id, ngram)."""
    import random

    rng = random.Random(8)
    base = [[f"w{rng.randrange(60)}" for _ in range(30)] for _ in range(4)]
    said = [(i, [w if rng.random() > 0.06 else f"w{rng.randrange(60)}" for w in base[i % 4]]) for i in range(60)]
    said += [(i + 100, said[i][1]) for i in range(5)] + [(200, []), (201, None), (202, ["one", "two", "three"])]
    df = spark.createDataFrame(said, "doc_id long, toks array<string>").repartition(3)
    trigrams = ngrams.postings(df, urls=False, orders=(3,)).select("doc_id", "ngram")
    exchanged = neardup.stored_sets(df, neardup.new_path(spark, "sets"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in exchanged and "Generate" not in exchanged
    links = {r.doc_id: r.n_links for r in neardup.message_links(df).collect()}
    assert links == {r.doc_id: r.n_links for r in neardup.neardup_links(df, trigrams).collect()} and max(links.values()) > 2
    assert sorted(neardup.message_groups(df).collect()) == sorted(neardup.neardup_groups(df, trigrams).collect())


def test_sets_that_meet_no_other_are_not_stored(spark):
    """Of sets, only hashes that another class may have are written, and copies are written once; whole sets of all messages were."""
    from pyarrow import fs

    said = [(f"m{i}", [f"w{i * 40 + k}" for k in range(40)]) for i in range(30)] + [(f"c{i}", [f"w{k}" for k in range(40)]) for i in range(20)] + [("near", [f"w{k}" for k in range(38)])]
    df = spark.createDataFrame(said, "doc_id string, toks array<string>").repartition(3)
    paths, path_of = [], neardup.new_path
    try:
        neardup.new_path = lambda *a: paths.append(path_of(*a)) or paths[-1]
        members, _, pairs = neardup.message_classes(df)
    finally:
        neardup.new_path = path_of
    assert {(r.a, r.b) for r in pairs.collect()} == {("c0", "near")} and members.count() == 51
    store, path = fs.FileSystem.from_uri(next(p for p in paths if "/sets-" in p))
    stored = sum(f.size for f in store.get_file_info(fs.FileSelector(path)))
    assert 2 * 36 * 8 <= stored < 2 * 40 * 8 + 30 * 8  # few trigrams' counters agree by chance; 51 whole sets are 15,456 bytes


def test_intermediate_files_go(spark):
    """Sets, counters and exchanges are deleted when nothing reads them again; they stayed with the session before."""
    import glob

    from facetloom import shared

    base = shared.shared_dir(spark).removeprefix("file://") + "/facetloom"
    before = set(glob.glob(f"{base}/*"))
    docs = spark.createDataFrame([(i, "one two three four five six".split()) for i in range(3)], "doc_id long, toks array<string>")
    assert {r.group_id for r in neardup.message_groups(docs).collect()} == {0}
    left = {p.rsplit("/", 1)[1].split("-")[0] for p in set(glob.glob(f"{base}/*")) - before}
    assert not left & {"sets", "counters", "copies"} and "pairs" in left
    setting = spark.conf.get(shared._CLEANUP)
    with shared.passing(spark):
        assert spark.conf.get(shared._CLEANUP) == "true"
    assert spark.conf.get(shared._CLEANUP) == setting


def test_merge_components(spark):
    import random

    rng = random.Random(9)
    base = [set(range(i * 20, i * 20 + 19)) for i in range(3)]
    sets = {f"t{i:02}": base[i % 3] - {rng.choice(sorted(base[i % 3])) for _ in range(i % 4)} for i in range(24)}
    root = {t: t for t in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.9:
                    root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([(1, t, g) for t, s in sets.items() for g in s], "n int, ngram string, group_id long")
    got = {r.ngram: r.topic_id for r in topics.merge_components(df).collect()}
    assert got == {t: f"1|{r}" for t, r in root.items()}


def test_greedy_merge():
    ten = set(range(20))
    groups = [ten, ten - {0}, ten - {0, 1}, ten - {19}, {99, 100}]
    leaders = topics.greedy_merge(groups)
    assert [(i, a) for i, a, _ in leaders] == [(0, [1, 2]), (3, []), (4, [])]
    assert leaders[0][2] == ten - {0, 1}
    assert topics.greedy_merge([set(range(9)), set(range(10))])[0][1] == []  # exactly .9 is not enough


def test_label_is_read_off_a_group_that_is_left(spark):
    groups = {"a b": range(1, 21), "b c": range(2, 21)}
    members = [(2, g, i, i, i, 1) for g, ids in groups.items() for i in ids]
    members = spark.createDataFrame(members, "n int, ngram string, group_id long, doc_id long, created_at long, place int")
    docs = spark.createDataFrame([(i, ["a", "b"] if i == 1 else ["a", "b", "c"]) for i in range(1, 21)], "doc_id long, toks array<string>")
    ranked = spark.createDataFrame([(2, "a b", 2.0), (2, "b c", 1.0)], "n int, ngram string, ratio double")
    merged = topics.merge_topics(ranked, members, docs, lm.foreground(docs, urls=False)).collect()
    assert [(r.label, r.ngrams, r.group_ids) for r in merged] == [("a b c", ["a b", "b c"], list(range(2, 21)))]


def test_labels():
    toks = "a b c d e".split()
    assert topics.runs_in(toks, [("a", "b"), ("b", "c"), ("e",), ("z",)]) == [("a", "b", "c"), ("e",)]
    p = {("b", "c", "d"): 0.5}
    assert topics.choose_label([("a", "b", "c", "d")], lambda g: p.get(g, 0.1)) == (("b", "c", "d"),)
    assert topics.choose_label([("a", "b"), ("e",)], lambda g: 0.1) == (("a", "b"), ("e",))


def test_scalars(spark):
    assert [one(spark, text.nice_timedelta("s"), s=s) for s in (1, 61, 3600, 3601, 90000)] == ["1 second", "1 minute", "60 minutes", "1 hour", "1 day"]
    assert [one(spark, text.query_refinement("q", "s"), s=s) for s in ("a b", "solo", "**EXTRAS**")] == ['q "a b"', "q solo", None]
    assert one(spark, text.link_urls("s"), s="see www.x.org/a now") == 'see <a class="t" target="_blank" href="http://www.x.org/a">www.x.org/a</a> now'
    assert [one(spark, text.si_number("x"), x=x) for x in (12345.0, 0.5, 7.0)] == ["12.3 k", "0.500", "7.00"]


def test_time_and_query(spark):
    assert str(one(spark, messages.parse_time("s"), s="Sun, 19 Apr 2009 05:38:24 +0000")) == "2009-04-19 05:38:24"
    assert messages.parse_query('a "b c" d') == [["a"], ["b", "c"], ["d"]]
    assert one(spark, messages.matches('a "b c" OR z', F.col("t")), t=["b", "c", "a"])


def test_options():
    o = QueryOptions.from_dict({"q": "x", "pages": "3", "english": "no", "other": 1})
    assert (o.pages, o.english) == (3, False)
    with pytest.raises(ValueError):
        QueryOptions(smoothing="__class__")


def test_cache(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(1)
    for now in (0.0, 60.0, 60.5):
        cache.ResultCache(spark, str(tmp_path), 60).call("k", make, now)  # each finds what the one before stored
    assert len(made) == 2
    c = cache.ResultCache(spark, str(tmp_path), None)
    assert c.call("k", make, 1e6).count() == 1 and len(made) == 2
    (tmp_path / cache.hashlib.sha256(b"k").hexdigest() / "70000").mkdir()  # one that was not written to the end
    assert c.made("k")[0] == 60.5
    assert len(cache.prebake(c, ["a", "b"], lambda q, n: spark.range(n), 100.0)) == 4


MESSAGES = [
    (1, "The big dog runs (fast) at www.zoo.org/x today", "ann"),
    (2, "The big dog runs (fast) at www.zoo.org/x today", "bob"),
    (3, "A big dog barks at @cat today", "ann"),
    (4, "my big dog sleeps", "cy"),
    (5, "big dog eats a bone", "di"),
    (6, "big lone wolf", "ed"),
]


@pytest.fixture(scope="module")
def searched(spark):
    from facetloom.plans.engine import Engine, tokens_of

    rows = [(i, t, u, "en", 1240000000 + i) for i, t, u in MESSAGES]
    df = spark.createDataFrame(rows, "doc_id long, text string, from_user string, iso_language_code string, s long").withColumn("created_at", F.timestamp_seconds("s")).drop("s")
    bg = lm.background(spark.createDataFrame([(9, "a cat and a dog")], "doc_id long, text string").withColumn("toks", tokens_of("text")))
    engine, o = Engine(df, bg), QueryOptions(q="big", min_count=2)
    return engine, o, engine.search(o)


def test_search(spark, searched):
    engine, o, r = searched
    import json

    answer = json.loads(engine.response(r, o, F.timestamp_seconds(F.lit(1240003601))).first().response)
    assert answer["topic_list"][-1] == topics.EXTRAS and answer["time_since_earliest"] == "60 minutes"
    dog = answer["topic_info"]["big dog"]
    assert dog["query_refinement"] == 'big "big dog"'
    htmls = [h for g in dog["groups"] for h in (g["head_html"], *g["rest_htmls"])]
    assert len(htmls) == 4 and sum("2 authors:" in h for h in htmls) == 1
    two = next(h for h in htmls if "2 authors:" in h)
    assert 'The <span class="topic_hl">big dog</span> runs ( fast ) at <a class="t" target="_blank" href="http://www.zoo.org/x">www.zoo.org/x</a> today' in two
    assert '<a class="m" target="_blank" href="http://twitter.com/ann/status/1">ann</a>' in two
    assert any('<a class="at" target="_blank" href="http://twitter.com/cat">@cat</a>' in h for h in htmls)
    left = answer["topic_info"][topics.EXTRAS]
    assert left["tweet_ids"] == "6" and left["query_refinement"] is None and '<span class="q_hl">big</span> lone' in left["groups"][0]["head_html"]


def test_drill_down(spark, searched):
    engine, o, _ = searched
    assert engine.refined(o, "big dog / x").q == 'big "big dog x"' and engine.refined(o, topics.EXTRAS) is o
    assert {i for r in engine.drill_down(o, "dog barks").docs.collect() for i in r.ids} == {3}
    assert {i for r in engine.drill_down(o, "big dog").docs.collect() for i in r.ids} == {1, 2, 3, 4, 5}


def test_page_is_looked_up_in_lines(spark, searched):
    """With the corpus's tokens stored as lines, only a page's messages are tokenized; all that might match were before."""
    from facetloom.plans.engine import Engine, tokens_of

    engine, o, _ = searched
    lines = ngrams.lines(engine.corpus, ("doc_id", "iso_language_code"), tokens_of("text"))
    other = Engine(engine.corpus, engine.background, lines=lines)
    rows = lambda r: sorted(map(str, r.drop("created_at").collect()))
    for q in ('big "dog barks"', "cat OR lone"):
        option = QueryOptions(q=q, pages=1, rpp=2, min_count=2)
        assert rows(other.read(option)) == rows(engine.read(option)), q
    both = lines.join(engine.corpus.select("doc_id", tokens_of("text").alias("toks")), "doc_id")
    for q in ("big", '"big dog"', "cat OR lone"):
        assert both.where(messages.matches_line(q, F.col("line")) != messages.matches(q, F.col("toks"))).isEmpty()
    one, two = (ngrams.occurrences(both, c, summed=True, keep=()) for c in ("line", "toks"))
    assert sorted(one.collect()) == sorted(two.collect())


def test_plain_words_are_passed_over(spark, sf):
    """Runs of plain words are one match of the tokenizer's pattern, which changes no token."""
    said = spark.read.parquet(f"{sf}/documents.parquet").select("text").unionByName(spark.createDataFrame([(t,) for t in ("a b.c d", "é ü. a.b. c", "www. x.com y", "x.com", " a  b\u00a0c\n", "it's 10:30 a", "" )], "text string"))
    plain = text.PROTECT
    assert plain.startswith("(?U)" + text.PLAIN)
    new = said.select("text", text.tokenize("text").alias("new"))
    text.PROTECT = "(?U)" + "|".join(text.PROTECTED)
    try:
        assert new.where(~F.col("new").eqNullSafe(text.tokenize("text"))).isEmpty()
    finally:
        text.PROTECT = plain
    assert said.where(text.squeeze("text") != F.trim(F.regexp_replace("text", r"(?U)\s+", " "))).isEmpty()


def test_paged_source(spark):
    import json

    def fetch(query, page, rpp):
        if page == 2:
            raise OSError("away")
        return [json.dumps({"id": page * 10 + i, "text": query, "created_at": "Sun, 19 Apr 2009 05:38:24 +0000"}) for i in range(rpp)] if page < 4 else None

    rows = messages.read_pages(spark, fetch, "q", 4, 2).collect()
    assert [r.doc_id for r in rows] == [31, 30, 11, 10] and rows[0].text == "q" and rows[0].created_at.year == 2009


def test_trends(spark):
    calls = []

    def fetch():
        calls.append(1)
        if len(calls) in (1, 4, 5):
            raise OSError
        return ["one", f"two words {len(calls)}"]

    t = messages.Trends(spark, fetch, retries=2)
    assert [r.simple_query for r in t.current(0.0).collect()] == ["one", '"two words 2"']
    assert t.current(300.0).count() == 2 and len(calls) == 2  # not yet stale
    t.current(301.0)
    assert [r.name for r in t.current(700.0).collect()] == ["one", "two words 3"] and len(calls) == 5  # the last answer stays


def test_multi_columns(spark):
    df = spark.createDataFrame([(2, "t", 5, "u", None), (1, "t", 6, "v", "x")], "doc_id long, text string, created_at int, from_user string, to_user string")
    r = dedupe.merge_same_text(df).first()
    assert (r.doc_id, r.created_at, r.ids, r.multi_from_user, r.multi_to_user) == (1, 5, [1, 2], ["v", "u"], ["x", None])


def test_reports(spark):
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["b", "c"])], "doc_id long, grams array<string>")
    members = spark.createDataFrame([("t", 1), ("t", 2), ("t", 3), ("u", 1)], "topic string, doc_id long")
    assert sorted(map(tuple, topics.pair_report(members, sets).collect())) == [("t", 1, 2, 1.0), ("t", 1, 3, 0.5), ("t", 2, 3, 0.5)]
    assert topics.pair_report(members, sets, 2).count() == 0
    assert [r.doc_id for r in topics.in_both(members.where("topic = 't'"), members.where("topic = 'u'"), sets).collect()] == [1]
    assert sorted(r.doc_id for r in topics.excluding(sets, members.where("topic = 'u'")).collect()) == [2, 3]


def test_streaming_counts(spark, tmp_path):
    from facetloom.streaming import counts

    rows = spark.createDataFrame([(["big", "dog"],), (["big", "cat"],)], "toks array<string>").repartition(2)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts.accumulate(stream, str(tmp_path / "out"), str(tmp_path / "ck"), urls=False).awaitTermination()
    got = {r.ngram: r.cnt for r in counts.stored_counts(spark, str(tmp_path / "out")).collect()}
    assert got == {"big": 2, "dog": 1, "cat": 1, "big dog": 1, "big cat": 1}


def test_stream_of_counts(spark, tmp_path):
    from facetloom.streaming import counts

    rows = spark.createDataFrame([(["big", "dog"], 10), (["big"], 20), (["big"], 4000)], "toks array<string>, s long").withColumn("created_at", F.timestamp_seconds("s")).drop("s")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counts.running_counts(stream(), urls=False).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start().awaitTermination()
    assert {r.ngram: r.cnt for r in spark.table("running").collect()} == {"big": 3, "dog": 1, "big dog": 1}
    counts.windowed_counts(stream(), urls=False).writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.cnt for r in spark.table("windowed").where("ngram = 'big'").collect()) == [1, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "j").write_text('{"id": 1, "text": "x", "created_at": "Sun, 19 Apr 2009 05:38:24 +0000"}\n')
    r = messages.read_jsonl(spark, str(tmp_path / "j")).first()
    assert (r.doc_id, r.text, r.to_user, r.created_at.hour) == (1, "x", None, 5)
    (tmp_path / "l").write_text("one\ntwo\n")
    assert [x.text for x in messages.read_lines(spark, str(tmp_path / "l")).collect()] == ["one", "two"]
    (tmp_path / "f").write_text("7\tann\tIt's a Big Dog\n")
    messages.featurize_tsv(spark, str(tmp_path / "f"), str(tmp_path / "g"), 3)
    assert tuple(messages.read_tsv(spark, str(tmp_path / "g"), "a string, b string, c string").first()) == ("7", "ann", "'s big dog it_'s big_dog")


def test_scrape(spark):
    asked = []

    def fetch(until, page):
        asked.append((until, page))
        return spark.createDataFrame([(1,)], "s long").select(F.timestamp_seconds("s").alias("created_at")) if len(asked) < 3 else None

    assert len(list(messages.scrape(fetch, "2009-04-19", pages=2))) == 2
    assert asked[:3] == [("2009-04-19", 1), ("2009-04-19", 2), ("1969-12-31", 1)] and len(asked) == 6


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b', None)], "x int, y string, z string")
    messages.write_tsv(df.select("x", "y"), str(tmp_path / "t"))
    assert messages.read_tsv(spark, str(tmp_path / "t"), "x int, y string").collect()[0].y == 'a "b'
    messages.write_csv(df.select("y", "x"), str(tmp_path / "c"))
    assert messages.read_csv(spark, str(tmp_path / "c")).columns == ["x", "y"]
