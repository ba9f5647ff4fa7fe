"""Topics: distinctive phrases of the messages found, pruned, grouped and merged."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetloom.functions.sequences import dice, ngrams
from facetloom.functions.text import norm_token
from facetloom.operators import language_model as lm
from facetloom.operators.components import connected_components
from facetloom.operators.neardup import classes, similar_pairs
from facetloom.operators.ngrams import NORMAL
from facetloom.shared import materialize

EXTRAS, EXTRAS_RATIO = "**EXTRAS**", -42.0
MERGE_JACCARD = 0.9


def reject_phrases(compared: DataFrame, query: list[str]) -> DataFrame:
    """Drops phrases that say no more than the query, and longer ones that end in a stop word."""
    words = F.array(*[norm_token(F.lit(q)) for q in query]) if query else F.array().cast("array<string>")
    df = compared.withColumn("__norm", F.transform(F.split("ngram", " "), norm_token))
    df = df.where(F.size(F.array_except("__norm", words)) > 0)
    stops = [w for w in NORMAL if w not in query]
    return df.where(~((F.col("n") > 1) & F.element_at("__norm", -1).isin(stops))).drop("__norm")


def prune_dominated(topics: DataFrame) -> DataFrame:
    """Drops a phrase when one a word longer begins or ends with it and is in as many messages.

    A longer phrase's messages are among the shorter one's, so equal counts are equal sets.
    """
    words = F.split("ngram", " ")
    longer = topics.where("n > 1").select((F.col("n") - 1).alias("n"), "cnt", F.explode(F.array(F.array_join(F.slice(words, 1, F.size(words) - 1), " "), F.array_join(F.slice(words, 2, F.size(words) - 1), " "))).alias("ngram"))
    return topics.join(longer, ["n", "ngram", "cnt"], "left_anti")


def extract_topics(fg: lm.LanguageModel, bg: lm.LanguageModel, query: list[str], smoothing: str = "lidstone", min_count: int = 3) -> DataFrame:
    """(n, ngram, cnt, bg_cnt, ratio) of the phrases that are topics."""
    return prune_dominated(materialize(reject_phrases(lm.compare(fg, bg, smoothing, min_count), query), "phrases"))


def topic_docs(topics: DataFrame, postings: DataFrame) -> DataFrame:
    return topics.select("n", "ngram").join(postings, ["n", "ngram"])


def topic_members(topics: DataFrame, postings: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """(n, ngram, group_id, doc_id, created_at, place): a group's members in a topic, oldest (place 1) first."""
    rows = topic_docs(topics, postings).join(groups, "doc_id").join(docs.select("doc_id", "created_at"), "doc_id")
    place = Window.partitionBy("n", "ngram", "group_id").orderBy("created_at", "doc_id")
    return rows.withColumn("place", F.row_number().over(place)).select("n", "ngram", "group_id", "doc_id", "created_at", "place")


def topic_counts(members: DataFrame) -> DataFrame:
    """(n, ngram, group_count, doc_count)."""
    per_group = members.groupBy("n", "ngram", "group_id").agg(F.count("*").alias("docs"))
    return per_group.groupBy("n", "ngram").agg(F.count("*").alias("group_count"), F.sum("docs").alias("doc_count"))


def merge_components(members: DataFrame, threshold: float = MERGE_JACCARD) -> DataFrame:
    """(n, ngram, topic_id): topics whose sets of groups overlap enough are one; the id is the first in order of n and ngram.

    Topics with one set of groups meet once, and only pairs that share one of their rarest
    groups are compared, as for near-duplicate messages.
    """
    key = F.concat_ws("|", "n", "ngram")
    sets = members.select(key.alias("doc_id"), F.col("group_id").cast("string").alias("ngram")).distinct()
    of_class, reps = classes(sets, 1)
    pairs = similar_pairs(reps, 2 * threshold / (1 + threshold) - 1e-9, 1)
    both = F.round(2 * F.col("common") / F.col("dice"))  # the sizes' sum
    label = connected_components(pairs.where(F.col("common") / (both - F.col("common")) >= threshold).select("a", "b"))
    named = of_class.join(label, of_class.rep == label.node, "left").select(F.col("doc_id").alias("topic"), F.coalesce("component", "rep").alias("topic_id"))
    return members.select("n", "ngram").distinct().withColumn("topic", key).join(named, "topic").select("n", "ngram", "topic_id")


def runs_in(tokens: list[str], phrases: Iterable[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Maximal runs of the tokens that the phrases' first occurrences cover."""
    covered = set()
    for p in phrases:
        at = next((i for i in range(len(tokens) - len(p) + 1) if tuple(tokens[i : i + len(p)]) == tuple(p)), None)
        if at is not None:
            covered.update(range(at, at + len(p)))
    runs: list[list[str]] = []
    for i in sorted(covered):
        if i - 1 not in covered:
            runs.append([])
        runs[-1].append(tokens[i])
    return [tuple(r) for r in runs]


def choose_label(runs: list[tuple[str, ...]], probability) -> tuple[tuple[str, ...], ...]:
    """Three words to name merged phrases by.

    From a long run its likeliest three words; a run of three as it is; else the
    combination of up to three neighbouring runs, of three words in all, whose
    probabilities, best first, are greatest.
    """
    longest = max(enumerate(runs), key=lambda r: (len(r[1]), r[0]))[1]
    if len(longest) > 3:
        windows = [longest[i : i + 3] for i in range(len(longest) - 2)]
        return (max(enumerate(windows), key=lambda w: (probability(w[1]), w[0]))[1],)
    if len(longest) == 3:
        return (longest,)
    sets = [tuple(runs[i : i + k]) for k in (1, 2, 3) for i in range(len(runs) - k + 1)]
    sets = [s for s in sets if sum(map(len, s)) <= 3]

    def worth(s):
        return sorted([*map(probability, s), *[0.0] * (3 - len(s))], reverse=True)

    best = max(range(len(sets)), key=lambda i: (worth(sets[i]), -i))
    return sets[best]


def greedy_merge(groups: list[set], threshold: float = MERGE_JACCARD) -> list[tuple[int, list[int], set]]:
    """Leaders in rank order, what each absorbs, and the groups that are left to it.

    A leader takes every later set that overlaps what is left of its own, which then
    shrinks to the intersection; what was taken never leads, but may be taken again. Sets
    are rows of bits, so a leader meets all later sets at once until its own set shrinks.
    """
    members = sorted(set().union(*groups)) if groups else []
    place = {g: i for i, g in enumerate(members)}
    bits = np.zeros((len(groups), max(1, -(-len(members) // 64)) * 64), dtype=np.uint8)
    for row, g in zip(bits, groups, strict=True):
        row[[place[x] for x in g]] = 1
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    taken = np.zeros(len(groups), dtype=bool)
    out = []
    for i in range(len(groups)):
        if taken[i]:
            continue
        left, absorbed, at = words[i].copy(), [], i + 1
        while at < len(groups):
            later = words[at:]
            common = np.bitwise_count(later & left).sum(axis=1, dtype=np.int64)
            union = np.bitwise_count(later | left).sum(axis=1, dtype=np.int64)
            hits = np.flatnonzero((union > 0) & (common / np.maximum(union, 1) > threshold))
            size = int(np.bitwise_count(left).sum())
            shrinks = np.flatnonzero(common[hits] < size)
            hits = hits[: shrinks[0] + 1] if len(shrinks) else hits
            absorbed += (hits + at).tolist()
            if not len(shrinks):
                break
            at += int(hits[-1]) + 1
            left &= words[at - 1]
        taken[absorbed] = True
        kept = np.unpackbits(left.view(np.uint8), bitorder="little")
        out.append((i, absorbed, {members[k] for k in np.flatnonzero(kept).tolist()}))
    return out


MERGED = "rank int, n int, ngram string, label string, ngrams array<string>, ratio double, group_ids array<bigint>"


def merge_topics(topics: DataFrame, members: DataFrame, docs: DataFrame, fg: lm.LanguageModel, delta: float = 0.5) -> DataFrame:
    """Topics with more than one group, merged greedily in rank order and labelled.

    A leader's label is read off the head of the smallest group that is left to it. The
    order decides, so one query's topics are one piece of work. Its size is bounded by the
    result page that a search reads (``pages * rpp`` messages), not by the corpus: of the
    tables, only the heads' tokens and the counts of n-grams that occur in heads are sent.
    """
    size = members.groupBy("n", "ngram", "group_id").agg(F.count("*").alias("size"), F.min_by("doc_id", "place").alias("head"))
    groups = F.array_sort(F.collect_list(F.struct("size", "group_id", "head"))).alias("groups")
    sets = materialize(size.groupBy("n", "ngram").agg(groups).where(F.size("groups") > 1), "topic-groups")
    rows = topics.select("n", "ngram", "ratio").join(sets, ["n", "ngram"]).crossJoin(F.broadcast(fg.info))  # one row
    heads = materialize(sets.select(F.explode("groups.head").alias("doc_id")).distinct().join(docs, "doc_id").select("doc_id", "toks"), "heads")
    asked = heads.select(F.explode(F.concat(*[ngrams("toks", n) for n in (1, 2, 3)])).alias("ngram")).distinct()
    tokens = heads.select(F.col("doc_id").alias("head"), "toks", F.lit(None).cast("string").alias("gram"), F.lit(None).cast("long").alias("cnt"))
    counts = fg.counts.join(asked, "ngram", "left_semi").select(F.lit(None).cast("long").alias("head"), F.lit(None).cast("array<string>").alias("toks"), F.col("ngram").alias("gram"), "cnt")
    one = F.lit(1).alias("query")

    def work(frame: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in MERGED.split(", ")]
        if not len(frame):
            return pd.DataFrame(columns=columns)
        frame = frame.sort_values(["ratio", "n", "ngram"], ascending=[False, False, True]).reset_index(drop=True)
        heads = other[other["gram"].isna()]
        heads = dict(zip(heads["head"].astype("int64"), heads["toks"], strict=True))
        grams = other[other["gram"].notna()]
        count = dict(zip(grams["gram"], grams["cnt"], strict=True))
        big, types = float(frame.loc[0, "big_n"]), {n: int(frame.loc[0, f"types_{n}"]) for n in (1, 2, 3)}

        def probability(g):
            return (count.get(" ".join(g), 0) + delta) / (big + delta * types[min(len(g), 3)])

        out = []
        for rank, (i, absorbed, left) in enumerate(greedy_merge([{int(x["group_id"]) for x in g} for g in frame["groups"]])):
            phrases = [frame.loc[j, "ngram"] for j in (i, *absorbed)]
            label = phrases[0]
            if absorbed:
                head = next(int(x["head"]) for x in frame.loc[i, "groups"] if int(x["group_id"]) in left)  # in order of size
                runs = runs_in(list(heads[head]), [tuple(p.split(" ")) for p in phrases])
                label = " / ".join(" ".join(r) for r in choose_label(runs, probability))
            out.append((rank, int(frame.loc[i, "n"]), phrases[0], label, phrases, float(frame.loc[i, "ratio"]), sorted(left)))
        return pd.DataFrame(out, columns=columns)

    return rows.groupBy(one).cogroup(tokens.unionByName(counts).groupBy(one)).applyInPandas(lambda a, b: work(a, b), MERGED)


def pair_report(members: DataFrame, sets: DataFrame, most: int = 100) -> DataFrame:
    """(topic, a, b, dice) of all pairs of a topic's messages, by the Dice similarity of their
    sets ``grams``; topics of more than ``most`` messages are left out of this report."""
    small = members.groupBy("topic").count().where(F.col("count") <= most).select("topic")
    rows = members.join(small, "topic").join(sets, "doc_id").select("topic", "doc_id", "grams")
    left, right = (rows.select("topic", F.col("doc_id").alias(i), F.col("grams").alias(g)) for i, g in (("a", "ga"), ("b", "gb")))
    return left.join(right, "topic").where("a < b").select("topic", "a", "b", dice("ga", "gb").alias("dice"))


def best(topics: DataFrame, most: int = 3) -> DataFrame:
    """The first few topics by rank."""
    return topics.orderBy(F.desc("ratio"), F.desc("n"), "ngram").limit(most)


def preloaded(topics: DataFrame, members: DataFrame, most: int = 3) -> DataFrame:
    """(n, ngram, ratio, doc_ids) of the topics whose messages are shown before one is asked for: the first few by rank."""
    top = best(topics, most)
    docs = members.join(F.broadcast(top.select("n", "ngram")), ["n", "ngram"]).groupBy("n", "ngram").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))
    return top.select("n", "ngram", "ratio").join(docs, ["n", "ngram"])


def in_both(one: DataFrame, two: DataFrame, docs: DataFrame) -> DataFrame:
    """Messages whose doc_id two topics share."""
    return docs.join(one.select("doc_id").intersect(two.select("doc_id")), "doc_id", "left_semi")


def excluding(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages that are not in a list of ids."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti")


def leftovers(docs: DataFrame, shown: DataFrame) -> DataFrame:
    """Messages that no topic has."""
    return docs.join(shown.select("doc_id").distinct(), "doc_id", "left_anti")
