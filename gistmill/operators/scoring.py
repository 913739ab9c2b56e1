"""Sentence scores. Lower is better in every method.

Term counts per sentence meet the group's term counts in blocks of sentences
(``blocks``), and the per-term parts are added in order of first occurrence so
that near ties fall the same way on every run.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.operators import terms as tm
from gistmill.operators.blocks import meet_counts
from gistmill.operators.topics import meet_keywords
from gistmill.session import BROADCAST_ROWS, join_hot, stage

NO_WORDS = 1000.0


def relative_entropy(a: Column, b: Column) -> Column:
    """``a ln(a/b)``; a zero ``a`` adds nothing."""
    return F.when(a > 0, a * F.ln(a / b)).otherwise(F.lit(0.0))


def kl_divergence(p: Column | str, q: Column | str) -> Column:
    """KL divergence of two aligned ``array<double>`` distributions."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.aggregate(
        F.zip_with(p, q, relative_entropy), F.lit(0.0), lambda total, part: total + part
    )


def term_frequency(tf: Column, max_tf: Column) -> Column:
    return tf / max_tf


def inverse_frequency(n_sentences: Column, df: Column) -> Column:
    return F.log2(n_sentences / df)


class Groups(NamedTuple):
    totals: DataFrame  # marked for broadcast while the groups are few, else for a merge: files say too little of their size
    largest: int  # sentences of the largest group


def measure_groups(sentences: DataFrame, keys: Sequence[str], min_words: int | None = None) -> Groups:
    """Totals of the groups to summarize; with ``min_words``, only groups of
    more raw words than that."""
    totals = tm.group_totals(sentences, keys)
    if min_words is not None:
        totals = totals.filter(F.col("total_words") > min_words)
    totals = stage(totals, "totals")
    count, largest = totals.agg(F.count(F.lit(1)), F.max("n_sentences")).first()
    return Groups(F.broadcast(totals) if count <= BROADCAST_ROWS else totals.hint("merge"), largest or 0)


def _part(method: str, n_topics: int | None, met: Column) -> Column:
    count, tf, n = met["count"], met["tf"], F.col("filt_words")
    a, b = count / F.col("filt_total"), tf / n
    if method == "kl":
        return relative_entropy(a, b)
    if method == "tfidf":
        idf = inverse_frequency(F.col("n_sentences"), met["df"])
        # 0 * ln 0 has no value: the sentence gets no score.
        return F.when(idf > 0, idf * F.ln(idf / term_frequency(tf, F.col("max_tf"))))
    if method == "topics":
        c = F.size(met["topics"]) / (met["n_topics"] if n_topics is None else F.lit(n_topics))
        return relative_entropy(a, b * c)
    raise ValueError(f"unknown scoring method: {method}")


def _meet_topics(sentences, keys, place, columns, shown, keywords) -> DataFrame:
    """As ``blocks.meet_counts``, with the terms that have topics. All others leave
    before anything is shuffled, which is most of them."""
    opened = meet_keywords(tm.explode_bag(sentences, keys), keywords, keys, "left_semi")
    dictionary = opened.groupBy(*keys, "term").agg(F.sum("tf").alias("count"), F.count(F.lit(1)).alias("df"))
    dictionary = stage(meet_keywords(dictionary, keywords, keys), "dictionary")
    tokens = meet_keywords(tm.explode_bag(sentences.filter(shown), [*place, *columns, "sentence"]), keywords, keys, "left_semi")
    # A term may be in a third of a large group's sentences: those stay in place.
    more = [c for c in ("topics", "n_topics") if c in dictionary.columns]
    met = F.array_sort(F.collect_list(F.struct("first", "tf", "count", *more)))
    return join_hot(tokens, dictionary, [*keys, "term"], "df").groupBy(*place).agg(
        *(F.max(c).alias(c) for c in (*columns, "sentence")), met.alias("met"))


def score_sentences(
    sentences: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    method: str = "kl",
    candidates: Column | None = None,
    groups: Groups | None = None,
    keywords: DataFrame | None = None,
    n_topics: int | None = None,
    with_empty: bool = True,
) -> DataFrame:
    """Score the sentences of a sentence table (ideally a staged one).

    ``method``: ``kl``, ``tfidf`` or ``topics`` (with a keyword table ``term,
    topics`` and the number of topics). Only ``candidates`` are scored, but all
    sentences shape the group's distribution. Sentences without terms are left
    out, except by TF-IDF (0) and in groups that have none at all (1000).
    """
    keys, place = list(keys), [*keys, *tm.sentence_place(sentences, order)]
    totals = (groups or measure_groups(sentences, keys)).totals
    words = ["og_words", "raw_words", "filt_words"]
    sums = ["n_sentences", "n_responses", "total_words", "filt_total"]
    topical = method == "topics"
    # Groups that are not summarized leave before their sentences are opened.
    known = sentences.join(totals.select(*keys, *sums), keys).withColumn("max_tf", tm.top_count())
    shown = F.lit(True) if candidates is None else candidates
    if topical:
        met = _meet_topics(known, keys, place, [*words, *sums], shown, keywords)
        touched = F.array_sort(F.array_distinct(F.flatten(F.transform("met", lambda m: m["topics"]))))
    else:
        known = known.withColumn("sentence", F.when(shown, F.col("sentence")))
        met = meet_counts(known, keys, [*place, *words, "sentence", *sums, *(["max_tf"] if method == "tfidf" else [])], shown)
    total = F.aggregate(
        "met", F.lit(0.0), lambda acc, m: acc + F.coalesce(_part(method, n_topics, m), F.lit(float("nan"))))
    score = total / F.col("filt_words")
    scored = met.withColumn("score", F.when(~F.isnan(score), score)).select(
        *place, "sentence", *words, *sums, *([touched.alias("sen_topics")] if topical else []), "score")
    without = {"kl": NO_WORDS, "tfidf": 0.0}.get(method)
    if without is None or not with_empty:
        return scored
    # By TF-IDF a sentence without terms competes with its score of 0. By
    # divergence it counts only where the whole group has no term.
    group = totals.filter("filt_total = 0") if method == "kl" else totals
    empty = sentences.filter("filt_words = 0")
    if method == "tfidf" and candidates is not None:
        empty = empty.filter(candidates)
    empty = empty.join(group, keys).withColumn("score", F.lit(without))
    return scored.unionByName(empty.select(*scored.columns))


def score_listing(sentences, keys, order, method="kl", **options) -> DataFrame:
    """Every sentence with its score, also those without terms (1000 by
    divergence, 0 by TF-IDF, none by topics)."""
    columns = [*keys, *order, "sen_pos", "sentence", "og_words", "score"]
    without = {"kl": NO_WORDS, "tfidf": 0.0}.get(method)
    scored = score_sentences(sentences, keys, order, method, with_empty=False, **options)
    empty = sentences.filter("filt_words = 0").withColumn("score", F.lit(without).cast("double"))
    return scored.select(*columns).unionByName(empty.select(*columns))


def has_positive(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: does any score lie strictly between 0 and 100?"""
    inside = (F.col("score") > 0) & (F.col("score") < 100)
    return scored.groupBy(*keys).agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("has_positive"))
