"""Sentence and term tables: the input of every scoring method.

A *sentence table* has one row per sentence: the group columns (``keys``), the
columns ordering responses inside a group (``order``), ``sen_pos``, the closed
``sentence``, its word counts, and ``bag``: its distinct terms with counts, in
order of first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import text as tx
from gistmill.functions.wordlists import STOP_WORDS
from gistmill.operators.splitting import SplitModel, split_fitted
from gistmill.session import spread

ROW = "text_row"


def sentence_place(sentences: DataFrame, order: Sequence[str]) -> list[str]:
    """Columns that tell the sentences of a group apart, in their order."""
    return [*order, *([ROW] if ROW in sentences.columns else []), "sen_pos"]


def explode_sentences(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, rule: str | SplitModel = "full"
) -> DataFrame:
    """One row per sentence, by a rule or a fitted model. Null and blank texts give none.

    ``text_row`` tells the texts of a group apart where ``order`` does not: a hash
    of the text, so that their order is stable, and a number for equal texts. The
    number holds while the table is read back from staging.
    """
    row = F.struct(F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("number")).alias(ROW)
    if isinstance(rule, SplitModel):
        return split_fitted(spread(df.select(*keys, *order, text)), [*keys, *order, row], text, rule)
    # The outer form keeps the optimizer from testing the array in a filter of
    # its own, which would split every text twice.
    parts = spread(df.select(*keys, *order, text)).select(*keys, *order, row, F.posexplode_outer(tx.split_sentences(text, rule)).alias("sen_pos", "part"))
    return parts.filter(F.col("part").isNotNull())


def describe_sentences(
    parts: DataFrame, part: str = "part", normalize: str = "stem", stop_words: Iterable[str] = STOP_WORDS
) -> DataFrame:
    """Close each sentence, count its words and list its terms.

    ``raw_words`` counts the sentence as it came, ``og_words`` without
    punctuation, ``filt_words`` without stop words. ``normalize``: ``stem``,
    ``lower`` or ``none``.
    """
    change = {"stem": tx.stems, "lower": tx.lowered, "none": lambda words: words}[normalize]
    return (
        parts.withColumn("raw_words", tx.count_words(part))
        .withColumn("sentence", tx.close_sentence(part))
        .withColumn("_words", tx.split_words(tx.strip_punctuation("sentence")))
        .withColumn("og_words", F.size("_words"))
        .withColumn("_kept", tx.drop_stop_words("_words", stop_words))
        .withColumn("filt_words", F.size("_kept"))
        .withColumn("terms", change(F.col("_kept")))
        .drop("_words", "_kept", *([part] if part != "sentence" else []))
    )


def with_bag(df: DataFrame, terms: str = "terms") -> DataFrame:
    """Replace ``terms`` by ``bag: array<struct<first, term, tf>>``."""
    return df.withColumn("bag", tx.counted(terms)).drop(terms)


def sentence_table(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    rule: str | SplitModel = "full",
    normalize: str = "stem",
    stop_words: Iterable[str] = STOP_WORDS,
) -> DataFrame:
    """Sentence table of a table of texts."""
    parts = explode_sentences(df, keys, order, text, rule)
    return with_bag(describe_sentences(parts, "part", normalize, stop_words))


def explode_bag(sentences: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """One row per sentence and distinct term."""
    return sentences.select(*columns, F.inline_outer("bag")).filter(F.col("term").isNotNull())


def sentence_terms(sentences: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Term counts per sentence."""
    return explode_bag(sentences, [*keys, *order, "sen_pos"]).drop("first")


def group_terms(sentences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group and term: ``count`` over all sentences, and ``df``, the number
    of sentences holding the term. Adds up inside each task before the shuffle."""
    return (
        explode_bag(sentences, keys)
        .groupBy(*keys, "term")
        .agg(F.sum("tf").alias("count"), F.count(F.lit(1)).alias("df"))
    )


def group_totals(sentences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: sentences, responses with a sentence, raw words, filtered words."""
    return sentences.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sentences"),
        F.sum((F.col("sen_pos") == 0).cast("long")).alias("n_responses"),
        F.sum("raw_words").alias("total_words"),
        F.sum("filt_words").alias("filt_total"),
    )


def max_frequency(sentences: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Highest term count of each sentence; 0 without terms."""
    return sentences.select(*keys, *order, "sen_pos", top_count().alias("max_tf"))


def top_count() -> Column:
    return F.coalesce(F.array_max(F.transform("bag", lambda b: b["tf"])), F.lit(0))
