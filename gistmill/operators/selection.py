"""Choosing summary sentences from scored ones, at redundancy level 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.operators.running import running_totals
from gistmill.operators.terms import sentence_place

MIN_WORDS, MAX_WORDS = 5, 29


def length_gate(low: int = MIN_WORDS, high: int = MAX_WORDS) -> Column:
    return F.col("og_words").between(low, high)


def summary_limit(kind: str, share: float = 0.15) -> Column:
    """How much a group's summary may hold: sentences for ``percent``, else words.

    ``percent`` is a share of the sentences, ``250`` a fixed number of words,
    ``rev_count`` 25 words per five responses, ``doc`` 80% of the raw words.
    """
    if kind == "percent":
        return F.floor(F.col("n_sentences") * F.lit(share)).cast("long")
    if kind == "rev_count":
        return F.floor(F.col("n_responses") / 5).cast("long") * 25
    if kind == "doc":
        return F.floor(F.col("total_words") * F.lit(0.8)).cast("long")
    return F.lit(int(kind)).cast("long")


def select_summary(
    scored: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    limit: str = "percent",
    share: float = 0.15,
    score_digits: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Best sentences of each group, ranked from 1.

    Equal scores go to the earlier sentence. A sentence equal to the one just
    above it is passed over. A word limit takes sentences while the words
    already taken are below it, so the last one may reach over. A group without
    any term offers only its first sentence. Unscored sentences are never taken.
    ``score_digits`` ranks on rounded scores. ``largest`` is the size of the
    largest group, where it is known.
    """
    score = F.col("score") if score_digits is None else F.round("score", score_digits)
    no_terms = F.col("filt_total") == 0
    pool = (
        scored.filter(F.col("score").isNotNull() & (length_gate() | no_terms))
        .withColumn("_limit", summary_limit(limit, share))
        .filter("_limit > 0")
        .withColumn("score", score)
    )
    ranked = running_totals(
        pool, keys, ["score", *sentence_place(scored, order)],
        {"rank": 1, "_taken_words": "og_words"}, compare="sentence", label="ranked", largest=largest,
    )
    if limit == "percent":
        within = F.col("rank") <= F.col("_limit")
    else:
        within = F.col("_taken_words") - F.col("og_words") < F.col("_limit")
    within = F.when(no_terms, length_gate() & (F.col("rank") == 1)).otherwise(within)
    return ranked.filter(~F.col("repeated") & within).select(
        *keys, F.col("rank").cast("int").alias("rank"), *order, "sen_pos", "sentence", "og_words", "score"
    )
