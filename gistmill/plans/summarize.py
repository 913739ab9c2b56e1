"""Whole jobs: from a table of texts to summaries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import text as tx
from gistmill.functions.wordlists import STOP_WORDS
from gistmill.operators import greedy, scoring, selection, terms
from gistmill.operators.running import number_rows, running_totals
from gistmill.operators.splitting import SplitModel
from gistmill.operators.topics import TopicModel
from gistmill.session import ship, stage


def prepare(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    rule: str | SplitModel = "full",
    normalize: str = "stem",
    stop_words: Iterable[str] = STOP_WORDS,
) -> DataFrame:
    """Staged sentence table: split, counted and stemmed once, read many times."""
    ship(df.sparkSession)
    return stage(terms.sentence_table(df, keys, order, text, rule, normalize, stop_words), "sentences")


def summarize(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    method: str = "kl",
    limit: str = "percent",
    share: float = 0.15,
    redundancy: int = 0,
    min_words: int | None = None,
    model: TopicModel | None = None,
    variant: str = "v1",
    score_digits: int | None = None,
    rule: str | SplitModel = "full",
    normalize: str = "stem",
    stop_words: Iterable[str] = STOP_WORDS,
) -> DataFrame:
    """Summary of every group in ``df``.

    ``keys`` name the group; ``order`` names the columns that tell responses of
    one group apart and put them in order (none when a group is one text).
    ``method`` is ``kl``, ``tfidf`` or ``topics`` (with a ``model``); ``limit``
    is ``percent`` (``share`` of the sentences), a number of words such as
    ``250``, ``rev_count`` or ``doc``. Groups need more than ``min_words`` raw
    words. ``redundancy`` 1 or 2, and topic variant ``v2``, re-score after each
    pick. Columns: keys, rank, order, sen_pos, sentence, og_words, score.
    """
    sentences = prepare(df, keys, order, text, rule, normalize, stop_words)
    return summarize_sentences(
        sentences, keys, order, method, limit, share, redundancy, min_words, model, variant, score_digits
    )


def summarize_sentences(
    sentences: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    method: str = "kl",
    limit: str = "percent",
    share: float = 0.15,
    redundancy: int = 0,
    min_words: int | None = None,
    model: TopicModel | None = None,
    variant: str = "v1",
    score_digits: int | None = None,
) -> DataFrame:
    """``summarize`` for a staged sentence table."""
    ship(sentences.sparkSession)
    topical = method == "topics"
    if topical and model is None:
        raise ValueError("topic scoring needs a topic model")
    if redundancy or (topical and variant == "v2"):
        if method == "tfidf":
            raise ValueError("TF-IDF scores do not change with picks")
        return greedy.select_reducing(
            sentences, keys, order, redundancy, limit, share, min_words,
            model.keywords if topical else None, model.n_topics if topical else None, variant,
        )
    groups = scoring.measure_groups(sentences, keys, min_words)
    scored = scoring.score_sentences(
        sentences, keys, order, method, selection.length_gate(), groups,
        model.keywords if topical else None, model.n_topics if topical else None,
    )
    return selection.select_summary(scored, keys, order, limit, share, score_digits, groups.largest)


def two_candidates(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str,
    method: str = "kl", share: float = 0.10, model: TopicModel | None = None, **options,
) -> tuple[DataFrame, DataFrame]:
    """A 250-word summary at redundancy level 2 (by divergence) and a percent
    summary at level 0 (by ``method``)."""
    sentences = prepare(df, keys, order, text, **options)
    by_words = summarize_sentences(sentences, keys, order, "kl", "250", redundancy=2)
    by_share = summarize_sentences(sentences, keys, order, method, "percent", share, model=model)
    return by_words, by_share


def paragraphs(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary text per group: one row, whatever the number of sentences."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "sentence")))
    return summary.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda s: s["sentence"]), " ").alias("paragraph"),
        F.sum("og_words").alias("n_words"),
    )


def shorten_extract(summary: DataFrame, keys: Sequence[str], target: Column | int, longest: int = 500) -> DataFrame:
    """Drop sentences from the end: one stays while the words before it do not
    exceed the target. Targets above ``longest`` become it, others lose one."""
    target = F.lit(target) if isinstance(target, int) else target
    aim = F.when(target > longest, F.lit(longest)).otherwise(target - 1)
    counted = summary.withColumn("_aim", aim).withColumn("_words", tx.count_words("sentence"))
    total = running_totals(counted, keys, ["rank"], {"_so_far": "_words"}, label="shorten")
    return total.filter(F.col("_so_far") - F.col("_words") <= F.col("_aim")).drop("_so_far", "_words", "_aim")


def shorten_text(df: DataFrame, text: str, target: Column | int, longest: int = 250, rule: str = "full") -> DataFrame:
    """The same for one text per row, split into sentences. Adds ``shortened``
    and ``n_words``. Only the first ``longest`` + 2 sentences can stay, since
    each has a word."""
    target = F.lit(target) if isinstance(target, int) else target
    aim = F.when(target > longest, F.lit(longest)).otherwise(target - 1)
    kept = F.aggregate(
        F.slice("_parts", 1, longest + 2),
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("kept")),
        lambda acc, s: F.when(
            acc["words"] <= F.col("_aim"),
            F.struct((acc["words"] + tx.count_words(s)).alias("words"), (acc["kept"] + 1).alias("kept")),
        ).otherwise(acc),
    )
    return (
        df.withColumn("_parts", tx.split_sentences(text, rule))
        .withColumn("_aim", aim)
        .withColumn("_kept", kept)
        .withColumn("shortened", F.array_join(F.slice("_parts", F.lit(1), F.col("_kept.kept")), " "))
        .withColumn("n_words", F.col("_kept.words"))
        .drop("_parts", "_aim", "_kept")
    )


def number_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "val") -> DataFrame:
    """Number groups from 1 by their first row in ``order``; groups that yield
    no summary are numbered too."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return number_rows(first, [], ["_first", *keys], name, label="groups").select(*keys, name)

