"""Measures of finished summaries.

Input is a summary table: ``keys``, ``rank`` from 1 without gaps, ``sentence``.
Neighbouring sentences meet by joining on rank + 1, so no group is gathered. These
joins are never by broadcast: words and vectors of many sentences are small in files
and large on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import text as tx
from gistmill.session import stage

BLOCK = 64
PENALTY = 0.1
_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def _grams(words: Column, n: int) -> Column:
    """Word n-grams of an array of words, joined by a space."""
    last = F.size(words) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def unique_ngram_ratio(summary: DataFrame, keys: Sequence[str], n: int = 2) -> DataFrame:
    """Distinct over all n-grams of the summary's running text, per group.

    N-grams that cross into following sentences are made where the earlier
    sentence ends.
    """
    keys = list(keys)
    words = stage(summary.select(*keys, "rank", tx.split_words("sentence").alias("_words")), "words")
    opened = words.withColumn("_own", F.size("_words"))
    for ahead in range(1, n):
        following = words.select(
            *keys, (F.col("rank") - ahead).alias("rank"), F.slice("_words", 1, n - 1).alias("_next")
        )
        opened = opened.join(following.hint("merge"), [*keys, "rank"], "left").select(
            *keys, "rank", "_own",
            F.concat("_words", F.coalesce("_next", F.array().cast("array<string>"))).alias("_words"),
        )
    grams = opened.select(*keys, F.explode(_grams(F.slice(F.col("_words"), F.lit(1), F.col("_own") + (n - 1)), n)).alias("_gram"))
    counted = grams.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_times"))
    return counted.groupBy(*keys).agg((F.count(F.lit(1)) / F.sum("_times")).alias("ratio"))


def ngram_redundancy(summary: DataFrame, keys: Sequence[str], n: int = 2) -> DataFrame:
    """``-(1 - ratio)``: 0 when no n-gram repeats, near -1 when most do."""
    return unique_ngram_ratio(summary, keys, n).select(*keys, (F.col("ratio") - 1).alias("redundancy"))


def _pair_tests(a: Column, b: Column) -> Column:
    """How many of the four likeness tests a pair of sentences passes.

    A common run of at least 80% of the shorter side exists exactly when one of
    the shorter side's windows of that length occurs in the other side, so no
    longest run is searched for.
    """
    swap = a["chars"] > b["chars"]
    short, long = F.when(swap, b["text"]).otherwise(a["text"]), F.when(swap, a["text"]).otherwise(b["text"])
    chars = F.least(a["chars"], b["chars"])
    run = F.floor((chars * 4 + 4) / 5).cast("int")
    same_chars = F.exists(
        F.sequence(F.lit(1), chars - run + 1), lambda i: F.contains(long, F.substring(short, i, run))
    )
    fewer = a["size"] > b["size"]
    few = F.when(fewer, b["words"]).otherwise(a["words"])
    many = F.concat(F.lit(" "), F.array_join(F.when(fewer, a["words"]).otherwise(b["words"]), " "), F.lit(" "))
    size = F.least(a["size"], b["size"])
    word_run = F.floor((size * 4 + 4) / 5).cast("int")
    same_words = F.exists(
        F.sequence(F.lit(1), size - word_run + 1),
        lambda i: F.contains(many, F.concat(F.lit(" "), F.array_join(F.slice(few, i, word_run), " "), F.lit(" "))),
    )
    most = F.floor(chars * 3 / 5).cast("int")
    near = F.call_function("levenshtein", a["text"], b["text"], most) >= 0
    shared = F.size(F.array_intersect(a["words"], b["words"])) * 5 >= size * 4
    return sum((test.cast("int") for test in (same_words, near, shared)), same_chars.cast("int"))


def pair_redundancy(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """-0.1 for every likeness test passed by any two sentences of a summary.

    Two sentences are alike by: a common text run, a common word run, a small
    edit distance, a large common word set. All sentence pairs count, so groups
    are cut into blocks of 64 sentences and blocks are compared pairwise: a
    summary up to that size is one row, a larger one spreads over many tasks,
    and pairs of sentences are never rows of their own.
    """
    keys = list(keys)
    words = word_tokens("sentence")
    described = (
        summary.filter(F.col("sentence") != "")
        .withColumn("words", words)
        .withColumn("_block", F.floor((F.col("rank") - 1) / BLOCK).cast("int"))
    )
    blocks = described.groupBy(*keys, "_block").agg(
        F.collect_list(
            F.struct("rank", F.col("sentence").alias("text"), F.length("sentence").alias("chars"),
                     "words", F.size("words").alias("size"))
        ).alias("_items")
    )
    blocks = stage(blocks, "blocks")
    last = blocks.groupBy(*keys).agg(F.max("_block").alias("_last"))
    single = blocks.join(last, keys)
    inside = F.aggregate(
        "_items", F.lit(0),
        lambda acc, a: acc + F.aggregate(
            F.filter("_items", lambda b: b["rank"] > a["rank"]), F.lit(0), lambda acc2, b: acc2 + _pair_tests(a, b)
        ),
    )
    within = single.select(*keys, inside.alias("_passed"))
    right = blocks.select(*keys, F.col("_block").alias("_other"), F.col("_items").alias("_items2"))
    across = (
        single.filter("_last > _block")
        .select(*keys, "_items", F.explode(F.sequence(F.col("_block") + 1, F.col("_last"))).alias("_other"))
        .join(right, [*keys, "_other"])
        .select(*keys, F.aggregate(
            "_items", F.lit(0),
            lambda acc, a: acc + F.aggregate("_items2", F.lit(0), lambda acc2, b: acc2 + _pair_tests(a, b)),
        ).alias("_passed"))
    )
    return (
        within.unionByName(across).groupBy(*keys)
        .agg((F.lit(-PENALTY) * F.sum("_passed")).alias("redundancy"))
    )


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def focus(summary: DataFrame, keys: Sequence[str], vector: str, low: float = 0.05) -> DataFrame:
    """-0.1 for every two neighbouring sentences whose vectors are unlike."""
    keys = list(keys)
    vectors = stage(summary.select(*keys, "rank", vector), "vectors")
    following = vectors.select(*keys, (F.col("rank") - 1).alias("rank"), F.col(vector).alias("_next"))
    paired = vectors.select(*keys, "rank", vector).join(following.hint("merge"), [*keys, "rank"], "left")
    similarity = F.coalesce(cosine(F.col(vector), F.col("_next")), F.lit(0.0))
    unlike = (F.col("_next").isNotNull() & (similarity < low)).cast("int")
    return paired.groupBy(*keys).agg((F.lit(-PENALTY) * F.sum(unlike)).alias("focus"))


def word_vectors(summary: DataFrame, size: int = 50, seed: int = 42, min_count: int = 1) -> DataFrame:
    """Add ``vector``: the mean vector of a sentence's words, trained on the table itself."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = summary.withColumn("_words", tx.lowered(tx.split_words(tx.strip_punctuation("sentence"))))
    model = Word2Vec(vectorSize=size, seed=seed, minCount=min_count, inputCol="_words", outputCol="_vector").fit(words)
    return model.transform(words).withColumn("vector", vector_to_array("_vector")).drop("_words", "_vector")


def _longest_common_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of words in both, by the suffix automaton of ``a``:
    each state is a set of runs that end at the same places."""
    follows, link, length, last = [{}], [-1], [0], 0
    for word in a:
        state = len(follows)
        follows.append({})
        link.append(0)
        length.append(length[last] + 1)
        at, last = last, state
        while at >= 0 and word not in follows[at]:
            follows[at][word] = state
            at = link[at]
        if at < 0:
            continue
        target = follows[at][word]
        if length[target] == length[at] + 1:
            link[state] = target
            continue
        # The runs of the target that end here too get a state of their own.
        shorter = len(follows)
        follows.append(dict(follows[target]))
        link.append(link[target])
        length.append(length[at] + 1)
        link[target] = link[state] = shorter
        while at >= 0 and follows[at].get(word) == target:
            follows[at][word] = shorter
            at = link[at]
    best = run = at = 0
    for word in b:
        while at and word not in follows[at]:
            at = link[at]
            run = length[at]
        at = follows[at].get(word, 0)
        run = run + 1 if at else 0
        best = max(best, run)
    return best


def longest_common_run(a: Column | str, b: Column | str) -> Column:
    """The length in words of the longest run that two arrays of words share; null
    where one is null. Time and memory grow with the words of both, not with their
    product."""
    @F.pandas_udf("long")
    def longest(x: pd.Series, y: pd.Series) -> pd.Series:
        runs = [None if p is None or q is None else _longest_common_run(*sorted((list(p), list(q)), key=len)) for p, q in zip(x, y)]
        return pd.Series(runs, dtype="Int64")

    return longest(a, b)


def word_tokens(c: Column | str) -> Column:
    """Words and single marks of a text, as the pair measures compare them."""
    return F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))


def common_runs(summary: DataFrame, keys: Sequence[str], order: str = "rank", text: str = "sentence") -> DataFrame:
    """For every two neighbours: ``run``, the words of the longest run in both, and
    ``share``, its part of the shorter one (0 where that is empty)."""
    keys = list(keys)
    worded = stage(summary.select(*keys, order, word_tokens(text).alias("_words")), "words")
    following = worded.select(*keys, (F.col(order) - 1).alias(order), F.col("_words").alias("_next"))
    run = worded.join(following.hint("merge"), [*keys, order]).withColumn("run", longest_common_run("_words", "_next"))
    shorter = F.nullif(F.least(F.size("_words"), F.size("_next")), F.lit(0))
    return run.select(*keys, order, "run", F.coalesce(F.col("run") / shorter, F.lit(0.0)).alias("share"))


def grammar(summary: DataFrame, keys: Sequence[str], errors: str = "n_errors") -> DataFrame:
    """Errors found by the caller's checker: their total, the words, and
    ``1 - errors / words``."""
    n_errors, n_words = F.sum(errors), F.sum(tx.count_words("sentence"))
    return summary.groupBy(*keys).agg(
        n_errors.alias("n_errors"), n_words.alias("n_words"),
        (F.lit(1) - n_errors / F.nullif(n_words, F.lit(0))).alias("grammar"),
    )


def min_max(df: DataFrame, column: str, keys: Sequence[str] = (), name: str = "scaled") -> DataFrame:
    """Scale a column to 0..1 within each group, or over the table; a group of
    one value has no scale (null)."""
    stats = df.groupBy(*keys).agg(F.min(column).alias("_min"), F.max(column).alias("_max"))
    if keys:
        joined, low, high = df.join(stats, list(keys)), F.col("_min"), F.col("_max")
    else:
        joined, low, high = df, stats.select("_min").scalar(), stats.select("_max").scalar()
    scaled = (F.col(column) - low) / F.nullif(high - low, F.lit(0).cast("double"))
    return joined.withColumn(name, scaled).drop("_min", "_max")


def readability(redundancy: DataFrame, focused: DataFrame, checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed total: coherence (always 0) + focus + redundancy + grammar."""
    keys = list(keys)
    joined = checked.join(focused, keys).join(redundancy, keys, "left")
    parts = [F.col("focus"), F.coalesce("redundancy", F.lit(0.0)), F.col("grammar")]
    return joined.select(*keys, *(p.alias(n) for p, n in zip(parts, ("focus", "redundancy", "grammar"))),
                         sum(parts, F.lit(0.0)).alias("readability"))


def readability_thirds(
    redundancy: DataFrame, focused: DataFrame, checked: DataFrame, sizes: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Grammar, redundancy and focus as thirds of 1; penalties count per sentence."""
    keys = list(keys)
    joined = sizes.select(*keys, "n_sentences").join(checked, keys).join(redundancy, keys, "left").join(focused, keys, "left")

    def third(penalty):
        return (1 - F.abs(F.coalesce(penalty, F.lit(0.0))) * 10 / F.col("n_sentences")) / 3

    correct = (1 - F.col("n_errors") / F.nullif(F.col("n_words"), F.lit(0))) / 3
    return joined.select(
        *keys, correct.alias("grammar"), third(F.col("redundancy")).alias("redundancy"), third(F.col("focus")).alias("focus")
    ).withColumn("readability", F.col("grammar") + F.col("redundancy") + F.col("focus"))


def summary_sizes(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return summary.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sentences"), F.sum("og_words").alias("n_words")
    )


def choose_candidate(first: DataFrame, second: DataFrame, keys: Sequence[str], score: str = "readability") -> DataFrame:
    """Per group, ``first`` when its score is strictly greater, else ``second``."""
    keys = list(keys)
    a = first.select(*keys, F.col(score).alias("first_score"))
    b = second.select(*keys, F.col(score).alias("second_score"))
    better = F.coalesce(F.col("first_score") > F.col("second_score"), F.lit(False))
    return a.join(b, keys, "full").withColumn("chosen", F.when(better, F.lit("first")).otherwise(F.lit("second")))


def rouge_n(
    candidates: DataFrame, references: DataFrame, keys: Sequence[str], words: str = "words", n: int = 1
) -> DataFrame:
    """ROUGE-N of texts (arrays of words) sharing a key: clipped n-gram overlap."""
    keys = list(keys)

    def counts(df, name):
        grams = df.select(*keys, F.explode(_grams(F.col(words), n)).alias("_gram"))
        return grams.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias(name))

    both = counts(candidates, "_c").join(counts(references, "_r"), [*keys, "_gram"], "full")
    sums = both.groupBy(*keys).agg(
        F.sum(F.least(F.coalesce("_c", F.lit(0)), F.coalesce("_r", F.lit(0)))).alias("_both"),
        F.sum("_c").alias("_cn"), F.sum("_r").alias("_rn"),
    )
    return _rouge(sums.filter("_cn is not null and _rn is not null"), keys)


def _rouge(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    precision, recall = F.col("_both") / F.col("_cn"), F.col("_both") / F.col("_rn")
    f1 = F.when(F.col("_both") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.select(*keys, precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def _common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[str, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        match = row & where.get(word, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def rouge_l(candidates: DataFrame, references: DataFrame, keys: Sequence[str], words: str = "words") -> DataFrame:
    """ROUGE-L of texts (arrays of words) sharing a key."""
    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_common_subsequence(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")

    a = candidates.select(*keys, F.col(words).alias("_a"))
    b = references.select(*keys, F.col(words).alias("_b"))
    pairs = a.join(b, list(keys)).filter((F.size("_a") > 0) & (F.size("_b") > 0))
    sums = pairs.select(*keys, common("_a", "_b").alias("_both"), F.size("_a").alias("_cn"), F.size("_b").alias("_rn"))
    return _rouge(sums, keys)
