"""Word vectors learned from a table's own texts.

Words are described by the words around them: counts of neighbours, weighed by how
much more often two words meet than by chance (positive pointwise mutual
information), and projected to a few dimensions, where each neighbour adds its weight
with a sign that a hash of it gives. Two words with the same company get like vectors.
Everything is counted by joins and sums, so the vocabulary has no limit, and weights
are whole millionths, so sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.session import join_hot, stage

SCALE = 1_000_000
MOST_DIMENSIONS = 32


def met_pairs(texts: DataFrame, words: str, window: int = 4) -> DataFrame:
    """``a, b, n``, a <= b, staged: how often two words are at most ``window`` words
    apart, a word that meets itself counted from both sides."""
    size = F.size(words)

    def met(ahead):
        rest = F.greatest(size - ahead, F.lit(0))
        return F.zip_with(
            F.slice(words, F.lit(1), rest), F.slice(words, F.lit(ahead + 1), rest),
            lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")),
        )

    pairs = F.concat(*(met(ahead) for ahead in range(1, window + 1)))
    twice = F.when(F.col("a") == F.col("b"), 2 * F.count(F.lit(1))).otherwise(F.count(F.lit(1)))
    return stage(texts.select(F.inline(pairs)).groupBy("a", "b").agg(twice.alias("n")), "neighbours")


def both_sides(pairs: DataFrame, *columns: str) -> DataFrame:
    """``word, context`` and ``columns`` of pairs (a, b), seen from both sides."""
    first = pairs.select(F.col("a").alias("word"), F.col("b").alias("context"), *columns)
    return first.unionByName(pairs.filter("a <> b").select(F.col("b").alias("word"), F.col("a").alias("context"), *columns))


def neighbour_counts(texts: DataFrame, words: str, window: int = 4) -> DataFrame:
    """``word, context, n``: how often two words are at most ``window`` words apart,
    counted from both sides."""
    return both_sides(met_pairs(texts, words, window), "n")


def learn_vectors(texts: DataFrame, words: str, size: int = 16, window: int = 4) -> DataFrame:
    """``word, vector array<long>`` of every word that has a neighbour, in millionths."""
    if not 1 <= size <= MOST_DIMENSIONS:
        raise ValueError(f"size must be from 1 to {MOST_DIMENSIONS}")
    pairs = met_pairs(texts, words, window)
    counts = both_sides(pairs, "n")
    # A context adds with the same signs wherever it is met: one bit for each dimension.
    bits = (F.when(F.substring(F.md5("word"), i + 1, 1) >= "8", F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(size))
    totals = counts.groupBy("word").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("times"))
    totals = stage(totals.withColumn("signs", reduce(lambda x, y: x + y, bits)), "word-totals")
    everything = totals.agg(F.sum("total")).first()[0] or 0
    # A pair weighs the same from both sides, so it meets the totals once; ``times``
    # is then at least the number of its rows.
    own, other = (totals.select(F.col("word").alias(c), F.col("total").alias(f"_total_{c}"), F.col("signs").alias(f"_signs_{c}"), "times") for c in "ab")
    met = stage(join_hot(pairs, own, ["a"], "times").drop("times"), "sides")
    met = join_hot(met, other, ["b"], "times")
    chance = F.col("n") * F.lit(float(everything)) / (F.col("_total_a").cast("double") * F.col("_total_b"))
    weighed = met.filter(chance > 1).withColumn("_w", F.round(F.log(chance) * SCALE).cast("long"))
    ends = [F.struct(F.col(x).alias("word"), F.col(f"_signs_{y}").alias("_signs")) for x, y in ("ab", "ba")]
    weighed = weighed.select("_w", F.inline(F.when(F.col("a") == F.col("b"), F.array(ends[0])).otherwise(F.array(*ends))))
    signed = [F.when(F.col("_signs").bitwiseAND(F.lit(1 << i)) != 0, F.col("_w")).otherwise(-F.col("_w")) for i in range(size)]
    added = weighed.groupBy("word").agg(*(F.sum(c).alias(f"_{i}") for i, c in enumerate(signed)))
    known = totals.select("word").join(added, "word", "left")
    return known.select("word", F.array(*(F.coalesce(f"_{i}", F.lit(0)) for i in range(size))).alias("vector"))


def sentence_vectors(
    sentences: DataFrame, place: Sequence[str], words: str, vectors: DataFrame, size: int = 16, name: str = "vector",
) -> DataFrame:
    """``place`` and the mean vector of a sentence's known words; zeros where it has none."""
    place = list(place)
    vectors = stage(vectors, "vectors")
    opened = stage(sentences.select(*place, F.explode(words).alias("word")).groupBy(*place, "word").agg(F.count(F.lit(1)).alias("_n")), "sentence-words")
    times = opened.groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    known = stage(vectors.join(times, "word"), "vectors")
    met = join_hot(opened, known, ["word"], "times")
    sums = met.groupBy(*place).agg(F.sum("_n").alias("_n"), *(F.sum(F.col("_n") * F.col("vector")[i]).alias(f"_{i}") for i in range(size)))
    same = [sentences[c].eqNullSafe(sums[c]) for c in place]
    match = same[0]
    for more in same[1:]:
        match &= more
    mean = F.array(*(F.coalesce(F.col(f"_{i}") / F.col("_n"), F.lit(0.0)) for i in range(size)))
    return sentences.join(sums, match, "left").select(*(sentences[c] for c in place), mean.alias(name))
