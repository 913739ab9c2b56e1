"""Token counts from an exact histogram of encoded lengths.

Documents are added up by encoded length; with suffix sums over the lengths, the
total, every quantile and the total truncated to any context limit are look-ups.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.words import ready

from gistmill.session import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut before merges, as published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKET = 1024


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, docs): how many rows of ``docs`` (text) have each encoded length.

    Whole texts are encoded, special tokens as ordinary text; null counts as empty.
    Other columns don't matter. An empty table has an empty histogram.
    """
    ready(docs.sparkSession)

    def count(batches):
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            lengths = np.array([len(encode(x.as_py() or "")) for x in batch.column("text")], dtype=np.int64)
            values, times = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(times.astype(np.int64))], names=["n_tokens", "docs"])

    parts = docs.select("text").mapInArrow(count, "n_tokens long, docs long")
    return parts.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with, for each length: documents and tokens of at least that
    length, all tokens if texts were cut to it, and the share of documents that fit.

    Lengths are added up in buckets first, so no task holds more than a bucket's
    lengths or one row per bucket.
    """
    rows = stage(histogram.withColumn("bucket", F.expr(f"n_tokens div {BUCKET}")).withColumn("tokens", F.col("n_tokens") * F.col("docs")), "token-histogram")
    buckets = rows.groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    longer = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    zero = F.lit(0).cast("long")
    buckets = buckets.select(
        "bucket",
        F.coalesce(F.sum("docs").over(longer), zero).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(longer), zero).alias("tokens_above"),
        F.sum("docs").over(every).alias("all_docs"),
        F.sum("tokens").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens"))
    sums = rows.withColumn("_docs", F.sum("docs").over(inside)).withColumn("_tokens", F.sum("tokens").over(inside)).join(buckets, "bucket")
    at_least, tokens = F.col("_docs") + F.col("docs_above"), F.col("_tokens") + F.col("tokens_above")
    return sums.select(
        "n_tokens",
        "docs",
        at_least.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens + F.col("n_tokens") * at_least).alias("truncated_total"),
        ((F.col("all_docs") - at_least + F.col("docs")) / F.col("all_docs")).alias("share_that_fits"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, truncated_total): all tokens if texts are cut to each limit, also for
    limits that are no text's length."""
    longer = sums.select(F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit"), "*")
    own = F.least("n_tokens", "limit") * F.col("docs")
    return longer.groupBy("limit").agg(F.sum(own).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least ``share`` of documents fit in."""
    rows = sums.select(F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"), "n_tokens", "share_that_fits")
    return rows.where("share_that_fits >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    return suffix_sums(length_histogram(docs, vocabulary, pattern))
