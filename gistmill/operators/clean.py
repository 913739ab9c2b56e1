"""Corpus cleaning: row filters, conversation filters, batches."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import text as tx
from gistmill.functions.automaton import holds_any, starts_any
from gistmill.operators.running import number_rows
from gistmill.session import ship, small_side, stage

#: Words of one pattern, and characters of one automaton's words.
PATTERN_WORDS = 500
SHARD_CHARS = 2_000_000
INDEX_SEPARATOR = r"\$#\$"


def drop_blank(df: DataFrame, text: str, na_tokens: Sequence[str] = ()) -> DataFrame:
    """Drop rows whose text is null or white space only. ``na_tokens`` are
    texts that also count as missing (CSV readers often have such a list)."""
    present = F.col(text).isNotNull() & (tx.strip(text) != "")
    if na_tokens:
        present &= ~F.col(text).isin(list(na_tokens))
    return df.filter(present)


def drop_missing(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.col(text).isNotNull())


def flag_profanity(df: DataFrame, text: str, words: Iterable[str] | DataFrame, name: str = "has_profanity") -> DataFrame:
    """Flag texts that hold a listed word as a substring, ignoring case in the text.

    A word list in Python, or a one-column frame of at most ``PATTERN_WORDS`` words,
    becomes one pattern. A longer frame becomes an automaton that is sent to every
    Python worker. Beyond ``SHARD_CHARS`` characters that has the heads of the words
    only; what follows a head in a text, at the lengths of the words that begin with it,
    then meets the list in a join. Null and empty words are no words.
    """
    if not isinstance(words, DataFrame):
        return df.withColumn(name, tx.contains_any(text, words))
    column = words.columns[0]
    listed = stage(words.filter(F.col(column) != "").select(F.col(column).alias("word")).distinct(), "words")
    count, chars = listed.agg(F.count("word"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    if count <= PATTERN_WORDS:
        return df.withColumn(name, tx.contains_any(text, [r.word for r in listed.collect()]))
    spark = ship(df.sparkSession)
    if chars <= SHARD_CHARS:
        held = spark.sparkContext.broadcast([r.word for r in listed.collect()])
        return df.withColumn(name, holds_any(F.lower(text), held))
    heads = _heads(listed)
    longest = F.length("head") < F.length("word")
    lengths = heads.groupBy("head").agg(
        F.min(longest).alias("longer"), F.array_sort(F.collect_set(F.when(longest, F.length("word")))).alias("lengths"))
    held = spark.sparkContext.broadcast({r.head: (not r.longer, r.lengths) for r in lengths.collect()})
    met = starts_any(F.lower(text), held)
    # Written once: the numbers hold, and texts are scanned once.
    out = df.withColumns({"_met": met, "_number": F.monotonically_increasing_id()})
    out = stage(out.withColumn(name, F.coalesce("_met.whole", F.lit(False))), "flagged")
    found = out.filter(~F.col(name)).select("_number", F.explode("_met.pieces").alias("word")).join(listed, "word", "left_semi")
    found = small_side(found.select("_number").distinct().withColumn("_found", F.lit(True)), "found")
    out = out.join(found, "_number", "left").withColumn(name, F.col(name) | F.col("_found").isNotNull())
    return out.select(*df.columns, *([name] if name not in df.columns else []))


def _heads(listed: DataFrame) -> DataFrame:
    """Add ``head``: the first characters of each word, as many as leave distinct heads
    of at most ``SHARD_CHARS`` characters together, or one."""
    for size in (128, 64, 32, 24, 16, 12, 8, 6, 4, 3, 2, 1):
        out = listed.withColumn("head", F.substring("word", 1, size))
        if size == 1 or (out.select("head").distinct().agg(F.sum(F.length("head"))).first()[0] or 0) <= SHARD_CHARS:
            return out


def drop_profane_conversations(
    df: DataFrame, text: str, words: Iterable[str] | DataFrame, conversation: str = "conv_id"
) -> DataFrame:
    """Drop every row of a conversation that holds a flagged row. The key is
    the conversation id alone, whatever the corpus."""
    flagged = flag_profanity(df.select(conversation, text), text, words, "_profane")
    bad = flagged.filter("_profane").select(conversation).distinct()
    return df.join(small_side(bad, "profane"), conversation, "left_anti")


def drop_profane_names(df: DataFrame, name: str, words: Iterable[str] | DataFrame) -> DataFrame:
    return flag_profanity(df, name, words, "_profane").filter(~F.col("_profane")).drop("_profane")


def corpus_sizes(df: DataFrame, corpus: str, conversation: str, text: str) -> DataFrame:
    """Conversations and characters per corpus.

    Counted per conversation first, so a large corpus is spread over its
    conversations before it meets in one row.
    """
    per_conversation = df.groupBy(corpus, conversation).agg(
        F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("_chars")
    )
    return per_conversation.groupBy(corpus).agg(
        F.count(conversation).alias("n_conversations"), F.sum("_chars").alias("n_chars")
    )


def valid_corpora(
    df: DataFrame, corpus: str, conversation: str, text: str,
    min_conversations: int = 10, min_text_length: int = 1000,
) -> DataFrame:
    """Corpora with enough conversations and enough raw text."""
    return corpus_sizes(df, corpus, conversation, text).filter(
        (F.col("n_conversations") >= min_conversations) & (F.col("n_chars") >= min_text_length)
    )


def keep_valid_corpora(df, corpus, conversation, text, **limits) -> DataFrame:
    valid = valid_corpora(df, corpus, conversation, text, **limits).select(corpus)
    return df.join(small_side(valid, "corpora"), corpus, "left_semi")


def batches(df: DataFrame, order: Sequence[str | Column], size: int = 10_000, name: str = "batch") -> DataFrame:
    """Number rows in order and cut them into batches of a fixed size, from 0."""
    numbered = number_rows(df, [], order, "_n", label="batches")
    return numbered.withColumn(name, F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def index_parts(line: str) -> Column:
    return F.split(tx.strip(line), INDEX_SEPARATOR)


def malformed_lines(df: DataFrame, line: str, order: Sequence[str] = ()) -> DataFrame:
    """Index lines that do not have three parts, with the number of parts. With
    ``order``, also the line's number from 1."""
    parts = F.size(index_parts(line))
    numbered = number_rows(df, [], order, "line_number", label="index-lines") if order else df
    return numbered.withColumn("n_parts", parts).filter("n_parts <> 3")


def remove_entries(lines: DataFrame, line: str, names: DataFrame, name: str) -> DataFrame:
    """Drop index lines whose first field is one of the names."""
    first = F.split(F.col(line), INDEX_SEPARATOR)[0]
    gone = small_side(names.select(F.col(name).alias("_entry")).distinct(), "entries")
    return lines.withColumn("_entry", first).join(gone, "_entry", "left_anti").drop("_entry")
