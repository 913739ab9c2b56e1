"""Whole jobs: building and cleaning the utterance table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.functions import text as tx
from gistmill.operators import clean, transcripts
from gistmill.operators.running import number_rows
from gistmill.session import ship

QUESTION = "DUMMY DATA"  # fixed value: the constant question of every utterance


def number_utterances(df: DataFrame, conversation: Sequence[str], order: Sequence[str], name: str = "res_id") -> DataFrame:
    """Position of an utterance in its conversation, from 1."""
    ship(df.sparkSession)
    return number_rows(df, conversation, order, name, "utterances")


def flatten(df: DataFrame, corpus: str, conversation: str, turn: str, text: str) -> DataFrame:
    """Utterance table of landed conversations, sanitized and numbered."""
    rows = df.select(
        F.col(corpus).cast("string").alias("corpus_name"),
        F.col(conversation).cast("string").alias("conv_id"),
        F.col(turn).alias("_turn"),
        F.lit(QUESTION).alias("question_text"),
        tx.sanitize(text).alias("answer_text"),
    )
    numbered = number_utterances(rows, ["corpus_name", "conv_id"], ["_turn"])
    return numbered.select("corpus_name", "conv_id", F.col("res_id").cast("int").alias("res_id"), "question_text", "answer_text")


def build_corpus(df: DataFrame, corpus: str, conversation: str, turn: str, text: str, **limits) -> DataFrame:
    """Keep corpora with enough text, then flatten them."""
    return flatten(clean.keep_valid_corpora(df, corpus, conversation, text, **limits), corpus, conversation, turn, text)


def clean_corpus(utterances: DataFrame, words: Iterable[str] | DataFrame, na_tokens: Sequence[str] = ()) -> DataFrame:
    """Drop blank rows, then whole conversations with a listed word."""
    present = clean.drop_blank(utterances, "answer_text", na_tokens)
    return clean.drop_profane_conversations(present, "answer_text", words)


def import_transcripts(files: DataFrame, conversation: str, text: str = "value", start: int = 0) -> DataFrame:
    """Question-answer table of transcript files: pruned answers, numbered on
    from ``start`` over all conversations."""
    ship(files.sparkSession)
    blocks = transcripts.transcript_blocks(files, [conversation], text)
    pairs = transcripts.prune_answers(transcripts.pair_turns(blocks, conversation, ["block"]))
    numbered = transcripts.number_responses(pairs, conversation, start)
    return numbered.select(
        F.col(conversation).cast("string").alias("conv_id"), F.col("res_id").cast("int").alias("res_id"),
        "question_text", "answer_text",
    )
