"""Dialogue transcripts: speaker blocks and question-answer pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import text as tx
from gistmill.operators.running import number_rows

_MARK = r"(?md)^>> (USER|ASSISTANT):"


def transcript_blocks(df: DataFrame, keys: Sequence[str], text: str = "value") -> DataFrame:
    """``(keys, block, role, text)`` from whole transcripts.

    A block counts only when the next marker belongs to the other speaker, or
    when it is the last one. Text before the first marker is dropped.
    """
    marked = F.regexp_replace(F.regexp_replace(F.col(text), "\u0002", ""), _MARK, "\u0002$1:")
    blocks = F.slice(F.split(marked, "\u0002"), 2, F.greatest(F.size(F.split(marked, "\u0002")) - 1, F.lit(0)))
    role = lambda b: F.lower(F.substring_index(b, ":", 1))
    parsed = F.transform(
        F.col("_blocks"),
        lambda b, i: F.struct(
            i.alias("block"),
            role(b).alias("role"),
            tx.strip(F.substr(b, F.length(role(b)) + 2)).alias("text"),
            F.coalesce(role(F.get(F.col("_blocks"), i + 1)) != role(b), F.lit(True)).alias("kept"),
        ),
    )
    return (
        df.select(*keys, blocks.alias("_blocks"))
        .select(*keys, F.inline(parsed))
        .filter("kept")
        .drop("kept")
    )


def pair_turns(
    turns: DataFrame,
    conversation: str,
    order: Sequence[str | Column],
    role: str = "role",
    text: str = "text",
    question: str = "user",
    answer: str = "assistant",
) -> DataFrame:
    """Pair the n-th question of a conversation with its n-th answer; extra
    turns of either side are dropped."""
    turns = turns.filter(F.col(role).isin(question, answer))
    numbered = number_rows(turns, [conversation, role], order, "n", "turns")
    questions = numbered.filter(F.col(role) == question).select(conversation, "n", F.col(text).alias("question_text"))
    answers = numbered.filter(F.col(role) == answer).select(conversation, "n", F.col(text).alias("answer_text"))
    return questions.join(answers, [conversation, "n"])


def number_responses(pairs: DataFrame, conversation: str, start: int = 0, name: str = "res_id") -> DataFrame:
    """Number pairs over all conversations, going on after ``start``."""
    numbered = number_rows(pairs, [], [conversation, "n"], name, label="responses")
    return numbered.withColumn(name, F.col(name) + F.lit(start))


def prune_answers(pairs: DataFrame, text: str = "answer_text") -> DataFrame:
    """Remove fenced code, then heading lines."""
    return pairs.withColumn(text, tx.prune_titles(tx.prune_code(text)))
