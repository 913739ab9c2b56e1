"""Extractive summaries of large conversation and review corpora on Spark."""

from gistmill.plans.corpus import build_corpus, clean_corpus, import_transcripts
from gistmill.plans.summarize import (
    number_groups,
    paragraphs,
    prepare,
    shorten_extract,
    shorten_text,
    summarize,
    summarize_sentences,
    two_candidates,
)

__all__ = [
    "build_corpus",
    "clean_corpus",
    "import_transcripts",
    "number_groups",
    "paragraphs",
    "prepare",
    "shorten_extract",
    "shorten_text",
    "summarize",
    "summarize_sentences",
    "two_candidates",
]
