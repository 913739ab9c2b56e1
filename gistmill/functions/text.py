"""Column functions on text. Everything here stays inside the JVM except
``stems`` and ``counted``, which are Arrow UDFs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill.functions import stemmer
from gistmill.functions.wordlists import ABBREVIATIONS, PUNCTUATION, STOP_WORDS

# White space as Python's str.split() sees it; the class reads the same in RE2.
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
BREAK = "\u0001"

_CLOSERS = r"[\"')\]]*"
_PLAIN_END = rf"([.!?]+{_CLOSERS}){SPACE}+"
# A lone full stop (not after an abbreviation or a single letter), any run with
# ! or ?, or dots when a capital follows.
_FULL_END = (
    r"((?:\.(?<!\.\.)(?<!\b(?i:" + "|".join([*ABBREVIATIONS, r"\p{L}"]) + r")\.)"
    r"|[!?][.!?]*"
    rf"|\.{{2,}}(?={_CLOSERS}{SPACE}+[\"'(\[]*\p{{Lu}}))"
    rf"{_CLOSERS}){SPACE}+"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def sanitize(c: Column | str) -> Column:
    """Printable characters only; null becomes the empty string. Removed
    characters leave no space behind."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[\p{C}\p{Z}&&[^ ]]", "")


def split_sentences(c: Column | str, rule: str = "full") -> Column:
    """Array of trimmed sentences.

    ``plain`` breaks at every terminator followed by white space; ``full`` also
    knows abbreviations, initials and dots inside a sentence.
    """
    pattern = {"plain": _PLAIN_END, "full": _FULL_END}[rule]
    parts = F.split(F.regexp_replace(_col(c), pattern, "$1" + BREAK), BREAK)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def close_sentence(c: Column | str) -> Column:
    """Append a full stop unless the last character is ASCII punctuation."""
    c = _col(c)
    return F.when(F.right(c, F.lit(1)).rlike(r"\p{Punct}"), c).otherwise(F.concat(c, F.lit(".")))


def strip_punctuation(c: Column | str) -> Column:
    return F.translate(_col(c), PUNCTUATION, "")


def split_words(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), SPACE + "+"), lambda w: w != "")


def count_words(c: Column | str) -> Column:
    return F.size(split_words(c))


def drop_stop_words(words: Column | str, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    stop = list(stop_words)
    return F.filter(_col(words), lambda w: ~w.isin(stop)) if stop else _col(words)


def stems(words: Column | str) -> Column:
    """Stem each word of an array."""

    @F.arrow_udf("array<string>")
    def run(batch):
        return stemmer.stem_lists(batch)

    return run(_col(words))


def counted(words: Column | str) -> Column:
    """Distinct words of an array, in order of first occurrence, with place and count:
    ``array<struct<first, term, tf>>``. A batch of arrays is sorted as numbers."""

    @F.arrow_udf("array<struct<first:int,term:string,tf:int>>")
    def run(lists):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")
        flat = lists.flatten()
        coded = flat.dictionary_encode(null_encoding="encode")
        row = np.repeat(np.arange(len(sizes)), sizes)
        pair = row * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
        _, first, times = np.unique(pair, return_index=True, return_counts=True)
        order = np.argsort(first)
        first, times = first[order], times[order]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(sizes)))])
        made = pa.StructArray.from_arrays(
            [pa.array((first - starts[row[first]]).astype("int32")), flat.take(pa.array(first)).cast(pa.string()), pa.array(times.astype("int32"))],
            names=["first", "term", "tf"],
        )
        return pa.ListArray.from_arrays(pa.array(ends.astype("int32")), made)

    return run(_col(words))


def lowered(words: Column | str) -> Column:
    return F.transform(_col(words), F.lower)


def topic_words(c: Column | str, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Punctuation-free lower-case words of 2 to 15 letters without stop words."""
    found = F.regexp_extract_all(F.lower(strip_punctuation(c)), F.lit(r"\p{L}+"), F.lit(0))
    return drop_stop_words(F.filter(found, lambda w: F.length(w).between(2, 15)), stop_words)


def prune_code(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?s)```.*?```", "")


def prune_titles(c: Column | str) -> Column:
    """Remove heading lines of three or more ``#``. Leading white space may
    reach over blank lines, as in the pattern's origin."""
    return F.regexp_replace(_col(c), rf"(?md)^{SPACE}*#{{3,}}.*$", "")


def bold_runs(c: Column | str, drop_unbalanced: bool = False) -> Column:
    """``array<struct<text, bold>>``: odd pieces between ``**`` marks are bold.

    A mark without a partner opens no bold run: its text stays plain with the
    mark in front, or is dropped with ``drop_unbalanced``.
    """
    pieces = F.split(_col(c), r"\*\*")
    count = F.size(pieces)
    whole = F.slice(pieces, 1, F.when(count % 2 == 0, count - 2).otherwise(count - 1))
    runs = F.transform(
        whole, lambda text, i: F.struct(text.alias("text"), (i % 2 == 1).alias("bold"))
    )
    last = F.element_at(pieces, -1)
    if drop_unbalanced:
        tail = F.when(count % 2 == 0, F.element_at(pieces, -2)).otherwise(last)
    else:
        tail = F.when(
            count % 2 == 0, F.concat(F.element_at(pieces, -2), F.lit("**"), last)
        ).otherwise(last)
    tail = F.struct(tail.alias("text"), F.lit(False).alias("bold"))
    return F.filter(F.concat(runs, F.array(tail)), lambda r: (r["text"] != "") | r["bold"])


_TREE_DEPTH = 200


def _word_tree(words: list[str], depth: int = 0) -> str:
    """Alternation of literal words, factored by first letter at the first levels."""
    if "" in words:
        return ""
    if len(words) == 1 or depth == _TREE_DEPTH:
        branches = ["".join(map(_quoted, word)) for word in words]
    else:
        heads: dict[str, list[str]] = {}
        for word in words:
            heads.setdefault(word[0], []).append(word[1:])
        branches = [_quoted(head) + _word_tree(rest, depth + 1) for head, rest in sorted(heads.items())]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def _quoted(ch: str) -> str:
    return ch if ch.isalnum() else "\\" + ch if ord(ch) < 128 else f"\\x{{{ord(ch):x}}}"


def contains_any(c: Column | str, words: Iterable[str], lower: bool = True) -> Column:
    """True where the (lower-cased) text holds any word as a substring. Empty
    words are no words."""
    wanted = {w for w in words if w}
    c = F.coalesce(_col(c), F.lit(""))
    if not wanted:
        return F.lit(False)
    return (F.lower(c) if lower else c).rlike(_word_tree(sorted(wanted)))
