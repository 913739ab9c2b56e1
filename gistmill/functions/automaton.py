"""Whether texts hold any word of a long list, by one automaton over all words."""

from __future__ import annotations

import uuid

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, words: Broadcast) -> ahocorasick.Automaton:
    """Built once in a Python worker; an earlier list's makes room."""
    if name not in _built:
        heads = words.value if isinstance(words.value, dict) else None
        found = ahocorasick.Automaton(ahocorasick.STORE_ANY if heads else ahocorasick.STORE_LENGTH)
        for word in words.value:
            found.add_word(word, *([(len(word), *heads[word])] if heads else []))
        found.make_automaton()
        _built.clear()
        _built[name] = found
    return _built[name]


def holds_any(c: Column, words: Broadcast) -> Column:
    """True where a text holds one of the broadcast words (none of them empty) as a
    substring; null holds none. One pass over a text, whatever the number of words,
    that ends at the first word found."""

    name = uuid.uuid4().hex

    @F.arrow_udf("boolean")
    def run(texts):
        import pyarrow as pa

        scan = _automaton(name, words).iter
        return pa.array([x is not None and next(scan(x), None) is not None for x in texts.to_pylist()], pa.bool_())

    return run(c)


def starts_any(c: Column, heads: Broadcast) -> Column:
    """``whole``: does a text hold a head that is a word by itself? If not, ``pieces``:
    what the text holds where a head is found, at the lengths of the longer words that
    begin so, each piece once. ``heads``: head to whether it is a word, and lengths."""

    name = uuid.uuid4().hex

    def pieces(text, scan):
        found = set()
        for end, (size, word, lengths) in scan(text):
            if word:
                return {"whole": True, "pieces": []}
            start = end + 1 - size
            found.update(text[start : start + n] for n in lengths if start + n <= len(text))
        return {"whole": False, "pieces": sorted(found)}

    @F.arrow_udf("whole boolean, pieces array<string>")
    def run(texts):
        import pyarrow as pa

        scan = _automaton(name, heads).iter
        kind = pa.struct([("whole", pa.bool_()), ("pieces", pa.list_(pa.string()))])
        return pa.array([None if x is None else pieces(x, scan) for x in texts.to_pylist()], kind)

    return run(c)
