"""English suffix stripping (Porter 1980 with the usual library extensions).

The algorithm runs on the distinct words of an Arrow batch, never on every
token: batches are dictionary-encoded first and the results are gathered back.
"""

from __future__ import annotations

from functools import lru_cache

VOWELS = frozenset("aeiou")

# Irregular forms and the stem each one takes.
IRREGULAR = {
    "sky": "sky", "skies": "sky",
    "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news",
    "inning": "inning", "innings": "inning",
    "outing": "outing", "outings": "outing",
    "canning": "canning", "cannings": "canning",
    "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffix and replacement, by step of the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance",
    "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
    "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
STEP_4 = {
    suffix: ""
    for suffix in (
        "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti "
        "ous ive ize"
    ).split()
}


def _shape(word: str) -> str:
    """One letter per character: ``v`` for a vowel, ``c`` for a consonant."""
    shape = []
    for ch in word:
        if ch in VOWELS or (ch == "y" and shape and shape[-1] == "c"):
            shape.append("v")
        else:
            shape.append("c")
    return "".join(shape)


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _ends_short(word: str) -> bool:
    """Consonant-vowel-consonant end (last not w, x, y), or a two-letter vc word."""
    shape = _shape(word)
    if len(word) == 2:
        return shape == "vc"
    return shape.endswith("cvc") and word[-1] not in "wxy"


def _longest_suffix(word: str, table: dict[str, str]) -> str | None:
    for size in range(min(len(word), 7), 1, -1):
        if word[-size:] in table:
            return word[-size:]
    return None


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past_or_progressive(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if "v" not in _shape(base):
                return word
            break
    else:
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c":
        return base if base[-1] in "lsz" else base[:-1]
    if _measure(base) == 1 and _ends_short(base):
        return base + "e"
    return base


def _final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        return word[:-1] + "i"
    return word


def _double_suffix(word: str) -> str:
    suffix = _longest_suffix(word, STEP_2)
    if suffix is None:
        return word
    base = word[: -len(suffix)]
    measured = base + "l" if suffix == "logi" else base
    if _measure(measured) == 0:
        return word
    shorter = base + STEP_2[suffix]
    return _double_suffix(shorter) if suffix == "alli" else shorter


def _swap(word: str, table: dict[str, str], above: int) -> str:
    suffix = _longest_suffix(word, table)
    if suffix is None:
        return word
    base = word[: -len(suffix)]
    if _measure(base) <= above or (suffix == "ion" and not base.endswith(("s", "t"))):
        return word
    return base + table[suffix]


def _final_e_and_l(word: str) -> str:
    if word.endswith("e"):
        base = word[:-1]
        size = _measure(base)
        if size > 1 or (size == 1 and not _ends_short(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of one word, lower-cased."""
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _final_y(_past_or_progressive(_plural(word)))
    word = _swap(_double_suffix(word), STEP_3, 0)
    return _final_e_and_l(_swap(word, STEP_4, 1))


def stem_lists(words, normalize=stem):
    """Stem every word of an Arrow ``list<string>`` array."""
    import numpy as np
    import pyarrow as pa

    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    encoded = words.flatten().dictionary_encode()
    stems = pa.array([normalize(w) for w in encoded.dictionary.to_pylist()], pa.string())
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), stems.take(encoded.indices))
