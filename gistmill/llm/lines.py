"""Fuzzy line deduplication.

Lines are normalised (lower case, runs of letters and digits joined by one
blank). Two are near by edit similarity: in words if the longer one has enough words
for an edit (ten, at 0.9), else in characters. Near lines share a key: one of the
first word trigrams in a fixed order (an edit changes three, so of k edits more than
3k can't change all), or, of short lines, an unchanged piece at about its place.
So joining on keys finds all of them; the distance decides, and of each connected
group the first occurrence in (doc_id, line) order stays. Lines of very few words have
no keys and are grouped by equal words alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.groups import components
from gistmill.llm.words import LOWER, PLACE, Slice, bundles, mix, ranges, ready, row_slices, span_hashes, unused
from gistmill.session import join_hot, stage

CHUNK = 1024
#: Keys of so many lines at most are compared together, larger ones by themselves.
FEW = 64
GRAM = 3
#: Short lines of so many characters have pieces as keys, longer ones all 8-grams:
#: from 72 on, edits to a tenth of the characters can't change all of them.
PIECED = 72
SEEN = 200_000
#: Pairs of lines held at a time, cells of the tables that compare them, and the most
#: edits for which pairs are compared together; further ones one by one.
PAIRS = 400_000
CELLS = 1_000_000
EDITS = 12
#: Classes of words, or of characters, that are counted per line.
BINS = 32

#: Bytes outside words of a normalised line: ASCII that is no letter or digit.
OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _lines(column: pa.Array):
    """Slices whose rows are lines, with the text row and line number of each."""
    for first, rows, data in row_slices(column):
        data = LOWER[data]
        breaks = np.flatnonzero(data == 0x0A) + 1
        # A line begins with each row, and after each line feed of the row.
        begins = np.concatenate([rows[:-1], breaks])
        owner = np.concatenate([np.arange(len(rows) - 1), np.searchsorted(rows, breaks - 1, side="right") - 1])
        order = np.lexsort((begins, owner))
        begins, owner = begins[order], owner[order]
        number = np.arange(len(begins)) - np.searchsorted(owner, owner)
        borders = np.concatenate([begins, [len(data)]])
        inside = ~OUTSIDE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[borders] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        yield Slice(first, data, borders, starts, ends, np.searchsorted(starts, borders)), first + owner, number


def _line_hashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each run of word hashes, given the runs' lengths (none of 0)."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], counts)
    return mix(np.add.reduceat(mix(hashes + mix(place)), offsets[:-1]) + counts.astype(np.uint64))


def fingerprints(batches):
    """Arrow function: (doc_id, row, text) to one row per line that has a word."""
    for batch in batches:
        ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
        for part, owner, number in _lines(batch.column("text")):
            hashes = span_hashes(part.data, part.starts, part.ends)
            counts = np.diff(part.words)
            keep = np.flatnonzero(counts)
            if not len(keep):
                continue
            line = _line_hashes(hashes, counts[keep])
            at = owner[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(line.view(np.int64)), pa.array(ids[at], pa.int64()), pa.array(rows[at], pa.int64()), pa.array(number[keep].astype(np.int32))],
                names=["line", "doc_id", "row", "pos"],
            )


def edits(n, least: float):
    """The most edits between something of length ``n`` and a longer one near it."""
    return np.floor(n * ((1 - least) / least) + 1e-9).astype(np.int64)


def word_limit(least: float) -> int:
    """From so many words of the longer line on, near is measured in words."""
    return int(np.ceil(1 / (1 - least) - 1e-9))


def _parity(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits of each run of hashes: whether an odd number of them falls on the bit.
    An edit of one changes two bits at most."""
    return np.bitwise_xor.reduceat(np.uint64(1) << (values >> np.uint64(58)), offsets)


def _gram_keys(hashes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, least: float):
    """(run, key) of runs of words, given their hashes, sizes in bytes and how many
    each run has: the first trigrams, of which near runs share one. Those of long
    words come first, since they are rarer; any fixed order would do."""
    grams, length = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.int64)
    for j in range(GRAM):
        grams[: len(grams) - j] += hashes[j:] * PLACE[j]
        length[: len(length) - j] += sizes[j:]
    many = counts - GRAM + 1
    at = ranges(np.cumsum(counts) - counts, many)
    rank = np.uint64(127) - np.minimum(length[at], 127).astype(np.uint64)
    key = np.uint64(1 << 63) | rank << np.uint64(56) | mix(grams[at]) >> np.uint64(8)
    run = np.repeat(np.arange(len(counts)), many)
    order = np.lexsort((key, run))
    run, key = run[order], key[order]
    first = np.cumsum(many) - many
    kept = np.arange(len(run)) - first[run] <= GRAM * edits(counts, least)[run]
    kept[1:] &= (key[1:] != key[:-1]) | (run[1:] != run[:-1])
    return run[kept], key[kept]


def piece_keys(text: str, least: float) -> set[int]:
    """Keys of a short line, of which lines with near characters share one.

    A line is cut in one piece more than it may have edits, so one piece is
    unchanged in a near line. The longer line looks for it where as many edits
    before and after it as there are pieces could have moved it.
    """
    size = len(text)
    found = set()
    for own in range(size - int((1 - least) * size + 1e-9), min(size + 1, PIECED)):
        most = int(edits(own, least))
        if not most:
            continue
        cuts, more = [own * i // (most + 1) for i in range(most + 2)], size - own
        for i in range(most + 1):
            long = cuts[i + 1] - cuts[i]
            low = max(0, cuts[i] - i, cuts[i] + more - (most - i))
            high = min(size - long, cuts[i] + i, cuts[i] + more + (most - i))
            for at in range(low, high + 1):
                found.add((own << 8 | i) << 32 | zlib.crc32(text[at : at + long].encode()))
    if size >= PIECED:
        found |= {1 << 61 | zlib.crc32(text[i : i + 8].encode()) for i in range(size - 7)}
    return found


def keys(min_words: int, least: float):
    """Arrow function: texts to (key, line, n, parity) of lines of enough words. Keys
    below 0 are of trigrams, where n and parity are of words, others of characters."""
    limit = word_limit(least)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part, _, _ in _lines(batch.column("text")):
                counts = np.diff(part.words)
                keep = np.flatnonzero(counts >= min_words)
                if not len(keep):
                    continue
                hashes = span_hashes(part.data, part.starts, part.ends)
                line = _line_hashes(hashes[np.repeat(counts >= min_words, counts)], counts[keep])
                # A line that repeats in this task is not sent again.
                line, at = np.unique(line, return_index=True)
                new = np.array([x not in seen for x in line.tolist()], dtype=bool)
                line, keep = line[new], keep[at[new]]
                seen = set() if len(seen) > SEEN else seen
                seen.update(line.tolist())
                rows = []
                own = counts[keep] >= max(GRAM, limit - 1)
                if own.any():
                    many, begin = counts[keep[own]], part.words[:-1][keep[own]]
                    word = ranges(begin, many)
                    which, key = _gram_keys(hashes[word], (part.ends - part.starts)[word], many, least)
                    parity = _parity(hashes[word], np.cumsum(many) - many)
                    rows.append((key.view(np.int64), line[own][which], many[which], parity[which]))
                for i in np.flatnonzero(counts[keep] < limit).tolist():
                    text = normal(part.data[part.rows[keep[i]] : part.rows[keep[i] + 1]])
                    key = np.fromiter(piece_keys(text, least), np.int64)
                    if len(key):
                        parity = _parity(mix(_codes(text)), np.zeros(1, np.int64))
                        rows.append((key, np.repeat(line[i], len(key)), np.repeat(len(text), len(key)), np.repeat(parity, len(key))))
                if rows:
                    key, own, n, parity = (np.concatenate(x) for x in zip(*rows))
                    columns = [key, own.view(np.int64), n.astype(np.int32), parity.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "line", "n", "parity"])

    return run


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def close(n: np.ndarray, parity: np.ndarray, least: float):
    """(a, all b > a that may be near), for each a that has such b, of rows sorted by
    n: as many edits as the longer one may have can make up for what differs."""
    most = np.floor((1 - least) * n + 1e-9).astype(np.int64)
    ends = np.searchsorted(n - most, n, side="right")
    for first in range(0, len(n), 256):
        last = min(first + 256, len(n))
        end = int(ends[last - 1])
        fit = np.bitwise_count(parity[first:last, None] ^ parity[None, first:end]) <= 2 * most[None, first:end]
        fit &= n[None, first:end] - n[first:last, None] <= most[None, first:end]
        a, b = np.nonzero(fit)
        a, b = a[b > a], b[b > a]
        for own in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1) if len(a) else ():
            yield first + int(a[own[0]]), first + b[own]


def _few_joined(group: np.ndarray, line: np.ndarray, n: np.ndarray, parity: np.ndarray, least: float):
    """(cluster, row) of the rows that may be near another of their group, for many
    small groups at once, by the rule of ``close``; rows are sorted by group and n."""
    most = np.floor((1 - least) * n + 1e-9).astype(np.int64)
    left, right, at = [], [], np.arange(len(n))
    for ahead in range(1, FEW):
        at = at[at + ahead < len(n)]
        at = at[group[at] == group[at + ahead]]
        if not len(at):
            break
        b = at + ahead
        fit = (n[b] - n[at] <= most[b]) & (np.bitwise_count(parity[at] ^ parity[b]) <= 2 * most[b])
        left.append(at[fit])
        right.append(b[fit])
    if not left:
        return line[:0], at
    a, b = np.concatenate(left), np.concatenate(right)
    name = line.copy()
    while len(a):
        least_name = np.minimum(name[a], name[b])
        before = name.copy()
        np.minimum.at(name, a, least_name)
        np.minimum.at(name, b, least_name)
        if (name == before).all():
            break
    kept = np.unique(np.concatenate([a, b]))
    return name[kept], kept


def _once(batches):
    """Rows sorted by ``key``, ``n`` and ``line``, each line of a key once."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, line = (batch.column(x).to_numpy() for x in ("key", "line"))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        new[0] = (key[0], line[0]) != last
        last = key[-1], line[-1]
        yield batch if new.all() else batch.filter(pa.array(new))


def clusters(least: float):
    """Arrow function: rows sorted by ``key``, ``n`` and ``line`` to those (cluster,
    short, line, n, parity) that may be near another of their key. A cluster is
    connected by such pairs and named after its smallest line."""

    def run(batches):
        for table in bundles(_once(batches), "key"):
            key, line, n = (table.column(x).to_numpy() for x in ("key", "line", "n"))
            parity = table.column("parity").to_numpy().view(np.uint64)
            borders = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            sizes = np.diff(borders)
            few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= FEW), sizes))
            name, at = _few_joined(key[few], line[few], n[few], parity[few], least)
            names, members = [name], [few[at]]
            many = np.flatnonzero(sizes > FEW)
            for first, last in zip(borders[many], borders[many + 1]):
                root = None
                for a, near in close(n[first:last], parity[first:last], least):
                    root = np.arange(last - first) if root is None else root
                    others = np.unique(root[near])
                    if len(others) > 1 or others[0] != root[a]:
                        root[np.isin(root, others)] = root[a]
                if root is None:
                    continue
                size = np.bincount(root, minlength=len(root))
                smallest = np.full(len(root), np.iinfo(np.int64).max)
                np.minimum.at(smallest, root, line[first:last])
                kept = np.flatnonzero(size[root] > 1)
                names.append(smallest[root[kept]])
                members.append(first + kept)
            at = np.concatenate(members)
            if len(at):
                columns = [np.concatenate(names), key[at] >= 0, line[at], n[at], table.column("parity").to_numpy()[at]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["cluster", "short", "line", "n", "parity"])

    return run


def edit_distance(a: list[str] | str, b: list[str] | str, most: int) -> int:
    """Levenshtein distance of word lists, or of strings in characters, by bit
    vectors; stops once it must exceed ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = mask, 0, len(a)
    for j, c in enumerate(b):
        match = where.get(c, 0)
        across = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | (mask & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score - (len(b) - j - 1) > most:
            return most + 1
        up = (up << 1) | 1
        plus = (down << 1 | ~((match | minus) | up)) & mask
        minus = up & (match | minus) & mask
    return score


def similar(a: list[str] | str, b: list[str] | str, least: float) -> bool:
    """Edit similarity, 1 - distance / longer length, of at least ``least``."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    return edit_distance(a, b, most) <= most


def normal(data: bytes | np.ndarray) -> str:
    """The words of a line, as ``fingerprints`` sees them, joined by blanks."""
    kept = np.frombuffer(data, dtype=np.uint8)
    kept = np.where(OUTSIDE[LOWER[kept]], np.uint8(0x20), LOWER[kept])
    return " ".join(x for x in kept.tobytes().decode("utf-8", "replace").split(" ") if x)


def _texts(batches):
    """Arrow function: documents with wanted line numbers to (line, words)."""
    for batch in batches:
        names, words = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            own = text.encode().split(b"\n")
            for x in wanted:
                names.append(x["line"])
                words.append(normal(own[x["pos"]]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(words, pa.string())], names=["line", "words"])


def _codes_of(words: pa.Array, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of each line, or of its characters where it is short: all
    one after the other, where each line begins, and how many it has."""
    split = pc.split_pattern(words.filter(pa.array(~short)), " ")
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    letters = words.filter(pa.array(short))
    sizes = np.zeros(len(short), np.int64)
    sizes[~short] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    sizes[short] = pc.utf8_length(letters).to_numpy(zero_copy_only=False)
    starts = np.empty(len(short), np.int64)
    order = np.concatenate([np.flatnonzero(~short), np.flatnonzero(short)])
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    # Words are numbered behind all characters.
    numbers = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32) + 0x110000
    points = np.frombuffer("".join(letters.to_pylist()).encode("utf-32-le"), dtype=np.int32)
    return np.concatenate([numbers, points]), starts, sizes


def _spectra(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of each line's codes fall in each of ``BINS`` classes. An edit moves one."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bins = (mix(codes[ranges(starts, sizes)].astype(np.uint64)) >> np.uint64(32)).astype(np.int64) % BINS
    return np.bincount(owner * BINS + bins, minlength=len(sizes) * BINS).reshape(-1, BINS).astype(np.int32)


def within(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether each pair of lines is at most ``most`` edits apart: for many pairs at
    once, the furthest place that so many edits reach on each diagonal."""
    out = np.zeros(len(a), dtype=bool)
    swap = sizes[a] > sizes[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    rest = np.flatnonzero(sizes[b] - sizes[a] <= most)
    rest = rest[np.lexsort((sizes[a[rest]], most[rest]))]
    while len(rest):
        edits_ = int(most[rest[0]])
        at = rest[: max(1, np.searchsorted(most[rest], edits_, side="right"))]
        size = sizes[a[at]]
        # As many pairs as fit, of which the last has the longest line.
        fit = np.arange(1, len(at) + 1) * (size + 1) * (2 * edits_ + 1) <= CELLS
        at = at[: max(1, int(fit.sum()))]
        rest = rest[len(at):]
        n, m = sizes[a[at]], sizes[b[at]]
        wide = int(n.max())
        column = np.arange(wide)
        left = np.where(column < n[:, None], codes[np.minimum(starts[a[at], None] + column, len(codes) - 1)], -1)
        column = np.arange(-edits_, wide + edits_)
        right = np.where((column >= 0) & (column < m[:, None]), codes[np.clip(starts[b[at], None] + column, 0, len(codes) - 1)], -2)
        # Per diagonal, the next place from each on where the two differ.
        differ = np.empty((2 * edits_ + 1, len(at), wide + 1), dtype=np.int32)
        differ[:, :, wide] = wide
        for d in range(2 * edits_ + 1):
            own = np.where(left == right[:, d : d + wide], wide, np.arange(wide))
            differ[d, :, :wide] = np.minimum.accumulate(own[:, ::-1], axis=1)[:, ::-1]
        shift = np.arange(-edits_, edits_ + 1)[:, None]
        ends = np.minimum(n, m - shift)
        none = -wide - 2 * edits_ - 2
        reach = np.full((2 * edits_ + 3, len(at)), none, dtype=np.int64)
        reach[edits_ + 1] = differ[edits_, :, 0]
        pair = np.arange(len(at))
        for _ in range(edits_):
            next_ = np.maximum(np.maximum(reach[1:-1] + 1, reach[2:] + 1), reach[:-2])
            next_ = np.minimum(next_, ends)
            ok = next_ >= np.maximum(0, -shift)
            reach[1:-1] = np.where(ok, differ[np.arange(2 * edits_ + 1)[:, None], pair, np.clip(next_, 0, wide)], none)
        out[at] = reach[m - n + edits_ + 1, pair] >= n
    return out


def _pairs(group: np.ndarray, n: np.ndarray, parity: np.ndarray, side: np.ndarray, least: float):
    """(a, b) of rows of a group that may be near, in parts: those of all small groups
    together, then those of some rows of a large one. Rows are sorted by group and n.
    Where a group has two sides, rows of one side have met in a group of their own."""
    most = np.floor((1 - least) * n + 1e-9).astype(np.int64)
    borders = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    sizes = np.diff(borders)
    first = np.repeat(borders[:-1], sizes)
    mixed = np.add.reduceat(side != side[first], borders[:-1])[np.repeat(np.arange(len(sizes)), sizes)] > 0
    apart = lambda a, b: ~mixed[a] | (side[a] != side[b])
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= FEW), sizes))
    left, right = [], []
    for ahead in range(1, FEW):
        at = at[at + ahead < len(n)]
        at = at[group[at] == group[at + ahead]]
        if not len(at):
            break
        b = at + ahead
        fit = (n[b] - n[at] <= most[b]) & (np.bitwise_count(parity[at] ^ parity[b]) <= 2 * most[b]) & apart(at, b)
        left.append(at[fit])
        right.append(b[fit])
    if left:
        yield np.concatenate(left), np.concatenate(right)
    for i in np.flatnonzero(sizes > FEW):
        low, high = int(borders[i]), int(borders[i + 1])
        left, right, held = [], [], 0
        for a, b in close(n[low:high], parity[low:high], least):
            b = b[apart(low + a, low + b)]
            left.append(np.full(len(b), low + a))
            right.append(low + b)
            held += len(b)
            if held > PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
        if held:
            yield np.concatenate(left), np.concatenate(right)


def verified(least: float):
    """Arrow function: rows sorted by ``group`` and ``n`` to links that join them, by
    edit similarity. Joined pairs are not compared again."""

    def run(batches):
        for table in bundles(batches, "group"):
            group, line, n, side = (table.column(x).to_numpy() for x in ("group", "line", "n", "side"))
            parity = table.column("parity").to_numpy().view(np.uint64)
            short = table.column("short").to_numpy().astype(bool)
            words = table.column("words").combine_chunks()
            codes, starts, sizes = _codes_of(words, short)
            spectra = _spectra(codes, starts, sizes)
            parent = list(range(len(n)))

            def top(x):
                while parent[x] != x:  # noqa: B023
                    parent[x] = x = parent[parent[x]]  # noqa: B023
                return x

            left, right = [], []
            for a, b in _pairs(group, n, parity, side, least):
                most = np.floor((1 - least) * np.maximum(sizes[a], sizes[b]) + 1e-9).astype(np.int64)
                # Of the classes of codes, too many may differ for so few edits.
                may = np.empty(len(a), dtype=bool)
                for first in range(0, len(a), PAIRS // 8):
                    part = slice(first, first + PAIRS // 8)
                    may[part] = np.abs(spectra[a[part]] - spectra[b[part]]).sum(axis=1) + np.abs(sizes[a[part]] - sizes[b[part]]) <= 2 * most[part]
                order = np.flatnonzero(may)
                order = order[np.lexsort((a[order], b[order]))]
                a, b, most, tried = a[order], b[order], most[order], 1
                while len(a):
                    # Of each row the next few; twice as many each time.
                    nth = np.arange(len(b)) - np.searchsorted(b, b)
                    now = nth < tried
                    x, y, limit = a[now], b[now], most[now]
                    long = limit > EDITS
                    near = np.zeros(len(x), dtype=bool)
                    near[~long] = within(codes, starts, sizes, x[~long], y[~long], limit[~long])
                    for i in np.flatnonzero(long).tolist():
                        p, q = words[int(x[i])].as_py(), words[int(y[i])].as_py()
                        near[i] = similar(p, q, least) if short[x[i]] else similar(p.split(" "), q.split(" "), least)
                    for p, q in zip(x[near].tolist(), y[near].tolist()):
                        own, other = top(p), top(q)
                        if own != other:
                            parent[own] = other
                            left.append(line[p])
                            right.append(line[q])
                    root = np.array(parent)
                    while (root[root] != root).any():
                        root = root[root]
                    rest = ~now & (root[a] != root[b])
                    a, b, most, tried = a[rest], b[rest], most[rest], 2 * tried
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def repeated_lines(docs: DataFrame, min_words: int = 3, least: float = 0.9) -> DataFrame:
    """(doc_id, row, removed): the numbers of the lines, from 0, that repeat an
    earlier one of their group, for each document that has such lines; ``row`` is
    the hash of its text."""
    if not 0.9 <= least < 1:
        raise ValueError("least must be from 0.9 to below 1")
    spark = ready(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text").where("doc_id is not null and text is not null")
    lines = stage(texts.mapInArrow(fingerprints, "line long, doc_id long, row long, pos int"), "lines")
    kinds = stage(lines.groupBy("line").agg(F.min(F.struct("doc_id", "row", "pos")).alias("at"), F.count("*").alias("times")), "line-kinds")
    keyed = texts.select("text").mapInArrow(keys(min_words, least), "key long, line long, n int, parity long")
    keyed = keyed.repartition("key").sortWithinPartitions("key", "n", "line")
    found = stage(keyed.mapInArrow(clusters(least), "cluster long, short boolean, line long, n int, parity long").distinct(), "line-clusters")
    # The words of lines that have a candidate, read once from their first place.
    places = found.select("line").distinct().join(kinds, "line").groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.row").alias("row"))
    wanted = places.agg(F.collect_list(F.struct("line", F.col("at.pos").alias("pos"))).alias("wanted"))
    words = texts.join(wanted, ["doc_id", "row"]).mapInArrow(_texts, "line long, words string")
    # A large cluster is compared chunk by chunk, each pair of chunks in one group.
    sizes = found.groupBy("cluster", "short").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("line"), F.col("chunks")).cast("int")
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    group = F.xxhash64("cluster", "short", F.least("_own", "_other"), F.greatest("_own", "_other"))
    rows = (
        found.join(sizes, ["cluster", "short"])
        .join(words, "line")
        .withColumn("_own", own)
        .withColumn("_other", F.explode(others))
        .select(group.alias("group"), F.col("_own").alias("side"), "short", "line", "n", "parity", "words")
        .repartition("group")
        .sortWithinPartitions("group", "n", "line")
    )
    links = rows.mapInArrow(verified(least), "a long, b long")
    groups = components(links, "line-links")
    kept = kinds.join(groups.withColumnRenamed("node", "line"), "line", "left").withColumn("component", F.coalesce("component", "line"))
    first = kept.groupBy("component").agg(F.min("at").alias("first"), F.sum("times").alias("times")).where("times > 1")
    repeats = stage(kept.select("line", "times", "component").join(first.select("component", "first"), "component").select("line", "times", "first"), "line-repeats")
    gone = join_hot(lines, repeats, ["line"], "times").where("struct(doc_id, row, pos) <> first").select("doc_id", "row", "pos")
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = 3, least: float = 0.9) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines`` (before)
    and ``n_removed``. ``n_chars``, if there is one, becomes the new length.

    A line goes if an earlier one is near it, or is joined to it by near ones: edit
    similarity of at least ``least`` (0.9 to below 1), in words where the longer line
    has 1 / (1 - least) or more, else in characters.

    Lines end at line feeds. Those of fewer than ``min_words`` words (runs of
    letters and digits) go only if an earlier one has the same words, and those
    without words stay. A null text stays null with
    0 lines, an empty one has one empty line; a row without doc_id stays as it
    is. Rows that share a doc_id come in the order of a hash of their texts; equal
    rows are one document and lose the same lines. Other columns pass through; those
    named like the added ones are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    row, own, removed = unused(docs, "row", "own", "removed")
    repeated = repeated_lines(docs, min_words, least).toDF(own, row, removed)
    match = (F.col("doc_id") == F.col(own)) & (F.xxhash64("text") == F.col(row))
    rest = docs.join(repeated, match, "left").drop(own, row)
    lines = F.split("text", "\n", -1)
    gone = F.coalesce(F.size(removed), F.lit(0))
    text = F.when(gone > 0, F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(removed, i)), "\n")).otherwise(F.col("text"))
    counts = {
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1),
        "n_removed": F.greatest(gone, F.lit(0)),
    }
    out = rest.select("*", *[c.cast("int").alias(n) for n, c in counts.items()]).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), "n_lines", "n_removed")
