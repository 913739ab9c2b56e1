"""Removal of word runs that repeat, by FM-indexes over content-routed shards.

A window of consecutive words repeats if the same words start anywhere else. Each
window is filed under its anchor, the k-gram of smallest hash inside it, so equal
windows have equal anchors. Consecutive windows with one anchor make a segment.
Segments whose anchor is found once can't repeat; equal segments repeat whole;
what is left, different segments of one anchor, goes by anchor to shards. A shard
has a compressed FM-index of its segments (a wavelet matrix over the
Burrows-Wheeler transform of 4-bit word symbols), in which backward search finds
the windows that occur more than once; their word hashes confirm it. An anchor whose
segments are more than a shard has no index: its windows are counted by word hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.llm.words import PLACE, bundles, mix, powers, ranges, ready, unused, word_slices
from gistmill.session import join_hot, stage

GRAM = 8
SHARD_SYMBOLS = 1_500_000
_PLACE_BITS = np.uint64(28)


def _sequence_hashes(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of runs of words."""
    up, down = powers(len(hashes))
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[starts + sizes] - total[starts]) * down[starts] + sizes.astype(np.uint64))


def segments(hashes: np.ndarray, words: np.ndarray, width: int):
    """(row, anchor, start, size, offset) of the segments of rows of word hashes.

    ``words`` are the rows' offsets; start counts from the slice's first word and
    offset is where the anchor is in the segment.
    """
    n, span = len(hashes), width - GRAM + 1
    if n < width:
        return [np.zeros(0, np.int64)] * 5
    grams = np.zeros(n - GRAM + 1, dtype=np.uint64)
    for j in range(GRAM):
        grams += hashes[j : n - GRAM + 1 + j] * PLACE[j]
    grams = mix(grams)
    # The smallest hash, and of equal ones the leftmost.
    low = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    place = (low & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    counts = np.maximum(np.diff(words) - width + 1, 0)
    windows = ranges(words[:-1][counts > 0], counts[counts > 0])
    row = np.repeat(np.arange(len(counts)), counts)
    own = place[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    start, size = windows[first], windows[last] - windows[first] + width
    return row[first], grams[own[first]], start, size, own[first] - start


def _anchors(width: int):
    """Arrow function: (row, text) to one row per segment."""

    def run(batches):
        for batch in batches:
            keys = batch.column("row").to_numpy()
            for part in word_slices(batch.column("text")):
                hashes = part.hashes(lower=False)
                row, anchor, start, size, offset = segments(hashes, part.words, width)
                if len(row):
                    whole = mix(_sequence_hashes(hashes, start, size) + offset.astype(np.uint64))
                    columns = [anchor.view(np.int64), whole.view(np.int64), keys[part.first + row], (start - part.words[row]).astype(np.int32), size.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "segment", "row", "start", "size"])

    return run


def _contents(batches):
    """Arrow function: (copy, text, wanted) to (anchor, segment, size, times, words),
    words being the hashes of a segment's words."""
    for batch in batches:
        wanted = batch.column("wanted")
        offsets = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
        flat = wanted.flatten()
        start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
        for part in word_slices(batch.column("text")):
            hashes = (part.hashes(lower=False) >> np.uint64(16)).astype(np.uint64)
            a, b = offsets[part.first], offsets[part.first + part.size]
            if a == b:
                continue
            row = np.repeat(np.arange(part.size), np.diff(offsets[part.first : part.first + part.size + 1]))
            at = ranges(part.words[row] + start[a:b], size[a:b].astype(np.int64))
            data = hashes[at].tobytes()
            ends = np.concatenate([[0], np.cumsum(size[a:b].astype(np.int64) * 8)]).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), int(b - a), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
            own = flat.slice(int(a), int(b - a))
            yield pa.RecordBatch.from_arrays([own.field("anchor"), own.field("segment"), own.field("times"), words], names=["anchor", "segment", "times", "words"])


class Wavelet:
    """A sequence of 4-bit symbols as four rows of bits with counts per 64."""

    def __init__(self, symbols: np.ndarray):
        self.rows = []
        for bit in (3, 2, 1, 0):
            bits = (symbols >> bit) & 1
            padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
            padded[: len(bits)] = bits
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed), dtype=np.int64)
            np.cumsum(np.bitwise_count(packed)[:-1], out=before[1:])
            zeros = len(bits) - int(bits.sum())
            self.rows.append((packed, before, zeros))
            order = np.argsort(bits, kind="stable")
            symbols = symbols[order]

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends among the last row's ``symbol``s."""
        for bit, (packed, before, zeros) in zip((3, 2, 1, 0), self.rows):
            block = at >> 6
            inside = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(packed[block] & inside)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at


class FmIndex:
    """Backward search over a text of symbols 0..15; 0 separates its parts."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        key = text.astype(np.uint64)
        reach = 1
        while reach < 16:
            after = np.zeros(n, dtype=np.uint64)
            after[: n - reach] = key[reach:]
            key = (key << np.uint64(4 * reach)) | after
            reach *= 2
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        while reach < 64:
            after = np.zeros(n, dtype=np.uint64)
            after[: n - reach] = rank[reach:] + np.uint64(1)
            key = (rank << np.uint64(32)) | after
            rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            reach *= 2
        suffixes = np.argsort(rank, kind="stable")
        self.size = n
        self.wavelet = Wavelet(text[suffixes - 1])
        counts = np.bincount(text, minlength=16)
        self.below = np.concatenate([[0], np.cumsum(counts)[:-1]])
        symbols = np.arange(16)
        self.shift = self.below - self.wavelet.place(symbols, np.zeros(16, dtype=np.int64))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.wavelet.place(symbol, at) + self.shift[symbol]

    def repeated(self, text: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
        """Those of the windows of ``width`` symbols before ``ends`` that occur more
        than once: their matching statistic reaches ``width`` twice."""
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.size)
        alive = np.arange(len(ends))
        for back in range(1, width + 1):
            symbol = text[ends[alive] - back]
            low, high = self.step(symbol, low), self.step(symbol, high)
            more = high - low > 1
            low, high, alive = low[more], high[more], alive[more]
        return alive


def _searched(width: int):
    """Arrow function: rows sorted by anchor to (segment, mask): bit i of mask says
    that word i of the segment is in a window that is in another segment too."""

    def shard(segment, words, sizes):
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        at = ranges(starts, sizes)
        text = np.zeros(int((sizes + 1).sum()), dtype=np.uint8)
        text[at] = (words % np.uint64(15)).astype(np.uint8) + 1
        held = np.zeros(len(text), dtype=np.uint64)
        held[at] = words
        counts = sizes - width + 1
        first = ranges(starts, counts)
        found = FmIndex(text).repeated(text, first + width, width)
        # Symbols are four bits of a word, so equal symbols are only candidates.
        exact = _sequence_hashes(mix(held), first[found], np.full(len(found), width))
        _, back, times = np.unique(exact, return_inverse=True, return_counts=True)
        found = found[times[back] > 1] if len(found) else found
        owner = np.repeat(np.arange(len(sizes)), counts)[found]
        offset = (first[found] - starts[owner]).astype(np.uint64)
        mask = np.zeros(len(sizes), dtype=np.uint64)
        np.bitwise_or.at(mask, owner, np.uint64((1 << width) - 1) << offset)
        return segment[mask > 0], mask[mask > 0]

    def run(batches):
        for table in bundles(batches, "anchor", SHARD_SYMBOLS * 8):
            words = table.column("words").combine_chunks() if isinstance(table.column("words"), pa.ChunkedArray) else table.column("words")
            words = words if isinstance(words, pa.Array) else words.chunk(0)
            ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
            data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64)
            found = shard(table.column("segment").to_numpy(), data, np.diff(ends) // 8)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].view(np.int64))], names=["segment", "mask"])

    return run


def _windows(width: int):
    """Arrow function: segments to (window, segment, mask), for each window the hash
    of its words and its bits in the segment."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("words")
            ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
            data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64)
            starts, counts = (ends[:-1] - ends[0]) // 8, np.diff(ends) // 8 - width + 1
            first = ranges(starts, counts)
            owner = np.repeat(np.arange(len(counts)), counts)
            mask = np.uint64((1 << width) - 1) << (first - starts[owner]).astype(np.uint64)
            window = _sequence_hashes(mix(data), first, np.full(len(first), width))
            columns = [window.view(np.int64), batch.column("segment").to_numpy()[owner], mask.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["window", "segment", "mask"])

    return run


def repeated_runs(texts: DataFrame, width: int) -> DataFrame:
    """(row, runs): for each text (row, text), the words in repeated windows as an
    array of (start, mask), with bit i of mask for word start + i."""
    found = stage(texts.mapInArrow(_anchors(width), "anchor long, segment long, row long, start int, size int"), "run-segments")
    often = stage(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "run-anchors")
    shared = stage(join_hot(found, often, ["anchor"], "n").drop("n"), "run-shared")
    kinds = shared.groupBy("anchor", "segment").agg(F.count("*").alias("times"), F.min(F.struct("row", "start", "size")).alias("at"))
    kinds = stage(kinds, "run-kinds")
    whole = kinds.where("times > 1").select("segment", "times", F.expr("shiftleft(1L, at.size) - 1").alias("mask"))
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("at.size").alias("symbols")).where("n > 1")
    mixed = stage(mixed.select("anchor", (F.col("symbols") > SHARD_SYMBOLS).alias("large")), "run-mixed")
    wanted = F.collect_list(F.struct("anchor", "segment", "times", F.col("at.start").alias("start"), F.col("at.size").alias("size")))

    def contents(anchors):
        rows = kinds.join(anchors.select("anchor"), "anchor").groupBy("at.row").agg(wanted.alias("wanted"))
        return texts.join(rows, "row").select("text", "wanted").mapInArrow(_contents, "anchor long, segment long, times long, words binary")

    shards = contents(mixed.where("not large")).repartition("anchor").sortWithinPartitions("anchor", "segment")
    partly = shards.mapInArrow(_searched(width), "segment long, mask long")
    # An anchor of more than a shard would be one task: its windows meet one by one.
    large = mixed.where("large")
    if not large.isEmpty():
        windows = stage(contents(large).mapInArrow(_windows(width), "window long, segment long, mask long"), "run-windows")
        again = stage(windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1"), "run-again")
        partly = partly.unionByName(join_hot(windows, again, ["window"], "n").select("segment", "mask"))
    whole = whole.unionByName(partly.withColumn("times", F.lit(1).cast("long")))
    masks = stage(whole.groupBy("segment").agg(F.bit_or("mask").alias("mask"), F.max("times").alias("times")), "run-masks")
    return join_hot(shared, masks, ["segment"], "times").groupBy("row").agg(F.collect_set(F.struct("start", "mask")).alias("runs"))


def _kept(schema, name: str):
    """Arrow function: rows with runs in column ``name`` to the same with their words left out."""

    def run(batches):
        for batch in batches:
            runs = batch.column(name).fill_null([])
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = runs.flatten()
            start = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
            mask = flat.field("mask").to_numpy(zero_copy_only=False).astype(np.int64)
            texts, many, gone = [], [], []
            for part in word_slices(batch.column("text")):
                count = np.diff(part.words)
                a, b = offsets[part.first], offsets[part.first + part.size]
                row = np.repeat(np.arange(part.size), np.diff(offsets[part.first : part.first + part.size + 1]))
                which, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(mask[a:b]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                covered = np.zeros(len(part.starts), dtype=bool)
                covered[part.words[row[which]] + start[a:b][which] + bit] = True
                owner = part.row_of_word()
                removed = np.bincount(owner[covered], minlength=part.size)
                keep = ~covered
                sizes = (part.ends - part.starts)[keep] + 1
                at = ranges(part.starts[keep], sizes)
                data = part.data[np.minimum(at, max(0, len(part.data) - 1))]
                data[np.cumsum(sizes) - 1] = 0x20
                length = np.bincount(owner[keep], weights=sizes, minlength=part.size).astype(np.int64)
                ends = np.cumsum(length)
                joined = data.tobytes()
                # The blank after the last word of a row goes.
                texts += [joined[e - n : max(e - 1, e - n)].decode() for e, n in zip(ends.tolist(), length.tolist())]
                many.append(count)
                gone.append(removed)
            null = pc.is_null(batch.column("text"))
            text = pc.if_else(null, pa.scalar(None, pa.string()), pa.array(texts, pa.string()))
            added = {"text": text, "n_words": np.concatenate(many) if many else [], "n_removed": np.concatenate(gone) if gone else []}
            columns = [pa.array(added[f.name], pa.int64()) if f.name in ("n_words", "n_removed") else added.get(f.name, None) if f.name == "text" else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return run


def remove_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """``docs`` with every word left out of ``text`` that a repeated window of
    ``width`` words covers, and ``n_words`` (before) and ``n_removed``.

    Words are runs of bytes other than ASCII white space, unchanged; those kept are
    joined by one blank. Windows are judged on the input: also the first place of a
    repeat goes, and repeats inside one text count. A null text stays null with 0
    words. Rows that repeat, with or without doc_id, repeat each other's text.
    Other columns pass through; columns named like the added ones are replaced. Names
    hold no dots, which Arrow functions don't take.
    ``width`` is from 9 to 36: a segment's words must fit in 64 bits.
    """
    if not GRAM < width <= 36:
        raise ValueError("width must be from 9 to 36")
    ready(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed")
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    row, name = unused(docs, "row", "runs")
    runs = repeated_runs(docs.select(key.alias("row"), "text").where("text is not null"), width).toDF(row, name)
    rest = docs.select("*", key.alias(row)).join(runs, row, "left").drop(row)
    schema = T.StructType([*docs.schema, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return rest.mapInArrow(_kept(schema, name), schema)
