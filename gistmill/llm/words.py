"""Words and word hashes of Arrow string columns, as numpy arrays.

A word is a run of bytes other than the ASCII white space 0x20 and 0x09-0x0D.
Everything works on slices of a few megabytes of UTF-8, so memory stays bounded
whatever an Arrow batch holds; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gistmill.session import ship

#: Rows of whole texts in one Arrow batch, where the session has Spark's default.
BATCH_ROWS = 1000
SLICE_BYTES = 700_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
#: Factors that make the hash of a word sequence depend on its order.
PLACE = mix(np.arange(1001, 1001 + 64, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size + 1, _BASE, dtype=np.uint64)
    down = np.full(size + 1, _BASE_INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(SLICE_BYTES, 1 << int(size).bit_length()))


def ready(spark: SparkSession) -> SparkSession:
    """Ship the package, and let batches of whole texts be smaller than Spark's
    default of 10,000 rows, as they are held by the executor and by Python."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship(spark)


@dataclass
class Slice:
    """Consecutive texts: their bytes, and where rows and words begin and end."""

    first: int  # row of the column that the slice starts with
    data: np.ndarray  # uint8
    rows: np.ndarray  # byte offset of each row, and of the end
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    words: np.ndarray  # number of the first word of each row, and of the end

    @property
    def size(self) -> int:
        return len(self.rows) - 1

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; by default of the word with A-Z lower-cased."""
        return span_hashes(LOWER[self.data] if lower else self.data, self.starts, self.ends)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.size), np.diff(self.words))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of ``df`` has."""
    held = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        found.append(name)
    return found


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def row_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row offsets, bytes) of runs of whole rows of about ``limit`` bytes."""
    offsets, data = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, rows)
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last
    # What Arrow keeps for later use counts as an executor's memory.
    pa.default_memory_pool().release_unused()


def word_slices(column: pa.Array, limit: int = SLICE_BYTES, outside: np.ndarray = SPACE) -> Iterator[Slice]:
    """``outside`` says of each byte whether it separates words."""
    for first, rows, data in row_slices(column, limit):
        n = len(data)
        inside = ~outside[data]
        border = np.zeros(n + 1, dtype=bool)
        border[rows] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | border[:n]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | border[1:])) + 1
        yield Slice(first, data, rows, starts, ends, np.searchsorted(starts, rows))


def shingles(part: Slice, hashes: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, row by row, and the offset of each row.

    A row of fewer than k words has its whole sequence as its one shingle, and
    a row without words none.
    """
    counts = np.diff(part.words)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    total = len(hashes)
    out = np.empty(int(offsets[-1]), dtype=np.uint64)
    if total >= k:
        every = np.zeros(total - k + 1, dtype=np.uint64)
        for j in range(k):
            every += hashes[j : total - k + 1 + j] * PLACE[j]
        long = counts >= k
        at = np.repeat(part.words[:-1][long] - offsets[:-1][long], n[long]) + ranges(offsets[:-1][long], n[long])
        out[ranges(offsets[:-1][long], n[long])] = mix(every[at])
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashes[part.words[row] : part.words[row + 1]]
        out[offsets[row] : offsets[row] + 1] = mix(np.array([(own * PLACE[: len(own)]).sum(), len(own)], np.uint64).sum(keepdims=True))
    return out, offsets


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + size."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1])) + np.repeat(starts - (ends - sizes), sizes)


def shingle_sets(column: pa.Array, k: int = 5, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) of each slice."""
    for part in word_slices(column, limit):
        values, offsets = shingles(part, part.hashes(), k)
        sets = []
        for i in range(part.size):
            own = np.sort(values[offsets[i] : offsets[i + 1]])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            sets.append(own)
        yield part.first, sets


def bundles(batches: Iterable[pa.RecordBatch], key: str, limit: int = 4_000_000) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by ``key``: at least one group
    each, and more up to about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) < limit:
            continue
        table = pa.Table.from_batches(held)
        values = table.column(key).to_numpy()
        cut = int((values != values[-1]).sum())
        if cut:
            yield from _groups_up_to(table.slice(0, cut), key, limit)
            held = table.slice(cut).to_batches()
    if held:
        yield from _groups_up_to(pa.Table.from_batches(held), key, limit)


def _groups_up_to(table: pa.Table, key: str, limit: int) -> Iterator[pa.Table]:
    values = table.column(key).to_numpy()
    borders = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    row_bytes = max(1, table.nbytes // max(1, len(values)))
    first = 0
    while first < len(borders) - 1:
        last = max(first + 1, int(np.searchsorted(borders, borders[first] + limit // row_bytes, side="right")) - 1)
        yield table.slice(int(borders[first]), int(borders[last] - borders[first])).combine_chunks()
        first = last
