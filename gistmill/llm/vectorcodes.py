"""Vector codes: each part of a vector by the number of its nearest codebook entry.

Vectors become whole numbers once and are kept in blocks, each dimension as a
dictionary of its distinct values and the values' numbers in it. In a round the
squared differences of every distinct value to all entries are tabulated, so the
distances of all parts are gathers from these tables and additions.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.words import ready
from gistmill.session import join_hot, stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Numbers in one block.
BLOCK_CELLS = 1 << 19


def steps(values: np.ndarray, dims: int) -> np.ndarray:
    """floor(4096 x) as whole numbers. Where a squared distance would not fit 64
    bits (beyond 32,768 for 64 dimensions), the largest that does stands in."""
    most = math.isqrt((1 << 62) // max(1, dims)) // 2
    return np.clip(np.floor(np.asarray(values, dtype=np.float64) * SCALE), -most, most).astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` whole numbers; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = steps(column.flatten().to_numpy(zero_copy_only=False), dims)
    return out


def _blocks(dims: int):
    """Arrow function: (vec_id, label, embedding) to blocks of dictionary codes."""
    rows = max(1, min(1 << 16, BLOCK_CELLS // dims))

    def block(table: pa.Table):
        numbers = _matrix(table.column("embedding"), dims)
        values, codes = [], []
        for d in range(dims):
            own, code = np.unique(numbers[:, d], return_inverse=True)
            values.append(own)
            codes.append(code.astype(np.uint16))
        column = lambda name: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column(name).combine_chunks())
        sizes = pa.array(np.cumsum([0, *map(len, values)]).astype(np.int32))
        per_dim = pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(values)))
        return pa.RecordBatch.from_arrays(
            [column("vec_id"), column("label"), pa.ListArray.from_arrays(pa.array([0, dims], pa.int32()), per_dim), pa.array([np.concatenate(codes).tobytes()], pa.binary())],
            names=["ids", "labels", "dictionary", "codes"],
        )

    def run(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= rows:
                table = pa.Table.from_batches(held)
                while len(table) >= rows:
                    yield block(table.slice(0, rows).combine_chunks())
                    table = table.slice(rows)
                held, count = table.to_batches(), len(table)
        if count:
            yield block(pa.Table.from_batches(held).combine_chunks())

    return run


def nearest_entries(dictionary: list[np.ndarray], codes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry, and its distance, of every part of a block's
    vectors, both (parts, vectors). ``book`` is (parts, entries, width)."""
    parts, entries, width = book.shape
    found = np.empty((parts, codes.shape[1]), dtype=np.int64)
    least = np.empty_like(found)
    for p in range(parts):
        distance = np.zeros((codes.shape[1], entries), dtype=np.int64)
        for j in range(width):
            d = p * width + j
            distance += np.square(dictionary[d][:, None] - book[p, :, j])[codes[d]]
        found[p] = distance.argmin(axis=1)
        least[p] = distance.min(axis=1)
    return found, least


def _opened(batches, dims: int):
    for batch in batches:
        for i in range(batch.num_rows):
            dictionary = [np.asarray(x, dtype=np.int64) for x in batch.column("dictionary")[i].as_py()]
            codes = np.frombuffer(batch.column("codes")[i].as_py(), dtype=np.uint16).reshape(dims, -1)
            yield batch, i, dictionary, codes


def _sums(book: np.ndarray):
    """Arrow function: blocks to the task's sum of each entry's parts by position,
    with how many there are."""
    parts, entries, width = book.shape

    def run(batches):
        sums = np.zeros((parts, entries, width), dtype=np.int64)
        counts = np.zeros((parts, entries), dtype=np.int64)
        for _, _, dictionary, codes in _opened(batches, parts * width):
            found, _ = nearest_entries(dictionary, codes, book)
            for p in range(parts):
                counts[p] += np.bincount(found[p], minlength=entries)
                for j in range(width):
                    d = p * width + j
                    size = len(dictionary[d])
                    times = np.bincount(found[p] * size + codes[d], minlength=entries * size)
                    sums[p, :, j] += times.reshape(entries, size) @ dictionary[d]
        slot = np.arange(sums.size)
        columns = [slot, sums.ravel(), np.repeat(counts.ravel(), width)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "total", "times"])

    return run


def _coded(book: np.ndarray):
    """Arrow function: blocks to one row per vector: code and error."""
    parts, _, width = book.shape

    def run(batches):
        for batch, i, dictionary, codes in _opened(batches, parts * width):
            found, least = nearest_entries(dictionary, codes, book)
            code = ["".join(f"{x:02x}" for x in own) for own in found.T.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(code, pa.string()), pa.array(least.sum(axis=0))],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def codebooks(blocks: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Entries after ``rounds`` of assigning all parts and moving each entry to the
    floored mean of its parts; one that has none stays."""
    book = start.copy()
    for _ in range(rounds):
        moved = blocks.mapInArrow(_sums(book), "slot long, total long, times long").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("times").alias("times"))
        flat = book.reshape(-1)
        for row in moved.where("times > 0").collect():
            flat[row.slot] = row.total // row.times
    return book


def vector_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector, from
    columns vec_id, embedding and label.

    Left out are vectors that are null or hold a null or a non-finite component.
    Components become floor(4096 x), and vectors are cut into 8 consecutive parts.
    Each position's codebook starts as that part of the 16 vectors of smallest
    vec_id (of all, if fewer; rows that share one by their components, ids that are
    null last) and moves in 6 rounds. Nearest is by squared distance, ties to the
    lower entry; ``error`` adds up the distances of a vector's parts, and
    ``label_error`` the errors of all rows of equal label, nulls together.

    Vectors shorter than the longest end in zeros, as does the last part where 8
    doesn't divide the length; repeated rows count each. Components so large that an
    error would not fit 64 bits are replaced by the largest that fits, and a sum of
    errors that doesn't fit by the largest number. An empty table gives an empty
    result. Other columns don't matter.
    """
    spark = ready(vectors.sparkSession)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & finite)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    dims = PARTS * width
    label = vectors.schema["label"].dataType.simpleString()
    blocks = kept.mapInArrow(_blocks(dims), f"ids array<bigint>, labels array<{label}>, dictionary array<array<bigint>>, codes binary")
    blocks = stage(blocks, "codes-blocks")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").toArrow()
    start = _matrix(first.column("embedding"), dims).reshape(-1, PARTS, width).transpose(1, 0, 2)
    if not start.size:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    book = codebooks(blocks, np.ascontiguousarray(start))
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    coded = blocks.mapInArrow(_coded(book), f"vec_id long, label {label}, code string, error long")
    coded = coded.select("vec_id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))
    coded = stage(coded, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = stage(coded.groupBy("none", "name").agg(total.alias("label_error"), F.count("*").alias("times")), "codes-labels")
    out = join_hot(coded, sums, ["none", "name"], "times")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
