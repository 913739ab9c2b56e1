"""Running totals inside a key, in a total order, without a task per key.

A window over one key puts that key's rows into one task, so it is used only
where every key is known to be small. Otherwise rows are range-partitioned by
(key, order), each partition adds up its own rows, and partitions that continue
a key get the totals of the partitions before them. A key may span any number
of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.session import stage

WINDOW_ROWS = 1_000_000
_CHUNK = "_chunk"
_SEQ = "_seq"
_REPEAT = "_repeat"


def _partition_totals(keys: Sequence[str], counters: dict[str, str], compare: str | None):
    """Arrow function adding the running columns to one sorted partition."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()
        last_key = last_value = None
        carry = {name: 0 for name in (_SEQ, *counters)}
        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue

            def changed(column, before):
                """True where a row differs from the row above it (nulls are equal)."""
                out = np.empty(rows, dtype=bool)
                out[0] = column[0].as_py() != before
                if rows > 1:
                    upper, lower = column.slice(0, rows - 1), column.slice(1)
                    differs = pc.fill_null(pc.not_equal(lower, upper), False)
                    one_null = pc.not_equal(pc.is_null(lower), pc.is_null(upper))
                    out[1:] = pc.or_(differs, one_null).to_numpy(zero_copy_only=False)
                return out

            starts = np.zeros(rows, dtype=bool)
            for i, key in enumerate(keys):
                column = batch.column(key)
                starts |= changed(column, last_key[i] if last_key else None)
            if last_key is None:
                starts[0] = True
            first = np.maximum.accumulate(np.where(starts, np.arange(rows), 0))

            repeat = np.zeros(rows, dtype=bool)
            if compare is not None:
                repeat = ~changed(batch.column(compare), last_value) & ~starts
                last_value = batch.column(compare)[rows - 1].as_py()
            last_key = [batch.column(key)[rows - 1].as_py() for key in keys]

            added = []
            for name in (_SEQ, *counters):
                if name == _SEQ:
                    step = np.ones(rows, dtype="int64")
                else:
                    step = batch.column(counters[name]).to_numpy(zero_copy_only=False)
                    step = np.where(repeat, 0, step).astype("int64")
                total = np.cumsum(step)
                local = total - (total - step)[first]
                # Rows before the first new key continue the previous batch.
                local = np.where(np.cumsum(starts) == 0, local + carry[name], local)
                carry[name] = int(local[-1])
                added.append(pa.array(local))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(rows, chunk, dtype="int32")), pa.array(repeat), *added],
                names=[*batch.schema.names, _CHUNK, _REPEAT, _SEQ, *counters],
            )

    return run


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    counters: dict[str, str | int | Column],
    compare: str | None = None,
    label: str = "running",
    largest: int | None = None,
) -> DataFrame:
    """Add a running total per counter, over ``keys`` in ``order``.

    ``counters`` maps a new column to what each row adds (a column, or 1 to
    number rows from 1); amounts are whole numbers >= 0. ``order`` must be total
    within a key. With ``compare``, a row whose value equals the row above it in
    the same key adds nothing and gets ``repeated = true``. ``largest`` is an
    upper bound of the rows of one key, where the caller has one.
    """
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    steps = {name: f"_step_{name}" for name in counters}
    prepared = df.withColumns(
        {
            steps[name]: F.col(c).cast("long") if isinstance(c, str)
            else F.lit(c).cast("long") if isinstance(c, int) else c.cast("long")
            for name, c in counters.items()
        }
    )
    if keys and largest is not None and largest <= WINDOW_ROWS:
        return _window_totals(prepared, df.columns, keys, order, steps, compare)
    extra = [
        T.StructField(_CHUNK, T.IntegerType()),
        T.StructField(_REPEAT, T.BooleanType()),
        T.StructField(_SEQ, T.LongType()),
        *(T.StructField(name, T.LongType()) for name in counters),
    ]
    ranges = [*(F.col(k) for k in keys), *order]
    local = (
        prepared.repartitionByRange(*ranges)
        .sortWithinPartitions(*ranges)
        .mapInArrow(
            _partition_totals(keys, steps, compare), T.StructType([*prepared.schema.fields, *extra])
        )
    )
    local = stage(local, label)

    # One row per (key, partition); only keys that reach into a further
    # partition need an offset, so there are fewer of those than partitions.
    pieces = local.groupBy(*keys, _CHUNK).agg(
        *(F.max(name).alias(name) for name in counters),
        *(F.min_by(steps[name], _SEQ).alias(steps[name]) for name in counters),
        *([F.min_by(compare, _SEQ).alias("_first"), F.max_by(compare, _SEQ).alias("_last")] if compare else []),
    )
    by_chunk = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    follows = F.col("_first").eqNullSafe(F.lag("_last").over(by_chunk)) if compare else F.lit(False)
    pieces = pieces.withColumn("_continued", F.row_number().over(by_chunk) > 1)
    pieces = pieces.withColumn("_follows", F.col("_continued") & follows)
    again = {name: F.when(F.col("_follows"), F.col(steps[name])).otherwise(0) for name in counters}
    offsets = (
        pieces.withColumns(
            {f"_off_{name}": F.sum(F.col(name) - again[name]).over(before) - again[name] for name in counters}
        )
        .filter("_continued")
        .select(
            *(F.col(k).alias(f"_k_{k}") for k in keys),
            F.col(_CHUNK).alias("_k_chunk"),
            "_follows",
            *(f"_off_{name}" for name in counters),
        )
    )
    match = F.col(_CHUNK) == F.col("_k_chunk")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(F.broadcast(offsets), match, "left")
    at_start = F.col("_follows") & (F.col(_SEQ) == 1)
    return joined.select(
        *df.columns,
        *([(F.col(_REPEAT) | F.coalesce(at_start, F.lit(False))).alias("repeated")] if compare else []),
        *((F.col(name) + F.coalesce(F.col(f"_off_{name}"), F.lit(0))).alias(name) for name in counters),
    )


def _window_totals(
    prepared: DataFrame, columns: Sequence[str], keys: list[str], order: list[Column],
    steps: dict[str, str], compare: str | None,
) -> DataFrame:
    rows = Window.partitionBy(*keys).orderBy(*order)
    repeated = F.lit(False)
    if compare is not None:
        above = F.lag(F.struct(compare)).over(rows)
        prepared = prepared.withColumn("repeated", F.coalesce(above.eqNullSafe(F.struct(compare)), F.lit(False)))
        repeated = F.col("repeated")
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = {name: F.sum(F.when(repeated, 0).otherwise(F.col(step))).over(so_far) for name, step in steps.items()}
    return prepared.withColumns(totals).select(*columns, *(["repeated"] if compare else []), *steps)


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key. One pass over the key columns."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def number_rows(df, keys, order, name="n", label="number", largest: int | None = None) -> DataFrame:
    """Number rows from 1 within ``keys``."""
    return running_totals(df, keys, order, {name: 1}, label=label, largest=largest)
