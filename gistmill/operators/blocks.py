"""The terms of sentences meet the counts of their groups block by block.

A row per sentence and term is several times the texts and would go through two
shuffles. Here a task cuts its sentences into blocks and numbers the (group, term)
pairs of each. A group that lies in one block has its counts at once; of the others
the pairs are added up over all blocks, and each block gets the sums of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.session import ship, stage

BLOCK_TERMS = 2_000_000
_PAIR = "_block long, _term string, _spot int, _count long, _df long"
_SPOTS = "_spots array<int>, _times array<int>"
_MET = "met array<struct<tf int, count long, df long>>"


def _cut(keys: Sequence[str], columns: Sequence[str], most: int):
    """Arrow function: rows of sentences, of groups within the block with their
    counts and of others with the spots of their pairs, and rows of the latter's pairs."""

    def block(batches, number):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.Table.from_batches(batches).combine_chunks()
        rows = table.num_rows
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        sizes = pc.list_value_length(column["bag"]).to_numpy(zero_copy_only=False).astype("int64")
        bag = column["bag"].flatten()
        words = bag.field("term").dictionary_encode()
        tf = bag.field("tf").to_numpy(zero_copy_only=False).astype("int32")
        group = np.zeros(rows, dtype="int64")
        for key in keys:
            own = column[key].dictionary_encode()
            group = np.unique(group * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
        token_group = np.repeat(group, sizes)
        first, spot = np.unique(token_group * len(words.dictionary) + words.indices.to_numpy(), return_index=True, return_inverse=True)[1:]
        spot = spot.astype("int32")
        count = np.bincount(spot, weights=tf).astype("int64")
        df = np.bincount(spot).astype("int64")
        total = np.zeros(group.max() + 1, dtype="int64")
        total[group] = column["filt_total"].to_numpy()
        closed = np.bincount(token_group, weights=tf).astype("int64") == total
        shown = column["_shown"].to_numpy(zero_copy_only=False)

        # Rows of a group lie together, as they are smaller so in shuffles.
        sorted_ = np.argsort(group, kind="stable")
        starts = np.cumsum(sizes) - sizes

        def lists(chosen, values):
            ends = np.concatenate([[0], np.cumsum(sizes[chosen])])
            taken = np.arange(ends[-1]) + np.repeat(starts[chosen] - ends[:-1], sizes[chosen])
            made = [pa.array(v[taken]) for v in values.values()]
            made = made[0] if len(made) == 1 else pa.StructArray.from_arrays(made, names=list(values))
            return pa.ListArray.from_arrays(pa.array(ends.astype("int32")), made)

        def out(n, given):
            types = {c: column[c].type for c in columns} | {
                "_block": pa.int64(), "_term": pa.string(), "_spot": pa.int32(), "_count": pa.int64(), "_df": pa.int64(),
                "_spots": pa.list_(pa.int32()), "_times": pa.list_(pa.int32()),
                "met": pa.list_(pa.struct([("tf", pa.int32()), ("count", pa.int64()), ("df", pa.int64())])),
            }
            given = {"_block": pa.array(np.full(n, number, dtype="int64"))} | given
            return pa.RecordBatch.from_arrays([given[c].cast(t) if c in given else pa.nulls(n, t) for c, t in types.items()], names=list(types))

        inside, open_ = (sorted_[(shown & c)[sorted_]] for c in (closed[group], ~closed[group]))
        for chosen, made in (
            (inside, {"met": {"tf": tf, "count": count[spot], "df": df[spot]}}), (open_, {"_spots": {"": spot}, "_times": {"": tf}}),
        ):
            if len(chosen):
                given = {c: column[c].take(pa.array(chosen)) for c in columns}
                yield out(len(chosen), given | {name: lists(chosen, values) for name, values in made.items()})
        pairs = np.flatnonzero(~closed[token_group[first]])
        if len(pairs):
            row = np.repeat(np.arange(rows), sizes)[first[pairs]]
            yield out(len(pairs), {key: column[key].take(pa.array(row)) for key in keys} | {
                "_term": bag.field("term").take(pa.array(first[pairs])), "_spot": pa.array(pairs.astype("int32")),
                "_count": pa.array(count[pairs]), "_df": pa.array(df[pairs]),
            })

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, terms = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                terms += len(batch.column("bag").flatten())
            if terms >= most:
                yield from block(held, number)
                held, terms, number = [], 0, number + 1
        if held:
            yield from block(held, number)

    return run


def _fill(sentences, found):
    """Sentences of a block with the counts of their spots."""
    import numpy as np
    import pyarrow as pa

    spots = sentences.column("_spots").combine_chunks()
    at = found.column("_spot").combine_chunks().to_numpy(zero_copy_only=False)
    place = np.zeros(at.max(initial=-1) + 1, dtype="int64")
    place[at] = np.arange(len(at))
    place = pa.array(place[spots.flatten().to_numpy(zero_copy_only=False)])
    values = [sentences.column("_times").combine_chunks().flatten(), *(found.column(c).combine_chunks().take(place) for c in ("count", "df"))]
    # The lists may be a slice of longer ones.
    ends = pa.array((spots.offsets.to_numpy() - spots.offsets[0].as_py()).astype("int32"))
    met = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(values, names=["tf", "count", "df"]))
    return sentences.drop_columns(["_block", "_spots", "_times"]).append_column("met", met)


def meet_counts(
    sentences: DataFrame, keys: Sequence[str], columns: Sequence[str], shown: Column, most: int = BLOCK_TERMS,
) -> DataFrame:
    """``columns`` of the ``shown`` sentences that have terms, and ``met``: for each
    distinct term, in order of first occurrence, its ``tf`` in the sentence, and
    ``count`` and ``df`` of the group's terms (``terms.group_terms``).

    ``sentences`` must have their group's ``filt_total`` in a column.
    """
    ship(sentences.sparkSession)
    keys, columns = list(keys), list(columns)
    opened = sentences.filter(F.size("bag") > 0).select(*columns, "bag", F.coalesce(shown, F.lit(False)).alias("_shown"))
    fields = [T.StructField(c, opened.schema[c].dataType) for c in columns]
    schema = T.StructType([*fields, *T.StructType.fromDDL(", ".join([_PAIR, _SPOTS, _MET]))])
    cut = stage(opened.mapInArrow(_cut(keys, columns, most), schema), "blocks")
    everywhere = Window.partitionBy(*keys, "_term")
    found = cut.filter("_term is not null").select(
        F.col("_block").alias("_in"), "_spot", F.sum("_count").over(everywhere).alias("count"), F.sum("_df").over(everywhere).alias("df"))
    open_ = cut.filter("_spots is not null").select(*columns, "_block", "_spots", "_times").groupBy("_block")
    filled = open_.cogroup(found.groupBy("_in")).applyInArrow(_fill, T.StructType([*fields, *T.StructType.fromDDL(_MET)]))
    return cut.filter("met is not null").select(*columns, "met").unionByName(filled)
