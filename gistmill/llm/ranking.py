"""Ranked lexical search by bags: documents that score alike are scored once.

Documents are reduced to the items' terms. Those with the same term counts and the
same length measure m have the same score for every item, so they form one class:
found by a hash, told apart by the whole vector, scored once, and expanded by
ascending doc_id. Of a class, as many members as are asked for suffice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.words import LOWER, ranges, ready, span_hashes, word_slices
from gistmill.session import stage

#: (item, term) pairs of one block of items, the bound of what is sent to all tasks.
BLOCK_TERMS = 1_000_000
#: Parts of scores that are added up at a time.
STEP = 1_000_000

#: Bytes that belong to no term: ASCII other than letters and digits.
OUTSIDE = np.zeros(256, dtype=bool)
OUTSIDE[:128] = True
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def _slices(column: pa.Array):
    for part in word_slices(column, outside=OUTSIDE):
        yield part, span_hashes(LOWER[part.data], part.starts, part.ends)


def _lists(values: np.ndarray, rows: np.ndarray, size: int, kind) -> pa.ListArray:
    """Values of rows in ascending order as one list per row."""
    offsets = np.searchsorted(rows, np.arange(size + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _item_terms(batches):
    """Arrow function: (item_id, text) to (item_id, term) with the hash of each term."""
    for batch in batches:
        ids = batch.column("item_id")
        for part, hashes in _slices(batch.column("text")):
            own = ids.take(pa.array(part.first + part.row_of_word()))
            yield pa.RecordBatch.from_arrays([own, pa.array(hashes.view(np.int64))], names=["item_id", "term"])


def _vectors(vocabulary: np.ndarray):
    """Arrow function: (doc_id, text) to the number of terms, and the numbers and
    frequencies of those in the sorted ``vocabulary``."""

    def run(batches):
        for batch in batches:
            for part, hashes in _slices(batch.column("text")):
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                hit = vocabulary[at] == hashes
                pairs, tf = np.unique(part.row_of_word()[hit] * len(vocabulary) + at[hit], return_counts=True)
                rows = pairs // len(vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.first, part.size),
                        pa.array(np.diff(part.words).astype(np.int64)),
                        _lists(pairs % len(vocabulary), rows, part.size, pa.int32()),
                        _lists(tf, rows, part.size, pa.int64()),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return run


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _best(weights: np.ndarray, first: np.ndarray, items: np.ndarray, n_items: int, top: int, step: int):
    """Arrow function: classes (m, terms, tfs, members) to the best ``top`` documents
    of the task for each item. Items that hold a term are
    ``items[first[term] : first[term + 1]]``."""

    def best(item, doc, score):
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        kept = np.arange(len(item)) - np.searchsorted(item, item) < top
        return item[kept], doc[kept], score[kept]

    def run(batches):
        held = (np.zeros(0, np.int64),) * 3
        least = np.ones(n_items, dtype=np.int64)
        for batch in batches:
            m = batch.column("m").to_numpy(zero_copy_only=False)
            terms, offsets = _flat(batch.column("terms"))
            tfs, _ = _flat(batch.column("tfs"))
            docs, members = _flat(batch.column("members"))
            owner = np.repeat(np.arange(len(m)), np.diff(offsets))
            part = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[owner]))
            many = np.concatenate([[0], np.cumsum(first[terms + 1] - first[terms])])[offsets]
            begin = 0
            while begin < len(m):
                end = max(begin + 1, int(np.searchsorted(many, many[begin] + step, side="right")) - 1)
                end = min(end, begin + max(1, step // n_items), len(m))
                own = slice(int(offsets[begin]), int(offsets[end]))
                sizes = first[terms[own] + 1] - first[terms[own]]
                scores = np.zeros((end - begin) * n_items, dtype=np.int64)
                at = np.repeat((owner[own] - begin) * n_items, sizes) + items[ranges(first[terms[own]], sizes)]
                np.add.at(scores, at, np.repeat(part[own], sizes))
                kind, item = np.nonzero(scores.reshape(-1, n_items) >= least)
                copies = members[begin + kind + 1] - members[begin + kind]
                new = np.repeat(item, copies), docs[ranges(members[begin + kind], copies)], np.repeat(scores.reshape(-1, n_items)[kind, item], copies)
                held = best(*(np.concatenate(x) for x in zip(held, new)))
                # Nothing below the last of a full list can enter it any more.
                last = np.flatnonzero(np.bincount(held[0], minlength=n_items) == top)
                least[last] = held[2][np.searchsorted(held[0], last, side="right") - 1]
                begin = end
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["item", "doc_id", "score"])

    return run


def _block(texts: DataFrame, pairs: list, top: int) -> DataFrame:
    """The best documents for one block of items, given as (item_id, terms) rows."""
    spark = texts.sparkSession
    hashes = [np.array(p.terms, dtype=np.int64).view(np.uint64) for p in pairs]
    vocabulary = np.unique(np.concatenate(hashes))
    number = np.concatenate([np.searchsorted(vocabulary, h) for h in hashes])
    item = np.repeat(np.arange(len(pairs)), [len(h) for h in hashes])
    order = np.argsort(number, kind="stable")
    first = np.searchsorted(number[order], np.arange(len(vocabulary) + 1))

    vectors = stage(texts.mapInArrow(_vectors(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>"), "rank-vectors")
    n_docs, length = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    for row in df.select("term", weight.alias("weight")).collect():
        weights[row.term] = row.weight
    kind = Window.partitionBy("hash", "m", "terms", "tfs").orderBy("doc_id")
    classes = (
        vectors.where("doc_id is not null and size(terms) > 0")
        .withColumn("m", F.expr(f"100 - 50 + ((50 * n * {n_docs}L) div {max(1, length)}L)"))
        .select("doc_id", "m", "terms", "tfs", F.xxhash64("m", "terms", "tfs").alias("hash"))
        .withColumn("place", F.row_number().over(kind))
        .where(F.col("place") <= top)
        .groupBy("hash", "m", "terms", "tfs")
        .agg(F.collect_list("doc_id").alias("members"))
    )
    scored = classes.select("m", "terms", "tfs", "members").mapInArrow(_best(weights, first, item[order], len(pairs), top, STEP), "item long, doc_id long, score long")
    names = F.broadcast(spark.createDataFrame([(i, p.item_id) for i, p in enumerate(pairs)], "item long, item_id long"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score
    above 0, highest first, equal scores by ascending doc_id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
    lower-cased; null has none. With N documents that have terms, L terms in all,
    n in the document, df documents holding the term and tf occurrences, a term's
    weight is floor(1000 ln((2N + 2) / (2 df + 1))), the document's m is
    50 + (50 n N) div L, and the score adds up weight * (10^9 tf div (1000 tf + 20 m))
    over the item's distinct terms, in whole numbers.

    Rows that share an item_id are one item with the terms of all; a null item_id is
    one too, and an item without terms has no result. Documents without doc_id count
    in N, L and df but are not returned, and rows that share a doc_id are ranked each
    for itself. Terms are told apart by 64-bit hashes. Other columns don't matter.
    Items whose terms are too many to be sent to every task are taken in blocks.
    """
    spark = ready(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, term long")
    pairs = stage(terms.groupBy("item_id").agg(F.collect_set("term").alias("terms")), "rank-items")
    blocks = -(-(pairs.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        if own:
            found = _block(texts, own, top)
            out = found if blocks == 1 else out.union(stage(found, "rank-block"))
    return out
