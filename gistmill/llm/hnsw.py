"""Approximate nearest neighbours: one HNSW graph per shard, results merged.

Rows with the same vector are one node that keeps the smallest ids. Nodes are dealt
to shards of bounded size. A shard's graph has levels of geometrically fewer nodes;
each level is a flat array of neighbours per node, chosen among the nearest nodes
so that they point in different directions, and completed by reverse edges.
For inner products vectors get one more component that makes their lengths equal,
so nearest by distance is largest by product. Searches descend greedily and end in
a beam over the lowest level; blocks of queries are searched at once in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.llm.words import mix, ready
from gistmill.session import stage

SHARD = 8192
QUERY_BLOCK = 1024
DEGREE = 16
CANDIDATES = 48
BEAM = 80
SALTS = 256


def _nodes(size: int):
    """Arrow function: (vec_id, embedding) to (vec_id, vector, a, b), vectors as
    bytes of doubles with two hashes; unusable rows are left out."""

    def run(batches):
        for batch in batches:
            ids, vectors, firsts, seconds = [], [], [], []
            for name, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if name is None or vector.as_py() is None:
                    continue
                own = np.array([np.nan if x is None else x for x in vector.as_py()], dtype=np.float64)
                if len(own) != size or not np.isfinite(own).all() or not own.any():
                    continue
                own = own + 0.0  # -0.0 is 0.0
                bits = own.view(np.uint64)
                order = np.arange(1, len(bits) + 1, dtype=np.uint64)
                ids.append(name)
                vectors.append(own.tobytes())
                firsts.append(int(mix(mix(bits) + order).sum().view(np.int64)))
                seconds.append(int(mix(mix(bits ^ np.uint64(0x5555)) * (order | np.uint64(1)) + order).sum().view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64())], names=["vec_id", "vector", "a", "b"])

    return run


def _scaled(vectors: np.ndarray, axis: int | None = None) -> np.ndarray:
    """Vectors by the largest component, of each where ``axis`` is 1: their order by
    products stays, and single precision can hold their squares."""
    if not vectors.size:
        return vectors
    most = np.abs(vectors).max(axis=axis, keepdims=True)
    return vectors / np.where(most > 0, most, 1.0)


class Graph:
    """Levels of neighbour arrays over a matrix of vectors."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors = vectors
        self.levels = levels  # (node numbers, neighbours as node numbers or -1), lowest first

    @staticmethod
    def build(vectors: np.ndarray, chance: np.ndarray) -> "Graph":
        """``chance`` in (0, 1) per node decides its highest level."""
        scaled = _scaled(vectors)
        norms = (scaled**2).sum(axis=1)
        even = np.hstack([scaled, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]]).astype(np.float32)
        top = np.floor(-np.log(chance) / np.log(DEGREE)).astype(int)
        levels = []
        for level in range(int(top.max()) + 1 if len(top) else 1):
            nodes = np.flatnonzero(top >= level)
            if level and len(nodes) < 2:
                break
            levels.append((nodes, nodes_or_none(nodes, _connect(even[nodes], 3 * DEGREE if level == 0 else 2 * DEGREE))))
        return Graph(vectors, levels)

    def search(self, queries: np.ndarray, count: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and products of the nearest nodes found, padded by -1."""
        vectors = _scaled(self.vectors).astype(np.float32)
        queries = _scaled(queries, axis=1).astype(np.float32)
        n, q = len(vectors), len(queries)
        at = np.full(q, self.levels[-1][0][0])
        score = queries @ vectors[at[0]]
        for nodes, neighbours in reversed(self.levels[1:]):
            index = np.full(n, -1)
            index[nodes] = np.arange(len(nodes))
            moving = np.arange(q)
            while len(moving):
                near = neighbours[index[at[moving]]]
                products = np.einsum("qd,qmd->qm", queries[moving], vectors[near])
                products[near < 0] = -np.inf
                best = products.argmax(axis=1)
                value = products[np.arange(len(moving)), best]
                better = value > score[moving]
                moving, best, near, value = moving[better], best[better], near[better], value[better]
                at[moving], score[moving] = near[np.arange(len(moving)), best], value
        neighbours = self.levels[0][1]
        beam = min(max(beam, count), n)
        held = np.full((q, beam), -1)
        held_score = np.full((q, beam), -np.inf, dtype=np.float32)
        open_ = np.zeros((q, beam), dtype=bool)
        seen = np.zeros((q, n), dtype=bool)
        # Several entries: the node that the descent found and the top level.
        entries = np.unique(self.levels[-1][0][:DEGREE])
        first = np.hstack([at[:, None], np.broadcast_to(entries, (q, len(entries)))])[:, :beam]
        for column in range(first.shape[1]):
            fresh = ~seen[np.arange(q), first[:, column]]
            held[fresh, column] = first[fresh, column]
            held_score[fresh, column] = np.einsum("qd,qd->q", queries[fresh], vectors[first[fresh, column]])
            open_[fresh, column] = True
            seen[np.arange(q), first[:, column]] = True
        active = np.arange(q)
        while len(active):
            ranked = np.where(open_[active], held_score[active], -np.inf)
            best = ranked.argmax(axis=1)
            alive = ranked[np.arange(len(active)), best] > -np.inf
            active, best = active[alive], best[alive]
            if not len(active):
                break
            open_[active, best] = False
            near = neighbours[held[active, best]]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            seen[np.repeat(active, fresh.sum(axis=1)), near[fresh]] = True
            products = np.einsum("qd,qmd->qm", queries[active], vectors[near])
            products[~fresh] = -np.inf
            every = np.hstack([held_score[active], products])
            keep = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            held_score[active] = np.take_along_axis(every, keep, axis=1)
            held[active] = np.take_along_axis(np.hstack([held[active], np.where(fresh, near, -1)]), keep, axis=1)
            open_[active] = np.take_along_axis(np.hstack([open_[active], fresh]), keep, axis=1)
        order = np.argsort(-held_score, axis=1)[:, :beam]
        return np.take_along_axis(held, order, axis=1), np.take_along_axis(held_score, order, axis=1)


def nodes_or_none(nodes: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    return np.where(neighbours >= 0, nodes[neighbours], -1).astype(np.int32)


def _diverse(points: np.ndarray, count: int, before: bool) -> np.ndarray:
    """``count`` neighbours of each point among its nearest: those no nearer to one
    chosen before than to the point, then the nearest of the rest. With ``before``
    only points of smaller number count, as if points were inserted one by one."""
    n = len(points)
    squares = (points**2).sum(axis=1)
    chosen = np.full((n, count), -1, dtype=np.int64)
    for first in range(0, n, 256):
        own = points[first : first + 256]
        rows = np.arange(first, first + len(own))
        upto = first + len(own) if before else n
        far = squares[None, :upto] + squares[rows, None] - 2 * own @ points[:upto].T
        far[np.arange(upto)[None, :] >= rows[:, None] if before else np.arange(upto)[None, :] == rows[:, None]] = np.inf
        k = min(CANDIDATES, upto)
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1), axis=1)
        far = np.take_along_axis(far, near, axis=1)
        some = points[near]
        between = squares[near][:, :, None] + squares[near][:, None, :] - 2 * some @ some.transpose(0, 2, 1)
        real = np.isfinite(far)
        taken = np.zeros(near.shape, dtype=bool)
        for i in range(k):
            blocked = (taken[:, :i] & (between[:, i, :i] < far[:, i : i + 1])).any(axis=1)
            taken[:, i] = ~blocked & real[:, i] & (taken.sum(axis=1) < count)
        rank = np.argsort(2 * ~real + ~taken, axis=1, kind="stable")[:, :count]
        chosen[first : first + len(own), : rank.shape[1]] = np.where(np.take_along_axis(real, rank, axis=1), np.take_along_axis(near, rank, axis=1), -1)
    return chosen


def _connect(points: np.ndarray, width: int) -> np.ndarray:
    """Neighbour numbers, points x width. A third are chosen among points of smaller
    number, which keeps distant clusters connected, a third among all points, and the
    rest are the nearest of the points that chose this one."""
    n, part = len(points), width // 3
    out = np.full((n, width), -1, dtype=np.int64)
    if n < 2:
        return out
    out[:, :part], out[:, part : 2 * part] = _diverse(points, part, True), _diverse(points, part, False)
    source, target = np.repeat(np.arange(n), 2 * part), out[:, : 2 * part].ravel()
    pairs = np.unique(target[target >= 0] * n + source[target >= 0])
    target, source = pairs // n, pairs % n
    gap = np.concatenate([((points[source[i : i + 65536]] - points[target[i : i + 65536]]) ** 2).sum(axis=1) for i in range(0, len(source), 65536)])
    order = np.lexsort((gap, target))
    source, target = source[order], target[order]
    turn = np.arange(len(target)) - np.searchsorted(target, target)
    keep = turn < width - 2 * part
    out[target[keep], 2 * part + turn[keep]] = source[keep]
    # A search must not meet a neighbour twice.
    out = np.sort(out, axis=1)[:, ::-1]
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


_INDEX = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("vectors", T.BinaryType()), T.StructField("levels", T.ArrayType(T.StructType([T.StructField("nodes", T.BinaryType()), T.StructField("neighbours", T.BinaryType())])))])


def build_index(vectors: DataFrame, size: int, keep: int) -> DataFrame:
    """One row per shard: ids of each node (the ``keep`` smallest), its vectors and
    the neighbour arrays of its levels, from (vec_id, vector, a, b)."""
    ready(vectors.sparkSession)
    least = lambda ids: F.slice(F.sort_array(F.collect_set(ids)), 1, keep)
    # A hot vector's ids are reduced in salted parts first.
    parts = vectors.groupBy("a", "b", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(least("vec_id").alias("ids"), F.first("vector").alias("vector"))
    nodes = parts.select("a", "b", "vector", "ids").groupBy("a", "b").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"), F.first("vector").alias("vector"))
    nodes = stage(nodes, "hnsw-nodes")
    shards = max(1, -(-nodes.count() // SHARD))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("b", "ascending")])
        own = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.float64).reshape(table.num_rows, size)
        chance = (mix(table.column("a").to_numpy().view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53 + 2.0**-54
        graph = Graph.build(own, chance)
        levels = [{"nodes": n.astype(np.int32).tobytes(), "neighbours": m.tobytes()} for n, m in graph.levels]
        row = {"shard": table.column("shard")[0].as_py(), "ids": table.column("ids").to_pylist(), "vectors": own.tobytes(), "levels": levels}
        kind = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.list_(pa.int64()))), ("vectors", pa.binary()), ("levels", pa.list_(pa.struct([("nodes", pa.binary()), ("neighbours", pa.binary())])))])
        return pa.Table.from_pylist([row], schema=kind)

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("a", "b"), F.lit(shards)))
    return stage(dealt.groupBy("shard").applyInArrow(build, _INDEX), "hnsw-index")


def search_index(index: DataFrame, queries: DataFrame, size: int, count: int, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (vec_id, vector)."""
    queries = stage(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")), "hnsw-queries")
    shards = [r.shard for r in index.select("shard").collect()]
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    if not shards:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)

    def search(keys, shard: pa.Table, block: pa.Table) -> pa.Table:
        names = block.column("vec_id").to_pylist() if shard.num_rows else []
        found, others, scores = [], [], []
        if names:
            row = shard.slice(0, 1)
            vectors = np.frombuffer(row.column("vectors")[0].as_py(), dtype=np.float64).reshape(-1, size)
            ids = row.column("ids")[0].as_py()
            levels = []
            for level in row.column("levels")[0].as_py():
                nodes = np.frombuffer(level["nodes"], dtype=np.int32)
                levels.append((nodes.astype(np.int64), np.frombuffer(level["neighbours"], dtype=np.int32).reshape(len(nodes), -1).astype(np.int64)))
            wanted = np.frombuffer(b"".join(block.column("vector").to_pylist()), dtype=np.float64).reshape(len(names), size)
            near, _ = Graph(vectors, levels).search(wanted, count + 1, beam)
            exact = np.einsum("qd,qmd->qm", wanted, vectors[near])
            exact[near < 0] = -np.inf
            for q, name in enumerate(names):
                rows = sorted((-s, i) for s, x in zip(exact[q].tolist(), near[q].tolist()) if x >= 0 for i in ids[x] if i != name)[:count]
                found += [name] * len(rows)
                others += [i for _, i in rows]
                scores += [-s for s, _ in rows]
        return pa.table({"query_id": pa.array(found, pa.int64()), "vec_id": pa.array(others, pa.int64()), "score": pa.array(scores, pa.float64())})

    one = F.lit(1).cast("long")
    sides = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks) - one)))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long")).withColumn("shard", F.explode(F.array(*[F.lit(s).cast("long") for s in shards])))
    hits = sides.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, is_query: Column, count: int = 20, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``table`` (vec_id, embedding)
    where ``is_query`` holds, the ``count`` rows of largest inner product found.

    Rows without vec_id, and vectors that are null, zero, hold nulls or non-finite
    numbers, or have another length than most, take no part. Rows that share the
    query's vec_id are its own, and one of them asks, the first by its bytes; otherwise
    equal rows are one candidate. Equal scores go to the smaller vec_id. Other columns don't matter.
    """
    spark = ready(table.sparkSession)
    rows = table.select("vec_id", "embedding", is_query.alias("_asked"))
    common = rows.groupBy(F.size("embedding").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    size = common["n"] if common else 1
    vectors = stage(rows.select("vec_id", "embedding").mapInArrow(_nodes(size), "vec_id long, vector binary, a long, b long"), "hnsw-vectors")
    del spark
    index = build_index(vectors, size, count + 1)
    return search_index(index, vectors.where(is_query), size, count, beam)
