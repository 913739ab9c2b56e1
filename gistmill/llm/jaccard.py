"""N-gram Jaccard join by signature trees.

A document is the set of its distinct word shingles. Two documents link when
their Jaccard similarity reaches a percentage; groups are connected documents.

Documents that can link are brought together in bounded groups, and each group
is searched with a signature tree: a node holds the OR of its members' token
bitmaps and the range of their sizes, and a traversal of the tree against itself
drops pairs of nodes whose largest possible overlap is too small. What remains is
verified on the shingles.

Groups come in two rounds. The first takes documents that share a min-hash, which
gathers nearly all copies. The second makes the join complete: similar sets share
one of their first (1 - threshold) shingles in any common order, so groups of the
first round that share such a shingle are compared with each other. In the order
used, shingles that many groups hold come last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.groups import components
from gistmill.llm.words import bundles, mix, ready, shingle_sets
from gistmill.session import stage

SEEDS = mix(np.arange(11, 14, dtype=np.uint64))
CHUNK = 256
#: Shingles of more components than this come last among a document's shingles.
CROWD = 8
#: So often they are moved at most; each time reads the texts again.
MOVES = 2
#: Shingles that come last are marked by so many of their low bits, in a bitmap of 8 MB.
MARK_BITS = 26
LEAF = 8
FANOUT = 4


def overlap_needed(a, b, percent: int):
    """Smallest intersection of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


class SignatureTree:
    """Nodes of a group's documents, level by level; level 0 are documents.

    A node holds the OR of its members' bitmaps, their smallest and largest size,
    and the largest number of shingles that share a bit with another one.
    """

    def __init__(self, sets: list[np.ndarray], order: np.ndarray):
        sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
        bits = 64 << max(0, int(4 * max(1, int(np.median(sizes)))).bit_length() - 6)
        bits = int(min(bits, 1 << 15))
        maps = np.zeros((len(order), bits // 64), dtype=np.uint64)
        for row, i in enumerate(order):
            at = (sets[i] >> np.uint64(40)).astype(np.int64) % bits
            np.bitwise_or.at(maps[row], at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        spare = sizes - np.bitwise_count(maps).sum(axis=1)
        self.order = order
        self.levels = [(maps, sizes, sizes, spare)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            maps, low, high, spare = self.levels[-1]
            at = np.arange(0, len(maps), width)
            self.levels.append(
                (np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at))
            )
            width = FANOUT

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether nodes a and b of a level may hold a pair that links."""
        maps, low, high, spare = self.levels[level]
        keep = np.zeros(len(a), dtype=bool)
        for first in range(0, len(a), 4096):
            x, y = a[first : first + 4096], b[first : first + 4096]
            common = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64)
            most = np.minimum(np.minimum(common + spare[x], common + spare[y]), np.minimum(high[x], high[y]))
            # The other set is at least as large as the overlap.
            needed = overlap_needed(np.maximum(low[x], 1), np.maximum(low[y], 1), percent)
            near = (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
            keep[first : first + 4096] = near & (most >= needed)
        return keep

    def pairs(self, percent: int):
        """Pairs of documents (in tree order) that the bounds can't rule out."""
        top = len(self.levels) - 1
        a, b = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        for level in range(top, -1, -1):
            if level < top:
                width = LEAF if level == 0 else FANOUT
                spread = np.arange(width)
                n = len(self.levels[level][0])
                a, b = (a[:, None] * width + np.repeat(spread, width)).ravel(), (b[:, None] * width + np.tile(spread, width)).ravel()
                inside = (a <= b) & (b < n) if level else (a < b) & (b < n)
                a, b = a[inside], b[inside]
            keep = self.possible(level, a, b, percent)
            a, b = a[keep], b[keep]
        return (a, b) if top else (a[:0], b[:0])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = int(np.isin(x, y, assume_unique=True).sum()) if len(x) * 8 < len(y) else len(x) + len(y) - len(np.union1d(x, y))
    return 100 * common >= percent * (len(x) + len(y) - common)


def linked(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between documents of different labels that join all that are linked;
    pairs that are joined already are not verified."""
    least = np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64)
    order = np.lexsort((least, [len(s) for s in sets]))
    tree = SignatureTree(sets, order)
    a, b = tree.pairs(percent)
    root = np.unique(labels, return_inverse=True)[1].reshape(-1)[order]
    found = []
    for own in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1) if len(a) else ():
        x, others = int(a[own[0]]), b[own]
        while len(others := others[root[others] != root[x]]):
            y, others = int(others[0]), others[1:]
            if similar(sets[order[x]], sets[order[y]], percent):
                root[root == root[y]] = root[x]
                found.append((int(order[x]), int(order[y])))
    return found


def _profile(k: int, share: float):
    """Arrow function: (doc_id, text) to sizes, set fingerprints and min-hashes,
    and, as rows without doc_id, shingles frequent in this partition."""

    def heavy(held: list[np.ndarray], counts: dict | None, floor: float):
        values, times = np.unique(np.concatenate(held), return_counts=True)
        if counts is not None:
            values, back = np.unique(np.concatenate([counts[0], values]), return_inverse=True)
            times = np.bincount(back, weights=np.concatenate([counts[1], times])).astype(np.int64)
        keep = times > floor
        return values[keep], times[keep]

    def batch_of(ids, n, sums, others, mins):
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64(), mask=None), pa.array(n, pa.int64()), pa.array(sums.view(np.int64)), pa.array(others.view(np.int64)), mins],
            names=["doc_id", "n_shingles", "sum1", "sum2", "mins"],
        )

    def run(batches):
        held, size, counts, rows = [], 0, None, 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            n, one, two, mins = [], [], [], []
            for _, sets in shingle_sets(batch.column("text"), k):
                for own in sets:
                    n.append(len(own))
                    one.append(own.sum() if len(own) else np.uint64(0))
                    two.append(mix(own ^ SEEDS[0]).sum() if len(own) else np.uint64(0))
                    mins.append([int(x) for x in np.array([mix(own ^ s).min() for s in SEEDS]).view(np.int64)] if len(own) else None)
                    held.append(own)
                    size += len(own)
                if size > 2_000_000:
                    # Lossy counting: what falls out here is not frequent.
                    rows += len(held)
                    counts = heavy(held, counts, max(2, share * rows / 4))
                    held, size = [], 0
            yield batch_of(ids, n, np.array(one, np.uint64), np.array(two, np.uint64), pa.array(mins, pa.list_(pa.int64())))
        if held:
            rows += len(held)
            counts = heavy(held, counts, 2)
        if counts is not None:
            keep = counts[1] >= max(8, share * rows)
            values, times = counts[0][keep], counts[1][keep].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(values), pa.int64()), pa.array(times), pa.array(values.view(np.int64)), pa.array(np.zeros(len(values), np.int64)), pa.nulls(len(values), pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "sum1", "sum2", "mins"],
            )

    return run


def _arrays(ids: pa.Array, keys: list[np.ndarray], name: str) -> pa.RecordBatch:
    values = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[name, "keys"])


def _prefixes(k: int, percent: int, frequent: np.ndarray, marks: np.ndarray):
    """Arrow function: (doc_id, text) to the shingles of which similar sets share one.

    In the order used, shingles of ``frequent`` and those marked in the bitmap
    ``marks`` come last; any order that all rows agree on is right, so marks that
    fall on other shingles too do no harm.
    """

    def run(batches):
        for batch in batches:
            keys = []
            for _, sets in shingle_sets(batch.column("text"), k):
                for own in sets:
                    many = len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0
                    last = np.zeros(len(own), dtype=bool)
                    if len(frequent) and len(own):
                        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                        last = frequent[at] == own
                    if len(marks):
                        at = own & np.uint64((1 << MARK_BITS) - 1)
                        last |= marks[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1
                    keys.append(np.concatenate([own[~last], own[last]])[:many])
            yield _arrays(batch.column("doc_id"), keys, "doc_id")

    return run


def _links(k: int, percent: int):
    """Arrow function: (group, doc_id, label, text) sorted by group to links."""

    def run(batches):
        for table in bundles(batches, "group"):
            group = table.column("group").to_numpy()
            ids = table.column("doc_id").to_numpy()
            labels = table.column("label").to_numpy()
            sets: list[np.ndarray] = []
            for _, some in shingle_sets(table.column("text"), k):
                sets += some
            borders = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).tolist()
            left, right = [], []
            for first, last in zip(borders[:-1], borders[1:]):
                for a, b in linked(sets[first:last], labels[first:last], percent) if last - first > 1 else ():
                    left.append(ids[first + a])
                    right.append(ids[first + b])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _shared(texts: DataFrame, sides: DataFrame, prefixes) -> DataFrame:
    """(key, component) of the keys that several components have."""
    keyed = texts.mapInArrow(prefixes, "doc_id long, keys array<long>").join(sides, "doc_id")
    keyed = keyed.select("component", F.explode("keys").alias("key"))
    # One shuffle: most keys are of one component, and end here.
    own = Window.partitionBy("key")
    keyed = keyed.select("key", "component", F.min("component").over(own).alias("low"), F.max("component").over(own).alias("high"))
    return stage(keyed.where("low < high").select("key", "component").distinct(), "jaccard-parts")


def _parts(texts: DataFrame, sides: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(key, component) of the first shingles that several components have.

    While pairs of components would be more than twice these rows, shingles of more
    than ``CROWD`` components are marked and come last from then on, in every document.
    A document gets as many other first shingles as it had marked ones, of which
    fewer are crowded, so a passage that many documents hold soon brings them together
    only where a document has little else, instead of in a row for each pair of them.
    """
    parts = _shared(texts, sides, _prefixes(k, percent, frequent, np.zeros(0, np.uint64)))
    marks = np.zeros(1 << MARK_BITS - 6, dtype=np.uint64)
    for _ in range(MOVES):
        counts = parts.groupBy("key").agg(F.count("*").alias("n"))
        rows, met = counts.agg(F.sum("n"), F.sum(F.expr("n * (n - 1) / 2"))).first()
        if not rows or met <= 2 * rows:
            break
        low = F.col("key").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
        crowd = counts.where(F.col("n") > CROWD).select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
        # At most the words of the bitmap, whatever the number of shingles.
        found = crowd.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        at, bits = found.column("word").to_numpy(), found.column("bits").to_numpy().view(np.uint64)
        if not (bits & ~marks[at]).any():
            break
        marks[at] |= bits
        parts = _shared(texts, sides, _prefixes(k, percent, frequent, marks))
    return parts


def _candidates(parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of components (x, y, nx, ny) that share enough first shingles to hold
    a link, from (key, component, least, most, n).

    Sets of n and m shingles that link have at least
    ceil(percent (n + m) / (100 + percent)) + 1 - ceil(percent max(n, m) / 100)
    of their first shingles in common. That falls with the larger size and grows
    with the smaller one, so the ends of the ranges of sizes give a bound.
    """
    a, b = parts.alias("a"), parts.alias("b")
    near = (F.col("a.most") * 100 >= F.col("b.least") * percent) & (F.col("b.most") * 100 >= F.col("a.least") * percent)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component")) & near)
    ends = [F.first(f"{side}.{name}").alias(f"{name}_{side}") for side in "ab" for name in ("least", "most", "n")]
    pairs = pairs.groupBy(F.col("a.component").alias("x"), F.col("b.component").alias("y")).agg(F.count("*").alias("common"), *ends)

    def least_common(large: str, small: str):
        # Sizes further apart than a link allows don't count.
        n = F.least(F.col(large), F.floor(F.col(small) * 100 / percent))
        m = F.least(n, F.col(small))
        return F.ceil(percent * (n + m) / (100 + percent) - 1e-9) + 1 - F.ceil(percent * n / 100)

    enough = F.least(least_common("most_a", "least_b"), least_common("most_b", "least_a"))
    # One less, as rounding up is not monotone.
    return pairs.where(F.col("common") >= enough - 1).select("x", "y", F.col("n_a").alias("nx"), F.col("n_b").alias("ny"))


def _searched(rows: DataFrame, k: int, percent: int) -> DataFrame:
    rows = rows.select("group", "doc_id", "label", "text").repartition("group").sortWithinPartitions("group", "doc_id")
    return rows.mapInArrow(_links(k, percent), "a long, b long")


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, share: float = 0.0005) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    ``component_id`` is the smallest doc_id that links reach, the document's own
    included. A text without words (null, empty, white space) has an empty set
    and no links. Rows without doc_id are left out; rows that share a doc_id
    are one document that has all their links. Other columns don't matter.

    A shingle in more than ``share`` of the documents is frequent: it comes last
    in the order of the second round, which changes the work but not the result.
    """
    spark = ready(docs.sparkSession)
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    profile = stage(texts.mapInArrow(_profile(k, share), "doc_id long, n_shingles long, sum1 long, sum2 long, mins array<long>"), "jaccard-profile")
    sized = profile.where("doc_id is not null")
    # Equal sets are one from here on, under the smallest id.
    kinds = sized.where("n_shingles > 0").groupBy("n_shingles", "sum1", "sum2").agg(F.min("doc_id").alias("kind"), F.min("mins").alias("mins"))
    kinds = stage(kinds, "jaccard-kinds")
    buckets = kinds.select(F.col("kind").alias("doc_id"), F.posexplode("mins").alias("seed", "value"))
    shared = buckets.groupBy("seed", "value").agg(F.count("*").alias("n")).where("n > 1")
    # A large bucket is cut in chunks, differently for each seed.
    members = buckets.join(shared, ["seed", "value"]).select(
        "doc_id", F.xxhash64("seed", "value", F.pmod(F.xxhash64("doc_id", "seed"), F.ceil(F.col("n") / CHUNK).cast("int"))).alias("group")
    )
    wanted = members.groupBy("doc_id").agg(F.collect_set("group").alias("groups"))
    rows = texts.join(wanted, "doc_id").select(F.explode("groups").alias("group"), "doc_id", F.col("doc_id").alias("label"), "text")
    first = components(_searched(rows, k, percent), "jaccard-links")
    first = stage(kinds.select(F.col("kind").alias("node"), "n_shingles").join(first, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-first")

    often = profile.where("doc_id is null").groupBy("sum1").agg(F.sum("n_shingles").alias("times"))
    # At most average size / share of them: the bound doesn't grow with the rows.
    floor = share * max(1, sized.count())
    frequent = np.array(sorted(np.array([r.sum1 for r in often.where(F.col("times") >= floor).select("sum1").collect()], dtype=np.int64).view(np.uint64)), dtype=np.uint64)
    spans = first.groupBy("component").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"), F.count("*").alias("n"))
    sides = first.select(F.col("node").alias("doc_id"), "component")
    parts = _parts(texts, sides, k, percent, frequent).join(spans, "component")
    pairs = _candidates(parts, percent)
    big, small = F.when(F.col("nx") >= F.col("ny"), F.col("x")), F.when(F.col("nx") >= F.col("ny"), F.col("y"))
    pairs = pairs.select(big.otherwise(F.col("y")).alias("big"), small.otherwise(F.col("x")).alias("small"), F.greatest("nx", "ny").alias("n"))
    pairs = stage(pairs.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), "jaccard-pairs")
    # The larger side is cut in chunks, and so are the many that it meets.
    side = F.pmod(F.xxhash64("small"), F.lit(64)).cast("int")
    of_big = pairs.groupBy("big", "chunks").agg(F.collect_set(side).alias("sides"))
    group = lambda chunk: F.xxhash64("big", "side", chunk).alias("group")
    bigs = of_big.join(first, F.col("big") == F.col("component")).select("node", "component", "big", F.explode("sides").alias("side"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    bigs = bigs.select("node", "component", group("chunk"))
    smalls = pairs.withColumn("side", side).join(first, F.col("small") == F.col("component"))
    smalls = smalls.select("node", "component", "big", "side", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select("node", "component", group("chunk"))
    wanted = bigs.union(smalls).groupBy("node", "component").agg(F.collect_set("group").alias("groups"))
    rows = texts.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id").select(F.explode("groups").alias("group"), "doc_id", F.col("component").alias("label"), "text")
    second = _searched(rows, k, percent)
    of_doc = sized.join(kinds.select("n_shingles", "sum1", "sum2", "kind"), ["n_shingles", "sum1", "sum2"], "left")
    of_doc = of_doc.join(first.select(F.col("node").alias("kind"), "component"), "kind", "left")
    own = F.coalesce("component", "doc_id")
    labelled = of_doc.select("doc_id", "n_shingles", own.alias("component"))
    joined = components(
        second.join(first.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
        .join(first.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        .select(F.col("x").alias("a"), F.col("y").alias("b")),
        "jaccard-second",
    ).withColumnRenamed("component", "final")
    out = labelled.join(joined.withColumnRenamed("node", "component"), "component", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("final", "component").alias("component_id"))


def near_duplicates_removed(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group. Rows without
    doc_id stay; of rows that share a doc_id, all stay or go together."""
    groups = jaccard_groups(docs, k, percent)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
