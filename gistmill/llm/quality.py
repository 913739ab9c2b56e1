"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed terms: trigrams of character classes, which show its
form, and words, with two terms for how much it repeats itself. Weighted by
inverse document frequency and projected on the leading singular vectors of a
labelled sample, it is a short unit vector. The labelled vectors, a bounded
number, go to every task; each document is compared with all of them in blocked
matrix products, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.llm.words import ready, shingles, word_slices

FORMS = 16**3
WORDS = 2048
TERMS = FORMS + WORDS + 2
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.7

#: Classes of bytes; letters of other scripts count as lower case.
CLASS = np.full(256, 15, dtype=np.int64)
for _number, _members in enumerate(["\n", "\t\r \x0b\x0c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!?", ";:", "'\"", "()[]{}", "|/\\", "*#", "%&", "$@"]):
    CLASS[[ord(c) for c in _members]] = _number
CLASS[0x80:] = 2


def terms(column: pa.Array) -> np.ndarray:
    """Texts x TERMS: square roots of the terms' shares in each whole text."""
    out = np.zeros((len(column), TERMS), dtype=np.float32)
    for part in word_slices(column, 1_000_000):
        n = part.size
        codes = CLASS[part.data]
        own = np.zeros((n, FORMS + WORDS))
        sizes = np.diff(part.rows)
        if len(codes) > 2:
            grams = codes[:-2] * 256 + codes[1:-1] * 16 + codes[2:]
            row = np.repeat(np.arange(n), sizes)
            inside = row[:-2] == row[2:]
            counts = np.bincount(row[:-2][inside] * FORMS + grams[inside], minlength=n * FORMS).reshape(n, FORMS)
            own[:, :FORMS] = counts / np.maximum(1, sizes - 2)[:, None]
        hashes = part.hashes()
        row, many = part.row_of_word(), np.diff(part.words)
        counts = np.bincount(row * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        own[:, FORMS:] = counts / np.maximum(1, many)[:, None]
        out[part.first : part.first + n, : FORMS + WORDS] = np.sqrt(own)
        values, offsets = shingles(part, hashes, 3)
        for i in np.flatnonzero(many > 5):
            some = values[offsets[i] : offsets[i + 1]]
            fresh = len(np.unique(some)) / len(some)
            out[part.first + i, -2:] = np.sqrt(1 - fresh), np.sqrt(fresh)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


class Voter:
    """Labelled unit vectors in latent space and the projection to it."""

    def __init__(self, texts: list[str], labels: list[int]):
        x = terms(pa.array(texts, pa.string()))
        self.weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        x = _unit(x * self.weight)
        # Leading right singular vectors, by way of the smaller Gram matrix.
        values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
        top = np.argsort(values)[::-1][: min(RANK, len(x))]
        top = top[values[top] > 1e-8]
        self.project = (x.T @ (left[:, top] / np.sqrt(values[top]))).astype(np.float32)
        self.vectors = _unit(x @ self.project)
        self.labels = np.array(labels, dtype=np.float64)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first in range(0, len(column), 512):
            some = column.slice(first, 512)
            near = _unit(_unit(terms(some) * self.weight) @ self.project) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(near, best, axis=1), 1e-3).astype(np.float64) ** SHARPNESS
            out[first : first + len(some)] = (vote * self.labels[best]).sum(axis=1) / vote.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def held_out():
    """Rows whose labels nothing is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``held_out``, ``score`` and ``predicted``.

    Learns from the ``sample`` labelled rows of smallest hash, of those that are
    not held out and have a label 0 or 1; of several labels of a doc_id the
    smallest counts. Texts that are null or empty are scored as the empty text.
    With no label to learn from, scores are 0.5. Other columns pass through;
    columns named like the added ones are replaced.
    """
    ready(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.join(docs.select("doc_id").where("text is not null").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    learnt = sorted(rows.collect(), key=lambda r: r.doc_id)
    voter = Voter([r.text for r in learnt], [r.quality for r in learnt]) if learnt else None

    def score(batches):
        for batch in batches:
            scores = voter.scores(batch.column("text")) if voter else np.full(batch.num_rows, 0.5)
            yield batch.append_column("score", pa.array(scores)).append_column("predicted", pa.array((scores >= THRESHOLD).astype(np.int32)))

    rows = docs.withColumn("held_out", held_out())
    return rows.mapInArrow(score, T.StructType([*rows.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
