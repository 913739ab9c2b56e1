"""Language identification by unigrams of pieces, marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A
word's likelihood is the sum over all ways to cut it into pieces (the forward
algorithm), a text's the product over its words. Words are runs of letters of
the lower-cased text. Piece probabilities are fitted by expectation maximisation
on a bounded sample of labelled rows, whose runs of over 64 bytes are cut there to
learn from; every text is scored whole, its runs of any length uncut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.llm.words import Slice, ranges, ready, span_hashes, word_slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNDETERMINED = "und"
#: Runs of the sample that is learnt from are cut after so many bytes.
LONGEST_RUN = 64
CACHED_WORDS = 200_000
#: Bytes of the words that are scored at a time; a longer word is scored alone.
CELLS = 100_000
ROWS = 1000

#: Bytes that end a run of letters: ASCII other than a-z.
OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[ord("a") : ord("z") + 1] = False
OUTSIDE[0x80:] = False


class Vocabulary:
    """Pieces as a trie of arrays: ``step[node, byte class]`` and ``piece[node]``.

    Pieces are lower-cased; a leading blank marks the start of a word. Every
    single byte is a piece, so every word has a segmentation.
    """

    def __init__(self, path: str = VOCABULARY):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        pieces = {text.replace("▁", " ").lower().encode() for text in texts}
        pieces = {p for p in pieces if b" " not in p[1:] and not OUTSIDE[list(p.lstrip(b" "))].any()}
        pieces |= {bytes([b]) for b in range(256)}
        self.pieces = sorted(pieces)
        self.longest = max(map(len, self.pieces))
        used = sorted({b for p in self.pieces if len(p) > 1 for b in p})
        self.byte_class = np.zeros(256, dtype=np.int64)
        self.byte_class[used] = np.arange(1, len(used) + 1)
        nodes: list[dict[int, int]] = [{}]
        piece = [-1]
        for number, text in enumerate(self.pieces):
            if len(text) == 1:
                continue
            at = 0
            for b in text:
                to = nodes[at].get(b)
                if to is None:
                    to = nodes[at][b] = len(nodes)
                    nodes.append({})
                    piece.append(-1)
                at = to
            piece[at] = number
        self.step = np.zeros((len(nodes), len(used) + 1), dtype=np.int32)
        for at, edges in enumerate(nodes):
            for b, to in edges.items():
                self.step[at, self.byte_class[b]] = to
        self.piece = np.array(piece, dtype=np.int32)
        self.single = np.array([self.pieces.index(bytes([b])) for b in range(256)], dtype=np.int32)

    def lattice(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces): the pieces that fit in rows of equally long words."""
        count, length = words.shape
        every = np.arange(count)
        for start in range(length):
            yield start, start + 1, every, self.single[words[:, start]]
            rows, node = every, np.zeros(count, dtype=np.int32)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                node = self.step[node, self.byte_class[words[rows, end - 1]]]
                alive = node > 0
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                piece = self.piece[node]
                fits = piece >= 0
                if end > start + 1 and fits.any():
                    yield start, end, rows[fits], piece[fits]

    def log_likelihood(self, words: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Forward algorithm: log of the sum over all segmentations, words x languages.

        Sums are held of as many positions as the longest piece can reach.
        """
        count, length = words.shape
        width = self.longest + 1
        ahead = np.zeros((width, count, table.shape[1]))
        ahead[0] = 1.0
        scale = np.zeros((count, table.shape[1]))
        for start, end, rows, pieces in self.lattice(words):
            if end == start + 1:
                if start:
                    ahead[(start - 1) % width] = 0.0
                if start and start % 12 == 0:
                    top = ahead.max(axis=0)
                    ahead /= top
                    scale += np.log(top)
                now = ahead[start % width]
            if len(rows) == count:
                ahead[end % width] += now * table[pieces]
            else:
                ahead[end % width, rows] += now[rows] * table[pieces]
        return np.log(ahead[length % width]) + scale

    def expected(self, words: np.ndarray, weights: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of weighted words."""
        count, length = words.shape
        lattice = list(self.lattice(words))
        forward = np.zeros((length + 1, count))
        backward = np.zeros((length + 1, count))
        forward[0] = backward[length] = 1.0
        for start, end, rows, pieces in lattice:
            forward[end, rows] += forward[start, rows] * table[pieces]
        for start, end, rows, pieces in reversed(lattice):
            backward[start, rows] += backward[end, rows] * table[pieces]
        uses = np.zeros(len(table))
        share = weights / forward[length]
        for start, end, rows, pieces in lattice:
            np.add.at(uses, pieces, forward[start, rows] * table[pieces] * backward[end, rows] * share[rows])
        return uses


def _runs(column: pa.Array):
    """Slices of the lower-cased texts with their runs of letters."""
    for first in range(0, len(column), ROWS):
        for part in word_slices(pc.utf8_lower(column.slice(first, ROWS)), outside=OUTSIDE):
            part.first += first
            yield part


def _cut(part: Slice) -> Slice:
    """The slice with its long runs cut."""
    sizes = part.ends - part.starts
    if len(sizes) and sizes.max() > LONGEST_RUN:
        pieces = -(-sizes // LONGEST_RUN)
        before = np.concatenate([[0], np.cumsum(pieces)])
        starts = np.repeat(part.starts, pieces) + LONGEST_RUN * ranges(np.zeros(len(pieces), np.int64), pieces)
        part.ends = np.minimum(starts + LONGEST_RUN, np.repeat(part.ends, pieces))
        part.starts, part.words = starts, before[part.words]
    return part


def _by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(positions, words as a matrix of bytes with a leading blank) for each length."""
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        for some in np.array_split(own, -(-len(own) * (int(sizes[own[0]]) + 1) // CELLS)):
            if len(some):
                words = np.full((len(some), sizes[some[0]] + 1), 0x20, dtype=np.uint8)
                words[:, 1:] = data[starts[some][:, None] + np.arange(sizes[some[0]])]
                yield some, words


def fit_pieces(texts: list[list[str]], vocabulary: Vocabulary, rounds: int = 3, smooth: float = 0.1) -> np.ndarray:
    """Piece probabilities, pieces x languages, from the texts of each language."""
    columns = []
    for own in texts:
        kept = []
        for part in map(_cut, _runs(pa.array(own, pa.string()))):
            hashes = span_hashes(part.data, part.starts, part.ends)
            _, first, count = np.unique(hashes, return_index=True, return_counts=True)
            kept += [(words, count[at]) for at, words in _by_length(part.data, part.starts[first], part.ends[first])]
        table = np.array([0.02 ** (len(p) == 1) for p in vocabulary.pieces])
        table /= table.sum()
        for _ in range(rounds):
            uses = np.full(len(table), smooth)
            for words, weights in kept:
                uses += vocabulary.expected(words, weights, table)
            table = uses / uses.sum()
        columns.append(table)
    return np.stack(columns, axis=1)


class Scorer:
    """Log likelihoods of whole texts; those of recent words are kept."""

    def __init__(self, vocabulary: Vocabulary, table: np.ndarray):
        self.vocabulary, self.table = vocabulary, table
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros((0, table.shape[1]))

    def words(self, data, hashes, starts, ends) -> np.ndarray:
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        hit = self.known[at] == unique if len(self.known) else np.zeros(len(unique), bool)
        scores = np.empty((len(unique), self.table.shape[1]))
        scores[hit] = self.scores[at[hit]]
        new = np.flatnonzero(~hit)
        for own, words in _by_length(data, starts[first[new]], ends[first[new]]):
            scores[new[own]] = self.vocabulary.log_likelihood(words, self.table)
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known, self.scores = np.zeros(0, np.uint64), np.zeros((0, self.table.shape[1]))
            new = np.arange(len(unique))[:CACHED_WORDS]
        known = np.concatenate([self.known, unique[new]])
        order = np.argsort(known)
        self.known, self.scores = known[order], np.concatenate([self.scores, scores[new]])[order]
        return scores[inverse]

    def texts(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), self.table.shape[1]))
        for part in _runs(column):
            if len(part.starts):
                hashes = span_hashes(part.data, part.starts, part.ends)
                scores = self.words(part.data, hashes, part.starts, part.ends)
                total = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)])
                out[part.first : part.first + part.size] = total[part.words[1:]] - total[part.words[:-1]]
        return out


def training_rows(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text): the rows of each language with the smallest hashes of their ids,
    at most ``per_language``, of those outside the held-out quarter."""
    rows = docs.where("lang is not null and text is not null").where(~held_out()).select("doc_id", "lang")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language).select("doc_id", "lang")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "text")


def held_out():
    """Rows whose labels nothing is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_language: int = 300, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with ``held_out``, ``lang_pred``, ``score``.

    ``score`` is the posterior of the predicted language under equal priors. A
    text that is null or has no letter, and every text where no row has a
    language to learn, gets ``und`` and 0. Other columns pass through; columns
    of the added names are replaced. Fitting reads at most ``per_language`` rows
    of each language; ties in the posterior go to the first language in order.
    """
    ready(docs.sparkSession)
    docs = docs.drop("held_out", "lang_pred", "score")
    sample = sorted(training_rows(docs, per_language).collect(), key=lambda r: r.doc_id)
    languages = sorted({r.lang for r in sample})
    words = Vocabulary(vocabulary)
    table = fit_pieces([[r.text for r in sample if r.lang == x] for x in languages], words) if languages else None

    def score(batches):
        scorer = Scorer(words, table) if languages else None
        for batch in batches:
            text = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names = np.full(len(text), UNDETERMINED, dtype=object)
            best = np.zeros(len(text))
            if languages:
                logs = scorer.texts(text)
                top = logs.argmax(axis=1)
                best = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                names = np.where(letters, np.array(languages, dtype=object)[top], UNDETERMINED)
                best = np.where(letters, best, 0.0)
            yield batch.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(best))

    rows = docs.withColumn("held_out", held_out())
    return rows.mapInArrow(score, T.StructType([*rows.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
