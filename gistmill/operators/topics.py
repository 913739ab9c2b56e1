"""Topic models of groups of texts, and the keyword table used in scoring."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.functions import text as tx
from gistmill.operators.terms import sentence_place
from gistmill.session import ship, small_side, spread, stage

#: Words of a block of texts in a topic fit, and candidates looked at in one piece.
BLOCK_WORDS = 250_000
BLOCK_CELLS = 100_000
#: Most parts that the terms of a group are merged in, and most tasks of a draw.
TERM_PARTS = 512
DRAW_TASKS = 4096


class TopicModel(NamedTuple):
    topics: DataFrame | None  # keys, topic int, terms array<string>
    keywords: DataFrame  # keys, term string, topics array<int>, and n_topics of the group if it has keys
    n_topics: int | None  # of all groups, where there is one model
    weights: DataFrame | None = None  # keys, n_topics, topic, term, weight: how often a term has the topic
    fits: tuple[float, ...] = ()  # per round, the mean log weight of the topics terms had before it


def topic_terms(df: DataFrame, text: str, name: str = "words") -> DataFrame:
    return df.withColumn(name, tx.stems(tx.topic_words(text)))


def fit_topics(
    df: DataFrame, text: str, keys: Sequence[str] = (), n_topics: int | None = None, n_keywords: int | None = None,
    seed: int = 42, max_iter: int = 12, tolerance: float = 0.02,
) -> TopicModel:
    """Topics of each group of texts, all groups at once; without ``keys`` one
    model of the whole table.

    Without ``n_topics`` a group has one topic per five texts, and groups of fewer
    than five have none; a topic has ``n_keywords`` terms, or ``4 + topics / 5``.
    The model is latent Dirichlet allocation by sampling: every term of a text has
    a topic, redrawn in each round among those of its text and one more, in
    proportion to their weights in text and term. Weights are tables keyed by group,
    text, topic and term, so neither vocabulary nor topics have a limit. Draws come
    from hashes, so a run repeats.

    Rounds end once the mean log weight of the topics that terms have has grown by
    less than ``tolerance`` of itself since the round before, or after ``max_iter``;
    the last one takes the best topics instead of drawing.
    """
    ship(df.sparkSession)
    whole, keys = not keys, list(keys) or ["_one"]
    if whole:
        df = df.select(F.lit(0).alias("_one"), text)
    row = F.struct(F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("number")).alias("doc")
    words = stage(topic_terms(spread(df.select(*keys, text).filter(F.col(text).isNotNull())).select(*keys, row, text), text).select(*keys, "doc", "words"), "words")
    sizes = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("_texts"), F.sum(F.size("words")).alias("_words"))
    many = F.floor(F.col("_texts") / 5) if n_topics is None else F.lit(n_topics)
    terms = F.floor(4 + F.col("n_topics") / 5) if n_keywords is None else F.lit(n_keywords)
    sizes = sizes.withColumn("n_topics", many.cast("int")).filter("n_topics >= 1").withColumn("_terms", terms.cast("int"))
    sizes = sizes.withColumn("_blocks", F.ceil(F.col("_words") / F.lit(BLOCK_WORDS)).cast("int") + 1).drop("_texts")
    sizes = small_side(sizes, "topic-sizes")
    # Blocks are few and take long, so a draw has more tasks than their bytes call for.
    n_blocks, n_words = sizes.agg(F.sum("_blocks"), F.sum("_words")).first()
    tasks = max(1, min(n_blocks or 0, 4 * (n_words or 0) // BLOCK_WORDS + 1, DRAW_TASKS))
    sizes = sizes.drop("_words")
    one = sizes.first() if whole else None
    if whole and one is None:
        raise ValueError("a topic model needs at least one topic, that is five texts")
    # A text's terms meet the weights of their group in blocks of texts, once per
    # block and term; terms of a text never become rows of candidates.
    place = [*keys, "_block"]
    block = F.pmod(F.xxhash64("doc.hash", "doc.number"), "_blocks").cast("int").alias("_block")
    filed = words.filter(F.size("words") > 0).join(sizes, keys).select(*keys, block, "n_topics", F.least("_blocks", F.lit(TERM_PARTS)).alias("_parts"), "doc.hash", "words", F.array_distinct("words").alias("terms"))
    filed = filed.select(*place, "n_topics", "_parts", "words", "terms", F.transform("terms", lambda t: F.xxhash64("hash", t)).alias("hashes"))
    fields = [words.schema[k] for k in keys]
    block_type = T.StructType([*fields, *T.StructType.fromDDL(_BLOCK)])
    state_type = T.StructType([*fields, *T.StructType.fromDDL(_STATE)])
    blocks = stage(filed.groupBy(*place).applyInArrow(_number_terms(place), block_type), "topic-blocks")
    places = stage(blocks.filter("number = -1").select(*place), "topic-places")
    met = df.sparkSession.createDataFrame([], state_type)
    fits: list[float] = []
    last = False
    for turn in range(max_iter + 1):
        last = turn > 0 and (last or turn == max_iter)
        sides = (x.repartition(tasks, *place).groupBy(*place) for x in (blocks, met))
        drawn = next(sides).cogroup(next(sides)).applyInArrow(_redraw(place, seed, turn, last), state_type)
        state = stage(drawn, "topic-state")
        if turn:
            fits.append(state.filter(f"kind = {_FIT}").agg(F.sum("fit") / F.sum("number")).first()[0] or 0.0)
        if last:
            break
        last = len(fits) > 1 and fits[-1] - fits[-2] < tolerance * abs(fits[-2])
        met = _weights_of_blocks(state, keys, places)
    per_group = [*keys, "n_topics", "_terms"]
    counted = state.filter(f"kind = {_TERM}").select(*keys, F.col("names")[0].alias("term"), F.inline(F.arrays_zip(F.col("topics").alias("topic"), F.col("counts").alias("n"))))
    given = counted.join(sizes.drop("_blocks"), keys)
    found = stage(given.groupBy(*per_group, "topic", "term").agg(F.sum("n").cast("double").alias("weight")), "topic-weights")
    # Where a topic has too few terms, the group's most frequent ones follow.
    common = found.groupBy(*per_group, "term").agg(F.sum("weight").cast("long").alias("_n"))
    if whole:
        common = common.orderBy(F.desc("_n"), "term").limit(2 * one._terms)
    common = common.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "term"))).filter("_at <= 2 * _terms")
    fill = common.select(*per_group, F.explode(F.sequence(F.lit(0), F.col("n_topics") - 1)).alias("topic"), "term", (0.01 / F.col("_at")).alias("weight"))
    weighed = found.unionByName(fill).groupBy(*per_group, "topic", "term").agg(F.sum("weight").alias("weight"))
    best = Window.partitionBy(*keys, "topic").orderBy(F.desc("weight"), "term")
    listed = weighed.withColumn("_at", F.row_number().over(best)).filter("_at <= _terms")
    listed = listed.groupBy(*keys, "n_topics", "topic").agg(F.array_sort(F.collect_list(F.struct("_at", "term"))).alias("_listed"))
    topics = stage(listed.select(*keys, "n_topics", "topic", F.transform("_listed", lambda x: x["term"]).alias("terms")), "topics")
    found = found.drop("_terms")
    if whole:
        topics = topics.drop("_one")
        return TopicModel(topics.drop("n_topics"), keyword_map(topics), one.n_topics, found.drop("_one"), tuple(fits))
    return TopicModel(topics.drop("n_topics"), keyword_map(topics, [*keys, "n_topics"]), None, found, tuple(fits))


# Tables of a topic fit. A block has one row with its terms and the part that each is
# merged in, at number -1, and one per text. Its state has rows of four kinds, of which
# the first goes to the next round. Terms of a part are one row, since rows cost more than
# what they hold; only the last draw has a row per term.
_BLOCK = "_block int, number long, n_topics int, vocabulary array<string>, terms array<int>, times array<int>, hashes array<long>"
_STATE = "_block int, kind int, number long, names array<string>, sizes array<int>, topics array<int>, counts array<long>, kinds array<long>, fit double"
_TEXT, _TERM, _TOTAL, _FIT = range(4)


def _weights_of_blocks(state: DataFrame, keys: Sequence[str], places: DataFrame) -> DataFrame:
    """What each block (of ``places``) needs for the next draw: its texts' topics, the
    weights of its terms in all blocks of the group, and the totals of the group's topics."""
    keys = list(keys)
    mine = state.filter(f"kind = {_TERM}").groupBy(*keys, "number")
    merged = stage(mine.applyInArrow(_merge_terms(keys), state.schema), "topic-terms")
    totals = merged.filter(f"kind = {_TOTAL}").select(*keys, F.inline(F.arrays_zip("topics", "counts", "kinds")))
    totals = totals.groupBy(*keys, "topics").agg(F.sum("counts").alias("counts"), F.sum("kinds").alias("kinds"))
    totals = totals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("topics", "counts", "kinds"))).alias("all")).join(places, keys)
    part = lambda name: F.transform("all", lambda x: x[name])
    held = {"_block": F.col("_block"), "kind": F.lit(_TOTAL)} | {c: part(c) for c in ("topics", "counts", "kinds")}
    totals = totals.select(*keys, *(held.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in state.schema.fields if f.name not in keys))
    return state.filter(f"kind = {_TEXT}").unionByName(merged.filter(f"kind = {_TERM}")).unionByName(totals)


def _rows(given: dict, size: int, own: dict):
    """A table of a block's state of ``size`` rows: the given columns, and ``own`` values in all of them."""
    import pyarrow as pa

    kinds = {
        "number": pa.int64(), "names": pa.list_(pa.string()), "sizes": pa.list_(pa.int32()), "topics": pa.list_(pa.int32()),
        "counts": pa.list_(pa.int64()), "kinds": pa.list_(pa.int64()), "fit": pa.float64(),
    }
    columns = [pa.repeat(x, size) for x in own.values()]
    return pa.table([*columns, *(given[c] if c in given else pa.nulls(size, t) for c, t in kinds.items())], names=[*own, *kinds])


def _gather(starts, sizes):
    """Places of runs, one run after the other."""
    import numpy as np

    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _merge_terms(keys: Sequence[str]):
    """Arrow function: the rows of a part of a group's terms, one per block, to rows with
    the counts of their terms in all blocks, in the same order, and the part's totals."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = lambda name: table.column(name).combine_chunks().flatten()
        numbers = lambda name: flat(name).to_numpy(zero_copy_only=False).astype(np.int64)
        names, terms = flat("names").dictionary_encode(), pc.list_value_length(table.column("names")).to_numpy()
        term, topics, counts = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), numbers("topics"), numbers("counts")
        wide = int(topics.max(initial=0)) + 1
        cell, which = np.unique(np.repeat(term, numbers("sizes")) * wide + topics, return_inverse=True)
        sums = np.zeros(len(cell), dtype=np.int64)
        np.add.at(sums, which, counts)
        edges = np.searchsorted(cell, np.arange(len(names.dictionary) + 1) * wide)
        size = np.diff(edges)[term]
        at = _gather(edges[:-1][term], size)
        ends = np.concatenate([[0], np.cumsum(terms)])
        lists = lambda values, ends, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
        cells = np.concatenate([[0], np.cumsum(size)])[ends]
        own = {c: pa.scalar(k.as_py(), table.schema.field(c).type) for c, k in zip(keys, key)}
        of_terms = _rows(
            {"number": table.column("number"), "sizes": lists(size, ends, pa.int32()), "topics": lists((cell % wide)[at], cells, pa.int32()), "counts": lists(sums[at], cells, pa.int64())},
            table.num_rows, own | {"_block": pa.scalar(0, pa.int32()), "kind": pa.scalar(_TERM, pa.int32())})
        of_terms = of_terms.set_column(len(own), "_block", table.column("_block"))
        topic, which = np.unique(cell % wide, return_inverse=True)
        total = np.zeros(len(topic), dtype=np.int64)
        np.add.at(total, which, sums)
        whole = [0, len(topic)]
        totals = _rows(
            {"topics": lists(topic, whole, pa.int32()), "counts": lists(total, whole, pa.int64()), "kinds": lists(np.bincount(which), whole, pa.int64())},
            1, own | {"_block": pa.scalar(-1, pa.int32()), "kind": pa.scalar(_TOTAL, pa.int32())})
        return pa.concat_tables([of_terms, totals])

    return run


def _number_terms(place: Sequence[str]):
    """Arrow function: the texts of a block to its terms and, per text, the numbers of
    its terms among them, how often it has them, and their hashes."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.combine_chunks()
        n = table.num_rows
        words, terms, hashes = (table.column(c).combine_chunks() for c in ("words", "terms", "hashes"))
        vocabulary = pc.unique(terms.flatten())
        vocabulary = vocabulary.take(pc.array_sort_indices(vocabulary))
        rows = lambda lists: np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        code = lambda lists: rows(lists) * len(vocabulary) + pc.index_in(lists.flatten(), vocabulary).to_numpy(zero_copy_only=False)
        found, times = np.unique(code(words), return_counts=True)
        order = np.argsort(code(terms))
        offsets = np.searchsorted(found, np.arange(n + 1) * len(vocabulary)).astype(np.int32)
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
        n_parts = table.column("_parts")[0].as_py()
        parts = pa.array([zlib.crc32(x.encode()) % n_parts for x in vocabulary.to_pylist()], pa.int32())
        whole = pa.array([0, len(vocabulary)], pa.int32())
        first = {
            "number": pa.array([-1], pa.int64()), "vocabulary": pa.ListArray.from_arrays(whole, vocabulary), "terms": pa.ListArray.from_arrays(whole, parts),
        }
        texts = {
            "number": pa.array(np.arange(n)), "terms": lists(found % len(vocabulary), pa.int32()), "times": lists(times, pa.int32()),
            "hashes": lists(hashes.flatten().to_numpy(zero_copy_only=False)[order], pa.int64()),
        }
        names = ["number", "n_topics", "vocabulary", "terms", "times", "hashes"]
        kinds = {"number": pa.int64(), "n_topics": pa.int32(), "vocabulary": pa.list_(pa.string()), "terms": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "hashes": pa.list_(pa.int64())}
        own = {c: pa.scalar(k.as_py(), table.schema.field(c).type) for c, k in zip(place, key)}

        def rows_of(given, size):
            given["n_topics"] = table.column("n_topics").combine_chunks()[:1].take(pa.array(np.zeros(size, np.int64)))
            columns = [pa.repeat(own[c], size) for c in place] + [given[c].cast(kinds[c]) if c in given else pa.nulls(size, kinds[c]) for c in names]
            return pa.table(columns, names=[*place, *names])

        return pa.concat_tables([rows_of(first, 1), rows_of(texts, n)])

    return run


def _hash_int(seed, value):
    """What ``xxhash64`` gives for one more int column after those hashed to ``seed``."""
    import numpy as np

    u = np.uint64
    out = (seed + u(0x27D4EB2F165667C5 + 4)) ^ ((np.atleast_1d(value).astype(np.uint64) & u(0xFFFFFFFF)) * u(0x9E3779B185EBCA87))
    part = out >> u(41)
    out <<= u(23)
    out |= part
    out *= u(0xC2B2AE3D27D4EB4F)
    out += u(0x165667B19E3779F9)
    for shift, factor in ((33, 0xC2B2AE3D27D4EB4F), (29, 0x165667B19E3779F9), (32, 1)):
        np.right_shift(out, u(shift), out=part)
        out ^= part
        if factor > 1:
            out *= u(factor)
    return out


def _redraw(place: Sequence[str], seed: int, turn: int, last: bool):
    """Cogroup function: a block of texts and the weights it needs, to its next state.
    At turn 0 there are no weights, and topics are drawn evenly."""
    most = BLOCK_CELLS

    def run(key, block, met):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = lambda table, name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        offsets = lambda table, name: np.concatenate([[0], np.cumsum(pc.list_value_length(table.column(name)).to_numpy())]).astype(np.int64)
        of_kind = lambda kind: met.filter(pc.equal(met.column("kind"), kind))
        block = block.sort_by("number")
        vocabulary = block.slice(0, 1).column("vocabulary").combine_chunks().flatten()
        parts = flat(block.slice(0, 1), "terms")
        by_part = np.argsort(parts, kind="stable")
        texts = block.slice(1)
        n_topics = block.column("n_topics")[0].as_py()
        term, times, starts = flat(texts, "terms").astype(np.int64), flat(texts, "times").astype(np.float64), offsets(texts, "terms")
        hashes = flat(texts, "hashes").view(np.uint64)
        uneven = lambda salt: np.mod(_hash_int(hashes, seed * 1000 + salt).view(np.int64), n_topics)
        fit = 0.0
        if turn == 0:
            topic = uneven(0)
        else:
            had = flat(of_kind(_TEXT).sort_by("number"), "topics").astype(np.int64)
            terms, totals = of_kind(_TERM).sort_by("number"), of_kind(_TOTAL)
            row_size, row_start = np.empty(len(vocabulary), dtype=np.int64), np.empty(len(vocabulary), dtype=np.int64)
            row_size[by_part] = flat(terms, "sizes")
            row_start[by_part] = np.cumsum(row_size[by_part]) - row_size[by_part]
            at = _gather(row_start, row_size)
            row_topic, row_count = flat(terms, "topics")[at].astype(np.int64), flat(terms, "counts")[at].astype(np.float64)
            row_start = np.cumsum(row_size) - row_size
            cells = np.repeat(np.arange(len(row_size)), row_size) * n_topics + row_topic
            in_all, kinds = np.zeros(n_topics), np.zeros(n_topics)
            in_all[flat(totals, "topics")] = flat(totals, "counts")
            kinds[flat(totals, "topics")] = flat(totals, "kinds")
            of_topic = np.log(in_all + 0.01 * (kinds + 1))

            def chance(tokens, topics):
                if last:
                    return 0.0
                drawn = _hash_int(_hash_int(tokens, topics), seed * 1000 + 500 + turn).view(np.int64)
                return -np.log(-np.log((np.mod(drawn, 1 << 30) + 0.5) / float(1 << 30)))

            # One topic more than those of the text.
            more = uneven(turn)
            at = np.minimum(np.searchsorted(cells, term * n_topics + more), len(cells) - 1)
            held = np.where(cells[at] == term * n_topics + more, row_count[at], 0.0)
            more_weight = np.log(0 + 1 / n_topics) + np.log(held + 0.01) - of_topic[more] + chance(hashes, more)
            topic = np.empty(len(term), dtype=np.int64)
            position = np.full(n_topics, -1, dtype=np.int64)
            for begin, end in zip(starts[:-1], starts[1:]):
                own, had_at = np.unique(had[begin:end], return_inverse=True)
                in_text = np.log(np.bincount(had_at, weights=times[begin:end]) + 1 / n_topics)
                position[own] = np.arange(len(own))
                wide = max(1, most // (len(own) + 1))
                for a in range(begin, end, wide):
                    b = min(end, a + wide)
                    size = row_size[term[a:b]]
                    gathered = np.repeat(row_start[term[a:b]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    column = position[row_topic[gathered]]
                    shared = column >= 0
                    in_term = np.zeros((b - a, len(own)))
                    in_term[np.repeat(np.arange(b - a), size)[shared], column[shared]] = row_count[gathered[shared]]
                    weight = in_text + np.log(in_term + 0.01) - of_topic[own]
                    fit += float(times[a:b] @ weight[np.arange(b - a), had_at[a - begin : b - begin]])
                    weight = weight + chance(hashes[a:b, None], own[None, :])
                    best = weight.argmax(axis=1)
                    top, kept = weight[np.arange(b - a), best], own[best]
                    better = (more_weight[a:b] > top) | ((more_weight[a:b] == top) & (more[a:b] < kept))
                    topic[a:b] = np.where(better, more[a:b], kept)
                position[own] = -1
        cell, which = np.unique(term * n_topics + topic, return_inverse=True)
        counts = np.bincount(which, weights=times, minlength=len(cell)).astype(np.int64)
        edges = np.searchsorted(cell, np.arange(len(vocabulary) + 1) * n_topics)
        size = np.diff(edges)[by_part]
        at = _gather(edges[:-1][by_part], size)
        # The terms of a part are one row, those of the last draw one each.
        part, ends = np.unique(np.arange(len(parts)) if last else parts[by_part], return_index=True)
        ends = np.append(ends, len(parts))
        cells = np.concatenate([[0], np.cumsum(size)])[ends]
        lists = lambda values, at, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
        names = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), vocabulary.take(pa.array(by_part)))
        made = (
            (_TEXT, len(texts), {"number": texts.column("number").combine_chunks(), "topics": lists(topic, starts, pa.int32())}),
            (_TERM, len(part), {
                "number": pa.array(part, pa.int64()), "names": names, "sizes": lists(size, ends, pa.int32()),
                "topics": lists((cell % n_topics)[at], cells, pa.int32()), "counts": lists(counts[at], cells, pa.int64())}),
            (_FIT, 1, {"number": pa.array([int(times.sum())], pa.int64()), "fit": pa.array([fit], pa.float64())}),
        )
        own = {c: pa.scalar(k.as_py(), block.schema.field(c).type) for c, k in zip(place, key)}
        return pa.concat_tables([_rows(given, rows, own | {"kind": pa.scalar(kind, pa.int32())}) for kind, rows, given in made])

    return run


def perplexity(
    weights: DataFrame, words: DataFrame, keys: Sequence[str] = (), rounds: int = 10, alpha: float = 0.1, beta: float = 0.01,
) -> DataFrame:
    """``n_terms, perplexity`` of texts a model has not seen, per group: how many
    terms are equally hard to choose from. Lower is better.

    ``weights`` are those of a TopicModel, ``words`` has a column ``words`` of terms.
    Terms are split in two halves by hash. A text's topic shares are fitted to the
    first half by expectation maximisation, and the second half is scored with them.
    Terms the model doesn't know take no part, nor do texts without any in one half.
    """
    if not keys:
        one = F.lit(0).alias("_one")
        return perplexity(weights.select("*", one), words.select("*", one), ["_one"], rounds, alpha, beta).drop("_one")
    keys = list(keys)
    weights = stage(weights, "model")
    known = weights.select(*keys, "term").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_kinds"))
    of_topic = weights.groupBy(*keys, "topic").agg(F.sum("weight").alias("_total"), F.first("n_topics").alias("n_topics"))
    sizes = of_topic.join(known, keys)
    sizes = sizes.withColumn("_mass", F.col("_total") + beta * F.col("_kinds"))
    # A term a topic lacks has beta / mass there; the sum of these over topics is one number a group.
    floor = sizes.groupBy(*keys).agg(F.sum(beta / F.col("_mass")).alias("_floor"), F.first("n_topics").alias("_topics"))
    has = weights.drop("n_topics").join(small_side(sizes.select(*keys, "topic", "_mass"), "topic-sizes"), [*keys, "topic"])
    one = F.struct("topic", ((F.col("weight") + beta) / F.col("_mass")).alias("phi"), (beta / F.col("_mass")).alias("none"))
    phi = has.groupBy(*keys, "term").agg(F.collect_list(one).alias("phi"), F.sum(F.col("weight") / F.col("_mass")).alias("above"))
    doc = F.struct(F.xxhash64("words").alias("hash"), F.monotonically_increasing_id().alias("number")).alias("doc")
    numbered = stage(words.select(*keys, doc, "words"), "words")
    tokens = numbered.select(*keys, "doc", F.explode("words").alias("term")).groupBy(*keys, "doc", "term").agg(F.count(F.lit(1)).alias("n"))
    # A text's shares depend on nothing but its own terms, so all rounds are one pass.
    held = tokens.join(phi, [*keys, "term"]).select(*keys, "doc", F.struct("n", (F.xxhash64("term") % 2 == 0).alias("second"), "above", "phi").alias("token"))
    texts = held.groupBy(*keys, "doc").agg(F.collect_list("token").alias("tokens")).join(small_side(floor, "topic-floors"), keys).drop("doc")
    schema = T.StructType([*(words.schema[k] for k in keys), *T.StructType.fromDDL("n long, log_chance double")])
    return texts.mapInArrow(_second_halves(keys, rounds, alpha), schema).groupBy(*keys).agg(
        F.sum("n").alias("n_terms"), F.exp(-F.sum("log_chance") / F.sum("n")).alias("perplexity")
    )


def _second_halves(keys: Sequence[str], rounds: int, alpha: float):
    """Arrow function: texts with the terms a model knows to the number of terms in
    their second half and the log of its chance, by shares fitted to the first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        values = lambda array: array.to_numpy(zero_copy_only=False)
        for batch in batches:
            lists = batch.column("tokens")
            starts = values(lists.offsets)
            first, end = int(starts[0]), int(starts[-1])
            tokens = lists.values.slice(first, end - first)
            n, second, above, held = (tokens.field(tokens.type.get_field_index(c)) for c in ("n", "second", "above", "phi"))
            n, second, above = values(n).astype(np.float64), values(second).astype(bool), values(above)
            cuts = values(held.offsets).astype(np.int64)
            cells = held.values.slice(cuts[0], cuts[-1] - cuts[0])
            cuts = cuts - cuts[0]
            topic, phi, none = (values(cells.field(cells.type.get_field_index(c))) for c in ("topic", "phi", "none"))
            floor, topics = values(batch.column("_floor")), values(batch.column("_topics"))
            kept, sums, chances = [], [], []
            for i, (a, b) in enumerate(zip(starts[:-1] - first, starts[1:] - first)):
                rows = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
                span = slice(cuts[a], cuts[b])
                fitted = ~second[a:b][rows]
                own, at = np.unique(topic[span][fitted], return_inverse=True)
                if not len(own) or not second[a:b].any():
                    continue
                row, weight = rows[fitted], phi[span][fitted]
                times = n[a:b]
                theta = np.bincount(at, weights=times[row] * weight)
                for _ in range(rounds):
                    part = weight * theta[at]
                    total = np.bincount(row, weights=part, minlength=b - a)
                    theta = np.bincount(at, weights=times[row] * part / total[row]) + alpha
                count = theta - alpha
                lacking = np.zeros(len(own))
                lacking[at] = none[span][fitted]
                # Of topics of the text: phi where a term has the topic, and what lacks it elsewhere.
                place = np.minimum(np.searchsorted(own, topic[span]), len(own) - 1)
                more = np.where(own[place] == topic[span], count[place] * (phi[span] - lacking[place]), 0.0)
                chance = float(count @ lacking) + np.bincount(rows, weights=more, minlength=b - a)
                p = (chance + alpha * (above[a:b] + floor[i])) / (count.sum() + alpha * topics[i])
                kept.append(i)
                sums.append(int(times[second[a:b]].sum()))
                chances.append(float((times * np.log(p))[second[a:b]].sum()))
            groups = [batch.column(k).take(pa.array(kept, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*groups, pa.array(sums, pa.int64()), pa.array(chances, pa.float64())], names=[*keys, "n", "log_chance"])

    return run


def coherence(topics: DataFrame, words: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``topic, n_pairs, coherence``: the mean over pairs of a topic's terms of how
    much more often texts hold both than if they were independent, -1 to 1.

    ``topics`` has a row per topic with ``terms``, ``words`` a row per text with
    ``words``. The measure of a pair is its pointwise mutual information over
    ``-log`` of the share of texts that hold both: -1 where none does, 1 where both
    are in all texts. Only pairs found in a text become rows. A topic of one term
    has no pairs and a null coherence.
    """
    if not keys:
        one = F.lit(0).alias("_one")
        return coherence(topics.select("*", one), words.select("*", one), ["_one"]).drop("_one")
    keys = list(keys)
    topics = stage(topics.select(*keys, "topic", F.array_distinct("terms").alias("terms")), "topics")
    listed = topics.select(*keys, "topic", F.explode("terms").alias("term"))
    doc = F.struct(F.xxhash64("words").alias("hash"), F.monotonically_increasing_id().alias("number")).alias("doc")
    numbered = stage(words.select(*keys, doc, F.array_distinct("words").alias("words")), "words")
    texts = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_texts"))
    met = numbered.select(*keys, "doc", F.explode("words").alias("term")).join(small_side(listed, "topic-terms"), [*keys, "term"])
    held = stage(met.groupBy(*keys, "topic", "doc").agg(F.array_sort(F.collect_list("term")).alias("held")), "held")
    single = held.select(*keys, "topic", F.explode("held").alias("term")).groupBy(*keys, "topic", "term").agg(F.count(F.lit(1)).alias("_df"))
    pairs = F.flatten(F.transform("held", lambda a: F.transform(F.filter("held", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = held.select(*keys, "topic", F.inline(pairs)).groupBy(*keys, "topic", "a", "b").agg(F.count(F.lit(1)).alias("_both"))
    for side in "ab":
        both = both.join(single.select(*keys, "topic", F.col("term").alias(side), F.col("_df").alias(f"_{side}")), [*keys, "topic", side])
    both = both.join(small_side(texts, "texts"), keys)
    pmi = F.log(F.col("_both") * F.col("_texts") / (F.col("_a") * F.col("_b").cast("double")))
    scaled = F.when(F.col("_both") == F.col("_texts"), 1.0).otherwise(pmi / F.log(F.col("_texts") / F.col("_both")))
    sums = both.groupBy(*keys, "topic").agg(F.sum(scaled).alias("_sum"), F.count(F.lit(1)).alias("_found"))
    size = F.size("terms").cast("long")
    n_pairs = (size * (size - 1) / 2).cast("long")
    found, total = F.coalesce("_found", F.lit(0)), F.coalesce("_sum", F.lit(0.0))
    return topics.join(sums, [*keys, "topic"], "left").select(
        *keys, "topic", n_pairs.alias("n_pairs"), ((total - (n_pairs - found)) / F.nullif(n_pairs, F.lit(0))).alias("coherence")
    )


def keyword_map(topics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Which topics of its group each keyword belongs to."""
    return (
        topics.select(*keys, "topic", F.explode("terms").alias("term"))
        .groupBy(*keys, "term")
        .agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    )


def meet_keywords(rows: DataFrame, keywords: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with a ``term`` and the topics of it in their group."""
    own = [k for k in keys if k in keywords.columns]
    columns = [*own, "term", "topics", *(["n_topics"] if "n_topics" in keywords.columns else [])]
    side = keywords.select(*(columns if how == "inner" else [*own, "term"]))
    return rows.join(small_side(side, "keywords"), [*own, "term"], how)


def sentence_topics(sentences: DataFrame, keys: Sequence[str], order: Sequence[str], keywords: DataFrame) -> DataFrame:
    """Topics touched by each sentence that holds a keyword."""
    place = [*keys, *sentence_place(sentences, order)]
    return (
        sentences.select(*place, F.explode(F.transform("bag", lambda b: b["term"])).alias("term"))
        .transform(meet_keywords, keywords, keys)
        .groupBy(*place)
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("sen_topics"))
        .select(*keys, *order, "sen_pos", "sen_topics")
    )
