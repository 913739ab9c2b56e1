"""Selection that changes the group's distribution after every pick.

Redundancy level 1 subtracts the picked sentence's term counts from the group's,
level 2 divides by them; both shorten the group's total. With topics, variant
``v2`` also weighs scores by the topics already covered. Each pick depends on
the one before it, so a group of ordinary size runs as one loop inside one task
and all groups run side by side. Groups too large for that are picked in rounds
instead: many picks a round (``lazy``), or one where covered topics and changing counts
meet. Where covered topics alone change scores, sentences of the same topics keep their
order, so the first of each set of topics are enough.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.operators import selection as sl
from gistmill.operators import terms as tm
from gistmill.operators.lazy import least, pick_lazily
from gistmill.operators.topics import meet_keywords
from gistmill.operators.scoring import NO_WORDS, measure_groups, relative_entropy
from gistmill.session import BROADCAST_ROWS, small_side, stage

LOCAL_SENTENCES = 200_000
#: Sentences of each set of topics that a group's loop is tried with first.
FIRST_OF_TOPICS = 256


def _pick_in_group(keys: Sequence[str], place: Sequence[str], shown: Sequence[str], level: int, by_sentences: bool, topical: bool, given: int | None, covering: bool):
    """Loop over one group (a pandas frame of its sentences)."""
    low, high = sl.MIN_WORDS, sl.MAX_WORDS

    def run(key, frame):
        import numpy as np
        import pandas as pd

        n_topics = given
        if topical and n_topics is None:
            found = frame["_n_topics"].dropna()
            n_topics = int(found.iloc[0]) if len(found) else 2

        frame = frame.sort_values(list(place), kind="stable", ignore_index=True)
        # Sentences with the same terms share their score at all times, so copies
        # form one class: scored once, used up one by one in order.
        classes: dict[tuple, int] = {}
        members: list[list[int]] = []
        for i, (terms, tfs) in enumerate(zip(frame["terms"], frame["tfs"])):
            at = classes.setdefault((tuple(terms), tuple(tfs)), len(members))
            if at == len(members):
                members.append([])
            members[at].append(i)
        kinds = frame.iloc[[m[0] for m in members]]
        count = len(members)
        sizes = kinds["terms"].map(len).to_numpy()
        vocabulary: dict[str, int] = {}
        codes = np.array(
            [vocabulary.setdefault(t, len(vocabulary)) for terms in kinds["terms"] for t in terms], dtype="int64"
        )
        tf = np.concatenate([np.asarray(v, dtype="float64") for v in kinds["tfs"]] or [np.empty(0)])
        n = kinds["filt_words"].to_numpy(dtype="float64")
        owner = np.repeat(np.arange(count), sizes)
        copies = np.array([len(m) for m in members])
        group = np.bincount(codes, weights=tf * copies[owner], minlength=len(vocabulary))
        total = float((n * copies).sum())
        following = np.zeros(count, dtype="int64")
        start = np.concatenate([[0], np.cumsum(sizes)])
        b = tf / n[owner]
        counted = np.ones(len(tf), dtype=bool)
        if n_topics is not None:
            width = np.concatenate([np.asarray(v, dtype="float64") for v in kinds["n_term_topics"]] or [np.empty(0)])
            counted = width > 0
            b = b * (width / n_topics)
            sentence_topics = [frozenset(v) for v in kinds["sen_topics"]]
        by_term = np.argsort(codes, kind="stable")
        term_start = np.searchsorted(codes[by_term], np.arange(len(vocabulary) + 1))
        open_ = np.bincount(owner, weights=counted, minlength=count) > 0
        never = not open_.any()
        weight = np.ones(count)
        covered: set[int] = set()

        def weigh():
            for i in np.flatnonzero(open_):
                topics = sentence_topics[i]
                weight[i] = (n_topics / len(topics)) / 1.25 ** len(topics & covered)

        def products(tokens):
            """count * ln(count / b) of tokens, 0 where nothing is left."""
            left = group[codes[tokens]]
            live = (left > 0) & counted[tokens]
            out = np.zeros(len(tokens))
            out[live] = left[live] * np.log(left[live] / b[tokens][live])
            return out, np.where(live, left, 0.0)

        def exact(i):
            tokens = slice(start[i], start[i + 1])
            a, q = group[codes[tokens]] / total, b[tokens]
            score = 0.0
            for x, y, used in zip(a, q, counted[tokens]):
                if used and x > 0:
                    score += x * np.log(x / y)
            return score * weight[i] / n[i]

        # A score is (product - mass * ln total) / (words * total). Product and
        # mass of a sentence change only with its own terms, so a pick touches
        # the sentences it shares terms with and the rest is one vector formula.
        # That formula narrows the choice; the choice itself is by exact score.
        product, mass = products(np.arange(len(tf)))
        sentence_product = np.bincount(owner, weights=product, minlength=count)
        sentence_mass = np.bincount(owner, weights=mass, minlength=count)
        if covering:
            weigh()

        words = frame["og_words"].to_numpy()
        texts = frame["sentence"].tolist()
        limit = int(frame["_limit"].iloc[0])
        picked: list[int] = []
        picked_scores: list[float] = []
        taken = 0
        if never:
            if n_topics is None and limit > 0 and low <= words[0] <= high:
                picked, picked_scores = [0], [NO_WORDS]
        while not never and taken < limit:
            where = np.flatnonzero(open_)
            if not len(where):
                break
            near = (sentence_product[where] - sentence_mass[where] * np.log(total)) / (n[where] * total) * weight[where]
            lowest = near.min()
            close = where[near <= lowest + 1e-12 + 1e-9 * abs(lowest)]
            score, best, kind = min((float(exact(i)), members[i][following[i]], int(i)) for i in close)
            if low <= words[best] <= high and not (picked and texts[picked[-1]] == texts[best]):
                picked.append(best)
                picked_scores.append(score)
                taken += 1 if by_sentences else int(words[best])
                if covering and not sentence_topics[kind] <= covered:
                    covered |= sentence_topics[kind]
                    weigh()
            following[kind] += 1
            open_[kind] = following[kind] < copies[kind]
            if level:
                span = slice(start[kind], start[kind + 1])
                changed = codes[span]
                group[changed] = group[changed] - tf[span] if level == 1 else group[changed] / tf[span]
                total -= n[kind]
                touched = np.concatenate([by_term[term_start[c]:term_start[c + 1]] for c in changed])
                new_product, new_mass = products(touched)
                np.add.at(sentence_product, owner[touched], new_product - product[touched])
                np.add.at(sentence_mass, owner[touched], new_mass - mass[touched])
                product[touched], mass[touched] = new_product, new_mass
        out = frame.loc[picked, [*shown, "sentence", "og_words"]].reset_index(drop=True)
        out["score"] = pd.Series(picked_scores, dtype="float64")
        out.insert(0, "rank", np.arange(1, len(picked) + 1, dtype="int32"))
        for i, value in enumerate(key):
            out.insert(i, keys[i], value)
        return out

    return run


def _picked_schema(sentences: DataFrame, keys: Sequence[str], place: Sequence[str]) -> T.StructType:
    fields = {f.name: f for f in sentences.schema.fields}
    return T.StructType(
        [
            *(fields[k] for k in keys),
            T.StructField("rank", T.IntegerType()),
            *(fields[p] for p in place),
            T.StructField("sentence", T.StringType()),
            T.StructField("og_words", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _with_topics(sentences: DataFrame, keys: Sequence[str], place: Sequence[str], keywords: DataFrame) -> DataFrame:
    """Add the topics of each sentence and the number of topics of each term."""
    found = (
        tm.explode_bag(sentences, [*keys, *place])
        .transform(meet_keywords, keywords, keys)
        .groupBy(*keys, *place)
        .agg(
            *([F.max("n_topics").alias("_n_topics")] if "n_topics" in keywords.columns else []),
            F.map_from_entries(F.collect_list(F.struct("first", F.size("topics")))).alias("_widths"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("sen_topics"),
        )
    )
    width = F.transform("bag", lambda b: F.coalesce(F.try_element_at(F.col("_widths"), b["first"]), F.lit(0)))
    return (
        sentences.join(found, [*keys, *place], "left")
        .withColumn("n_term_topics", F.when(F.col("_widths").isNull(), F.transform("bag", lambda b: F.lit(0))).otherwise(width))
        .withColumn("sen_topics", F.coalesce("sen_topics", F.array().cast("array<int>")))
        .drop("_widths")
    )


def select_reducing(
    sentences: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    level: int,
    limit: str = "250",
    share: float = 0.15,
    min_words: int | None = None,
    keywords: DataFrame | None = None,
    n_topics: int | None = None,
    variant: str = "v1",
    local_sentences: int = LOCAL_SENTENCES,
) -> DataFrame:
    """Greedy summary at redundancy ``level`` 0-2 over a staged sentence table.

    With ``keywords`` scores are topic-aware; ``variant='v2'`` multiplies them
    by topics / sentence topics and by 1/1.25 for each of the sentence's topics
    the summary already covers.
    """
    keys, place = list(keys), tm.sentence_place(sentences, order)
    by_sentences = limit == "percent"
    groups = measure_groups(sentences, keys, min_words)
    totals = groups.totals.withColumn("_limit", sl.summary_limit(limit, share))
    large = totals.filter(F.col("n_sentences") > local_sentences).select(*keys)
    n_large = large.limit(BROADCAST_ROWS + 1).count() if groups.largest > local_sentences else 0

    small = sentences
    if n_large:
        small = small.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, keys, "left_anti")
    small_totals = totals.filter(F.col("n_sentences") <= local_sentences).select(*keys, "_limit")
    if keywords is not None:
        small = _with_topics(small, keys, place, keywords)
    # Pandas sorts plain columns only, so the row's identity goes in two.
    shown = [*order, "sen_pos"]
    flat = [F.col(f"{tm.ROW}.hash").alias("_hash"), F.col(f"{tm.ROW}.number").alias("_number")] if tm.ROW in place else []
    local = [*order, *(["_hash", "_number"] if flat else []), "sen_pos"]
    small = small.join(small_totals, keys).select(
        *keys, *order, *flat, "sen_pos", "sentence", "og_words", "filt_words", "_limit",
        F.transform("bag", lambda b: b["term"]).alias("terms"),
        F.transform("bag", lambda b: b["tf"]).alias("tfs"),
        *(["n_term_topics", "sen_topics"] if keywords is not None else []),
        *(["_n_topics"] if "_n_topics" in small.columns else []),
    )
    schema = _picked_schema(sentences, keys, shown)
    run = _pick_in_group(keys, local, shown, level, by_sentences, keywords is not None, n_topics, variant == "v2")
    picked = small.groupBy(*keys).applyInPandas(run, schema)
    if not n_large:
        return picked
    big_totals = totals.filter(F.col("n_sentences") > local_sentences)
    big = sentences.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, keys, "left_semi")
    if keywords is not None:
        big = _with_topics(big, keys, place, keywords)
    if variant == "v2" and keywords is not None:
        # What a topic is worth changes for all sentences at once.
        by_rounds = (
            _pick_by_rounds(big, big_totals, keys, place, level, by_sentences, n_topics) if level
            else _pick_by_topics(big, big_totals, keys, place, by_sentences, n_topics))
    else:
        own = F.lit(n_topics) if n_topics is not None else F.col("_n_topics") if keywords is not None else None
        by_rounds = pick_lazily(big, big_totals, keys, place, level, by_sentences, own if keywords is not None else None)
    if keywords is None:
        by_rounds = by_rounds.unionByName(_first_sentences(big, big_totals, keys, place).select(*by_rounds.columns))
    return picked.unionByName(by_rounds.select(*picked.columns))


def _first_sentences(sentences: DataFrame, totals: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """A group without any term offers its first sentence only."""
    first = sentences.join(totals.filter("filt_total = 0 and _limit > 0").select(*keys), keys, "left_semi")
    item = F.struct(*(F.col(p) for p in place))
    first = first.groupBy(*keys).agg(F.min(F.struct(item.alias("place"), "sentence", "og_words")).alias("best"))
    return first.select(
        *keys, F.lit(1).alias("rank"), "best.place.*", "best.sentence", "best.og_words", F.lit(NO_WORDS).alias("score"),
    ).filter(sl.length_gate())


def _merge_topics(keys: Sequence[str], by_sentences: bool, count: int):
    """Loop over the first sentences of each set of topics of a group; ``done`` if it
    ended before one of ``count`` sentences ran out."""
    low, high = sl.MIN_WORDS, sl.MAX_WORDS

    def run(key, frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values(["topic_set", "nth"], ignore_index=True)
        _, start, sizes = np.unique(frame["topic_set"].to_numpy(dtype=str), return_index=True, return_counts=True)
        sets = [frozenset(x) for x in frame["sen_topics"].iloc[start]]
        at, end = start.copy(), start + sizes
        base, n, place = (frame[c].to_numpy() for c in ("base", "filt_words", "ord"))
        words, texts = frame["og_words"].to_numpy(), frame["sentence"].tolist()
        limit, taken, last, covered = int(frame["limit"].iloc[0]), 0, None, set()
        worth, rows, done = np.ones(len(sets)), [], False
        while True:
            left = np.flatnonzero(at < end)
            done = taken >= limit or not len(left)
            if done:
                break
            score = base[at[left]] / worth[left] / n[at[left]]
            lowest = np.flatnonzero(score == score.min())
            own = left[lowest[place[at[left[lowest]]].argmin()]]
            i = at[own]
            if low <= words[i] <= high and texts[i] != last:
                rows.append((*key, len(rows) + 1, int(place[i]), float(base[i] / worth[own] / n[i]), None))
                taken += 1 if by_sentences else int(words[i])
                last = texts[i]
                covered |= sets[own]
                worth = np.array([1.25 ** len(x & covered) for x in sets])
            at[own] += 1
            if at[own] == end[own] and sizes[own] == count:
                done = taken >= limit
                break
        return pd.DataFrame([*rows, (*key, None, None, None, bool(done))], columns=[*keys, "rank", "ord", "score", "done"], dtype=object)

    return run


def _pick_by_topics(
    sentences: DataFrame, totals: DataFrame, keys: list[str], place: list[str], by_sentences: bool, n_topics: int | None,
    count: int | None = None,
) -> DataFrame:
    """The loop with covered topics at level 0 for groups that span tasks.

    Scores are computed once. A covered topic changes those of all sentences with the
    same topics alike, so the loop needs only the first ``count`` of each set of topics.
    Groups where that is too few begin again with four times as many.
    """
    count = count or FIRST_OF_TOPICS
    all_topics = F.lit(n_topics) if n_topics is not None else F.col("_n_topics")
    own_topics = ["_n_topics"] if n_topics is None else []
    item = F.struct(*(F.col(p) for p in place)).alias("place")
    tokens = sentences.filter(F.size("sen_topics") > 0).select(
        *keys, item, "og_words", "filt_words", "sen_topics", *own_topics,
        F.inline(F.zip_with("bag", "n_term_topics", lambda b, w: F.struct(
            b["first"].alias("first"), b["term"].alias("term"), b["tf"].alias("tf"), w.alias("width")))),
    )
    tokens = stage(tokens.filter("width > 0"), "tokens")
    counts = tokens.groupBy(*keys, "term").agg(F.sum("tf").cast("double").alias("count"))
    open_ = stage(totals.filter("_limit > 0").select(
        *keys, F.col("_limit").cast("long").alias("limit"), F.col("filt_total").cast("double").alias("total")), "state")
    part = relative_entropy(F.col("count") / F.col("total"), F.col("tf") / F.col("filt_words") * (F.col("width") / all_topics))
    scored = tokens.join(counts.join(open_.select(*keys, "total"), keys), [*keys, "term"]).groupBy(*keys, "place").agg(
        F.array_sort(F.collect_list(F.struct("first", part.alias("part")))).alias("parts"),
        *(F.max(c).alias(c) for c in ("og_words", "filt_words", "sen_topics", *own_topics)),
    )
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["part"])
    scored = stage(scored.select(
        *keys, "place", "og_words", "filt_words", "sen_topics", F.concat_ws(",", F.col("sen_topics").cast("array<string>")).alias("topic_set"),
        (total * (all_topics / F.size("sen_topics"))).alias("base")), "scored")
    texts = sentences.select(*keys, item, "sentence")
    fields = {f.name: f for f in sentences.schema.fields}
    schema = T.StructType([*(fields[k] for k in keys), T.StructField("rank", T.IntegerType()), T.StructField("ord", T.LongType()),
                           T.StructField("score", T.DoubleType()), T.StructField("done", T.BooleanType())])
    picked: list[DataFrame] = []
    while not open_.isEmpty():
        first = scored.join(small_side(open_, "state").select(*keys, "limit"), keys).withColumn("at", F.col("base") / F.col("filt_words"))
        first = small_side(least(first, [*keys, "topic_set"], ["at", "place"], count, "nth"), "first")
        first = stage(first.join(texts, [*keys, "place"]).withColumn(
            "ord", F.row_number().over(Window.partitionBy(*keys).orderBy("place")).cast("long")), "first")
        tried = stage(first.drop("place", "at").groupBy(*keys).applyInPandas(_merge_topics(keys, by_sentences, count), schema), "picks")
        done = tried.filter("done").select(*keys)
        picks = tried.filter("rank is not null").join(done, keys, "left_semi").join(first.select(*keys, "ord", "place", "sentence", "og_words"), [*keys, "ord"])
        picked.append(picks.select(*keys, "rank", "place.*", "sentence", "og_words", "score"))
        open_ = stage(open_.join(tried.filter("not done").select(*keys), keys, "left_semi"), "state")
        count *= 4
    return reduce(DataFrame.unionByName, picked)


def _pick_by_rounds(
    sentences: DataFrame, totals: DataFrame, keys: list[str], place: list[str],
    level: int, by_sentences: bool, n_topics: int | None,
) -> DataFrame:
    """The loop with covered topics for groups that span tasks: one pick per group and
    round.

    The group's counts, the used sentences and the progress of each group are
    staged tables, replaced every round; sentences stay where they are.
    """
    all_topics = F.lit(n_topics) if n_topics is not None else F.col("_n_topics")
    own_topics = ["_n_topics"] if n_topics is None else []
    item = F.struct(*(F.col(p) for p in place))
    widths = F.col("n_term_topics")
    tokens = sentences.select(
        *keys, item.alias("place"), "og_words", "filt_words",
        "sen_topics", *own_topics,
        F.inline(F.zip_with("bag", widths, lambda b, w: F.struct(
            b["first"].alias("first"), b["term"].alias("term"), b["tf"].alias("tf"), w.alias("width")))),
    )
    tokens = stage(tokens, "tokens")
    texts = sentences.select(*keys, item.alias("place"), "sentence")
    counts = stage(
        tokens.groupBy(*keys, "term").agg(F.sum("tf").cast("double").alias("count")), "counts"
    )
    state = stage(
        totals.filter("_limit > 0").select(
            *keys, "_limit", F.col("filt_total").cast("double").alias("total"),
            F.lit(0).cast("long").alias("taken"), F.lit(0).alias("rank"),
            F.lit(None).cast("string").alias("last"), F.array().cast("array<int>").alias("covered"),
        ),
        "state",
    )
    rounds: list[DataFrame] = []
    used = None
    while not state.isEmpty():
        pool = tokens if used is None else tokens.join(used, [*keys, "place"], "left_anti")
        part = relative_entropy(
            F.col("count") / F.col("total"),
            F.col("tf") / F.col("filt_words") * (F.col("width") / all_topics),
        )
        parts = pool.filter("width > 0").join(counts.join(state.select(*keys, "total"), keys), [*keys, "term"])
        scored = parts.groupBy(*keys, "place").agg(
            F.array_sort(F.collect_list(F.struct("first", part.alias("part")))).alias("parts"),
            F.max("og_words").alias("og_words"), F.max("filt_words").alias("filt_words"),
            F.max("sen_topics").alias("sen_topics"),
            *(F.max(c).alias(c) for c in own_topics),
        )
        total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["part"])
        scored = scored.join(state.select(*keys, "covered"), keys)
        total = total * (all_topics / F.size("sen_topics")) / F.pow(
            F.lit(1.25), F.size(F.array_intersect("sen_topics", "covered")))
        best = scored.groupBy(*keys).agg(
            F.min(F.struct((total / F.col("filt_words")).alias("score"), "place", "og_words", "filt_words", "sen_topics")).alias("best")
        ).select(*keys, "best.*")
        best = best.join(texts, [*keys, "place"])
        accepted = sl.length_gate() & ~F.col("sentence").eqNullSafe(F.col("last"))
        step = F.lit(1) if by_sentences else F.col("og_words")
        picks = stage(state.join(best, keys).withColumn("accepted", accepted), "picks")
        rounds.append(picks.filter("accepted").select(
            *keys, (F.col("rank") + 1).cast("int").alias("rank"), "place.*", "sentence", "og_words", "score"))
        gone = picks.select(*keys, "place")
        used = stage(gone if used is None else used.unionByName(gone), "used")
        if level:
            hit = tokens.join(gone, [*keys, "place"], "left_semi").select(*keys, "term", F.col("tf").alias("_tf"))
            changed = F.col("count") - F.col("_tf") if level == 1 else F.col("count") / F.col("_tf")
            counts = stage(
                counts.join(hit, [*keys, "term"], "left").select(
                    *keys, "term", F.when(F.col("_tf").isNull(), F.col("count")).otherwise(changed).alias("count")),
                "counts",
            )
        grown = F.when(F.col("accepted"), F.col("taken") + step).otherwise(F.col("taken"))
        state = stage(
            picks.select(
                *keys, "_limit",
                (F.col("total") - (F.col("filt_words") if level else F.lit(0))).alias("total"),
                grown.cast("long").alias("taken"),
                (F.col("rank") + F.col("accepted").cast("int")).alias("rank"),
                F.when(F.col("accepted"), F.col("sentence")).otherwise(F.col("last")).alias("last"),
                F.when(F.col("accepted"), F.array_union("covered", "sen_topics")).otherwise(F.col("covered")).alias("covered"),
            ).filter("taken < _limit"),
            "state",
        )
    return reduce(DataFrame.unionByName, rounds)
