"""Greedy picks of groups that span tasks, many picks a round.

A sentence's score is (product - mass * ln total) / (words * total). Product and mass
are sums over its own terms, so they change only when a picked sentence shares a term
with it, and the total is the same for all. So they are stored, once per class of
sentences with the same terms, and a round goes like this: the best classes of each
group go through the loop in one task, as if there were no others. Then all others are
held against the loop's steps: first by a bound of their score over all steps, and the
few that it doesn't rule out by their sums as they change from step to step. Steps before the first at
which another class may be as good are proven, whatever comes later is dropped, and
stored sums are brought up to date for the proven steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.operators import selection as sl
from gistmill.operators.running import number_rows
from gistmill.session import small_side, stage

#: Classes of a group that go through the loop in a round, and at most as many steps.
#: Sums are rounded differently here and there: closer than this is not proven.
ROUND_CLASSES = 2048
_NEAR, _NEARER = 1e-9, 1e-12
#: Parts of a group whose first rows are found apart, before those of the group.
_PARTS = 64


def _loop(keys: Sequence[str], level: int, by_sentences: bool, steps: int):
    """Cogroup function: terms of a group's best classes, with counts and the group's
    progress, and the classes' unused sentences, to the steps of the loop."""
    low, high = sl.MIN_WORDS, sl.MAX_WORDS

    def run(key, terms, sentences):
        import numpy as np
        import pandas as pd

        columns = [*keys, "step", "cid", "ord", "accepted", "score", "near", "total", "words", "taken", "last", "term", "before", "after"]
        if not len(terms) or not len(sentences):
            return pd.DataFrame(columns=columns)
        terms = terms.sort_values(["cid", "first"], kind="stable", ignore_index=True)
        cids, owner = np.unique(terms["cid"].to_numpy(), return_inverse=True)
        start = np.searchsorted(owner, np.arange(len(cids) + 1))
        names, codes = np.unique(terms["term"].to_numpy(dtype=str), return_inverse=True)
        tf, b, n = (terms[c].to_numpy(dtype="float64") for c in ("tf", "b", "n"))
        n = n[start[:-1]]
        group = np.zeros(len(names))
        group[codes] = terms["count"].to_numpy(dtype="float64")
        total, limit, taken, last = float(terms["total"].iloc[0]), int(terms["limit"].iloc[0]), int(terms["taken"].iloc[0]), terms["last"].iloc[0]
        sentences = sentences.sort_values("ord", kind="stable")
        queues = [[] for _ in cids]
        for at, *own in zip(np.searchsorted(cids, sentences["cid"].to_numpy()), sentences["ord"], sentences["og_words"], sentences["sentence"]):
            queues[at].append(own)
        following = np.zeros(len(cids), dtype="int64")
        open_ = np.array([len(q) > 0 for q in queues])

        def sums():
            left = group[codes]
            live = left > 0
            part = np.zeros(len(codes))
            part[live] = left[live] * np.log(left[live] / b[live])
            return np.bincount(owner, weights=part, minlength=len(cids)), np.bincount(owner, weights=np.where(live, left, 0.0), minlength=len(cids))

        def exact(i):
            score = 0.0
            for x, y in zip(group[codes[start[i] : start[i + 1]]] / total, b[start[i] : start[i + 1]]):
                if x > 0:
                    score += x * np.log(x / y)
            return score / n[i]

        rows, (product, mass) = [], sums()
        for step in range(steps):
            where = np.flatnonzero(open_)
            if not len(where) or taken >= limit:
                break
            near = (product[where] - mass[where] * np.log(total)) / (n[where] * total)
            lowest = near.min()
            close = where[near <= lowest + _NEARER + _NEAR * abs(lowest)]
            score, at, kind = min((float(exact(i)), queues[i][following[i]][0], int(i)) for i in close)
            _, words, text = queues[kind][following[kind]]
            accepted = bool(low <= words <= high and text != last)
            before = total
            if accepted:
                taken += 1 if by_sentences else int(words)
                last = text
            following[kind] += 1
            open_[kind] = following[kind] < len(queues[kind])
            if level:
                span = slice(start[kind], start[kind + 1])
                changed, held = codes[span], group[codes[span]]
                group[changed] = held - tf[span] if level == 1 else held / tf[span]
                total -= n[kind]
                moved = group[changed] != held
                rows += [(*key, step, None, None, None, None, None, None, None, None, None, names[c], x, y) for c, x, y in zip(changed[moved], held[moved], group[changed][moved])]
                if moved.any():
                    product, mass = sums()
            rows.append((*key, step, int(cids[kind]), int(at), accepted, score, lowest, before, int(words), taken, last, None, None, None))
        # As objects: with missing values among them, 64-bit numbers would become floats.
        return pd.DataFrame(rows, columns=columns, dtype=object)

    return run


def _score(product: Column, mass: Column, total: Column, n: Column) -> Column:
    return (product - mass * F.ln(total)) / (n * total)


def _mass(count: Column) -> Column:
    return F.when(count > 0, count).otherwise(F.lit(0.0))


def _product(count: Column, b: Column) -> Column:
    return F.when(count > 0, count * F.ln(count / b)).otherwise(F.lit(0.0))


def least(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int, name: str) -> DataFrame:
    """The first ``count`` rows of each key, numbered from 1: those of every part of a
    key first, so that no task sorts all rows of a large one."""
    def first(df, within):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order))).filter(F.col(name) <= count)

    parts = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(_PARTS)))
    return first(first(parts, [*keys, "_part"]).drop("_part"), keys)


def _threats(keys: Sequence[str]):
    """Cogroup function: classes outside the loop, with what changed in their sums, and
    the loop's course, to the first step at which one of them may be as good."""

    def run(key, others, course):
        import numpy as np
        import pandas as pd

        course = course.sort_values("step", ignore_index=True)
        near, total = course["near"].to_numpy(dtype="float64"), course["total"].to_numpy(dtype="float64")
        reach, log_total = near + _NEARER + 2 * _NEAR * np.abs(near), np.log(total)
        product, mass, n = (others[c].to_numpy(dtype="float64") for c in ("product", "mass", "n"))
        first = len(course)
        for i, (steps, products, masses) in enumerate(zip(others["steps"], others["products"], others["masses"])):
            if not first:
                break
            p, m = product[i], mass[i]
            if steps is not None and len(steps):
                # What a step changes counts from the next one.
                late = np.minimum(np.asarray(steps) + 1, len(course))
                p = p + np.cumsum(np.bincount(late, weights=products, minlength=len(course) + 1))[:first]
                m = m + np.cumsum(np.bincount(late, weights=masses, minlength=len(course) + 1))[:first]
            met = (p - m * log_total[:first]) / (n[i] * total[:first]) <= reach[:first]
            if met.any():
                first = int(met.argmax())
        rows = [(*key[:-1], first)] if first < len(course) else []
        return pd.DataFrame(rows, columns=[*keys, "threat"])

    return run


def pick_lazily(
    sentences: DataFrame, totals: DataFrame, keys: Sequence[str], place: Sequence[str],
    level: int, by_sentences: bool, all_topics: Column | None, classes: int = ROUND_CLASSES,
) -> DataFrame:
    """Picks (keys, rank, place, sentence, og_words, score) at redundancy ``level``,
    one by one the same as by the loop over whole groups. ``totals`` has each group's
    ``filt_total`` and ``_limit``. With ``all_topics``, sentences have the number of
    topics of each term in ``n_term_topics``.

    Sentences with the same terms are told by a 64-bit hash of them. A round costs a
    pass over the stored sums and a join of the changed terms; where a round proves
    nothing, since too many classes are as good as each other, the next one takes
    four times as many into the loop.
    """
    keys = list(keys)
    widths = F.transform("bag", lambda b: F.lit(1)) if all_topics is None else F.col("n_term_topics")
    share = F.lit(1.0) if all_topics is None else F.col("width") / F.col("topics")
    rows = sentences.select(
        *keys, F.struct(*(F.col(p) for p in place)).alias("place"), "sentence", "og_words", "filt_words", "bag", widths.alias("widths"),
        (F.lit(1) if all_topics is None else all_topics).alias("topics"), F.xxhash64("bag", "filt_words", widths).alias("cid"),
    )
    members = stage(rows.select(*keys, "place", "cid", "sentence", "og_words"), "members")
    kinds = rows.groupBy(*keys, "cid").agg(
        F.first("bag").alias("bag"), F.first("widths").alias("widths"), F.first("filt_words").alias("n"),
        F.max("topics").alias("topics"), F.count(F.lit(1)).alias("copies"))
    terms = kinds.select(*keys, "cid", "n", "copies", "topics", F.inline(F.zip_with("bag", "widths", lambda t, w: F.struct(
        t["first"].alias("first"), t["term"].alias("term"), t["tf"].alias("tf"), w.alias("width")))))
    terms = stage(terms.filter("width > 0").select(*keys, "cid", "n", "copies", "first", "term", "tf", (F.col("tf") / F.col("n") * share).alias("b")), "terms")
    counts = stage(terms.groupBy(*keys, "term").agg(F.sum(F.col("tf") * F.col("copies")).cast("double").alias("count")), "counts")
    sums = terms.join(counts, [*keys, "term"]).groupBy(*keys, "cid").agg(
        F.max("n").alias("n"), F.max("copies").alias("copies"), F.lit(0).cast("long").alias("used"),
        F.lit(None).cast(members.schema["place"].dataType).alias("at"),
        F.sum(_product(F.col("count"), F.col("b"))).alias("product"), F.sum(_mass(F.col("count"))).alias("mass"))
    sums = stage(sums, "sums")
    state = stage(
        totals.filter("_limit > 0 and filt_total > 0").select(
            *keys, F.col("_limit").cast("long").alias("limit"), F.col("filt_total").cast("double").alias("total"),
            F.lit(0).cast("long").alias("taken"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("last")),
        "state")
    fields = {f.name: f for f in sentences.schema.fields}
    key_fields = T.StructType([*(fields[k] for k in keys)]).simpleString()[7:-1]
    threat_schema, schema = key_fields + ",threat int", key_fields + (
        ",step int,cid long,ord long,accepted boolean,score double,near double,total double,words long,taken long,last string,term string,before double,after double")
    picked: list[DataFrame] = []
    state = stage(state.join(sums.select(*keys).distinct(), keys, "left_semi"), "state")
    while not state.isEmpty():
        now = small_side(state, "state")
        open_ = sums.filter("used < copies").join(now, keys).withColumn("near", _score(F.col("product"), F.col("mass"), F.col("total"), F.col("n")))
        best = least(open_.select(*keys, "near", "cid", "at"), keys, ["near", "cid"], classes, "place_")
        best = small_side(best.select(*keys, "cid", "at"), "best")
        own_terms = terms.join(best, [*keys, "cid"]).join(counts, [*keys, "term"]).join(now, keys)
        # Each class goes on after its last used sentence.
        own = members.join(best, [*keys, "cid"]).filter(F.col("at").isNull() | (F.col("place") > F.col("at"))).drop("at")
        own = least(own, [*keys, "cid"], ["place"], classes, "nth")
        own = stage(own.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("place")).cast("long")), "own")
        steps = own_terms.select(*keys, "cid", "n", "first", "term", "tf", "b", "count", "limit", "total", "taken", "last").groupBy(*keys).cogroup(
            own.select(*keys, "cid", "ord", "og_words", "sentence").groupBy(*keys)
        ).applyInPandas(_loop(keys, level, by_sentences, classes), schema)
        steps = stage(steps, "steps")
        uses, changes = steps.filter("cid is not null"), steps.filter("term is not null")

        def moved(changed: DataFrame) -> DataFrame:
            """What the changed terms add to the sums of each class, by step."""
            met = terms.join(small_side(changed.select(*keys, "term", "step", "before", "after"), "changes"), [*keys, "term"])
            return met.select(
                *keys, "cid", "step", (_product(F.col("after"), F.col("b")) - _product(F.col("before"), F.col("b"))).alias("more_product"),
                (_mass(F.col("after")) - _mass(F.col("before"))).alias("more_mass"))

        # The first step at which a class outside the loop may be as good.
        reach = F.col("near") + _NEARER + 4 * _NEAR * F.abs("near")
        course = uses.groupBy(*keys).agg(
            F.min("total").alias("low"), F.max("total").alias("high"), F.max(reach).alias("reach"))
        course = small_side(course, "course")
        others = open_.select(*keys, "cid", "n", "product", "mass").join(best.select(*keys, "cid"), [*keys, "cid"], "left_anti")
        # Most are ruled out by the least that their score can be while the total falls:
        # product / total is least at one end, ln(total) / total most at the low one.
        fewest, most = F.col("product"), F.col("mass")
        if level:
            ends = moved(changes).groupBy(*keys, "cid").agg(
                F.sum(F.least("more_product", F.lit(0.0))).alias("less"), F.sum(F.greatest("more_mass", F.lit(0.0))).alias("more"))
            others = others.join(ends, [*keys, "cid"], "left")
            fewest, most = fewest + F.coalesce("less", F.lit(0.0)), most + F.coalesce("more", F.lit(0.0))
        bound = (F.least(fewest / F.col("high"), fewest / F.col("low")) - most * F.ln("low") / F.col("low")) / F.col("n")
        others = others.join(course, keys).filter((F.col("low") < 3) | (bound <= F.col("reach")))
        others = others.select(*keys, "cid", "n", "product", "mass")
        if level:
            others = stage(others, "others")
            met = moved(changes).join(others.select(*keys, "cid"), [*keys, "cid"], "left_semi")
            part = F.collect_list(F.struct("step", "more_product", "more_mass"))
            others = others.join(met.groupBy(*keys, "cid").agg(part.alias("moved")), [*keys, "cid"], "left")
        else:
            others = others.withColumn("moved", F.lit(None).cast("array<struct<step:int,more_product:double,more_mass:double>>"))
        others = others.select(
            *keys, F.pmod("cid", F.lit(_PARTS)).alias("_part"), "n", "product", "mass",
            F.col("moved.step").alias("steps"), F.col("moved.more_product").alias("products"), F.col("moved.more_mass").alias("masses"))
        parts = F.explode(F.sequence(*(F.lit(i).cast("long") for i in (0, _PARTS - 1)))).alias("_part")
        along = uses.select(*keys, parts, "step", "near", "total")
        proven = others.groupBy(*keys, "_part").cogroup(along.groupBy(*keys, "_part")).applyInPandas(_threats(keys), threat_schema)
        proven = small_side(proven.groupBy(*keys).agg(F.min("threat").alias("threat")), "proven")
        kept = lambda df: df.join(proven, keys, "left").filter(F.col("threat").isNull() | (F.col("step") < F.col("threat"))).drop("threat")  # noqa: B023, E731
        uses = stage(kept(uses), "uses")
        order = F.struct("step")
        after = uses.groupBy(*keys).agg(
            F.max_by("taken", order).alias("taken_"), F.max_by("last", order).alias("last_"),
            F.sum(F.col("accepted").cast("int")).cast("int").alias("more"), F.count(F.lit(1)).alias("steps"))
        after = small_side(after, "after")
        if after.isEmpty():
            classes *= 4
            continue
        within = uses.filter("accepted").join(now.select(*keys, "rank"), keys)
        within = number_rows(within, keys, ["step"], "nth_", largest=classes).join(own.select(*keys, "ord", "place", "sentence", "og_words"), [*keys, "ord"])
        picked.append(within.select(*keys, (F.col("rank") + F.col("nth_")).cast("int").alias("rank"), "place.*", "sentence", "og_words", "score"))
        if level:
            changes = stage(kept(changes), "changes")
            final = changes.groupBy(*keys, "term").agg(F.max_by("after", order).alias("after"))
            counts = stage(counts.join(final, [*keys, "term"], "left").select(*keys, "term", F.coalesce("after", "count").alias("count")), "counts")
            gone = uses.join(sums.select(*keys, "cid", "n"), [*keys, "cid"]).groupBy(*keys).agg(F.sum("n").alias("gone"))
            whole = moved(changes).groupBy(*keys, "cid").agg(F.sum("more_product").alias("more_product"), F.sum("more_mass").alias("more_mass"))
            added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0))).alias(c) for c in ("product", "mass")]
            sums = sums.join(whole, [*keys, "cid"], "left").select(*keys, "cid", "n", "copies", "used", "at", *added)
        else:
            gone = after.select(*keys, F.lit(0).alias("gone"))
        times = uses.join(own.select(*keys, "ord", "place"), [*keys, "ord"]).groupBy(*keys, "cid").agg(
            F.count(F.lit(1)).alias("times"), F.max("place").alias("at_"))
        sums = sums.join(times, [*keys, "cid"], "left").withColumns({"used": F.col("used") + F.coalesce("times", F.lit(0)), "at": F.coalesce("at_", "at")})
        sums = stage(sums.drop("times", "at_"), "sums")
        state = state.join(after, keys, "left").join(gone, keys, "left").select(
            *keys, "limit", (F.col("total") - F.coalesce("gone", F.lit(0))).alias("total"), F.coalesce("taken_", "taken").alias("taken"),
            (F.col("rank") + F.coalesce("more", F.lit(0))).cast("int").alias("rank"), F.when(F.col("steps").isNull(), F.col("last")).otherwise(F.col("last_")).alias("last"),
        ).filter("taken < limit")
        state = stage(state.join(sums.filter("used < copies").select(*keys).distinct(), keys, "left_semi"), "state")
    names = ["rank", *place, "sentence", "og_words", "score"]
    empty = members.select(*keys, F.lit(0).alias("rank"), "place.*", "sentence", "og_words", F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.unionByName, picked, empty).select(*keys, *names)
