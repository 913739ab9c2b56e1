"""A sentence splitter fitted to the texts themselves, without labels.

After Kiss and Strunk (2006), Unsupervised Multilingual Sentence Boundary Detection:
a full stop belongs to an abbreviation if the word before it nearly always has one,
is short and seldom stands without; initials and numbers keep theirs where the next
word follows them more often than chance; and after an abbreviation a sentence begins
only where the next word is written as words are at the start of sentences, or is
itself a frequent starter. All of it comes from one table of counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import text as tx
from gistmill.functions.wordlists import ABBREVIATIONS
from gistmill.session import small_side, spread, stage

# Fixed values of the paper: least abbreviation score, least log-likelihood ratios.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: How often an abbreviation has its full stop.
CERTAIN = 0.99
NUMBER = "##"

_OPENERS, _CLOSERS = "\"'([{", "\"')]}"
_NOT_SPACE = tx.SPACE.replace("[", "[^", 1)
_END = rf"([.!?]+[\"')\]}}]*{tx.SPACE}+)"


class SplitModel(NamedTuple):
    abbreviations: DataFrame  # word, n, with_stop, score
    collocations: DataFrame  # first, second, n, ratio
    starters: DataFrame  # word, n, after_end, ratio
    cases: DataFrame  # word, upper_inside, lower


def _core(token: Column) -> Column:
    return F.rtrim(F.ltrim(token, F.lit(_OPENERS)), F.lit(_CLOSERS))


def token_word(token: Column) -> Column:
    """The lower-cased word of a token, without quotes, brackets and final marks;
    all numbers are one."""
    word = F.lower(F.rtrim(_core(token), F.lit(".!?,;:")))
    return F.when(word.rlike(r"^[+-]?[0-9][0-9.,]*$"), NUMBER).otherwise(word)


def token_kind(token: Column) -> Column:
    """How a token ends: ``mark`` (with ! or ?), ``dots``, ``stop`` or ``word``."""
    core = _core(token)
    without = F.rtrim(core, F.lit("."))
    return (
        F.when(without.endswith("!") | without.endswith("?"), "mark").when(core.endswith(".."), "dots")
        .when(core.endswith("."), "stop").otherwise("word")
    )


def _upper(token: Column) -> Column:
    return _core(token).rlike(r"^\p{Lu}")


def _lower(token: Column) -> Column:
    return _core(token).rlike(r"^\p{Ll}")


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """How often each word comes with or without a full stop, with a capital or a
    small letter, after which kind of token (``start`` at the start of a text), and
    if that has a full stop, after which word. Adds up in each task first."""
    words = tx.split_words(text)
    pairs = df.select(words.alias("words")).filter(F.size("words") > 0).select(
        F.inline(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.slice("words", F.lit(1), F.size("words") - 1)).alias("before"), F.col("words").alias("token")))
    )
    token, before = F.col("token"), F.col("before")
    # What comes before matters only with a mark. Equal pairs are one from here on.
    marked = F.when(before.isNull() | (token_kind(before) != "word"), before).otherwise("w")
    pairs = pairs.groupBy(marked.alias("before"), "token").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(before.isNull(), "start").otherwise(token_kind(before))
    rows = pairs.select(
        kind.alias("kind"), F.when(kind == "stop", token_word(before)).otherwise("").alias("before"),
        token_word(token).alias("word"), (token_kind(token) == "stop").alias("stop"),
        _upper(token).alias("upper"), _lower(token).alias("lower"), "n",
    )
    return rows.filter("word <> ''").groupBy("kind", "before", "word", "stop", "upper", "lower").agg(F.sum("n").alias("n"))


def _weighed(count: Column, p: Column) -> Column:
    return F.when(count > 0, count * F.ln(p)).otherwise(F.lit(0.0))


def _log_likelihood(hits: Column, tries: Column, p: Column) -> Column:
    return _weighed(hits, p) + _weighed(tries - hits, 1 - p)


def association(together: Column, first: Column, second: Column, total: Column) -> Column:
    """Log-likelihood ratio of ``second`` depending on ``first`` or not."""
    p, p1, p2 = second / total, together / first, (second - together) / (total - first)
    apart, rest = second - together, total - first
    return -2 * (
        _log_likelihood(together, first, p) + _log_likelihood(apart, rest, p)
        - _log_likelihood(together, first, p1) - _log_likelihood(apart, rest, p2)
    )


def word_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("with_stop"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``word, n, with_stop, score`` of words with a letter that have a full stop
    somewhere. The score is the log-likelihood ratio of nearly always having it,
    less for longer words and those found without, more for inner full stops."""
    totals = word_totals(counts)
    whole = totals.agg(F.sum("n").alias("total"), F.sum("with_stop").alias("stops"))
    bare = F.length(F.translate("word", ".", ""))
    inner = F.length("word") - bare
    p = F.col("stops") / F.col("total")
    ratio = -2 * (
        _log_likelihood(F.col("with_stop"), F.col("n"), p)
        - _log_likelihood(F.col("with_stop"), F.col("n"), F.lit(CERTAIN))
    )
    score = ratio * F.exp(-bare) * (inner + 1) * F.pow(bare.cast("double"), -(F.col("n") - F.col("with_stop")))
    # One row of totals on every word.
    words = totals.filter((F.col("with_stop") > 0) & F.col("word").rlike(r"\p{L}"))
    return words.join(F.broadcast(whole)).select("word", "n", "with_stop", score.alias("score"))


def with_ends(counts: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Add ``after_end``: whether the token before ends a sentence by its form alone:
    by a mark, or by a full stop that is no abbreviation's."""
    known = abbreviations.select(F.col("word").alias("before"), F.lit(True).alias("known"))
    stops, rest = counts.filter("kind = 'stop'"), counts.filter("kind <> 'stop'")
    stops = stops.join(known, "before", "left").withColumn("after_end", F.col("known").isNull()).drop("known")
    return rest.withColumn("after_end", F.col("kind") == "mark").unionByName(stops)


def sentence_starters(ended: DataFrame) -> DataFrame:
    """``word, n, after_end, ratio`` of words that come after the end of a sentence
    more often than chance would have it."""
    words = ended.groupBy("word").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("after_end"), F.col("n")).otherwise(0)).alias("after_end"))
    whole = words.agg(F.sum("n").alias("total"), F.sum("after_end").alias("ends"))
    words = words.filter(F.col("word").rlike(r"^\p{L}") & (F.col("after_end") > 0)).join(F.broadcast(whole))
    more = F.col("after_end") * F.col("total") > F.col("n") * F.col("ends")
    ratio = association(F.col("after_end"), F.col("ends"), F.col("n"), F.col("total"))
    return words.filter(more).select("word", "n", "after_end", ratio.alias("ratio"))


def stop_collocations(counts: DataFrame) -> DataFrame:
    """``first, second, n, ratio`` of words that follow the full stop of an initial
    or a number more often than chance would have it."""
    totals = word_totals(counts).select("word", F.col("n").alias("times"))
    whole = totals.agg(F.sum("times").alias("total"))
    pairs = counts.filter((F.col("kind") == "stop") & (F.col("before").rlike(r"^\p{L}$") | (F.col("before") == NUMBER)) & F.col("word").rlike(r"^\p{L}"))
    pairs = pairs.groupBy(F.col("before").alias("first"), F.col("word").alias("second")).agg(F.sum("n").alias("n"))
    pairs = (
        pairs.join(totals.select(F.col("word").alias("first"), F.col("times").alias("n1")), "first")
        .join(totals.select(F.col("word").alias("second"), F.col("times").alias("n2")), "second").join(F.broadcast(whole))
    )
    ratio = association(F.col("n"), F.col("n1"), F.col("n2"), F.col("total"))
    return pairs.filter(F.col("n") * F.col("total") > F.col("n1") * F.col("n2")).select("first", "second", "n", ratio.alias("ratio"))


def word_cases(ended: DataFrame) -> DataFrame:
    """How often a word has a capital inside a sentence, and a small letter at all."""
    inside = (F.col("kind") != "start") & (F.col("kind") != "dots") & ~F.col("after_end") & F.col("upper")
    return ended.groupBy("word").agg(
        F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("upper_inside"),
        F.sum(F.when(F.col("lower"), F.col("n")).otherwise(0)).alias("lower"),
    )


def fit_splitter(df: DataFrame, text: str, known: Iterable[str] = ABBREVIATIONS, counts: DataFrame | None = None) -> SplitModel:
    """The model of the texts of ``df``, with the abbreviations found there and those
    ``known`` beforehand, which few texts may not tell. Texts are read once, or not at
    all where their ``token_counts`` are at hand, staged, as ``counts``; tables
    that are small enough are broadcast where the model is used, and joined by
    shuffles beyond."""
    if counts is None:
        counts = stage(token_counts(spread(df.select(text)), text), "split-counts")
    listed = list(known)
    found = abbreviation_scores(counts).filter((F.col("score") >= ABBREVIATION) | F.col("word").isin(listed))
    more = df.sparkSession.createDataFrame([(w, 0, 0, None) for w in listed], found.schema).join(found.select("word"), "word", "left_anti")
    abbreviations = small_side(found.unionByName(more), "split-abbreviations")
    ended = stage(with_ends(counts, abbreviations), "split-ends")
    starters = small_side(sentence_starters(ended).filter(F.col("ratio") >= STARTER), "split-starters")
    pairs = stop_collocations(counts).filter(F.col("ratio") >= COLLOCATION)
    pairs = pairs.join(starters.select(F.col("word").alias("second")), "second", "left_anti").select("first", "second", "n", "ratio")
    return SplitModel(abbreviations, small_side(pairs, "split-collocations"), starters, small_side(word_cases(ended), "split-cases"))


def split_fitted(df: DataFrame, columns: Sequence[str | Column], text: str, model: SplitModel) -> DataFrame:
    """One row per sentence: ``columns``, ``sen_pos`` from 0 and the trimmed ``part``.
    ``columns`` must tell the rows of ``df`` apart. Null and blank texts give none.

    Texts are cut after every terminator; only cuts that a full stop or dots leave in
    doubt meet the model, and pieces on both sides of a cut that is no end are put
    together again.
    """
    marked = F.regexp_replace(text, _END, "$1" + tx.BREAK)
    pieces = df.select(*columns, F.split(marked, tx.BREAK).alias("pieces"))
    keys = pieces.drop("pieces").columns
    # As arrays of one length, so that a piece knows the next one.
    nexts = F.concat(F.slice("pieces", F.lit(2), F.size("pieces")), F.array(F.lit(None).cast("string")))
    rows = pieces.select(*keys, F.posexplode(F.arrays_zip(F.col("pieces").alias("piece"), nexts.alias("next"))).alias("pos", "own"))
    last = F.regexp_extract("own.piece", f"({_NOT_SPACE}+){tx.SPACE}*$", 1)
    following = F.regexp_extract("own.next", f"^{tx.SPACE}*({_NOT_SPACE}+)", 1)
    rows = rows.select(
        *keys, "pos", F.col("own.piece").alias("piece"), token_kind(last).alias("kind"), token_word(last).alias("first"),
        token_word(following).alias("second"), _upper(following).alias("upper"), _lower(following).alias("lower"),
        F.col("own.next").isNull().alias("final"),
    )
    rows = stage(rows, "split-pieces")
    in_doubt = ~F.col("final") & F.col("kind").isin("stop", "dots")
    # The model sees each kind of cut once; texts don't go through its joins.
    about = ["kind", "first", "second", "upper", "lower"]
    cuts = rows.filter(in_doubt).select(*about).distinct()

    def marked_by(table: DataFrame, on: dict[str, str], name: str):
        own = table.select(*(F.col(theirs).alias(ours) for theirs, ours in on.items()), F.lit(True).alias(name))
        return own, list(on.values())

    for table, on, name in (
        (model.abbreviations, {"word": "first"}, "known"),
        (model.collocations, {"first": "first", "second": "second"}, "paired"),
        (model.starters, {"word": "second"}, "starter"),
    ):
        cuts = cuts.join(*marked_by(table, on, name), "left")
    cuts = cuts.join(model.cases.select(F.col("word").alias("second"), "upper_inside", F.col("lower").alias("n_lower")), "second", "left")
    seen_lower, seen_inside = F.coalesce("n_lower", F.lit(0)) > 0, F.coalesce("upper_inside", F.lit(0)) > 0
    # What the writing of the next word says: a start, no start, or nothing.
    starts = F.when(F.col("upper") & seen_lower & ~seen_inside, True).when(F.col("lower"), False)
    is_known, is_paired = F.col("known").isNotNull(), F.col("paired").isNotNull()
    initial, number = F.col("first").rlike(r"^\p{L}$"), F.col("first") == NUMBER
    by_abbreviation = F.coalesce(starts, F.col("starter").isNotNull() & F.col("upper"))
    by_initial = F.coalesce(starts, ~(F.col("upper") & ~seen_lower))
    ends = (
        F.when(F.col("kind") == "dots", F.col("upper"))
        .when((initial | number) & is_paired, False)
        .when(initial, by_initial).when(is_known, by_abbreviation)
        .when(number, F.coalesce(starts, F.lit(True)))
        .otherwise(True)
    )
    within = small_side(cuts.filter(~ends).select(*about, F.lit(True).alias("within")), "split-cuts")
    every = rows.join(within, about, "left").select(*keys, "pos", "piece", (~in_doubt | F.col("within").isNull()).alias("ends"))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = every.withColumn("sen_pos", F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    return numbered.groupBy(*keys, "sen_pos").agg(tx.strip(joined).alias("part")).filter("part <> ''")
