"""The fitted sentence splitter against plain loops and on saved texts."""

import math
import os
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gistmill.operators import splitting, terms
from gistmill.plans import summarize as plans

FOLDER = Path(os.environ.get("SUMMARY_FILES", "no-such-folder"))


def core(token):
    return re.sub(r"[\"')\]}]+$", "", re.sub(r"^[\"'(\[{]+", "", token))


def word(token):
    found = re.sub(r"[.!?,;:]+$", "", core(token)).lower()
    return "##" if re.fullmatch(r"[+-]?[0-9][0-9.,]*", found) else found


def kind(token):
    c = core(token)
    return "mark" if re.search(r"[!?][.!?]*$", c) else "dots" if c.endswith("..") else "stop" if c.endswith(".") else "word"


def chance(hits, tries, p):
    part = lambda n, q: n * math.log(q) if n > 0 else 0.0
    return part(hits, p) + part(tries - hits, 1 - p)


def association(k, n1, n2, n):
    return -2 * (chance(k, n1, n2 / n) + chance(n2 - k, n - n1, n2 / n) - chance(k, n1, k / n1) - chance(n2 - k, n - n1, (n2 - k) / (n - n1)))


def fitted(texts):
    """Scores and ratios of all words, counted one token after the other."""
    n, stops = Counter(), Counter()
    for text in texts:
        for token in (text or "").split():
            if word(token):
                n[word(token)] += 1
                stops[word(token)] += kind(token) == "stop"
    total, p = sum(n.values()), sum(stops.values()) / sum(n.values())
    scores = {}
    for w in n:
        if stops[w] and any(c.isalpha() for c in w):
            bare = len(w.replace(".", ""))
            ratio = -2 * (chance(stops[w], n[w], p) - chance(stops[w], n[w], 0.99))
            scores[w] = ratio * math.exp(-bare) * (len(w) - bare + 1) * bare ** -(n[w] - stops[w])
    known = {w for w, s in scores.items() if s >= 0.3} | set(splitting.ABBREVIATIONS)
    after, pairs = Counter(), Counter()
    for text in texts:
        tokens = (text or "").split()
        for a, b in zip(tokens, tokens[1:]):
            if not word(b):
                continue
            after[word(b)] += kind(a) == "mark" or (kind(a) == "stop" and word(a) not in known)
            if kind(a) == "stop" and (re.fullmatch(r"[^\W\d_]|##", word(a))) and word(b)[0].isalpha():
                pairs[word(a), word(b)] += 1
    ends = sum(after.values())
    starters = {w: association(k, ends, n[w], total) for w, k in after.items() if k and w[0].isalpha() and k * total > n[w] * ends}
    together = {ab: association(k, n[ab[0]], n[ab[1]], total) for ab, k in pairs.items() if k * total > n[ab[0]] * n[ab[1]]}
    return scores, starters, together


def made_texts(count=120):
    rng = random.Random(8)
    names = ["".join(rng.choices("abdeghilmnoprstu", k=rng.randint(3, 8))) for _ in range(300)]
    texts = []
    for _ in range(count):
        said = []
        for _ in range(rng.randint(1, 6)):
            own = rng.choices(names, k=rng.randint(4, 12))
            own[0] = rng.choice(["then", "so", own[0]]).capitalize()
            for i in range(1, len(own) - 1):
                roll = rng.random()
                if roll < 0.06:
                    own[i] = "ca."
                elif roll < 0.09:
                    own[i] = "(e.g. " + own[i] + ")"
                elif roll < 0.11:
                    own[i] = "J. Marlow"
                elif roll < 0.13:
                    own[i] = str(rng.randint(1, 30)) + rng.choice(["", ".", ",5"])
            said.append(" ".join(own) + rng.choice([".", ".", ".", "!", "?", "..."]))
        texts.append(" ".join(said))
    return [*texts, None, "", " \n ", '"', "...", "Word"]


def test_scores(spark):
    texts = made_texts()
    counts = splitting.token_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), "text").persist()
    scores, starters, together = fitted(texts)
    got = {r.word: r.score for r in splitting.abbreviation_scores(counts).collect()}
    assert got.keys() == scores.keys() and all(math.isclose(got[w], s, rel_tol=1e-9, abs_tol=1e-12) for w, s in scores.items())
    assert got["ca"] > 0.3 and got["e.g"] > 0.3
    model = splitting.fit_splitter(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    found = {r.word: r.ratio for r in splitting.sentence_starters(splitting.with_ends(counts, model.abbreviations)).collect()}
    assert found.keys() == starters.keys() and all(math.isclose(found[w], s, rel_tol=1e-9) for w, s in starters.items())
    pairs = {(r.first, r.second): r.ratio for r in splitting.stop_collocations(counts).collect()}
    assert pairs.keys() == together.keys() and all(math.isclose(pairs[w], s, rel_tol=1e-9) for w, s in together.items())
    assert pairs["j", "marlow"] > splitting.COLLOCATION


def split(spark, model, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [r.part for r in splitting.split_fitted(df, ["id"], "text", model).orderBy("sen_pos").collect()]


def test_split(spark):
    model = splitting.fit_splitter(spark.createDataFrame([(t,) for t in made_texts()], "text string"), "text")
    cases = {
        "It took ca. five days. Then we met J. Marlow there.": ["It took ca. five days.", "Then we met J. Marlow there."],
        "She asked Dr. Unheard again. Nobody knew!  Why?\nSo it was.": ["She asked Dr. Unheard again.", "Nobody knew!", "Why?", "So it was."],
        "We had ca. Then nothing.": ["We had ca.", "Then nothing."],
        'He said "stop." Nothing (e.g. rain) came... and went... So what.': ['He said "stop."', "Nothing (e.g. rain) came... and went...", "So what."],
        "It was 5. august. It was 6. Nobody knew.": ["It was 5. august.", "It was 6.", "Nobody knew."],
        "no end": ["no end"], " . ": ["."], "": [], "   ": [],
    }
    for text, parts in cases.items():
        assert split(spark, model, text) == parts, text
    assert split(spark, model, None) == []
    # White space inside a sentence stays.
    assert split(spark, model, "It took ca.\n five days.") == ["It took ca.\n five days."]


def test_counts_at_hand_are_not_counted_again(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in made_texts()], "text string")
    whole = splitting.fit_splitter(df, "text")
    counts = splitting.stage(splitting.token_counts(df, "text"), "counts")
    monkeypatch.setattr(splitting, "token_counts", None)
    again = splitting.fit_splitter(df, "text", counts=counts)
    for one, other in zip(whole, again):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_model_of_nothing(spark):
    model = splitting.fit_splitter(spark.createDataFrame([], "text string"), "text")
    assert split(spark, model, "Mr. Fox ran. He won.") == ["Mr. Fox ran.", "He won."]


def test_summary_with_fitted_rule(spark):
    """A model stands in for a rule in whole jobs; equal texts of a group stay apart."""
    text = "The old gate opened ca. twice every day. Nobody went through that old gate again."
    df = spark.createDataFrame([(1, text), (1, text), (2, None)], "id int, text string")
    model = splitting.fit_splitter(spark.createDataFrame([(t,) for t in made_texts()], "text string"), "text")
    table = terms.explode_sentences(df, ["id"], [], "text", model)
    assert table.groupBy("part").count().orderBy("part").select("count").collect() == [(2,), (2,)]
    assert table.agg(F.countDistinct("text_row")).first()[0] == 2
    summary = plans.summarize(df, ["id"], [], "text", share=0.5, rule=model).collect()
    assert len(summary) == 2 and all(r.id == 1 for r in summary)


@pytest.mark.skipif(not FOLDER.exists(), reason="no saved summaries here")
def test_saved_sentences(spark):
    """Sentences of saved texts, joined by blanks, are found again at least as
    precisely and as completely as by the full rule."""
    head, cut = "Original Response: \n", "\nSummary: \n"
    folders = {}
    for path in FOLDER.rglob("*.txt"):
        text = path.read_text(encoding="utf-8", errors="replace")
        if text.startswith(head) and cut in text:
            folders.setdefault(path.parent, []).append([s.strip() for s in text[len(head):].split(cut, 1)[0].split("\n") if s.strip()])
    saved = next(files for files in folders.values() if len(files) == 187)
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(saved)], "id int, text string")

    def ends(parts):
        sizes = [len("".join(p.split())) for p in parts]
        return {sum(sizes[: i + 1]) for i in range(len(sizes) - 1)}

    def measured(rule):
        got = {}
        for r in terms.explode_sentences(df, ["id"], [], "text", rule).orderBy("sen_pos").collect():
            got.setdefault(r.id, []).append(r.part)
        hits = sum(len(ends(s) & ends(got[i])) for i, s in enumerate(saved))
        return hits / sum(len(ends(got[i])) for i in got), hits / sum(len(ends(s)) for s in saved)

    by_model, by_rule = measured(splitting.fit_splitter(df, "text")), measured("full")
    assert by_model[0] >= by_rule[0] and by_model[1] >= by_rule[1]


def test_model_meets_each_kind_of_cut_once(spark, monkeypatch):
    """Texts don't go through the joins with the model: like cuts are one row there."""
    kept = {}
    side = splitting.small_side
    monkeypatch.setattr(splitting, "small_side", lambda df, label: kept.setdefault(label, side(df, label)))
    texts = spark.createDataFrame([(i, "Dr. Stone met him. Then Dr. Stone left. So it went.") for i in range(50)], "id int, text string")
    ratio = "n int, after_end int, ratio double"
    model = splitting.SplitModel(
        spark.createDataFrame([("dr", 9, 9, 1.0)], "word string, n int, with_stop int, score double"),
        spark.createDataFrame([], f"first string, second string, {ratio}"), spark.createDataFrame([], f"word string, {ratio}"),
        spark.createDataFrame([], "word string, upper_inside int, lower int"))
    found = {}
    for r in splitting.split_fitted(texts, ["id"], "text", model).collect():
        found.setdefault(r.id, []).append((r.sen_pos, r.part))
    assert len(found) == 50
    assert all(sorted(f) == [(0, "Dr. Stone met him."), (1, "Then Dr. Stone left."), (2, "So it went.")] for f in found.values())
    assert [r.asDict() for r in kept["split-cuts"].select("first", "second").collect()] == [{"first": "dr", "second": "stone"}]
