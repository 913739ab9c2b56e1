import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gistmill.operators import evaluate, vectors

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def summaries(spark, seed, sizes=(1, 2, 5, 9)):
    rng = random.Random(seed)
    groups = {}
    for g, size in enumerate(sizes):
        base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) + "." for _ in range(size)]
        for i in range(1, size):
            if rng.random() < 0.5:
                base[i] = base[i - 1].replace(rng.choice(WORDS), rng.choice(WORDS), 1)
        groups[g] = base
    rows = [(g, i + 1, s, len(s.split())) for g, ss in groups.items() for i, s in enumerate(ss)]
    return groups, spark.createDataFrame(rows, "g int, rank int, sentence string, og_words int")


def longest_run(a, b):
    best = 0
    for i, j in itertools.product(range(len(a)), range(len(b))):
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        best = max(best, k)
    return best


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def passed(a, b):
    wa, wb = (re.findall(r"\w+|[^\w\s]", s) for s in (a, b))
    chars, words = min(len(a), len(b)), min(len(wa), len(wb))
    return (
        (longest_run(a, b) / chars >= 0.8) + (longest_run(wa, wb) / words >= 0.8)
        + (edits(a, b) / chars <= 0.6) + (len(set(wa) & set(wb)) / words >= 0.8)
    )


@pytest.mark.parametrize("block", [64, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_pair_redundancy(spark, monkeypatch, seed, block):
    monkeypatch.setattr(evaluate, "BLOCK", block)
    groups, summary = summaries(spark, seed)
    got = {r.g: r.redundancy for r in evaluate.pair_redundancy(summary, ["g"]).collect()}
    assert got == {g: pytest.approx(-0.1 * sum(passed(a, b) for a, b in itertools.combinations(s, 2))) for g, s in groups.items()}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngram_ratio(spark, n):
    groups, summary = summaries(spark, 3)
    expected = {}
    for g, sentences in groups.items():
        words = " ".join(sentences).split()
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        if grams:
            expected[g] = pytest.approx(len(set(grams)) / len(grams))
    assert {r.g: r.ratio for r in evaluate.unique_ngram_ratio(summary, ["g"], n).collect()} == expected


def test_focus(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [0.1, 1.0]), (1, 4, [0.0, 0.0]), (2, 1, [1.0, 0.0])]
    summary = spark.createDataFrame(rows, "g int, rank int, v array<double>")
    got = {r.g: r.focus for r in evaluate.focus(summary, ["g"], "v").collect()}
    assert got == {1: pytest.approx(-0.2), 2: 0.0}


def test_word_vectors(spark):
    _, summary = summaries(spark, 4)
    vectors = evaluate.word_vectors(summary, size=5)
    assert {len(r.vector) for r in vectors.collect()} == {5}
    assert evaluate.focus(vectors, ["g"], "vector").count() == 4


@pytest.mark.parametrize("seed", range(4))
def test_longest_common_run(spark, seed):
    rng = random.Random(seed)
    rows = [(i, *([rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 25))] for _ in range(2))) for i in range(60)]
    rows += [(60, [], []), (61, ["a"], None), (62, None, None)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    got = {r.i: r.run for r in df.select("i", evaluate.longest_common_run("a", "b").alias("run")).collect()}
    assert got == {i: None if a is None or b is None else longest_run(a, b) for i, a, b in rows}


def test_common_runs_of_long_texts(spark):
    shared = " ".join(f"s{i}" for i in range(20_000))
    rows = [(1, 1, "one two " + shared), (1, 2, shared + " three"), (1, 3, ""), (1, 4, None), (2, 1, "alone")]
    df = spark.createDataFrame(rows, "g int, rank int, sentence string")
    got = {(r.g, r["rank"]): (r.run, r.share) for r in evaluate.common_runs(df, ["g"]).collect()}
    assert got[1, 1] == (20_000, pytest.approx(20_000 / 20_001)) and got[1, 2] == (0, 0.0) and len(got) == 3


def test_learned_vectors_match_loop(spark):
    import hashlib
    import math

    rng = random.Random(6)
    texts = [[rng.choice(WORDS) for _ in range(rng.randint(0, 9))] for _ in range(30)] + [["lonely"], []]
    counts = {}
    for text in texts:
        for i, j in itertools.permutations(range(len(text)), 2):
            if abs(i - j) <= 2:
                counts[text[i], text[j]] = counts.get((text[i], text[j]), 0) + 1
    totals = {}
    for (word, _), n in counts.items():
        totals[word] = totals.get(word, 0) + n
    expected = {word: [0] * 8 for word in totals}
    for (word, other), n in counts.items():
        chance = n * sum(totals.values()) / (totals[word] * totals[other])
        if chance > 1:
            digest = hashlib.md5(other.encode()).hexdigest()
            for i in range(8):
                expected[word][i] += round(math.log(chance) * 1_000_000) * (1 if digest[i] >= "8" else -1)
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "words array<string>")
    learned = vectors.learn_vectors(df, "words", size=8, window=2)
    assert {r.word: r.vector for r in learned.collect()} == expected
    sentences = spark.createDataFrame([(1, 1, ["alpha", "beta", "alpha"]), (1, 2, ["lonely"]), (None, 3, ["gamma"]), (2, 4, [])], "g int, rank int, words array<string>")
    got = {(r.g, r["rank"]): r.vector for r in vectors.sentence_vectors(sentences, ["g", "rank"], "words", learned, 8).collect()}
    assert got[1, 1] == pytest.approx([(2 * a + b) / 3 for a, b in zip(expected["alpha"], expected["beta"])])
    assert got[None, 3] == pytest.approx(expected["gamma"]) and got[1, 2] == got[2, 4] == [0.0] * 8
    with pytest.raises(ValueError):
        vectors.learn_vectors(df, "words", size=33)


def test_learned_vectors_of_like_words(spark):
    rng = random.Random(7)
    sides = [["cat", "dog"], ["bread", "cake"]]
    company = [["fur", "paw", "tail"], ["oven", "flour", "sugar"]]
    texts = [[rng.choice(company[i % 2]), rng.choice(sides[i % 2]), rng.choice(company[i % 2])] for i in range(200)]
    learned = vectors.learn_vectors(spark.createDataFrame([(t,) for t in texts], "words array<string>"), "words", size=32)
    held = {r.word: r.vector for r in learned.collect()}

    def like(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(held[x], held[y]))
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    assert min(like("cat", "dog"), like("bread", "cake")) > 0.8 > 0.5 > max(like("cat", "bread"), like("dog", "cake"))


def test_readability(spark):
    groups, summary = summaries(spark, 5)
    summary = summary.withColumn("n_errors", F.col("rank") % 2).withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    keys = ["g"]
    redundancy, focused = evaluate.ngram_redundancy(summary, keys), evaluate.focus(summary, keys, "vector")
    checked = evaluate.grammar(summary, keys)
    total = {r.g: r for r in evaluate.readability(redundancy, focused, checked, keys).collect()}
    thirds = {r.g: r for r in evaluate.readability_thirds(
        redundancy, focused, checked, evaluate.summary_sizes(summary, keys), keys).collect()}
    for g, sentences in groups.items():
        words = " ".join(sentences).split()
        grams = list(zip(words, words[1:]))
        red = len(set(grams)) / len(grams) - 1 if grams else 0.0
        correct = 1 - sum((i + 1) % 2 for i in range(len(sentences))) / len(words)
        assert total[g].readability == pytest.approx(red + correct)
        assert thirds[g].readability == pytest.approx(correct / 3 + (1 - abs(red) * 10 / len(sentences)) / 3 + 1 / 3)


def test_min_max(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 5.0)], "k string, x double")
    assert sorted((r.k, r.scaled) for r in evaluate.min_max(df, "x", ["k"]).collect() if r.k == "a") == [("a", 0.0), ("a", 0.5), ("a", 1.0)]
    assert [r.scaled for r in evaluate.min_max(df, "x", ["k"]).collect() if r.k == "b"] == [None]
    assert sorted(r.scaled for r in evaluate.min_max(df, "x").collect()) == [0.0, 0.25, 0.5, 1.0]


def test_choose(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 1.0)], "g int, readability double")
    b = spark.createDataFrame([(1, 1.0), (2, 1.0), (4, 0.0)], "g int, readability double")
    got = {r.g: r.chosen for r in evaluate.choose_candidate(a, b, ["g"]).collect()}
    assert got == {1: "first", 2: "second", 3: "second", 4: "second"}


def test_rouge(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice(WORDS) for _ in range(rng.randint(1, 12))], [rng.choice(WORDS) for _ in range(rng.randint(1, 12))]) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, a array<string>, b array<string>")
    candidates, references = (df.select("g", F.col(c).alias("words")) for c in "ab")
    ones = {r.g: r for r in evaluate.rouge_n(candidates, references, ["g"]).collect()}
    longest = {r.g: r for r in evaluate.rouge_l(candidates, references, ["g"]).collect()}
    for g, a, b in rows:
        both = sum(min(a.count(w), b.count(w)) for w in set(a))
        assert ones[g].recall == pytest.approx(both / len(b)) and ones[g].precision == pytest.approx(both / len(a))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert longest[g].recall == pytest.approx(table[-1][-1] / len(b))


def test_learned_vectors_meet_totals_once_a_pair(spark, monkeypatch):
    """Vectors as a plain loop makes them, with one row for both sides of a pair."""
    texts = ["a b a c d e", "b b c a", "d d d e f a", "", "g", "c f b"]
    size, window = 16, 2
    met, pairs = Counter(), set()
    for text in texts:
        said = text.split()
        for i, word in enumerate(said):
            for other in said[i + 1 : i + 1 + window]:
                met[word, other] += 1
                met[other, word] += 1
                pairs.add((min(word, other), max(word, other)))
    totals = Counter()
    for (word, _), n in met.items():
        totals[word] += n
    expected = {word: [0] * size for word in totals}
    for (word, context), n in met.items():
        chance = n * float(sum(totals.values())) / (float(totals[word]) * totals[context])
        if chance > 1:
            for i, digit in enumerate(hashlib.md5(context.encode()).hexdigest()[:size]):
                expected[word][i] += round(math.log(chance) * 1_000_000) * (1 if digit >= "8" else -1)
    written, own = {}, vectors.stage

    def counted(df, label):
        out = own(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(vectors, "stage", counted)
    df = spark.createDataFrame([(t.split(),) for t in texts], "words array<string>")
    got = {r.word: list(r.vector) for r in vectors.learn_vectors(df, "words", size, window).collect()}
    assert got == expected
    assert written["neighbours"] == written["sides"] == len(pairs)


def test_neighbours_are_not_broadcast(spark):
    """Vectors and words of many sentences take little room in files, but not on the driver."""
    rows = [(k, r, f"some words {r % 3} of {k}", [float(k + r), 1.0]) for k in range(3) for r in range(1, 5)]
    summary = spark.createDataFrame(rows, "k long, rank int, sentence string, vector array<double>")
    found = [evaluate.focus(summary, ["k"], "vector"), evaluate.ngram_redundancy(summary, ["k"]), evaluate.common_runs(summary, ["k"])]
    for df in found:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert df.count()
