import math
import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmill.operators import greedy, lazy, running, scoring, selection, terms, topics
from gistmill.plans import summarize as plans
from gistmill.session import stage
from loops import Group

WORDS = "river stone bridge walking walked market silver cloud The the of runner running apples apple green light".split()


def make_groups(seed, n_groups=6, big=40):
    rng = random.Random(seed)
    groups = {}
    for g in range(n_groups):
        size = big if g == 0 else rng.randint(1, 14)
        sentences = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([2, 5, 6, 8, 12, 31]))) for _ in range(size)]
        for i in range(1, size):
            if rng.random() < 0.15:
                sentences[i] = sentences[i - 1]
        groups[g] = sentences
    groups[97] = ["the of the of the", "of the of the of"]  # no terms
    groups[98] = ["of the", "the of the of the"]  # no terms, first sentence too short
    return groups


def table(spark, groups):
    rows = [(g, i // 3, i % 3, s) for g, sentences in groups.items() for i, s in enumerate(sentences)]
    parts = spark.createDataFrame(rows, "g int, r int, sen_pos int, part string")
    return stage(terms.with_bag(terms.describe_sentences(parts, "part")), "test")


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.g, r["rank"])):
        out.setdefault(r.g, []).append(r.r * 3 + r.sen_pos)
    return out


def by_loop(groups, limit, by_sentences, **options):
    picked = {g: Group(s).pick(limit(s), by_sentences, **options) for g, s in groups.items()}
    return {g: p for g, p in picked.items() if p}


LIMITS = {
    "percent": (lambda s: int(len(s) * 0.3), True),
    "250": (lambda s: 250, False),
    "40": (lambda s: 40, False),
}


@pytest.mark.parametrize("window_rows", [1, 1_000_000])
@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("seed", [1, 2])
def test_level_0_matches_loop(spark, monkeypatch, seed, limit, window_rows):
    monkeypatch.setattr(running, "WINDOW_ROWS", window_rows)
    groups = make_groups(seed)
    size, by_sentences = LIMITS[limit]
    got = plans.summarize_sentences(table(spark, groups), ["g"], ["r"], limit=limit, share=0.3)
    assert result(got) == by_loop(groups, size, by_sentences)


@pytest.mark.parametrize("seed", [1, 2])
def test_tfidf_matches_loop(spark, seed):
    groups = {g: s for g, s in make_groups(seed).items() if g < 90}
    got = plans.summarize_sentences(table(spark, groups), ["g"], ["r"], method="tfidf", share=0.3)
    assert result(got) == by_loop(groups, LIMITS["percent"][0], True, method="tfidf")


@pytest.mark.parametrize("level", [1, 2])
@pytest.mark.parametrize("limit", ["percent", "40"])
@pytest.mark.parametrize("local_sentences", [20_000, 10])
def test_reducing_matches_loop(spark, level, limit, local_sentences):
    groups = make_groups(5, n_groups=4, big=24)
    size, by_sentences = LIMITS[limit]
    got = greedy.select_reducing(
        table(spark, groups), ["g"], ["r"], level, limit, share=0.3, local_sentences=local_sentences)
    assert result(got) == by_loop(groups, size, by_sentences, level=level)


@pytest.mark.parametrize("level, classes", [(1, 3), (2, 5), (2, 1)])
def test_reducing_in_many_rounds_matches_loop(spark, monkeypatch, level, classes):
    """Few classes a round, so that classes outside end most rounds early."""
    rounds = []
    monkeypatch.setattr(greedy, "pick_lazily", functools.partial(lazy.pick_lazily, classes=classes))
    monkeypatch.setattr(lazy, "_loop", lambda *a, own=lazy._loop: (rounds.append(1), own(*a))[1])
    groups = make_groups(6, n_groups=3, big=30)
    got = greedy.select_reducing(table(spark, groups), ["g"], ["r"], level, "percent", share=0.4, local_sentences=3)
    assert result(got) == by_loop(groups, lambda s: int(len(s) * 0.4), True, level=level) and len(rounds) > 2


def test_hundreds_of_rejected_sentences_are_one_round(spark, monkeypatch):
    """Short sentences score best and are all used up before the first pick."""
    rounds = []
    monkeypatch.setattr(lazy, "_loop", lambda *a, own=lazy._loop: (rounds.append(1), own(*a))[1])
    texts = [f"River w{i}." for i in range(600)] + [f"Silver gates open v{i} slowly near quiet frozen lakes u{i}." for i in range(5)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g int, r int, text string")
    sentences = plans.prepare(df, ["g"], ["r"], "text")
    rows = lambda **more: sorted(map(tuple, greedy.select_reducing(sentences, ["g"], ["r"], 2, "20", **more).collect()))
    assert rows(local_sentences=1) == rows() != [] and len(rounds) == 1


def test_copies_in_rounds_match_one_task(spark):
    """Many equal sentences, and the same words in another order: near ties."""
    rng = random.Random(3)
    base = ["silver gate opens slowly near river", "river near slowly opens gate silver", "quiet foxes cross seven frozen bridges daily"]
    texts = [" ".join(rng.choice([". ".join(rng.choices(base, k=4)), "lonely boats drift past old mills again"]).split()).capitalize() + "." for _ in range(60)]
    df = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts)], "g int, r int, text string")
    sentences = plans.prepare(df, ["g"], ["r"], "text")
    rows = lambda **more: sorted(map(tuple, greedy.select_reducing(sentences, ["g"], ["r"], 2, "percent", share=0.3, **more).collect()))
    assert rows(local_sentences=1) == rows()


@pytest.mark.parametrize("level", [1, 2])
def test_topics_in_rounds_match_one_task(spark, level):
    sentences = table(spark, make_groups(9, n_groups=3, big=20))
    rows = lambda **more: sorted(
        (r.g, r["rank"], r.r, r.sen_pos, round(r.score, 9)) for r in greedy.select_reducing(
            sentences, ["g"], ["r"], level, "percent", share=0.4, keywords=keyword_table(spark), n_topics=4, **more).collect())
    assert rows(local_sentences=1) == rows() != []


TOPICS = {"river": {0, 1}, "silver": {2}, "appl": {1}, "run": {3, 0}}


def keyword_table(spark):
    return spark.createDataFrame([(t, sorted(x)) for t, x in TOPICS.items()], "term string, topics array<int>")


@pytest.mark.parametrize("local_sentences", [20_000, 10])
@pytest.mark.parametrize("level", [0, 2])
def test_topic_variant_2_matches_loop(spark, level, local_sentences):
    groups = make_groups(7, n_groups=3, big=16)
    got = greedy.select_reducing(
        table(spark, groups), ["g"], ["r"], level, "percent", 0.3, keywords=keyword_table(spark), n_topics=4,
        variant="v2", local_sentences=local_sentences)
    assert result(got) == by_loop(groups, LIMITS["percent"][0], True, level=level, topics=TOPICS, n_topics=4, v2=True)


def test_covered_topics_alone_take_no_round_a_pick(spark, monkeypatch):
    """At level 0 the first sentences of each set of topics do; too few are tried again."""
    monkeypatch.setattr(greedy, "_pick_by_rounds", None)
    monkeypatch.setattr(greedy, "FIRST_OF_TOPICS", 1, raising=False)
    sentences = table(spark, make_groups(7, n_groups=3, big=16))
    rows = lambda **more: sorted(
        (r.g, r["rank"], r.r, r.sen_pos, round(r.score, 9)) for r in greedy.select_reducing(
            sentences, ["g"], ["r"], 0, "percent", 0.3, keywords=keyword_table(spark), n_topics=4, variant="v2", **more).collect())
    assert rows(local_sentences=1) == rows() != []


def test_topic_variant_1_matches_loop(spark):
    groups = make_groups(8)
    model = topics.TopicModel(None, keyword_table(spark), 4)
    got = plans.summarize_sentences(table(spark, groups), ["g"], ["r"], method="topics", share=0.3, model=model)
    assert result(got) == by_loop(groups, LIMITS["percent"][0], True, topics=TOPICS, n_topics=4)


def test_summary_is_part_of_source_and_repeatable(spark):
    groups = make_groups(3)
    sentences = table(spark, groups)
    first, second = (result(plans.summarize_sentences(sentences, ["g"], ["r"])) for _ in range(2))
    assert first == second
    sources = {(r.g, r.sentence) for r in sentences.collect()}
    assert {(r.g, r.sentence) for r in plans.summarize_sentences(sentences, ["g"], ["r"]).collect()} <= sources


def test_word_limit_stops_at_the_sum(spark):
    groups = {1: [" ".join(f"w{i}x{j}" for j in range(25)) for i in range(12)]}
    got = plans.summarize_sentences(table(spark, groups), ["g"], ["r"], limit="250")
    assert got.count() == 10


def test_size_gate(spark):
    groups = {1: ["one two three four five"] * 4, 2: ["one two three four five"] * 5}
    sentences = table(spark, groups)
    got = plans.summarize_sentences(sentences, ["g"], ["r"], limit="250", min_words=20)
    assert {r.g for r in got.collect()} == {2}
    got = plans.summarize_sentences(sentences, ["g"], ["r"], limit="250", min_words=20, redundancy=1)
    assert {r.g for r in got.collect()} == {2}


def test_limits(spark):
    df = spark.createDataFrame([(23, 14, 131)], "n_sentences long, n_responses long, total_words long")
    got = df.select(*(selection.summary_limit(k).alias(f"x{i}") for i, k in enumerate(["percent", "rev_count", "doc", "250"]))).first()
    assert tuple(got) == (int(23 * 0.15), int(14 / 5) * 25, int(131 * 0.8), 250)


def test_listing_scores_sentences_without_terms(spark):
    groups = {1: ["of the of the of", "river stone bridge walked far"]}
    listed = scoring.score_listing(table(spark, groups), ["g"], ["r"]).orderBy("sen_pos").collect()
    assert listed[0].score == 1000.0
    assert listed[1].score == pytest.approx(Group(groups[1]).kl(1))
    flags = scoring.has_positive(scoring.score_listing(table(spark, groups), ["g"], ["r"]), ["g"]).first()
    assert flags.has_positive is (0 < listed[1].score < 100)


@pytest.mark.parametrize("redundancy", [0, 1])
def test_texts_without_an_order(spark, redundancy):
    texts = [("a", f"Item{i} holds word{i} and other{i} things{i} here now.") for i in range(3)]
    df = spark.createDataFrame(texts, "asin string, content string")
    picked = plans.summarize(df, ["asin"], [], "content", share=1.0, redundancy=redundancy, rule="plain", normalize="lower").collect()
    placed = plans.summarize(
        spark.createDataFrame([(*t, i) for i, t in enumerate(texts)], "asin string, content string, at int"),
        ["asin"], ["at"], "content", share=1.0, redundancy=redundancy, rule="plain", normalize="lower",
    ).collect()
    assert {r.sentence for r in picked} == {r.sentence for r in placed} and len(picked) == len(placed) == 3
    assert sorted(round(r.score, 9) for r in picked) == sorted(round(r.score, 9) for r in placed)


def test_hot_keys_stay_in_place(spark, monkeypatch):
    from gistmill import session

    monkeypatch.setattr(session, "HOT_KEYS", 20)
    left = spark.createDataFrame([("g", "hot" if i % 2 else f"t{i}", i) for i in range(400)], "g string, term string, i int")
    right = left.groupBy("g", "term").count().withColumnRenamed("count", "df")
    joined = session.join_hot(session.stage(left, "left"), session.stage(right, "right"), ["g", "term"], "df")
    assert sorted(r.i for r in joined.collect()) == list(range(400))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    parts = joined.where("term = 'hot'").rdd.glom().map(len).collect() if left.rdd.getNumPartitions() > 1 else [1]
    assert max(parts) < 200


def test_paragraphs_and_shortening(spark):
    rows = [(1, i, f"a{i} b c d e f g h i j", 10) for i in range(1, 4)]
    summary = spark.createDataFrame(rows, "g int, rank int, sentence string, og_words int")
    assert [r["rank"] for r in plans.shorten_extract(summary, ["g"], 15).orderBy("rank").collect()] == [1, 2]
    whole = plans.paragraphs(summary, ["g"]).first()
    assert whole.paragraph == " ".join(r[2] for r in rows) and whole.n_words == 30
    text = spark.createDataFrame([(" ".join(r[2] + "." for r in rows),)], "t string")
    short = plans.shorten_text(text, "t", 15, rule="plain").first()
    assert short.n_words == 20 and short.shortened == " ".join(r[2] + "." for r in rows[:2])


def test_candidates(spark):
    groups = make_groups(11)
    rows = [(g, i, s + ".") for g, sentences in groups.items() for i, s in enumerate(sentences)]
    df = spark.createDataFrame(rows, "g int, r int, text string")
    by_words, by_share = plans.two_candidates(df, ["g"], ["r"], "text", share=0.3)
    loop = lambda **o: {g: [Group(s).texts[i] for i in Group(s).pick(**o(s))] for g, s in groups.items()}

    def texts(summary):
        out = {g: [] for g in groups}
        for r in summary.orderBy("g", "rank").collect():
            out[r.g].append(r.sentence)
        return out

    assert texts(by_words) == {g: [Group(s).texts[i] for i in Group(s).pick(250, False, level=2)] for g, s in groups.items()}
    assert texts(by_share) == {g: [Group(s).texts[i] for i in Group(s).pick(int(len(s) * 0.3), True)] for g, s in groups.items()}


def test_fitted_topics(spark):
    rng = random.Random(0)
    sets = [["river", "stone", "water"], ["market", "price", "trade"]]
    rows = [(" ".join(rng.choice(sets[i % 2]) for _ in range(12)),) for i in range(30)]
    model = topics.fit_topics(spark.createDataFrame(rows, "t string"), "t")
    assert model.n_topics == 6
    assert model.topics.count() == 6
    assert {r.n for r in model.topics.select(F.size("terms").alias("n")).collect()} == {5}
    pairs = {(t, r.topic) for r in model.topics.collect() for t in r.terms}
    assert pairs == {(r.term, x) for r in model.keywords.collect() for x in r.topics}
    again = topics.fit_topics(spark.createDataFrame(rows, "t string"), "t")
    assert sorted(map(str, again.topics.collect())) == sorted(map(str, model.topics.collect()))
    with pytest.raises(ValueError):
        topics.fit_topics(spark.createDataFrame(rows[:4], "t string"), "t")


def test_topic_fit_by_blocks(spark, monkeypatch):
    """Blocks of texts give the model that one block gives; copies and null groups are among them."""
    words = "apple banana cherry orange engine wheel brake motor river mountain valley forest".split()
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for _ in range(60)]
    rows += rows[:9] + [("a", ""), ("b", None)]
    df = spark.createDataFrame(rows, "g string, t string")

    def model(keys):
        fitted = topics.fit_topics(df, "t", keys, max_iter=4)
        return sorted(map(tuple, fitted.weights.collect()), key=str), sorted(map(tuple, fitted.topics.collect()), key=str), fitted.fits

    want = [model(["g"]), model([])]
    monkeypatch.setattr(topics, "BLOCK_WORDS", 100)
    monkeypatch.setattr(topics, "BLOCK_CELLS", 20)
    for (weights, listed, fits), keys in zip(want, (["g"], [])):
        found = model(keys)
        assert found[:2] == (weights, listed)
        assert found[2] == pytest.approx(fits)


def test_topic_rounds_have_a_row_per_part_of_terms(spark, monkeypatch):
    """Terms of a block are rows of their own in the last draw only."""
    rng = random.Random(21)
    rows = [(g, " ".join(rng.choice("abcdefgh") * 3 + rng.choice("mnopqrst") * 2 for _ in range(9))) for g in ("x", None, "y") for _ in range(12)]
    held, real = [], topics.stage

    def staged(df, label):
        out = real(df, label)
        if label == "topic-state":
            held.append((out.filter("kind = 1"), out.filter("kind = 1").count()))
        return out

    monkeypatch.setattr(topics, "stage", staged)
    topics.fit_topics(spark.createDataFrame(rows, "g string, t string"), "t", ["g"], n_topics=3, max_iter=2)
    names = held[0][0].selectExpr("g", "_block", "explode(names) as name").collect()
    blocks = {(r.g, r._block) for r in names}
    assert len(held) == 3 and len(names) > 40 and {g for g, _ in blocks} == {"x", "y"}
    assert all(count <= 2 * len(blocks) for _, count in held[:-1]) and held[-1][1] == len(names)


def test_topic_hashes_are_those_of_columns(spark):
    values = [0, 1, -1, 7, 123_456, 2**31 - 1, -(2**31)]
    df = spark.createDataFrame([(v,) for v in values], "v int").select("v", F.xxhash64(F.lit("term")).alias("h"), F.xxhash64(F.lit("term"), "v").alias("hv"))
    for v, h, hv in df.collect():
        assert int(topics._hash_int(np.array([h]).view(np.uint64), np.array([v])).view(np.int64)[0]) == hv


def test_topic_rounds_end_by_fit(spark):
    rng = random.Random(3)
    sets = [["river", "stone", "water"], ["market", "price", "trade"]]
    df = spark.createDataFrame([(" ".join(rng.choice(sets[i % 2]) for _ in range(12)),) for i in range(20)], "t string")
    early = topics.fit_topics(df, "t", n_topics=2, tolerance=10.0)
    assert len(early.fits) == 3  # two to see the growth, and the round that takes the best
    assert len(topics.fit_topics(df, "t", n_topics=2, tolerance=-1.0, max_iter=5).fits) == 5


def test_perplexity_matches_loop(spark):
    alpha, beta, rounds = 0.1, 0.01, 4
    held = {(0, "river"): 5.0, (0, "stone"): 3.0, (1, "market"): 4.0, (1, "price"): 2.0, (1, "stone"): 1.0, (0, "cloud"): 2.0, (1, "trade"): 2.0}
    weights = spark.createDataFrame([(3, t, w, x) for (t, w), x in held.items()] + [(3, 2, "song", 1.0)], "n_topics int, topic int, term string, weight double")
    held[2, "song"] = 1.0
    texts = [["river", "stone", "cloud", "river"], ["market", "price", "trade", "stone", "nowhere"], ["song"], [], ["nowhere"], ["river", "market", "cloud", "price", "song"]]
    words = spark.createDataFrame([(t,) for t in texts], "words array<string>")
    terms = sorted({w for _, w in held})
    second = {r.w for r in spark.createDataFrame([(w,) for w in terms], "w string").filter("xxhash64(w) % 2 = 0").collect()}
    mass = {t: sum(x for (u, _), x in held.items() if u == t) + beta * len(terms) for t in range(3)}
    phi = lambda t, w: (held.get((t, w), 0.0) + beta) / mass[t]
    n_terms, total = 0, 0.0
    for text in texts:
        known = [w for w in text if w in terms]
        first, rest = [w for w in known if w not in second], [w for w in known if w in second]
        if not first or not rest:
            continue
        own = {t for t, w in held if w in first}
        theta = {t: sum(phi(t, w) for w in first if (t, w) in held) for t in own}
        for _ in range(rounds):
            new = dict.fromkeys(own, alpha)
            for w in first:
                parts = {t: phi(t, w) * theta[t] for t in own if (t, w) in held}
                for t, x in parts.items():
                    new[t] += x / sum(parts.values())
            theta = new
        counts = {t: x - alpha for t, x in theta.items()}
        for w in rest:
            p = sum(x * phi(t, w) for t, x in counts.items()) + alpha * sum(phi(t, w) for t in range(3))
            total += math.log(p / (sum(counts.values()) + alpha * 3))
            n_terms += 1
    assert n_terms
    got = topics.perplexity(weights, words, rounds=rounds, alpha=alpha, beta=beta).first()
    assert (got.n_terms, got.perplexity) == (n_terms, pytest.approx(math.exp(-total / n_terms)))


def test_coherence_matches_loop(spark):
    rng = random.Random(5)
    vocabulary = ["river", "stone", "cloud", "price", "song", "all"]
    texts = [(g, ["all"] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 5))]) for g in "ab" for _ in range(12)]
    given = [("a", 0, ["river", "stone", "all", "river"]), ("a", 1, ["price", "absent", "song"]), ("b", 0, ["all"]), ("b", 1, ["cloud", "river"])]
    expected = {}
    for g, topic, terms in given:
        docs = [set(t) for k, t in texts if k == g]
        terms, measures = sorted(set(terms)), []
        for i, a in enumerate(terms):
            for b in terms[i + 1:]:
                x, y, both = (sum(s <= d for d in docs) / len(docs) for s in ({a}, {b}, {a, b}))
                measures.append(-1 if not both else 1 if both == 1 else math.log(both / (x * y)) / -math.log(both))
        expected[g, topic] = (len(measures), pytest.approx(sum(measures) / len(measures)) if measures else None)
    got = topics.coherence(
        spark.createDataFrame(given, "g string, topic int, terms array<string>"), spark.createDataFrame(texts, "g string, words array<string>"), ["g"])
    assert {(r.g, r.topic): (r.n_pairs, r.coherence) for r in got.collect()} == expected


def test_topics_of_each_group(spark):
    rng = random.Random(1)
    sets = {"a": [["river", "stone", "water"], ["market", "price", "trade"]], "b": [["cloud", "storm", "rain"], ["song", "music", "dance"]], "c": [["alone"]], "d": [["few"]]}
    sizes = {"a": 10, "b": 15, "c": 9, "d": 4}
    rows = [(g, i, " ".join(rng.choice(sets[g][i % len(sets[g])]) for _ in range(12)) + ".") for g in sets for i in range(sizes[g])]
    df = spark.createDataFrame(rows, "g string, i int, t string")
    model = topics.fit_topics(df, "t", ["g"], max_iter=12)
    assert {r.g: r.n for r in model.topics.groupBy("g").agg(F.countDistinct("topic").alias("n")).collect()} == {"a": 2, "b": 3, "c": 1}
    assert {(r.g, r.n_topics) for r in model.keywords.collect()} == {("a", 2), ("b", 3), ("c", 1)}
    for r in model.topics.filter("g = 'a'").collect():
        assert {t for t in r.terms[:3]} in [{"river", "stone", "water"}, {"market", "price", "trade"}]
    for variant in ("v1", "v2"):
        picked = plans.summarize(df, ["g"], ["i"], "t", method="topics", share=0.5, model=model, variant=variant).collect()
        assert {r.g for r in picked} == {"a", "b", "c"}


def test_group_numbers(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 0)], "g string, i int")
    assert {r.g: r.val for r in plans.number_groups(df, ["g"], ["i"]).collect()} == {"c": 1, "b": 2, "a": 3}


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_blocks_count_terms_of_groups_in_one_block_or_many(spark, most):
    from gistmill.operators import blocks

    groups = make_groups(5)
    sentences = table(spark, groups)
    totals = scoring.measure_groups(sentences, ["g"]).totals
    met = blocks.meet_counts(
        sentences.join(totals, "g").repartition(3), ["g"], ["g", "r", "sen_pos", "filt_total"], F.col("sen_pos") != 1, most=most).collect()
    bags = {(r.g, r.r, r.sen_pos): r.bag for r in sentences.collect()}
    counts, df = {}, {}
    for (g, _, _), bag in bags.items():
        for b in bag:
            counts[g, b.term] = counts.get((g, b.term), 0) + b.tf
            df[g, b.term] = df.get((g, b.term), 0) + 1
    wanted = {k: [(b.tf, counts[k[0], b.term], df[k[0], b.term]) for b in bag] for k, bag in bags.items() if bag and k[2] != 1}
    assert len(met) == len(wanted) > 10
    assert {(r.g, r.r, r.sen_pos): [tuple(m) for m in r.met] for r in met} == wanted


def test_scoring_makes_no_shuffle_row_per_sentence_and_term(spark, monkeypatch):
    """A group that lies in one block has its counts there: no pair is met elsewhere."""
    from gistmill.operators import blocks

    seen = []
    staged = blocks.stage
    monkeypatch.setattr(blocks, "stage", lambda df, label: seen.append(staged(df, label)) or seen[-1])
    sentences = table(spark, {1: ["walk stone stone bridge"] * 200, 2: ["river of silver"] * 100}).coalesce(1)
    assert scoring.score_sentences(sentences, ["g"], ["r"]).count() == 300
    assert len(seen) == 1 and seen[0].filter("_term is not null").count() == 0
    spread = scoring.score_sentences(sentences.repartition(2, "r", "sen_pos"), ["g"], ["r"])
    assert spread.count() == 300 and seen[1].filter("_term is not null").count() <= 10


def test_bags_hold_first_places_and_counts(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c", "a", "b"]), (2, []), (3, None), (4, ["a"])], "i int, terms array<string>")
    found = {r.i: [tuple(b) for b in r.bag] for r in terms.with_bag(df).collect()}
    assert found == {1: [(0, "b", 3), (1, "a", 2), (3, "c", 1)], 2: [], 3: [], 4: [(0, "a", 1)]}
