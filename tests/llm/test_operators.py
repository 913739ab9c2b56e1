"""The operators against plain loops, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistmill.llm import decontaminate, hnsw, html, jaccard, langid, lines, mixing, quality, substrings, tokens, words
from gistmill.llm.groups import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
ODD = [
    (None, "a row without an id and some words", None, None, None),
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\f\r ", None, None, 7),
    (4, "one two three", "en", "b", 13),
    (5, "One two THREE", "en", "b", 13),
    (6, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (7, "é ü  x", None, "ü", 5),
    (8, "x" * 20_000, "de", "b", 20_000),
]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def invented(seed, count=160, size=60, vocabulary=600):
    """Texts with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    names = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(vocabulary)]
    made = []
    passage = rng.choices(names, k=40)
    for i in range(count):
        kind = rng.random()
        if made and kind < 0.15:
            text = list(rng.choice(made))
        elif made and kind < 0.45:
            text = list(rng.choice(made))
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.randint(0, 1)] = rng.choices(names, k=rng.randint(0, 2))
        else:
            text = rng.choices(names, k=rng.randint(1, size))
            if rng.random() < 0.3:
                text += passage
        made.append(text or ["x"])
    return [" ".join(t) for t in made]


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def grouped(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# Words and groups


def test_words_and_hashes():
    texts = ["A b\tC\x0bd", None, "", "x" * 10, "é f g"]
    found, hashes = [], []
    for part in words.word_slices(pa.array(texts, pa.string()), 8):
        found += [bytes(part.data[s:e]).decode() for s, e in zip(part.starts, part.ends)]
        hashes += part.hashes().tolist()
    assert found == ["A", "b", "C", "d", "x" * 10, "é f", "g"]
    assert len(set(hashes)) == 7
    again = next(words.word_slices(pa.array(["z z a A"], pa.string()))).hashes()
    assert again[0] == again[1] and again[2] == again[3] == hashes[0]


def test_bundles_hold_whole_groups():
    batches = [pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), pa.array(["x" * 50] * 3)], names=["k", "v"]), pa.RecordBatch.from_arrays([pa.array([2, 2, 3, 4]), pa.array(["x" * 50] * 4)], names=["k", "v"])]
    for limit in (1, 200, 10_000):
        tables = list(words.bundles(batches, "k", limit))
        assert [x for t in tables for x in t.column("k").to_pylist()] == [1, 1, 2, 2, 2, 3, 4]
        assert all(len({t2 for t2, t in enumerate(tables) if k in t.column("k").to_pylist()}) == 1 for k in (1, 2, 3, 4))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 30)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(frame(spark, chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 90: 90, 95: 90, 100: 90}
    assert components(frame(spark, [], "a long, b long")).count() == 0


# 1


def test_tree_keeps_every_link():
    texts = invented(5, 120)
    sets = [s for _, part in words.shingle_sets(pa.array(texts)) for s in part]
    tree = jaccard.SignatureTree(sets, np.argsort([len(s) for s in sets], kind="stable"))
    kept = {tuple(sorted((int(tree.order[a]), int(tree.order[b])))) for a, b in zip(*tree.pairs(80))}
    every = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if jaccard.similar(sets[a], sets[b], 80)}
    assert every and every <= kept
    assert len(kept) < len(sets) * (len(sets) - 1) // 4


@pytest.mark.parametrize("share", [0.0005, 0.2])
def test_jaccard_groups(spark, share):
    texts = invented(1, 220)
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, share=share).collect()}
    sets = dict(enumerate(map(shingle_set, texts)))
    expected = grouped(list(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}
    assert len(set(expected.values())) < len(texts)


def test_jaccard_of_one_template(spark, monkeypatch):
    """Texts that share most of their words but don't link, and a few that do."""
    template = [f"t{i}" for i in range(33)]
    texts = [" ".join(template + [f"d{d}x{i}" for i in range(12)]) for d in range(300)]
    near = [t + " more" for t in texts[::60]]
    docs = list(enumerate(texts + near))
    monkeypatch.setattr(jaccard, "CHUNK", 40)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(frame(spark, docs, "doc_id long, text string")).collect()}
    assert got == {d: (d - 300) * 60 if d >= 300 else d for d, _ in docs}


@pytest.mark.parametrize("passage", [0, 30, 60])
def test_jaccard_of_a_shared_passage(spark, monkeypatch, passage):
    """Texts that hold one passage: the rows of the join don't grow with their pairs."""
    shared = [f"p{i}" for i in range(passage)]
    texts = [" ".join([f"d{d}x{i}" for i in range(60)] + shared + [f"d{d}y{i}" for i in range(40)]) for d in range(150)]
    near = [t + " more words" for t in texts[::50]]
    made = []

    def counted(parts, percent):
        a, b = parts.alias("a"), parts.alias("b")
        made.append(a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component"))).count())
        return own(parts, percent)

    own = jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", counted)
    df = frame(spark, list(enumerate(texts + near)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(df, share=0.9999).collect()}
    assert got == {d: (d - 150) * 50 if d >= 150 else d for d in range(153)}
    assert made[0] <= 153


def test_jaccard_moves_shingles_without_opening_texts(spark, monkeypatch):
    """Texts of one passage: what becomes rows is first shingles alone, never all of a text."""
    shared = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"d{d}x{i}" for i in range(60)] + shared + [f"d{d}y{i}" for i in range(40)]) for d in range(60)]
    texts += [" ".join(f"e{d}x{i}" for i in range(40)) for d in range(6)]
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    kept, opened, own = sum(len(s) - -(-80 * len(s) // 100) + 1 for s in map(shingle_set, texts)), [], type(df).mapInArrow

    def counted(self, func, schema, *rest, **more):
        out = own(self, func, schema, *rest, **more)
        if "keys" in out.columns:
            opened.append(out.agg(F.sum(F.size("keys"))).first()[0] or 0)
        return out

    monkeypatch.setattr(type(df), "mapInArrow", counted)
    assert jaccard.jaccard_groups(df, share=0.9999).where("doc_id <> component_id").count() == 0
    assert opened and max(opened) <= kept and sum(opened) <= 3 * kept


def test_jaccard_odd_rows(spark):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(frame(spark, ODD).withColumn("component_id", F.lit(9))).collect())
    assert [g[::2] for g in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (6, 6), (7, 7), (8, 8)]
    assert [g[1] for g in got][:5] == [0, 0, 0, 1, 1]
    assert jaccard.jaccard_groups(frame(spark, [])).count() == 0
    kept = jaccard.near_duplicates_removed(frame(spark, ODD))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 6, 7, 8]


# 2


def vectors(count=400, size=8, seed=3):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(count, size)).astype(np.float32)
    made[50:60] = made[50]
    return [(i, v.tolist()) for i, v in enumerate(made)]


def test_nearest(spark):
    rows = vectors()
    odd = [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [1.0] * 7 + [None]), (980, [1.0, 2.0]), (None, [1.0] * 8), (3, rows[3][1])]
    df = frame(spark, [(a, b, 5) for a, b in rows + odd], "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    table = np.array([v for _, v in rows], dtype=np.float64)
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - table[i] @ table[q]) < 1e-12 and i != q for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        scores = sorted(((-(table[i] @ table[q]), i) for i in range(400) if i != q))
        hits += len({i for _, i, _ in found} & {i for _, i in scores[:20]})
    assert hits / (20 * len(got)) >= 0.95


def test_nearest_ties_and_few(spark):
    same = frame(spark, [(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<float>")
    got = hnsw.nearest(same, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) + list(range(20))
    few = frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in hnsw.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.5)]
    assert hnsw.nearest(same.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("sizes, recall", [((1e25, 1e25), 0.9), ((1e-25, 1e-25), 0.9), ((3e38, 3e38), 0.9), ((1e25, 1e-25), 0.8)])
def test_nearest_of_large_and_small_vectors(spark, sizes, recall):
    """Graphs are of single precision, so next to vectors 10^50 times as long the
    small ones are found less surely; none fails, and scores are exact."""
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * sizes[i % 12 == 0])) for _ in range(8)]) for i in range(120)]
    rows = [(i, v if any(v) else [1.0] * 8) for i, v in rows]
    got = defaultdict(list)
    for r in hnsw.nearest(frame(spark, rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0, count=5).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == {i for i, _ in rows if i % 10 == 0} and all(len(x) == 5 for x in got.values())
    own, hits = dict(rows), 0
    for q, found in got.items():
        best = sorted((-float(np.dot(own[q], own[i])), i) for i in own if i != q)[:5]
        hits += len({i for _, i in best} & {i for i, _ in found})
        assert all(math.isclose(s, float(np.dot(own[q], own[i])), rel_tol=1e-12, abs_tol=1e-300) for i, s in found)
    assert hits >= recall * 5 * len(got)


def test_graph_reaches_clusters():
    rng = np.random.default_rng(2)
    table = np.concatenate([rng.normal(size=(60, 16)) * 0.05 + rng.normal(size=16) for _ in range(25)])
    table = table[rng.permutation(len(table))]
    graph = hnsw.Graph.build(table, rng.random(len(table)) * 0.999 + 1e-4)
    assert len(graph.levels) > 1
    found, _ = graph.search(table[::10], 20, 80)
    best = np.argsort(-(table[::10] @ table.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(found.tolist(), best.tolist())]) >= 0.9


# 3


def test_token_counts(spark):
    texts = invented(4, 60) + ["", None, "<|endoftext|> é中", "a" * 3000]
    df = frame(spark, [(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    encode = tokens.encoder(tokens.VOCABULARY, tokens.PATTERN).encode_ordinary
    lengths = [len(encode(t or "")) for t in texts]
    got = {r.n_tokens: tuple(r)[1:] for r in tokens.token_counts(df).collect()}
    assert got == {
        n: (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths), pytest.approx(sum(x <= n for x in lengths) / len(lengths)))
        for n in set(lengths)
    }
    sums = tokens.token_counts(df)
    limits = [1, 7, 50, 100_000]
    assert {r.limit: r.truncated_total for r in tokens.truncated_totals(sums, limits).collect()} == {c: sum(min(x, c) for x in lengths) for c in limits}
    found = {r.share: r.n_tokens for r in tokens.quantiles(sums, [0.5, 1.0]).collect()}
    assert found == {q: sorted(lengths)[math.ceil(q * len(lengths)) - 1] for q in (0.5, 1.0)}
    assert tokens.token_counts(df.limit(0)).count() == 0


# 4

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><a href="a>b">Menu</a></nav><div class="ad">Buy <b>now</b></div>
<article><header><h1>Head&shy;line</h1></header><p>First <b>bo</b>ld &lt;x&gt; a < b<p>Second<br>line &eacute;&#233;
<aside>Side</aside><script>if (a<b) {"</p>"}</script><form><p>Name</p></form><div class="cookie-notice">Accept</div>
<ul><li>One<li>Two</ul><section id="comments"><article>A reader</article></section></article>
<footer>&copy; Site</footer><!-- c --></body></html>"""


def test_blocks_of_markup():
    got = " ".join(t for r, t in html.blocks(PAGE) if r == "in")
    assert got == "Head­line First bold <x> a < b Second line éé One Two"
    assert html.blocks("") == [] and html.blocks("<p") == [("open", "<p")]
    assert [t for r, t in html.blocks('<div class="ad">x<article>y</article>') if r == "in"] == ["y"]
    assert html.host("HTTPS://u@A.example:8/x") == "a.example" and html.host(None) == ""


def test_suffix_array_orders_runs():
    rng = np.random.default_rng(1)
    tokens_ = rng.integers(0, 3, 80).astype(np.uint64)
    order, rank = html.suffix_array(tokens_, 5)
    keys = [tuple(tokens_[i : i + 5].tolist()) for i in range(80)]
    assert [keys[i] for i in order] == sorted(keys)
    assert all((rank[i] == rank[j]) == (keys[i] == keys[j]) for i in range(80) for j in range(80))


def test_main_text(spark, monkeypatch):
    monkeypatch.setattr(html, "SHARD_PAGES", 2)
    rng = random.Random(9)
    boiler = "all rights reserved by the makers of this fine site"
    own = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(12)) for _ in range(8)]
    bare = [(i, f"http://h.example/{i}", f"<html><body><div>{boiler}</div><p>{t}</p><p>{boiler} ok{i}</p></body></html>", 0) for i, t in enumerate(own)]
    rows = bare + [(20, None, None, 0), (21, "http://h.example/x", "", 0), (22, "http://a.example/", PAGE, 0), (22, "http://a.example/", PAGE, 0)]
    got = main_rows(html.main_text(frame(spark, rows, "page_id long, url string, html string, text int")))
    for i, t in enumerate(own):
        assert got[i][0] == (f"{t} ok{i}", len(t) + 4)
    assert got[20] == [("", 0)] and got[21] == [("", 0)] and len(got[22]) == 2 and got[22][0][0].startswith("Head")
    assert html.main_text(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_open_blocks_beside_an_article(spark):
    """A story outside the article element stays; what the host's pages share there goes."""
    shared = "read more news every day on this fine site of ours"
    page = '<html><body><article>Teaser {0}</article><div class="content"><p>Story {0} told at length by {0}</p></div><div>{1}</div><nav>Menu</nav></body></html>'
    rows = [(i, f"http://h.example/{i}", page.format(f"n{i}", shared)) for i in range(4)]
    got = main_rows(html.main_text(frame(spark, rows, "page_id long, url string, html string")))
    assert {i: v[0][0] for i, v in got.items()} == {i: f"Teaser n{i} Story n{i} told at length by n{i}" for i in range(4)}


def main_rows(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.page_id].append((r.text, r.n_chars))
    return out


# 5


def filled(sizes, share=1.5, cap=2.0):
    """Weights 5, 2, 1 by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > cap * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "c", "d", None, ""])) for i in range(300)]
    df = frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    out = mixing.mix_sources(df.repartition(5)).collect()
    assert {r.doc_id: r.taken for r in out} == {r.doc_id: r.taken for r in mixing.mix_sources(df).collect()}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = filled(sizes)
    taken = defaultdict(int)
    for r in out:
        assert r["size"] == len(rows[r.doc_id][1].split()) and 0 <= r.taken <= 2 * r["size"]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert sum(d.words for d in r.draws) == r.taken
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    draws = Counter(d.shard for r in out for d in r.draws)
    assert len(draws) == 16
    mixed = mixing.mixed_documents(df.drop("size"))
    assert mixed.agg(F.sum("words")).first()[0] == sum(taken.values())
    assert mixed.where("size(split(text, ' ')) <> words").count() == 0


def test_quotas_are_hypergeometric(spark):
    quotas = frame(spark, [("a", 400), ("b", 37), (None, 3), ("z", 0)], "source string, quota long")
    parts = mixing.split_quotas(quotas, 3, 1).collect()
    total = defaultdict(int)
    shard = defaultdict(int)
    for r in parts:
        total[r.source] += r.quota
        shard[r.shard] += r.quota
    assert total == {"a": 400, "b": 37, None: 3, "z": 0} and set(shard.values()) == {55}
    # Against the distribution itself: the mean over many uniform numbers.
    us = frame(spark, [((i + 0.5) / 2000,) for i in range(2000)], "u double")
    draw = mixing._hypergeometric(F.lit(100).cast("long"), F.lit(30).cast("long"), F.lit(20).cast("long"), F.col("u"))
    values = [r[0] for r in us.select(draw).collect()]
    assert np.mean(values) == pytest.approx(6, abs=0.02) and np.var(values) == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, abs=0.05)


def test_mixing_odd_rows(spark):
    out = mixing.mix_sources(frame(spark, ODD)).collect()
    assert len(out) == len(ODD)
    by = {(r.doc_id, r.source): r for r in out}
    assert by[(1, "a")].taken == 0 and by[(1, "a")].target == 0 and by[(3, None)]["size"] == 0
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
    drawn = mixing.mix_sources(frame(spark, ODD)).select("doc_id", "size", F.explode("draws.words").alias("words"))
    odd = mixing.mixed_documents(frame(spark, ODD))
    assert Counter(map(tuple, odd.select("doc_id", "words").collect())) == Counter(map(tuple, drawn.select("doc_id", "words").collect()))


# 6


def leak_loop(docs, items):
    """Best similarity of the windows that have a shingle where the item has it."""
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t.lower().strip(" \t\n\x0b\f\r")) if w]
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    bags = {i: bag(split(t)) for i, t in items if t and len(split(t)) >= 5}
    texts = {i: split(t) for i, t in items if t}
    sizes = {i: len(t) for i, t in texts.items()}
    df = Counter(g for b in bags.values() for g in b)
    weight = lambda g: math.log(1 + len(bags) / df.get(g, 1)) if g in df else math.log(1 + len(bags))
    best = {}
    for d, t in docs:
        w = split(t or "")
        for i, b in bags.items():
            for at in range(-sizes[i] + 5, len(w) - 4):
                if not any(w[at + j : at + j + 5] == texts[i][j : j + 5] for j in range(max(0, -at), sizes[i] - 4)):
                    continue
                own = bag(w[max(0, at) : at + sizes[i]])
                common = sum(weight(g) * min(n, b[g]) for g, n in own.items())
                both = sum(weight(g) * n for g, n in own.items()) + sum(weight(g) * n for g, n in b.items()) - common
                if common and round(common / both, 12) >= 0.8:
                    best[(d, i)] = max(best.get((d, i), 0), round(common / both, 12))
    return best


def test_leaks(spark):
    rng = random.Random(6)
    names = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(names, k=rng.randint(12, 30)))) for i in range(12)] + [(50, "too few words here"), (51, None), (52, "")]
    docs = []
    for d in range(60):
        own = rng.choices(names, k=rng.randint(0, 60))
        if d % 3 == 0:
            leak = items[rng.randrange(12)][1].split()
            leak = leak[rng.randint(0, 2) : len(leak) - rng.randint(0, 1)]
            if rng.random() < 0.3:
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(own) + 1)
            own[at:at] = leak
        docs.append((d, " ".join(own).upper() if d % 2 else "\n".join(own)))
    df = frame(spark, [(*r, 7) for r in docs + [(100, None), (101, ""), (None, items[0][1]), (102, items[1][1]), (102, "other words")]], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(df, frame(spark, items, "item_id long, text string")).collect()}
    expected = leak_loop(docs + [(102, items[1][1])], items)
    assert len(expected) >= 10 and got == {k: pytest.approx(v) for k, v in expected.items()}
    clean = decontaminate.without_benchmark(df, frame(spark, items, "item_id long, text string"))
    assert sorted(r.doc_id for r in clean.where("doc_id is not null").collect()) == [d for d in [*range(60), 100, 101] if d not in {k for k, _ in expected}]
    assert clean.where("doc_id is null").count() == 1
    empty = frame(spark, [], "item_id long, text string")
    assert decontaminate.leaks(df, empty).count() == 0 and decontaminate.leaks(df.limit(0), empty).count() == 0


# 7


def runs_loop(texts, width):
    split = [WORD.findall(t or "") for t in texts]
    times = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - width + 1) if times[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("width", [9, 12, 35])
def test_remove_repeats(spark, width):
    texts = invented(7, 150, 90) + ["a b " * 60, None, "", "Z " * 34, "Z " * 36, LONG]
    df = frame(spark, [(i if i % 5 else None, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_removed int")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in substrings.remove_repeats(df, width).collect())
    expected = runs_loop(texts, width)
    assert got == Counter((i if i % 5 else None, *e) for i, e in enumerate(expected))
    assert sum(e[1] for e in expected) > 500


def test_remove_repeats_odd_rows(spark):
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(frame(spark, ODD)).collect())
    assert got[(6, 40_000, 40_000)] == 2 and got[(1, 0, 0)] == 1 and got[(8, 1, 0)] == 1 and sum(got.values()) == len(ODD)
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 4, 500).astype(np.uint8)
    text[::97] = 0
    index = substrings.FmIndex(text)
    ends = np.arange(6, 500)
    found = set(ends[index.repeated(text, ends, 6)].tolist())
    grams = Counter(tuple(text[e - 6 : e].tolist()) for e in range(6, 501))
    assert found == {e for e in ends.tolist() if grams[tuple(text[e - 6 : e].tolist())] > 1}


# 8


def test_quality_learns_form(spark):
    rng = random.Random(3)
    clean = invented(8, 200, 80)
    rows = [(i, t if i % 4 else " ".join(w.upper() + rng.choice(["!!", "###", "$$$"]) for w in t.split()), i) for i, t in enumerate(clean)]
    rows += [(900, None, 0), (901, "", 0)]
    labels = [(i, int(i % 4 > 0), 0) for i, _, _ in rows[:200]] + [(5, None, 0), (None, 1, 0), (7, 9, 1)]
    df = frame(spark, rows, "doc_id long, text string, score int")
    marks = frame(spark, labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(df, marks).collect()}
    held = [i for i in range(200) if got[i].held_out]
    assert 30 < len(held) < 80
    assert np.mean([got[i].predicted == int(i % 4 > 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[900].score == got[901].score
    assert {r.score for r in quality.score_quality(df, marks.limit(0)).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), marks).count() == 0


def quality_loop(texts, labels, asked):
    """Plain loops: term shares, weights, singular vectors, all cosines, votes."""

    def bag(text):
        data = text.encode()
        held = np.zeros(quality.TERMS)
        codes = [int(quality.CLASS[b]) for b in data]
        grams = Counter(a * 256 + b * 16 + c for a, b, c in zip(codes, codes[1:], codes[2:]))
        for gram, n in grams.items():
            held[gram] = np.sqrt(n / (len(codes) - 2))
        own = re.findall(rb"[^\x20\x09-\x0D]+", data.lower())
        for place, n in Counter(word_place(w) for w in own).items():
            held[quality.FORMS + place] = np.sqrt(n / len(own))
        if len(own) > 5:
            some = list(zip(own, own[1:], own[2:]))
            fresh = len(set(some)) / len(some)
            held[-2:] = np.sqrt(1 - fresh), np.sqrt(fresh)
        return held

    def word_place(word):
        data = np.frombuffer(word, np.uint8)
        return int(words.span_hashes(data, np.array([0]), np.array([len(data)]))[0] % np.uint64(quality.WORDS))

    def unit(v):
        return v / max(np.linalg.norm(v), 1e-12)

    sample = np.array([bag(t) for t in texts])
    weight = np.log((1 + len(sample)) / (1 + (sample > 0).sum(axis=0))) + 1
    sample = np.array([unit(v * weight) for v in sample])
    _, size, right = np.linalg.svd(sample, full_matrices=False)
    project = right[: quality.RANK][size[: quality.RANK] > 1e-4].T
    known = [unit(v @ project) for v in sample]
    scores = []
    for text in asked:
        own = unit(unit(bag(text) * weight) @ project)
        near = sorted(((float(own @ v), y) for v, y in zip(known, labels)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 1e-3) ** quality.SHARPNESS, y) for c, y in near]
        scores.append(sum(v * y for v, y in votes) / sum(v for v, _ in votes))
    return scores


def test_quality_against_plain_loops(spark):
    rng = random.Random(13)
    rows = [(i, t if i % 3 else " ".join(w.upper() + rng.choice(["!", " 12", " | "]) for w in t.split()[:30])) for i, t in enumerate(invented(9, 160, 60))]
    # Some of both kinds in each form, so that votes differ.
    labels = [(i, int(i % 3 > 0) ^ int(i % 11 == 0), 0) for i in range(160)]
    out = quality.score_quality(frame(spark, rows, "doc_id long, text string"), frame(spark, labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in out.collect()}
    learnt = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert all(got[i].held_out == (i not in learnt) for i in got)
    texts = dict(rows)
    expected = quality_loop([texts[i] for i in learnt], [labels[i][1] for i in learnt], [t for _, t in rows])
    assert len({round(x, 3) for x in expected}) > 20
    assert [got[i].score for i, _ in rows] == pytest.approx(expected, abs=2e-3)


def test_anchors_of_more_than_a_shard_are_spread(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(20)]
    tail = [word() for _ in range(12)]
    texts = []
    for i in range(80):
        after = tail if i % 3 == 0 else [word() for _ in range(12)]
        texts.append(" ".join([word() for _ in range(30 - i % 5)] + (["same"] * 8 if i % 2 else []) + passage + after + [word() for _ in range(20)]))
    texts += [" ".join(t.split()[5:] + ["end"]) for t in texts[:20]]
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    collect = lambda: {r.doc_id: (r.text, r.n_removed) for r in substrings.remove_repeats(df).collect()}
    usual, limit, searched = collect(), 300, substrings._searched
    assert sum(n > 0 for _, n in usual.values()) >= 40

    def bounded(width):
        inner = searched(width)

        def run(batches):
            held, size = list(batches), Counter()
            for batch in held:
                for anchor, own in zip(batch.column("anchor").to_pylist(), batch.column("words").to_pylist()):
                    size[anchor] += len(own) // 8
            assert not size or max(size.values()) <= limit
            yield from inner(iter(held))

        return run

    monkeypatch.setattr(substrings, "SHARD_SYMBOLS", limit)
    monkeypatch.setattr(substrings, "_searched", bounded)
    assert collect() == usual


# 9


def test_line_clusters_of_many_small_keys(monkeypatch):
    """Lines of small keys are compared together, with the clusters of a plain loop."""
    rng = np.random.default_rng(9)
    sizes = np.concatenate([rng.integers(1, 8, 300), [lines.FEW, lines.FEW + 1, 150]])
    key = np.repeat(rng.permutation(len(sizes)) - 100, sizes)
    n = rng.integers(10, 31, len(key))
    parity = (np.uint64(1) << rng.integers(0, 64, len(key)).astype(np.uint64)) | (np.uint64(1) << rng.integers(0, 3, len(key)).astype(np.uint64))
    line = rng.permutation(len(key)) - 50
    order = np.lexsort((n, key))
    key, n, parity, line = key[order], n[order], parity[order], line[order]
    expected = set()
    for k in set(key.tolist()):
        own = np.flatnonzero(key == k).tolist()
        name = {i: int(line[i]) for i in own}
        near = [(a, b) for a, b in itertools.combinations(own, 2) if int(parity[a] ^ parity[b]).bit_count() <= 2 * int(n[b] * 0.1 + 1e-9) and n[b] - n[a] <= int(n[b] * 0.1 + 1e-9)]
        for _ in own:
            for a, b in near:
                name[a] = name[b] = min(name[a], name[b])
        expected |= {(name[i], k >= 0, int(line[i])) for i in {i for pair in near for i in pair}}
    calls, close = [], lines.close
    monkeypatch.setattr(lines, "close", lambda *a: calls.append(len(a[0])) or close(*a))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (key, line, n.astype(np.int32), parity.view(np.int64))], names=["key", "line", "n", "parity"])
    got = [tuple(r[c] for c in ("cluster", "short", "line")) for out in lines.clusters(0.9)([batch]) for r in out.to_pylist()]
    assert expected and len(got) == len(set(got)) and set(got) == expected
    assert sorted(calls) == [lines.FEW + 1, 150]
    assert list(lines.clusters(0.9)([batch.slice(0, 0)])) == []


def test_line_pairs_are_compared_together(monkeypatch):
    """Links join the lines of each group as a plain loop over all pairs does, with no
    pair compared by itself but those of many edits; sides of a group have met before."""
    rng = random.Random(12)
    rows = []
    for group, (size, short) in enumerate([(2, False), (40, True), (30, False), (90, True), (100, False), (3, False)]):
        base = [[rng.choice("abcdefgh") for _ in range(160 if size == 3 else 30)] for _ in range(4)]
        for i in range(size):
            own = list(base[rng.randrange(1 if size == 3 else 4)])
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice("abcdefgh\u00e9")
            text = "".join(own) if short else " ".join(own)
            rows.append((group, i % 2 if size == 100 else 0, short, len(rows), len(own), text))
    counted = [np.array([x for x in r[5] if x != " "]) for r in rows]
    parity = [lines._parity(words.mix(np.array([ord(x) for x in own], np.uint64)), np.zeros(1, np.int64))[0] for own in counted]
    columns = [*zip(*rows), parity]
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.uint64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["group", "side", "short", "line", "n", "words", "parity"])
    batch = batch.set_column(6, "parity", batch.column("parity").view(pa.int64()))
    expected = {i: i for i in range(len(rows))}
    for a, b in itertools.combinations(range(len(rows)), 2):
        p, q = rows[a], rows[b]
        if p[0] == q[0] and (p[0] != 4 or p[1] != q[1]) and edit_row(counted[a], counted[b]) <= int(len(counted[b]) * 0.1 + 1e-9) and expected[a] != expected[b]:
            old, new = expected[a], expected[b]
            expected = {i: new if x == old else x for i, x in expected.items()}
    calls, alone = [], lines.edit_distance
    monkeypatch.setattr(lines, "edit_distance", lambda a, b, most: calls.append(len(a)) or alone(a, b, most))
    got = {i: i for i in range(len(rows))}
    for out in lines.verified(0.9)(iter([batch])):
        for link in out.to_pylist():
            old, new = got[link["a"]], got[link["b"]]
            assert old != new
            got = {i: new if x == old else x for i, x in got.items()}
    parts = lambda names: {frozenset(i for i in names if names[i] == x) for x in names.values()}
    assert parts(got) == parts(expected) and len(parts(got)) < len(rows)
    assert set(calls) == {160}


def test_line_dedup(spark):
    rng = random.Random(11)
    base = [rng.choices([f"n{i}" for i in range(200)], k=rng.randint(2, 40)) for _ in range(60)]
    docs = []
    for d in range(50):
        own = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(base))
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = "other"
            text = " ".join(line)
            own.append(rng.choice([text, text.upper() + "!!", f"- {text}."]))
        docs.append((d, "\n".join(own)))
    docs += [(60, None), (61, ""), (62, "\n\n"), (63, "a b c\n\nA, b; c.\n")]
    df = frame(spark, [(*r, 1, 0) for r in docs], "doc_id long, text string, n_removed int, n_chars int")
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    gone = all_near_lines(docs)
    assert sum(map(len, gone.values())) > 50
    for d, t in docs:
        own = (t or "").split("\n")
        assert got[d].n_lines == (0 if t is None else len(own)) and got[d].n_removed == len(gone[d])
        assert got[d].text == (None if t is None else "\n".join(x for i, x in enumerate(own) if i not in gone[d]))
    assert got[63].text == "a b c\n\n"


def test_line_dedup_odd_rows(spark):
    got = lines.dedup_lines(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if r.n_removed} == {5}
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def edit_row(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def all_near_lines(docs, least=0.9):
    """Removed lines by edit similarity of all pairs, without any fingerprint."""
    where = defaultdict(list)
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            if w := re.findall(r"[0-9a-z\u0080-\U0010ffff]+", line.translate(LOWER)):
                where[tuple(w)].append((d, i))
    kinds = list(where)

    def near(a, b):
        a, b = kinds[a], kinds[b]
        if min(len(a), len(b)) < 3:
            return False
        a, b = (a, b) if max(len(a), len(b)) >= 10 else (" ".join(a), " ".join(b))
        most = int((1 - least) * max(len(a), len(b)) + 1e-9)
        return abs(len(a) - len(b)) <= most and edit_row(a, b) <= most

    groups, gone = defaultdict(list), defaultdict(set)
    for i, g in grouped(range(len(kinds)), near).items():
        groups[g] += where[kinds[i]]
    for places in groups.values():
        for d, i in sorted(places)[1:]:
            gone[d].add(i)
    return gone


def test_line_dedup_finds_all_near_lines(spark):
    rng = random.Random(12)
    names = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 9))) for _ in range(150)]
    base = [rng.choices(names, k=rng.choice([3, 5, 8, 9, 9, 10, 11, 19, 20, 30, 50])) for _ in range(70)]
    docs = []
    for d in range(60):
        own = []
        for _ in range(5):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, max(1, len(line) // 9))):
                at, kind = rng.randrange(len(line)), rng.random()
                line[at : at + (kind < 0.7)] = [] if kind < 0.2 else ["other"] if kind < 0.4 else [line[at][1:] + rng.choice("xyz")]
            own.append(" ".join(line))
        docs.append((d, "\n".join(own)))
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, docs, "doc_id long, text string")).collect()}
    gone = all_near_lines(docs)
    assert sum(map(len, gone.values())) > 100
    assert got == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def test_near_short_lines_share_a_key():
    rng = random.Random(13)
    tried = 0
    for _ in range(2000):
        a = "".join(rng.choices("abcd ", k=rng.randint(5, 110)))
        b = list(a)
        for _ in range(rng.randint(1, max(1, len(a) // 9))):
            at, kind = rng.randrange(len(b) + 1), rng.random()
            b[at : at + (kind > 0.3)] = rng.choice("xyz") if kind < 0.7 else ""
        b = "".join(b)
        if a != b and edit_row(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9):
            tried += 1
            assert lines.piece_keys(a, 0.9) & lines.piece_keys(b, 0.9)
    assert tried > 1000


def test_line_dedup_removes_copies_of_very_short_lines(spark):
    docs = [(1, "Read more\nSome text of one\n---\nread"), (2, "* READ more!\n---\nRead mode\nRead"), (3, "Read, more\n\nmore read\n\nread")]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(frame(spark, docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("---\nRead mode", 2), 3: ("\nmore read\n", 2)}


# 10


def test_forward_sums_all_segmentations():
    vocabulary = langid.Vocabulary()
    rng = np.random.default_rng(1)
    table = rng.random((len(vocabulary.pieces), 2))
    table /= table.sum(axis=0)
    number = {p: i for i, p in enumerate(vocabulary.pieces)}

    def brute(word):
        total = np.zeros((len(word) + 1, 2))
        total[0] = 1
        for end in range(1, len(word) + 1):
            for start in range(end):
                if word[start:end] in number:
                    total[end] += total[start] * table[number[word[start:end]]]
        return np.log(total[-1])

    assert vocabulary.longest > 20 and any(len(p) == vocabulary.longest for p in vocabulary.pieces)
    lengthy = max((p for p in vocabulary.pieces if p[:1] == b" "), key=len).decode().strip()
    for text in ("the", "straße", "zzzqqq", "international", "é", "availability", lengthy, lengthy + "s" + lengthy, "thequickbrownfox" * 12):
        word = b" " + text.encode()
        got = vocabulary.log_likelihood(np.frombuffer(word, np.uint8)[None, :], table)
        assert got[0] == pytest.approx(brute(word))
    long = np.frombuffer(b" " + b"ab" * 3000, np.uint8)[None, :]
    assert np.isfinite(vocabulary.log_likelihood(long, table)).all()


def test_language_id(spark):
    some = {"en": "the of and to in is that it was for with", "fr": "le la les des et un une dans que pour est", "xx": "zu xq qz kx vz qj zk"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(some[x].split(), k=rng.randint(4, 40))), x) for i, x in enumerate(rng.choices(sorted(some), k=300))]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 !? —", "fr"), (1003, "LE LA LES DES", None), (1004, "le " * 30_000, None), (1005, "a" * 5000, None), (None, "the of and", "en")]
    df = frame(spark, [(*r, "old") for r in rows + odd], "doc_id long, text string, lang string, lang_pred string")
    out = langid.identify(df, per_language=40)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"]
    held = [(i, x) for i, _, x in rows if got[i].held_out]
    assert len(held) > 40 and np.mean([got[i].lang_pred == x for i, x in held]) > 0.97
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == got[1004].lang_pred == "fr" and all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    assert langid.identify(df.limit(0)).count() == 0


def test_hashes_of_kept_text(spark):
    out = substrings.remove_repeats(frame(spark, [(1, " a  b\n"), (2, None)], "doc_id long, text string"))
    got = {r.doc_id: r[1] for r in out.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()}
    assert got == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


CLASHING = ["size", "_row", "_page", "_removed", "runs", "covered", "_d", "_cut", "row", "page", "own", "removed", "doc", "drawn"]
OPERATORS = {
    "lines": (lines.dedup_lines, ["n_lines", "n_removed"]),
    "substrings": (substrings.remove_repeats, ["n_words", "n_removed"]),
    "mixing": (mixing.mixed_documents, ["shard", "pass", "words"]),
    "html": (html.main_text, ["text", "n_chars"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(spark, name):
    operator, added = OPERATORS[name]
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"s{i % 2}", f"http://h/{i}", text) for i, text in enumerate([body, body, "one line\n" + body, "", None, "one line\nother"])]
    text = "html" if name == "html" else "text"
    plain = frame(spark, rows, f"doc_id long, source string, url string, {text} string")
    more = plain.select("*", *(F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHING))
    expected, got = operator(plain), operator(more)
    names = [c for c in got.columns if c not in CLASHING]
    assert sorted(names) == sorted(expected.columns) and set(CLASHING) <= set(got.columns) and set(added) <= set(names)
    pick = lambda df: Counter(map(str, df.select(*sorted(names)).collect()))
    assert pick(got) == pick(expected)
    for row in got.select("doc_id", *(F.col(f"`{c}`") for c in CLASHING)).collect():
        assert list(row[1:]) == [f"{c}-{row.doc_id}" for c in CLASHING]


def test_lines_of_rows_that_share_a_doc_id(spark):
    rows = [(1, "the same line here\nfirst text alone"), (1, "second text alone\nthe same line here\nits own end"), (2, "the same line here\nlast")]
    got = Counter(r.text for r in lines.dedup_lines(frame(spark, rows, "doc_id long, text string")).collect())
    kept = " ".join(got).replace("\n", " ")
    assert all(x in kept for x in ("first text alone", "second text alone", "its own end", "last")) and kept.count("the same line here") == 1


def test_mix_keeps_rows_without_and_with_shared_doc_id(spark):
    rows = [(None, "a", "one two three"), (None, "a", "four five six"), (7, "a", "seven eight"), (7, "a", "nine ten"), (7, "a", "nine ten"), (8, "b", "x " * 50)]
    df = frame(spark, rows, "doc_id long, source string, text string")
    got = Counter((r.doc_id, r.text) for r in mixing.mixed_documents(df, share=2.0, cap=2.0).collect())
    assert got == {(None, "one two three"): 2, (None, "four five six"): 2, (7, "seven eight"): 2, (7, "nine ten"): 4, (8, "x " * 50): 2}
