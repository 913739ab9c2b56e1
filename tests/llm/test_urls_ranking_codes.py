"""URL rules, ranked search and vector codes against plain loops, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from gistmill.llm import ranking, urlfilter, vectorcodes
from gistmill.llm.queries import URL_RULES

RULES = "host string, path string, verdict string"
CLASHING = ["size", "_row", "_page", "_removed", "runs", "covered", "_d", "_cut", "key", "rule", "_best", "m", "hash", "terms", "none", "name"]


def clashing(df):
    """``df`` with more columns, named like inner ones."""
    return df.selectExpr("*", *(f"'x' AS `{c}`" for c in CLASHING if c not in df.columns))


# --- urls ------------------------------------------------------------------


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = re.search(r"[/?#]", rest)
        host, rest = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
        host, path = lower(host), re.split(r"[?#]", rest)[0]
    fits = [
        (len(h) + len(p), len(h), lower(h) + p, v == "block")
        for h, p, v in rules
        if h is not None and p is not None and (host == lower(h) or host.endswith("." + lower(h))) and path.startswith(p)
    ]
    rule = max(fits) if fits else (0, 0, None, False)
    return host, path, rule[2], "block" if rule[3] else "allow"


ODD_URLS = [
    None, "", "no address", "http://", "://com/", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/1",
    "https://www.example.com/en/x?y#z", "https://example.com/EN/1", "http://example.com/en", "http://a.example.com/en/",
    "http://com./", "http://.com/", "http://xcom/", "http://a.b.net/es/?q", "http://a.net?/es/", "http://net#x", "http://net/fr/\n/x",
    "ftp://a://b.net/fr/", "http://com:80/", "http://ü.com/é", "http://" + "a." * 300 + "com/" + "x" * 5000, "http://ÀB.net/es/1",
]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(ODD_URLS)] + [(None, "http://com/"), (5, "http://com/"), (5, "http://com/")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string"))
    got = urlfilter.judge_urls(pages, spark.createDataFrame(URL_RULES, RULES))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter((i, *judged(u, URL_RULES)) for i, u in rows)


@pytest.mark.parametrize("most_bits", [urlfilter.MOST_BITS, 2000])
def test_urls_with_many_rules(spark, most_bits):
    """Also where the list is cut in parts."""
    rng = random.Random(5)
    hosts = [".".join(rng.choices(["a", "b", "shop", "blog", "c"], k=rng.randint(0, 2)) + [rng.choice(["com", "net", "org.uk"])]) for _ in range(60)]
    paths = ["", "/", "/en/", "/en/a", "/fr/", "/x/y/"]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(250)]
    rules += [(None, "/", "block"), ("com", None, "block"), ("a.com", "en", "block"), ("com", "/", "other"), ("B.COM", "/", "block")]
    used = [(h, p, v) for h, p, v in rules if v in ("allow", "block") and p != "en"]
    urls = [f"http://{rng.choice(['', 'www.', 'q.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '1', '/2', '?x'])}" for _ in range(3000)]
    rows = list(enumerate(urls))
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, RULES), most_bits=most_bits)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *judged(u, used)) for i, u in rows), key=str)


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://com/x")], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert [tuple(r) for r in urlfilter.judge_urls(pages, none).collect()] == [(1, "com", "/x", None, "allow")]
    assert urlfilter.judge_urls(pages.limit(0), spark.createDataFrame(URL_RULES, RULES)).collect() == []


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 3)], "key string").persist()
    every = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    # The size is understated, so that many keys pass wrongly and levels are many.
    levels = urlfilter.cascade(listed, 1000, lambda passes: every.where(passes(every.key)), 1000)
    assert len(levels) > 3
    found = every.where(urlfilter.contains(levels, every.key)).collect()
    assert sorted(r.key for r in found) == sorted(f"k{i}" for i in range(0, 3000, 3))


# --- ranked search ---------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall(lower(text or ""))


def ranked_loop(docs, items, top):
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    length = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for d, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n_docs) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in terms & bag.keys())
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:top])]
    return out


def made_docs(seed, count):
    rng = random.Random(seed)
    names = ["".join(rng.choices("abcdeéÀ1", k=rng.randint(1, 4))) for _ in range(150)]
    texts = [" ".join(rng.choices(names, k=rng.randint(0, 40))) + rng.choice(["", "!", "\n"]) for _ in range(count // 2)]
    # Copies, and the same words in another order: one class each.
    texts += [" - ".join(random.Random(i).sample(t.split(), len(t.split()))) for i, t in enumerate(rng.choices(texts, k=count - len(texts)))]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    return docs, [(i, " ".join(rng.choices(names, k=rng.randint(1, 12)))) for i in range(12)]


@pytest.mark.parametrize("top, step, block", [(50, 1_000_000, 1_000_000), (3, 40, 1_000_000), (7, 500, 20)])
def test_ranked(spark, monkeypatch, top, step, block):
    monkeypatch.setattr(ranking, "STEP", step)
    docs, items = made_docs(top, 400)
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    got = ranking.ranked(*frames, top=top, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(ranked_loop(docs, items, top))


def test_ranked_odd_rows(spark):
    long = " ".join(f"w{i % 911}" for i in range(60_000)) + " alpha"
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, " \t,;"), (4, "Alpha, BETA"), (5, "beta alpha"), (5, "beta alpha"), (6, long), (7, "ÀÉ alphà"), (8, "x" * 30_000), (9, "\x7falpha\x00")]
    items = [(1, "alpha ÀÉ"), (1, "beta w5"), (2, None), (3, "..."), (None, "alpha"), (4, "nowhere")]
    frames = clashing(spark.createDataFrame(docs, "doc_id long, text string")), clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(map(tuple, ranking.ranked(*frames).collect()), key=str)
    assert got == sorted(ranked_loop(docs, items, 50), key=str)
    assert any(r[0] is None for r in got)
    assert ranking.ranked(frames[0].limit(0), frames[1]).collect() == []
    assert ranking.ranked(frames[0], frames[1].limit(0)).collect() == []


# --- vector codes ----------------------------------------------------------


def floor_steps(x):
    return math.floor(4096 * x)


def codes_loop(rows):
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 8))
    whole = [[floor_steps(x) for x in v] + [0] * (8 * width - len(v)) for _, v, _ in kept]
    parts = [[tuple(w[p * width : (p + 1) * width]) for p in range(8)] for w in whole]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:16]
    book = [[parts[k][p] for k in order] for p in range(8)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(own[p], e)), n) for n, e in enumerate(book[p])) for p in range(8)] for own in parts]

    for _ in range(6):
        near = assign()
        for p in range(8):
            for n in range(len(book[p])):
                own = [parts[k][p] for k in range(len(kept)) if near[k][p][1] == n]
                if own:
                    book[p][n] = tuple(sum(x) // len(own) for x in zip(*own))
    near = assign()
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in own) for own in near]
    by_label = Counter()
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    return [(i, "".join(f"{n:02x}" for _, n in own), e, by_label[label], digest) for (i, _, label), own, e in zip(kept, near, errors)]


VECTORS = "vec_id long, embedding array<float>, label int"


def single(x):
    import numpy as np

    return float(np.float32(x))


def made_vectors(count, dims, seed=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(20)]
    return [(i * 3 % count, [single(c + rng.gauss(0, 0.05)) for c in rng.choice(centres)], rng.choice([None, 0, 1, 2])) for i in range(count)]


@pytest.mark.parametrize("count, dims, cells", [(301, 16, 1 << 19), (120, 64, 64 * 7), (9, 8, 1 << 19)])
def test_vector_codes(spark, monkeypatch, count, dims, cells):
    monkeypatch.setattr(vectorcodes, "BLOCK_CELLS", cells)
    rows = made_vectors(count, dims)
    got = vectorcodes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(codes_loop(rows))


def test_vector_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made_vectors(40, 16)
    rows += [(90, None, 1), (91, [nan] * 16, 1), (92, [inf] + [0.0] * 15, 2), (93, [None] + [0.0] * 15, None), (94, [], 7), (95, [1.5], 7), (None, [0.5] * 16, None), (5, [0.25] * 16, 1), (5, [0.25] * 16, 1), (96, [0.1] * 13, None), (97, [-0.0] * 16, 3)]
    rows = [(i, v if v is None else [x if x is None else single(x) for x in v], label) for i, v, label in rows]
    got = vectorcodes.vector_codes(clashing(spark.createDataFrame(rows, VECTORS)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(codes_loop(rows), key=str)
    assert vectorcodes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert [r.code for r in vectorcodes.vector_codes(spark.createDataFrame([(1, [], None)], VECTORS)).collect()] == ["00" * 8]
    # Components beyond what 64 bits can hold have a result as well.
    huge = [(i, [single(x * 10.0**e) for x in (1, -2, 3, 0, 1, 1, 0, 5)], i) for i, e in enumerate([25, 37, -25, 0, 3] * 8)]
    found = vectorcodes.vector_codes(spark.createDataFrame(huge, VECTORS)).collect()
    assert len(found) == 40 and all(r.error >= 0 for r in found)


def test_codes_hot_label(spark, monkeypatch):
    """Labels meet their sums in place where many rows share one."""
    import gistmill.session as session

    monkeypatch.setattr(session, "HOT_KEYS", 4)
    rows = [(i, v, None if i % 3 else 1) for i, v, _ in made_vectors(200, 8)]
    got = vectorcodes.vector_codes(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, got.collect())) == sorted(codes_loop(rows))
