"""The pipeline stage by stage against loops, and the registered queries."""

import random
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from gistmill.llm.queries import QUERIES, SQL  # noqa: E402
from test_operators import all_near_lines, filled, grouped, leak_loop, shingle_set  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
NATURAL = {"en": "the of and to in is that it was for with on as by", "fr": "le la les des et un une dans que pour est sur"}


def corpus(seed=4):
    rng = random.Random(seed)
    names = {x: [f"{a}{b}" for a in t.split() for b in t.split()] + t.split() for x, t in NATURAL.items()}
    items = [(i, " ".join(rng.choices(names["en"], k=20))) for i in range(6)]
    docs, shared = [], [" ".join(rng.choices(names["en"], k=10)) for _ in range(5)]
    for d in range(140):
        lang = rng.choice(["en", "en", "fr"])
        own = [" ".join(rng.choices(names[lang], k=rng.randint(5, 30))) for _ in range(rng.randint(1, 4))]
        if d % 9 == 0:
            own.insert(0, rng.choice(shared))
        if d % 11 == 0:
            own[-1] += " " + rng.choice(items)[1] + " " + " ".join(rng.choices(names[lang], k=4))
        text = "\n".join(own)
        if docs and d % 7 == 0:
            old = docs[rng.randrange(len(docs))][1].split(" ")
            old[rng.randrange(len(old))] = "changed"
            text = " ".join(old).replace("\n", " ")
        docs.append((d, text, lang, rng.choice(["a", "b", "c", None]), len(text)))
    docs += [(200, None, "en", "a", None), (201, "", "en", "a", 0), (202, "... 123", None, "b", 7)]
    return docs, items


def test_pipeline(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before, folder = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, folder)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / f"out-{number}"))
        before = spark.read.parquet(str(tmp_path / f"out-{number}"))
        kept[name] = [tuple(r) for r in before.collect()]
    ids = lambda name: sorted(r[0] for r in kept[name])
    assert ids("language_id") == list(range(140))
    gone = all_near_lines([(r[0], r[1]) for r in kept["language_id"]])
    texts = {r[0]: "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone[r[0]]) for r in kept["language_id"]}
    assert {r[0]: r[1] for r in kept["line_dedup"]} == {d: t for d, t in texts.items() if t.strip()}
    assert sum(map(len, gone.values())) > 5 and all(r[4] == len(r[1]) for r in kept["line_dedup"])
    sets = {r[0]: shingle_set(r[1]) for r in kept["line_dedup"]}
    groups = grouped(sorted(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert ids("near_duplicates") == sorted(set(groups.values())) and len(set(groups.values())) < len(groups)
    leaks = {d for d, _ in leak_loop([(r[0], r[1]) for r in kept["near_duplicates"]], items)}
    assert leaks and ids("decontamination") == [d for d in ids("near_duplicates") if d not in leaks]
    sizes, words = defaultdict(int), defaultdict(int)
    for r in kept["decontamination"]:
        sizes[r[3]] += len(r[1].split())
    for r in kept["mixing"]:
        words[r[3]] += len(r[1].split())
    assert all(abs(words[s] - t) <= 0.5 for s, t in filled(sizes).items())
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, run.collect())) == sorted(map(str, before.collect()))


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    df = QUERIES[name](spark, str(FOLDER))
    got = [r.asDict() for r in df.collect()]
    if name not in SQL:
        assert got
        return
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    expected = sorted(map(str, result.fetchall()))
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got) == expected
