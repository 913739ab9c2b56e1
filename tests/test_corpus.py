import random

from pyspark.sql import functions as F

from gistmill.operators import clean, crawl, transcripts
from gistmill.plans import corpus
from gistmill.sources import readers, schemas, sinks
from gistmill.streaming.ingest import ingest, ingest_keyed, read_ingested


def column(df, name):
    return sorted(r[name] for r in df.collect())


def test_blank_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "  \n"), (4, "NA"), (5, "")], "i int, t string")
    assert column(clean.drop_blank(df, "t"), "i") == [1, 4]
    assert column(clean.drop_blank(df, "t", ["NA"]), "i") == [1]
    assert column(clean.drop_missing(df, "t"), "i") == [1, 3, 4, 5]


def test_profanity_removes_whole_conversations(spark):
    rows = [("a", "x", "fine"), ("a", "x", "CLASSic"), ("b", "x", "ok"), ("b", "y", "ok")]
    df = spark.createDataFrame(rows, "corpus_name string, conv_id string, answer_text string")
    # The conversation id decides, in whichever corpus it occurs.
    assert [r.conv_id for r in clean.drop_profane_conversations(df, "answer_text", ["ass"]).collect()] == ["y"]
    names = spark.createDataFrame([("Bass",), ("trout",)], "n string")
    assert column(clean.drop_profane_names(names, "n", ["ass"]), "n") == ["trout"]


def test_long_word_lists(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcÉ ") for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None]
    words = ["a", "bc", "cab", "abca", "bcab c", "éa", "cccccc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    listed = spark.createDataFrame([(w,) for w in words], "w string")
    expected = sorted((t or "", any(w in (t or "").lower() for w in words)) for t in texts)
    for most, chars in ((500, 1000), (2, 1000), (2, 6)):  # a pattern, an automaton, several
        monkeypatch.setattr(clean, "PATTERN_WORDS", most)
        monkeypatch.setattr(clean, "SHARD_CHARS", chars)
        got = clean.flag_profanity(df, "t", listed.union(spark.createDataFrame([(None,), ("",)], "w string")))
        assert sorted((r.t or "", r.has_profanity) for r in got.collect()) == expected
        assert not any(r.has_profanity for r in clean.flag_profanity(df, "t", listed.limit(0)).collect())


def test_long_lists_write_texts_once(spark, monkeypatch):
    """However long the list: heads in one automaton, the rest of a word by a join."""
    written = []
    monkeypatch.setattr(clean, "PATTERN_WORDS", 2)
    monkeypatch.setattr(clean, "SHARD_CHARS", 20)
    monkeypatch.setattr(clean, "stage", lambda df, label, own=clean.stage: (written.append(label), own(df, label))[1])
    texts = ["Heads1x", "heads12x", "no head", "head", "tail", "heads", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    listed = spark.createDataFrame([(w,) for w in [*(f"heads{i}x" for i in range(2, 40)), "tail"]], "w string")
    got = clean.flag_profanity(df, "t", listed)
    assert sorted(r.i for r in got.collect() if r.has_profanity) == [1, 4]
    assert got.columns == ["i", "t", "has_profanity"] and written.count("flagged") == 1


def test_valid_corpora(spark):
    rows = [("big", i, "x" * 100) for i in range(10)] + [("few", i, "x" * 1000) for i in range(9)]
    rows += [("short", i, "x") for i in range(20)] + [("edge", i, "x" * 100 if i else None) for i in range(11)]
    df = spark.createDataFrame(rows, "c string, i int, t string")
    assert column(clean.valid_corpora(df, "c", "i", "t"), "c") == ["big", "edge"]
    assert clean.keep_valid_corpora(df, "c", "i", "t").count() == 21


def test_build_and_clean(spark):
    rows = [("c", f"v{i}", t, f"text {i}\t{t} " + "y" * 60) for i in range(10) for t in (5, 3, 9)]
    rows[0] = ("c", "v0", 5, "   ")
    rows[4] = ("c", "v1", 3, "has BADword in it")
    df = spark.createDataFrame(rows, "corpus string, conv string, turn int, body string")
    built = corpus.build_corpus(df, "corpus", "conv", "turn", "body")
    assert built.schema == schemas.UTTERANCES or [f.name for f in built.schema] == schemas.UTTERANCES.names
    first = {r.conv_id: r.answer_text for r in built.filter("res_id = 1").collect()}
    assert first["v2"] == "text 23 " + "y" * 60
    assert {r.question_text for r in built.collect()} == {"DUMMY DATA"}
    cleaned = corpus.clean_corpus(built, ["badword"])
    assert cleaned.count() == 30 - 1 - 3 and not cleaned.filter("conv_id = 'v1'").count()


def test_index_lines(spark):
    lines = spark.createDataFrame([("a$#$b$#$c\n",), ("a$#$b",), ("b$#$c$#$d$#$e",), ("ab$#$c$#$d",)], "line string")
    assert {r.line: r.n_parts for r in clean.malformed_lines(lines, "line").collect()} == {"a$#$b": 2, "b$#$c$#$d$#$e": 4}
    gone = spark.createDataFrame([("a",)], "name string")
    assert column(clean.remove_entries(lines, "line", gone, "name"), "line") == ["ab$#$c$#$d", "b$#$c$#$d$#$e"]


def test_batches(spark):
    df = spark.createDataFrame([(f"n{i:03}",) for i in range(25)], "name string").repartition(3)
    got = {r.name: r.batch for r in clean.batches(df, ["name"], 10).collect()}
    assert got == {f"n{i:03}": i // 10 for i in range(25)}


def test_transcripts(spark):
    text = "lost\n>> USER: first\n>> USER: second\nline\n>> ASSISTANT: ```x\ny```ans\n### head\n>> USER:last"
    df = spark.createDataFrame([("t", text), ("u", "nothing"), ("v", ">> ASSISTANT: a\n>> USER: q")], "id string, value string")
    blocks = transcripts.transcript_blocks(df, ["id"]).orderBy("id", "block").collect()
    assert [(b.id, b.role, b.text) for b in blocks] == [
        ("t", "user", "second\nline"), ("t", "assistant", "```x\ny```ans\n### head"), ("t", "user", "last"),
        ("v", "assistant", "a"), ("v", "user", "q")]
    table = corpus.import_transcripts(df, "id", start=7).orderBy("res_id").collect()
    # Pairs go by position, not by adjacency.
    assert [(r.conv_id, r.res_id, r.question_text, r.answer_text) for r in table] == [
        ("t", 8, "second\nline", "ans\n"), ("v", 9, "q", "a")]


def test_links(spark):
    base = "https://host.org/sets/b/"
    html = "<A HREF='/up'>u</A><a class=x href=\"n%20a+b.corpus.zip\"></a><a href='t.txt'></a><a href=\"/sets/b/c.corpus.zip\">"
    pages = spark.createDataFrame([(1, base, html)], "page_id int, url string, html string")
    assert [(r.pos, r.href) for r in crawl.page_hrefs(pages, ["page_id"]).collect()][0] == (1, "n%20a+b.corpus.zip")
    assert column(crawl.archive_names(pages, ["page_id"]), "name") == ["subreddit-c", "subreddit-n a+b"]


def test_crawl_rules(spark):
    robots = spark.createDataFrame(
        [("h", "User-agent: *"), ("h", "Disallow: /a"), ("h", "disallow: /b"), ("e", "Disallow: ")], "domain string, value string")
    rules = crawl.robots_prefixes(robots, ["domain"])
    assert sorted((r.domain, r.prefix) for r in rules.collect()) == [("e", ""), ("h", "/a")]
    urls = ["http://h/abc", "http://h/b", "http://h", "http://e/x", "http://other/b", "http://open/z"]
    links = spark.createDataFrame([(u,) for u in urls], "url string")
    known = rules.unionByName(spark.createDataFrame([("open", None)], "domain string, prefix string"))
    assert column(crawl.allowed_links(links, "url", known), "url") == ["http://h", "http://h/b", "http://open/z"]


def test_resolved_links(spark):
    """As the standard library joins addresses, without fragments."""
    from urllib.parse import urldefrag, urljoin

    bases = ["http://h.org/a/b/c.html?q=1#f", "https://h.org", "http://h.org/", "http://h.org/a/"]
    hrefs = ["x", "x/y?z=/../1", "/x", "//o.net/p", "?n=2", "", "#top", "./x", "../x", "../../../x", "a/./b/../c/", "http://o.net/k", "..", "mailto:a@b", " x "]
    rows = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(rows, "base string, href string").select("base", "href", crawl.resolve_link("base", "href").alias("url")).collect()
    for r in got:
        expected = urldefrag(urljoin(r.base, r.href.strip()))[0]
        assert r.url == expected, (r.base, r.href)


def _followed_loop(pages, starts, rules):
    """Breadth first, one page at a time. Links are given as absolute addresses."""
    def allowed(url):
        host, path = url.split("/")[2], "/" + "/".join(url.split("/")[3:])
        return any(d == host for d, _ in rules) and not any(d == host and p is not None and path.startswith(p) for d, p in rules)

    step = {u: 0 for u in starts if u in pages and allowed(u)}
    queue = list(step)
    for url in queue:
        for link in pages[url][1:]:
            if link in pages and link not in step and allowed(link) and link.split("/")[2] == url.split("/")[2]:
                step[link] = step[url] + 1
                queue.append(link)
    return step


def test_followed_pages(spark):
    """Cycles, pages that are missing, forbidden, on another host, or not linked."""
    import random

    rng = random.Random(4)
    urls = [f"http://{h}/{p}{i}" for h in ("one", "two", "shut") for p in ("a/", "b/", "no/") for i in range(12)]
    pages = {u: [rng.choice(urls) for _ in range(rng.randint(0, 4))] + ["http://one/missing"] for u in urls}
    for i in range(20):  # a chain longer than the steps that are kept apart
        pages[f"http://one/chain{i}"] = ["http://one/", f"http://one/chain{i + 1}", "http://one/chain0"]
    rules = [("one", "/no"), ("two", None), ("one", "/b/1")]
    html = lambda links: "".join(f"<a href='{x}'>x</a>" for x in links)
    frame = spark.createDataFrame([(u + "#part", html(x)) for u, x in pages.items()] + [(None, None), ("http://one/a/0", None)], "url string, html string")
    starts = ["http://one/a/0", "http://one/no/1", "http://two/b/3", "http://shut/a/1", "http://one/gone", "http://one/chain0"]
    got = lambda **more: {
        r.address: r.step for r in crawl.followed_pages(
            frame, spark.createDataFrame([(u,) for u in starts], "url string"), spark.createDataFrame(rules, "domain string, prefix string"), **more).collect()}
    expected = _followed_loop(pages, starts, rules)
    assert got() == expected and max(expected.values()) >= 19
    assert got(most_steps=1) == {u: n for u, n in expected.items() if n <= 1}


def test_archives_of_followed_pages(spark):
    top, sub = "https://host.org/sets/", "https://host.org/sets/b/"
    pages = [(1, top, "<a href='/'></a><a href='b/'></a><a href='own.corpus.zip'></a>"), (2, sub, "<a href='../'></a><a href='n%20a.corpus.zip'></a><a href='../'></a>")]
    frame = spark.createDataFrame(pages, "page_id int, url string, html string")
    known = spark.createDataFrame([("host.org", None)], "domain string, prefix string")
    got = crawl.archive_names_followed(frame, spark.createDataFrame([(top,)], "url string"), known, ["page_id"])
    assert sorted((r.page_id, r.step, r.name) for r in got.collect()) == [(1, 0, "subreddit-own"), (2, 1, "subreddit-n a")]
    shut = spark.createDataFrame([("host.org", "/sets/b")], "domain string, prefix string")
    got = crawl.archive_names_followed(frame, spark.createDataFrame([(top,)], "url string"), shut, ["page_id"])
    assert [r.page_id for r in got.collect()] == [1]


def test_lists(spark, tmp_path):
    assert readers.read_list(spark, str(tmp_path / "missing.txt")).count() == 0
    (tmp_path / "names.txt").write_text("  One \n\nbad/name\nTwo?\nThree\n")
    assert column(readers.read_list(spark, str(tmp_path / "names.txt")), "value") == ["One", "Three"]
    assert column(readers.read_list(spark, str(tmp_path / "names.txt"), lower=True), "value") == ["one", "three"]
    sinks.write_list(readers.read_list(spark, str(tmp_path / "names.txt")), "value", str(tmp_path / "out"))
    assert column(spark.read.text(str(tmp_path / "out")), "value") == ["One", "Three"]


def test_tables(spark, tmp_path):
    rows = [("c", "v", 1, "q", 'say "hi",\nthere'), ("c", "v", 2, "q", None)]
    df = spark.createDataFrame(rows, schemas.UTTERANCES)
    sinks.write_sheet(df, str(tmp_path / "sheet"))
    back = readers.read_table(spark, str(tmp_path / "sheet"), format="csv")
    assert sorted(back.collect()) == sorted(df.collect())
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "table"))
    assert readers.read_table(spark, str(tmp_path / "table")).count() == 2
    reviews = spark.createDataFrame([("0123", "a"), ("123", "b")], schemas.REVIEWS)
    assert column(readers.item_reviews(reviews, "123"), "content") == ["b"]


def test_summary_files(spark, tmp_path):
    sentences = spark.createDataFrame([(1, 0, "B."), (1, 1, "A."), (2, 0, "C.")], "val int, sen_pos int, sentence string")
    summary = spark.createDataFrame([(1, 1, "A."), (1, 2, "B.")], "val int, rank int, sentence string")
    sinks.write_summary_files(sentences, summary, "val", ["sen_pos"], str(tmp_path / "files"))
    text = {}
    for part in sorted((tmp_path / "files").glob("val=*/*.txt")):
        text[part.parent.name] = text.get(part.parent.name, "") + part.read_text()
    assert text["val=1"] == "Original Response: \nB.\nA.\n\nSummary: \nA.\nB.\n"
    assert text["val=2"] == "Original Response: \nC.\n\nSummary: \n"
    (tmp_path / "one.txt").write_text(text["val=1"])
    parsed = readers.read_summary_files(spark, str(tmp_path / "one.txt")).collect()
    assert sorted((r.part, r.idx, r.sentence) for r in parsed) == [
        ("source", 0, "B."), ("source", 1, "A."), ("summary", 0, "A."), ("summary", 1, "B.")]
    sinks.write_sentences(summary, "val", str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines" / "val=1")).collect()] == ["A.", "B."]
    assert readers.read_summaries(spark, str(tmp_path / "one.txt")).first().summary == text["val=1"]
    texts = spark.createDataFrame([(1, "One. Two.")], "id int, t string")
    sinks.write_text_sentences(texts, "id", "t", str(tmp_path / "sens"))
    assert [r.value for r in spark.read.text(str(tmp_path / "sens" / "id=1")).collect()] == ["One.", "Two."]
    scores = spark.createDataFrame([(0.1, 0.2, 0.3, 0.6)], "grammar double, redundancy double, focus double, readability double")
    sinks.write_scores(scores, str(tmp_path / "scores"))
    assert tuple(spark.read.csv(str(tmp_path / "scores")).first()) == ("0.1", "0.2", "0.3", "0.6")


def test_summary_folders_of_many_files(spark, tmp_path):
    sentences = [(g, i, f"{g} sentence {i}.") for g in (1, 2) for i in range(300)] + [(3, 0, "with\nline feed."), (None, 0, "no group.")]
    summary = [(1, r, f"1 sentence {300 - r}.") for r in range(1, 40)] + [(3, 1, "Summary: ")]
    path = str(tmp_path / "folders")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_summary_files(
            spark.createDataFrame(sentences, "val int, sen_pos int, sentence string"),
            spark.createDataFrame(summary, "val int, rank int, sentence string"), "val", ["sen_pos"], path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "folders").glob("val=*/*.txt"))) > 4  # a group is several files
    got = sorted(((r.val, r.part, r.idx, r.sentence) for r in readers.read_summary_folders(spark, path, "val").collect()), key=str)
    expected = [(g, "source", i, s.replace("\n", " ")) for g, i, s in sentences] + [(g, "summary", r - 1, s) for g, r, s in summary]
    assert got == sorted(expected, key=str)


def test_read_checked(spark, tmp_path):
    (tmp_path / "table.csv").write_text(
        'id,name,size\n1,"a, ""quoted""\nname",2.5\nNA,b,NA\nx7,c,1\n4,d\n5,e,1,more\n6,,big\n\n7,n/a,3\n')
    schema = "id int, name string, size double"
    from pyspark.sql.types import StructType

    got = readers.read_checked(spark, str(tmp_path / "table.csv"), StructType.fromDDL(schema), ["NA", "n/a"])
    assert [tuple(r) for r in got.collect()] == [
        (1, 'a, "quoted"\nname', 2.5, None, None), (None, "b", None, None, None), (None, "c", 1.0, "id", "x7"),
        (None, None, None, "columns", "4,d"), (None, None, None, "columns", "5,e,1,more"), (6, None, None, "size", "big"),
        (7, None, 3.0, None, None)]
    assert got.select("name").count() == 7 and got.filter("damage = 'columns'").count() == 2
    (tmp_path / "empty.csv").write_text("id,name,size\n")
    assert readers.read_checked(spark, str(tmp_path / "empty.csv"), StructType.fromDDL(schema)).count() == 0


def test_ingest_is_incremental(spark, tmp_path):
    landing, table = tmp_path / "landing", str(tmp_path / "table")

    def land(name, conv):
        rows = [("c", conv, t, f"{conv} {t}") for t in range(3)]
        spark.createDataFrame(rows, "corpus string, conv string, turn int, body string").coalesce(1).write.mode("append").parquet(str(landing))

    def run(checkpoint):
        schema = spark.read.parquet(str(landing)).schema
        ingest(spark, str(landing), schema, lambda df: corpus.flatten(df, "corpus", "conv", "turn", "body"),
               table, str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.conv_id, r.res_id) for r in spark.read.parquet(table).collect())

    land("one", "v1")
    assert run("a") == [("v1", i) for i in (1, 2, 3)]
    land("two", "v2")
    assert run("a") == [(v, i) for v in ("v1", "v2") for i in (1, 2, 3)]
    # A new checkpoint sees every file again, and adds nothing.
    assert len(run("b")) == 6


def test_keyed_ingest(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), tmp_path / "table"
    schema = "corpus string, conv string, turn int, body string"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)

    def land(*convs):
        rows = [("c", v, t, f"{v} {t}") for v in convs for t in range(3)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)

    def run():
        query = ingest_keyed(spark, landing, spark.read.parquet(landing).schema, ["conv", "turn"],
                             lambda df: corpus.flatten(df, "corpus", "conv", "turn", "body"), str(table), str(tmp_path / "state"))
        query.awaitTermination()
        return query.recentProgress

    def held():
        return sorted((r.conv_id, r.res_id, r.answer_text) for r in read_ingested(spark, str(table), schemas.UTTERANCES).collect())

    def expected(*convs):
        return [(v, t + 1, f"{v} {t}") for v in convs for t in range(3)]

    land("v1", "v1", "v2")
    run()
    assert held() == expected("v1", "v2")
    # What the table holds isn't read again: it may even be unreadable meanwhile.
    first = {p: p.read_bytes() for p in (table / "batch=0").glob("*.parquet")}
    for path in first:
        path.write_bytes(b"damaged")
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    land("v2", "v3")
    progress = run()
    for path, data in first.items():
        path.write_bytes(data)
    assert held() == expected("v1", "v2", "v3")
    assert sum(p["numInputRows"] for p in progress) == 6
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in progress) == 3
    # A run without new files adds nothing, and a batch that is repeated replaces itself.
    run()
    (tmp_path / "state" / "commits" / "1").unlink()
    (tmp_path / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert held() == expected("v1", "v2", "v3")
    assert spark.conf.get(provider, None) == before


def test_numbers(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), (-F.col("id")).alias("t"))
    got = {(r.k, r.t): r.res_id for r in corpus.number_utterances(df, ["k"], ["t"]).collect()}
    assert got[(0, -8)] == 1 and got[(1, -1)] == 5
