"""Main text of web pages: markup where it speaks, a host suffix array where not.

Markup settles most blocks. What is inside an article or main element is text;
menus, headers, footers, sidebars, adverts, notices, forms, scripts and reader
comments, known by element, role or class, are not. All other blocks are open, on
pages with an article too. For those, token streams of a host's pages, without
article text, are concatenated in shards; a suffix array of each shard finds the
token runs it shares between pages, and counts from all shards of the host are
added up. Open words that such runs cover are boilerplate, and the rest stays.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.llm.words import PLACE, mix, ready, unused, word_slices
from gistmill.session import stage

RUN = 6
PAGES = 3
SHARD_PAGES = 2000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|noscript|iframe|object|svg|math|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[/a-zA-Z][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("head nav footer aside form button dialog menu".split())
KEPT = {"article", "main"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WORDS = set(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets ad ads advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner notice notices cookie cookies consent gdpr newsletter subscribe subscription popup modal alert "
    "share sharing social related recommended login signup".split()
)
COMMENTS = set("comment comments commentlist disqus replies respond responses discussion".split())
CONTENT = set("content article post entry story main body".split())


def _region(tag: str, attributes: str, inside: str) -> str | None:
    """The region an element opens: "in", "out", "comments", or None for no change."""
    if tag in SKIPPED:
        return "out"
    names, role = set(), ""
    for kind, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        value = next((v for v in values if v), "").lower()
        if kind.lower() == "role":
            role = value.strip()
        else:
            names.update(re.split(r"[^a-z0-9]+", value))
    if names & COMMENTS and not names & {"content", "body"} - COMMENTS and tag not in ("html", "body"):
        return "comments"
    if tag in KEPT or role in ("main", "article"):
        return "in"
    if tag in ("html", "body"):
        return None
    if tag == "header":
        return None if inside == "in" else "out"
    if role in ROLES:
        return "out"
    if names & WORDS and not names & CONTENT:
        return "out"
    return None


def blocks(page: str) -> list[tuple[str, str]]:
    """(region, text) of the blocks of a page, in order, white space collapsed.

    Elements that are not closed end with their parent; a paragraph ends the one
    before it. An article inside an unclosed advert or the like is text again.
    """
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # (tag, region before it)
    region, words = "open", []

    def close_block():
        if words:
            text = " ".join("".join(words).split())
            if text:
                found.append((region, text))
            words.clear()

    at = 0
    for match in TOKEN.finditer(page):
        if match.start() > at:
            words.append(references.unescape(page[at : match.start()]))
        at = match.end()
        tag = match["tag"]
        if not tag:
            if match["raw"] and match["raw"].lower() not in ("svg", "math"):
                close_block()
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag not in VOID and not match["end"]:
                stack.append((tag, region))
            elif match["end"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        if stack[i][1] != region:
                            close_block()
                        region = stack[i][1]
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
                continue
            new = _region(tag, match["attributes"], region) if tag not in VOID and match["attributes"] and region not in ("comments",) else None
            if new and new != region and new != "in":
                close_block()
                region = new
            continue
        if tag == "br":
            words.append(" ")
            continue
        close_block()
        if tag in VOID:
            continue
        if match["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    region = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] in KEPT and tag not in ("body", "html", "main", "article"):
                    break
            continue
        if tag == "p":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    region = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if match["attributes"].endswith("/"):
            continue
        new = _region(tag, match["attributes"], region)
        stack.append((tag, region))
        if new and region != "comments" and not (region == "out" and new == "in" and any(t in SKIPPED for t, _ in stack[:-1])):
            region = new
    if at < len(page):
        words.append(references.unescape(page[at:]))
    close_block()
    return found


def host(url: str | None) -> str:
    match = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "", re.I)
    return match[1].lower() if match else ""


def _word_hashes(texts: list[str]):
    """(text number, hash) arrays of the words of texts."""
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for part in word_slices(pa.array(texts, pa.string())):
        rows.append(part.first + part.row_of_word())
        hashes.append(part.hashes(lower=False))
    return np.concatenate(rows), np.concatenate(hashes)


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of RUN words."""
    n = len(hashes) - RUN + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for j in range(RUN if n > 0 else 0):
        out += hashes[j : j + n] * PLACE[j]
    return mix(out)


def _streams(batches):
    """Arrow function: pages to (page, host, words, open): the hashes of the words
    outside articles, and whether the page leaves blocks open."""
    for batch in batches:
        texts, hosts, pages, opens = [], [], [], []
        for page, url, text in zip(batch.column("page").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            own = blocks(text or "")
            texts.append(" ".join(t for r, t in own if r != "in"))
            hosts.append(host(url))
            pages.append(page)
            opens.append(any(r == "open" for r, _ in own))
        rows, hashes = _word_hashes(texts)
        offsets = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(hosts, pa.string()), words, pa.array(opens, pa.bool_())], names=["page", "host", "words", "open"])


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, ranks) of tokens, as far as the first ``depth`` of each
    suffix decide; equal beginnings have equal ranks."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64).reshape(-1)
    n, reach = len(tokens), 1
    while reach < depth:
        step = min(reach, depth - reach)
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64).reshape(-1)
        reach += step
    return np.argsort(rank, kind="stable"), rank


def _shared_runs(table: pa.Table) -> pa.Table:
    """(host, run, pages) of a shard: runs of RUN words and how many pages have them."""
    words = table.column("words").combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    sizes = np.diff(words.offsets.to_numpy())
    flat = words.flatten().to_numpy().view(np.uint64)
    # Pages are separated by tokens of their own, so no run crosses them.
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    tokens = mix(np.arange(len(flat) + len(sizes), dtype=np.uint64) + np.uint64(1 << 60))
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = np.ones(len(tokens), dtype=bool)
    inside[starts + sizes] = False
    tokens[inside] = flat
    order, rank = suffix_array(tokens, RUN)
    full = np.zeros(len(tokens), dtype=bool)
    counts = np.maximum(sizes - RUN + 1, 0)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
    full[at] = True
    order = order[full[order]]
    # Suffixes of equal rank stand together: the interval of one run.
    pairs = np.unique(np.stack([rank[order], owner[order]]), axis=1) if len(order) else np.zeros((2, 0), np.int64)
    ranks, pages = np.unique(pairs[0], return_counts=True)
    first = order[np.searchsorted(rank[order], ranks)]
    run = np.zeros(len(first), dtype=np.uint64)
    for j in range(RUN):
        run += tokens[np.minimum(first + j, max(0, len(tokens) - 1))] * PLACE[j]
    return pa.table({"host": pa.array([table.column("host")[0].as_py()] * len(run), pa.string()), "run": pa.array(mix(run).view(np.int64)), "pages": pa.array(pages.astype(np.int64))})


def _texts(schema, name: str):
    """Arrow function: pages with covered words of open blocks, in column ``name``, to their texts."""

    def run(batches):
        for batch in batches:
            texts = []
            for text, covered in zip(batch.column("html").to_pylist(), batch.column(name).to_pylist()):
                gone = {i for at in covered or () for i in range(at, at + RUN)}
                kept, count = [], 0
                for r, t in blocks(text or ""):
                    if r == "in":
                        kept.append(t)
                        continue
                    words = t.split(" ")
                    if r == "open":
                        left = [w for i, w in enumerate(words, count) if i not in gone]
                        kept += [" ".join(left)] if left else []
                    count += len(words)
                texts.append(" ".join(kept))
            added = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([added[f.name] if f.name in added else batch.column(f.name) for f in schema], names=[f.name for f in schema])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html, ...) with ``text`` and ``n_chars`` (code points) instead
    of html.

    Character references are decoded, white space in a block becomes one blank, and
    blocks are joined by one blank. A null or empty html has an empty text. Without
    a host (null or odd url) pages form a group of their own. Equal rows count as
    one page when runs are counted. Other columns pass through; columns named like
    the added ones are replaced. Names hold no dots, which Arrow functions don't take.
    """
    ready(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    page = F.xxhash64("url", "html")
    streams = stage(pages.select(page.alias("page"), "url", "html").mapInArrow(_streams, "page long, host string, words array<long>, open boolean"), "page-streams").dropDuplicates(["page"])
    hosts = streams.where("open").select("host").distinct()
    sizes = streams.join(hosts, "host", "left_semi").groupBy("host").agg(F.ceil(F.count("*") / F.lit(SHARD_PAGES)).alias("shards"))
    shards = streams.join(sizes, "host").select("host", "words", F.pmod(F.xxhash64("page"), F.col("shards")).alias("shard"))
    runs = shards.groupBy("host", "shard").applyInArrow(_shared_runs, "host string, run long, pages long")
    runs = runs.groupBy("host", "run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= PAGES).select("host", "run")
    own = streams.where("open").mapInArrow(_positions, "page long, host string, at int, run long")
    covered = stage(own.join(runs, ["host", "run"]).groupBy("page").agg(F.collect_list("at").alias("covered")), "page-covered")
    key, name = unused(pages, "page", "covered")
    rest = pages.select("*", page.alias(key)).join(covered.toDF(key, name), key, "left").drop(key)
    schema = T.StructType([*[f for f in pages.schema if f.name != "html"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rest.mapInArrow(_texts(schema, name), schema)


def _positions(batches):
    """Arrow function: streams to (page, host, at, run), one row per run of words."""
    for batch in batches:
        names, hosts, at, runs = [], [], [], []
        for page, name, words in zip(batch.column("page").to_pylist(), batch.column("host").to_pylist(), batch.column("words")):
            grams = _grams(words.values.to_numpy().view(np.uint64))
            names += [page] * len(grams)
            hosts += [name] * len(grams)
            at.append(np.arange(len(grams), dtype=np.int32))
            runs.append(grams.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(hosts, pa.string()), pa.array(np.concatenate(at) if at else np.zeros(0, np.int32)), pa.array(np.concatenate(runs) if runs else np.zeros(0, np.int64))],
            names=["page", "host", "at", "run"],
        )
