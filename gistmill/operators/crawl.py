"""Links of landed pages and crawl permission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.session import small_side, stage

_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def page_hrefs(pages: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """``href`` of every anchor but the first of a page, with its position."""
    found = F.regexp_extract_all(F.col(html), F.lit(_HREF), F.lit(1))
    return pages.select(*keys, F.posexplode(found).alias("pos", "href")).filter("pos > 0")


def percent_decode(c: Column) -> Column:
    """Decode %XX; a plus sign stays one, and broken escapes leave the text as is."""
    plain = F.regexp_replace(c, r"\+", "%2B")
    return F.coalesce(F.try_url_decode(plain), c)


def archive_names(
    pages: DataFrame, keys: Sequence[str], url: str = "url", html: str = "html",
    suffix: str = ".zip", ending: str = ".corpus.zip", prefix: str = "subreddit-",
) -> DataFrame:
    """Names of the archives a page links to: the decoded link, without the
    page's own address in front and the archive ending behind. The defaults are
    fixed values of the published archive lists."""
    links = page_hrefs(pages, [*keys, url], html).filter(F.col("href").endswith(suffix))
    base = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"[^/]*$", "")
    site = F.regexp_extract(F.col(url), r"^[a-zA-Z]+://[^/?#]+", 0)
    absolute = (
        F.when(F.col("href").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.col("href"))
        .when(F.col("href").startswith("/"), F.concat(site, "href"))
        .otherwise(F.concat(base, "href"))
    )
    decoded = links.withColumn("_link", percent_decode(absolute)).withColumn("_base", percent_decode(base))
    tail = F.when(F.col("_link").startswith(F.col("_base")), F.substr("_link", F.length("_base") + 1)).otherwise(
        F.element_at(F.split("_link", "/"), -1)
    )
    keep = F.length("_tail") - F.length(F.lit(ending))
    name = F.when(F.col("_tail").endswith(ending), F.left("_tail", keep)).otherwise(F.col("_tail"))
    return decoded.withColumn("_tail", tail).select(*keys, "pos", F.concat(F.lit(prefix), name).alias("name"))


def robots_prefixes(lines: DataFrame, keys: Sequence[str], line: str = "value") -> DataFrame:
    """Forbidden path prefixes of ``Disallow: `` lines, for every agent alike.
    An empty prefix forbids the whole site."""
    return lines.filter(F.col(line).startswith("Disallow: ")).select(
        *keys, F.substr(line, F.lit(len("Disallow: ") + 1)).alias("prefix")
    )


def split_url(c: Column | str) -> tuple[Column, Column]:
    """Host and path of an address, without failing on a malformed one."""
    c = F.col(c) if isinstance(c, str) else c
    host = F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return host, path


def allowed_links(links: DataFrame, url: str, rules: DataFrame, domain: str = "domain", prefix: str = "prefix") -> DataFrame:
    """Links a crawler may follow: the host is a known domain and no prefix
    forbidden there starts the path.

    ``rules`` has one row per forbidden prefix; a domain without any has one
    row with a null prefix. Paths are opened into their own prefixes and joined
    on (domain, prefix), so no link is compared with every rule.
    """
    return _permitted(links, url, *_rule_tables(rules, domain, prefix))


def _rule_tables(rules: DataFrame, domain: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    rules = small_side(rules.select(F.col(domain).alias("_host"), F.col(prefix).alias("_prefix")).distinct(), "rules")
    # One row per domain, with the lengths its prefixes have.
    hosts = small_side(rules.groupBy("_host").agg(F.collect_set(F.length("_prefix")).alias("_lengths")), "hosts")
    return rules, hosts


def _permitted(links: DataFrame, url: str, rules: DataFrame, hosts: DataFrame) -> DataFrame:
    host, path = split_url(url)
    links = links.withColumn("_host", host).withColumn("_path", path)
    targets = links.select("_host", "_path").distinct()
    heads = targets.join(hosts, "_host").select(
        "_host", "_path",
        F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_size"),
    ).withColumn("_prefix", F.left("_path", F.col("_size")))
    forbidden = heads.join(rules, ["_host", "_prefix"], "left_semi").select("_host", "_path").distinct()
    return (
        links.join(hosts, "_host", "left_semi")
        .join(forbidden, ["_host", "_path"], "left_anti")
        .drop("_host", "_path")
    )


_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; a last one leaves its slash."""
    parts = F.split(path, "/", -1)
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.array_append(acc, x)),
    )
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.contains("/."), F.array_join(ended, "/")).otherwise(path)


def resolve_link(base: Column | str, href: Column | str) -> Column:
    """Absolute address of a link found on the page at ``base``, without fragment."""
    base, href = (F.col(c) if isinstance(c, str) else c for c in (base, href))
    href = F.regexp_replace(F.trim(href), r"(?s)#.*$", "")
    page = F.regexp_replace(base, r"(?s)[?#].*$", "")
    scheme = F.regexp_extract(base, _SCHEME, 0)
    site = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    folder = F.when(page == site, F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    whole = (
        F.when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href == "", F.regexp_replace(base, r"(?s)#.*$", ""))
        .otherwise(F.concat(folder, href))
    )
    head = F.regexp_extract(whole, r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)([^?]*)(.*)$", 1)
    path, rest = (F.regexp_extract(whole, r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)([^?]*)(.*)$", i) for i in (2, 3))
    return F.when(head == "", whole).otherwise(F.concat(head, _without_dots(path), rest))


def page_address(c: Column | str) -> Column:
    """What tells pages apart: the decoded address without fragment."""
    c = F.col(c) if isinstance(c, str) else c
    return percent_decode(F.regexp_replace(c, r"(?s)#.*$", ""))


def link_graph(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (source, target) addresses of links, all but the first of each page,
    that stay on the page's own host and lead to another landed page."""
    links = page_hrefs(pages.select(F.col(url).alias("base"), F.col(html).alias("html")), ["base"])
    links = links.select(page_address("base").alias("source"), page_address(resolve_link("base", "href")).alias("target"))
    links = links.filter((split_url("source")[0] == split_url("target")[0]) & (F.col("source") != F.col("target"))).distinct()
    landed = pages.select(page_address(url).alias("target")).distinct()
    return links.join(landed, "target", "left_semi").select("source", "target")


#: Steps after which the pages seen are written as one table again.
_SEEN_STEPS = 16


def followed_pages(
    pages: DataFrame, starts: DataFrame, rules: DataFrame, url: str = "url", html: str = "html",
    domain: str = "domain", prefix: str = "prefix", most_steps: int | None = None,
) -> DataFrame:
    """(address, step) of the landed pages that a crawler reaches from ``starts``
    (a frame with ``url``) by links it may follow, each at its first step, from 0.

    A link is followed within its page's host, if ``allowed_links`` lets it, starts
    too. Links to pages that did not land lead nowhere. One step is one join of the
    links with the pages found by the step before, without those seen already, so
    cycles end, and a page that many others link to is one row as soon as a task
    has seen it. The number of jobs grows with the length of the shortest paths.
    """
    links = stage(link_graph(pages, url, html), "links")
    rules, hosts = _rule_tables(rules, domain, prefix)
    landed = pages.select(page_address(url).alias("address")).distinct()

    def permitted(found: DataFrame, step: int) -> DataFrame:
        return _permitted(found, "address", rules, hosts).select("address", F.lit(step).alias("step"))

    first = starts.select(page_address(url).alias("address")).distinct().join(landed, "address", "left_semi")
    newest = small_side(permitted(first, 0), "crawl-step")
    seen, step = newest, 0
    while (most_steps is None or step < most_steps) and not newest.isEmpty():
        step += 1
        found = links.join(newest, F.col("source") == F.col("address")).select(F.col("target").alias("address")).distinct()
        newest = small_side(permitted(found.join(seen, "address", "left_anti"), step), "crawl-step")
        seen = seen.unionByName(newest)
        if step % _SEEN_STEPS == 0:
            seen = stage(seen, "crawl-seen")
    return seen


def archive_names_followed(
    pages: DataFrame, starts: DataFrame, rules: DataFrame, keys: Sequence[str],
    url: str = "url", html: str = "html", most_steps: int | None = None, **names: str,
) -> DataFrame:
    """``archive_names`` of the pages that links reach from ``starts``, with the step
    that reached them. Archives listed one link away are those of step 1."""
    reached = followed_pages(pages, starts, rules, url, html, most_steps=most_steps)
    on_way = pages.withColumn("_address", page_address(url)).join(reached.withColumnRenamed("address", "_address"), "_address")
    return archive_names(on_way, [*keys, "step"], url, html, **names)
