"""URL rules by a cascade of Bloom filters.

A rule is a host with a path prefix and lets urls in or keeps them out. The keys
that can settle a url are the ends of its host at a dot with the beginnings of its
path, in the shapes that rules have. Whether such a key is listed is answered by a
cascade: its first level is a Bloom filter of the listed keys, the second one of the
keys of the corpus that pass the first without being listed, the third of the listed
keys that pass the second, and so on until nothing passes wrongly. As the levels are
built from every key that the corpus has, answers for the corpus are exact, and pages
are neither joined nor shuffled. A second cascade says which listed keys block.

Everything is DataFrame functions: bits are set by aggregates, and a level reaches
the tasks as a binary literal of bounded size, of which tests read single bytes.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.session import stage

#: Bits of one cascade, the bound of what a task holds: 11 MB. Longer lists are cut
#: by a hash of their keys, and pages are passed once for each part.
MOST_BITS = 1 << 26
#: Bits of a cell: a byte holds six, as a printable character from ``0`` on.
CELL = 6
_LEVELS = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Level(NamedTuple):
    cells: bytes
    probes: int


def url_host(url: str) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def url_path(url: str) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_keys(rules: DataFrame) -> DataFrame:
    """(key, labels, size, blocks) of rules (host, path, verdict), once per key.
    Nulls, and paths that no url can have, are no rules; of two opposite rules for
    one key the blocking one holds."""
    host = F.translate("host", _UPPER, _LOWER)
    usable = F.col("host").isNotNull() & ~F.col("host").rlike("[/?#]") & F.col("path").rlike(r"(?s)^(/[^?#]*)?$")
    return (
        rules.where(usable & F.col("verdict").isin("allow", "block"))
        .groupBy(F.concat(host, "path").alias("key"))
        .agg(
            F.first(F.length("host") - F.length(F.translate("host", ".", "")) + 1).alias("labels"),
            F.first(F.length("path")).alias("size"),
            F.max(F.col("verdict") == "block").alias("blocks"),
        )
    )


def url_keys(host: Column, path: Column, shapes: Column) -> Column:
    """array<struct<length, host_length, key>>: what could be listed for a url."""

    def key(shape):
        end = F.call_function("substring_index", host, F.lit("."), -shape["labels"])
        return F.struct(
            (F.length(end) + shape["size"]).alias("length"),
            F.length(end).alias("host_length"),
            F.concat(end, F.substring(path, F.lit(1), shape["size"])).alias("key"),
        )

    return F.transform(F.filter(shapes, lambda s: s["size"] <= F.length(path)), key)


def _position(key: Column, number: int, cells: int, probe: Column) -> Column:
    bits = F.lit(cells * CELL).cast("long")
    one, two = (F.pmod(F.xxhash64(key, F.lit(2 * number + i)), bits) for i in (0, 1))
    return F.pmod(one + probe * two, bits)


def _passes(level: Level, number: int, key: Column) -> Column:
    def is_set(probe):
        at = _position(key, number, len(level.cells), probe)
        cell = F.substring(F.lit(level.cells), F.floor(at / CELL).cast("int") + 1, F.lit(1))
        return F.getbit(F.ascii(cell.cast("string")) - ord("0"), F.pmod(at, F.lit(CELL)).cast("int")) == 1

    return F.forall(F.sequence(F.lit(0), F.lit(level.probes - 1)), is_set)


def _level(keys: DataFrame, count: int, number: int, rate: float) -> Level:
    """A filter of ``keys`` (key) that lets about ``rate`` of other keys pass."""
    probes = max(1, min(32, round(-math.log2(rate))))
    cells = max(11, math.ceil(count * probes / math.log(2) / CELL))
    at = _position(F.col("key"), number, cells, F.col("probe"))
    places = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))).alias("probe")).select(at.alias("at"))
    bit = F.call_function("shiftleft", F.lit(1), F.pmod("at", F.lit(CELL)).cast("int"))
    some = places.select(F.floor(F.col("at") / CELL).alias("cell"), bit.alias("bits"))
    every = some.union(keys.sparkSession.range(cells).select("id", F.lit(0)))
    dense = every.groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("cell", "bits")))
    row = dense.agg(F.array_join(F.transform(ordered, lambda x: F.char(x["bits"] + ord("0"))), "").alias("cells"))
    return Level(row.first().cells.encode(), probes)


def contains(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe that the cascade was built over is listed."""
    answer = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels) - 1, -1, -1):
        answer = F.when(_passes(levels[number], number, key), answer).otherwise(F.lit(number % 2 == 1))
    return answer


def cascade(listed: DataFrame, count: int, universe, size: int) -> list[Level]:
    """Levels for ``listed`` (key, staged, ``count`` rows). ``universe(passes)`` gives
    the distinct keys of the universe that ``passes`` lets through, listed or not;
    ``size`` is about how many there are at most."""
    levels = [_level(listed, count, 0, min(0.5, count / max(1, size)))]
    passing = universe(lambda key: _passes(levels[0], 0, key)).select("key", F.lit(0).alias("own"))
    both = passing.union(listed.select("key", F.lit(1)))
    wrong = stage(both.groupBy("key").agg(F.max("own").alias("own")).where("own = 0").select("key"), "url-wrong")
    held = listed
    while left := wrong.count():
        number = len(levels)
        if number == _LEVELS:
            raise RuntimeError("keys don't settle")
        levels.append(_level(wrong, left, number, 0.5))
        held, wrong = wrong, stage(held.where(_passes(levels[-1], number, F.col("key"))), "url-wrong")
    return levels


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keys: tuple[str, ...] = ("page_id",), most_bits: int = MOST_BITS) -> DataFrame:
    """``keys`` of every row of ``pages``, then host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and
    all subdomains where the path starts with the rule's; the longest that fits is
    named by ``rule`` and settles the verdict. Where none fits, rule is null and the
    verdict is allow, as nothing of the url is listed. A url that is null or has no
    ``://`` has an empty host and path. Repeated rows stay; other columns of
    ``pages`` don't matter, whatever their names. Without rules all is allowed.
    """
    spark = pages.sparkSession
    out = pages.select(*keys, url_host(url).alias("host"), url_path(url).alias("path"), F.lit(None).cast("struct<length:int,host_length:int,key:string,blocks:boolean>").alias("rule"))
    listed = stage(listed_keys(rules), "url-rules")
    count = listed.count()
    # Per listed key about 1.5 bits for each halving of the rate, and as many again.
    size = pages.count() * listed.select("labels", "size").distinct().count()
    parts = math.ceil(count * (1.5 * max(1.0, math.log2(max(1, size) / max(1, count))) + 5) / most_bits)
    for part in range(parts):
        mine = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts)) == part  # noqa: B023, E731
        own = stage(listed.where(mine(F.col("key"))), "url-part")
        n = own.count()
        if not n:
            continue
        kinds = json.dumps([r.asDict() for r in own.select("labels", "size").distinct().collect()])
        shapes = F.from_json(F.lit(kinds), "array<struct<labels:int,size:int>>")
        found = url_keys(url_host(url), url_path(url), shapes)
        found = F.filter(found, lambda k: mine(k["key"]))  # noqa: B023

        def universe(passes, found=found):
            return pages.select(F.explode(F.filter(found, lambda k: passes(k["key"]))).alias("k")).select("k.key").distinct()

        is_listed = cascade(own.select("key"), n, universe, size)
        blocking = own.where("blocks").select("key")
        blocked = blocking.count()
        blocks = cascade(blocking, blocked, lambda passes, own=own: own.select("key").where(passes(F.col("key"))), n) if blocked else []
        hits = F.filter(url_keys(F.col("host"), F.col("path"), shapes), lambda k: mine(k["key"]) & contains(is_listed, k["key"]))  # noqa: B023
        # One at a time, so that each is worked out once.
        out = out.withColumn("_best", F.array_max(hits))
        best = F.struct("_best.length", "_best.host_length", "_best.key", contains(blocks, F.col("_best.key")).alias("blocks"))
        out = out.withColumn("rule", F.greatest("rule", F.when(F.col("_best").isNotNull(), best))).drop("_best")
        if parts > 1:
            out = stage(out, "url-judged")
    verdict = F.when(F.col("rule.blocks"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*keys, "host", "path", F.col("rule.key").alias("rule"), verdict.alias("verdict"))
