"""Benchmark decontamination by SimHash of item-sized windows.

A window is as many words of a document as an item has. It leaks the item if
their weighted 5-word shingles are similar enough. Such a window shares a shingle
with its item, so windows are laid where one does, with the shingle at the same
distance from the start. Windows and items of a size get 64-bit SimHashes of
their weighted shingles; those within the radius agree in one of radius + 1
blocks, so joining on blocks finds all of them. The exact similarity decides.

Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.session import small_side, stage

K = 5
RADIUS = 19
SPACES = " \t\n\x0b\f\r"


def _words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(SPACES)), r"[\x20\x09-\x0D]+")


def _shingles(words: Column) -> Column:
    """Hashes of the K-word shingles of an array of words, in order."""

    def hashes(own: Column) -> Column:
        last = F.size(own) - K
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(K)]))

    # Through an array of one, so that the words are split once and not per shingle.
    return F.get(F.transform(F.array(words), hashes), 0)


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sim, weight (the sum), from (keys, shingle, n, weight)."""
    bits = [F.sum(F.col("weight") * F.col("n") * (2 * F.shiftright("shingle", i).bitwiseAND(1) - 1)).alias(f"b{i}") for i in range(64)]
    sums = rows.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("n")).alias("weight"), *bits)
    sim = F.lit(0).cast("long")
    for i in range(64):
        sim = sim.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, sim.alias("sim"), "weight")


def _blocks(sim: Column) -> Column:
    """(number, bits) of RADIUS + 1 blocks of a fingerprint."""
    cuts = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    one = F.lit(1).cast("long")
    return F.array(*[F.struct(F.lit(i).alias("number"), F.shiftrightunsigned(sim, a).bitwiseAND(F.shiftleft(one, b - a) - 1).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def leaks(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_windows): documents (doc_id, text)
    with a window like an item (item_id, text). A window counts where a shingle of
    the item is at the item's distance from its start.

    Words are lower-cased and split at ASCII white space. A shingle weighs
    ln(1 + items / items that have it); similarity is the weight of common
    shingles, with their multiplicity, over that of all. A window at the border of
    a document is cut there. Items of fewer than five words, and null or empty
    texts, take no part; nor do rows without an id. Rows of ``docs`` that share a
    doc_id are searched on their own and reported together, with the best
    similarity and the first place of it; rows of ``items`` that share an item_id
    are searched as items of their own under that id. Other columns don't matter.
    """
    own = items.where("item_id is not null and text is not null").select("item_id", F.xxhash64("text").alias("copy"), _words(F.col("text")).alias("words")).distinct()
    own = own.select("item_id", "copy", F.size("words").alias("size"), _shingles(F.col("words")).alias("all")).where(F.size("all") > 0)
    own = own.select(F.xxhash64("item_id", "copy").alias("item"), "item_id", "size", F.posexplode("all").alias("at", "shingle"))
    own = stage(own, "leak-items")
    total = own.select("item").distinct().count()
    df = own.groupBy("shingle").agg(F.countDistinct("item").alias("df"))
    weights = small_side(df.select("shingle", F.log(1 + F.lit(float(total)) / F.col("df")).alias("weight")), "leak-weights")
    plain = F.log(F.lit(1.0 + total))
    item_parts = stage(own.groupBy("item", "size", "shingle").agg(F.count("*").alias("n")).join(weights, "shingle"), "leak-item-parts")
    places = small_side(own.groupBy("shingle").agg(F.collect_list(F.struct("item", "size", "at")).alias("places")), "leak-places")

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    rows = texts.select("doc_id", F.xxhash64("text").alias("copy"), _shingles(_words(F.col("text"))).alias("all")).where(F.size("all") > 0)
    hits = rows.select("doc_id", "copy", F.size("all").alias("many"), F.posexplode("all").alias("at", "shingle")).join(places, "shingle")
    found = hits.select("doc_id", "copy", "many", "at", F.explode("places").alias("p"))
    first = F.col("at") - F.col("p.at")
    begin = F.greatest(F.lit(0), first)
    end = F.least(F.col("many"), first + F.col("p.size") - (K - 1))
    windows = stage(found.select("doc_id", "copy", F.col("p.size").alias("size"), begin.alias("begin"), (end - begin).alias("length")).distinct(), "leak-windows")
    # The shingles of those windows; other documents are not read further.
    wanted = windows.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("size", "begin", "length")).alias("windows"))
    again = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("copy", F.xxhash64("text"))
    cut = again.join(wanted, ["doc_id", "copy"]).select("doc_id", "copy", "windows", _shingles(_words(F.col("text"))).alias("all")).dropDuplicates(["doc_id", "copy"])
    cut = cut.select("doc_id", "copy", "all", F.explode("windows").alias("w"))
    keys = ["doc_id", "copy", "size", "begin"]
    cut = cut.select("doc_id", "copy", F.col("w.size").alias("size"), F.col("w.begin").alias("begin"), F.explode(F.slice("all", F.col("w.begin") + 1, F.col("w.length"))).alias("shingle"))
    parts = cut.groupBy(*keys, "shingle").agg(F.count("*").alias("n")).join(weights, "shingle", "left").withColumn("weight", F.coalesce("weight", plain))
    parts = stage(parts, "leak-parts")

    of_items = small_side(_fingerprints(item_parts, ["item", "size"]), "leak-item-sims").select("item", "size", F.col("sim").alias("item_sim"), F.col("weight").alias("item_weight"))
    of_windows = stage(_fingerprints(parts, keys), "leak-window-sims")
    left = of_windows.select("*", F.explode(_blocks(F.col("sim"))).alias("block"))
    right = small_side(of_items.select("item", "size", "item_sim", "item_weight", F.explode(_blocks(F.col("item_sim"))).alias("block")), "leak-item-blocks")
    near = left.join(right, ["size", "block"]).where(F.bit_count(F.col("sim").bitwiseXOR(F.col("item_sim"))) <= RADIUS)
    near = near.select(*keys, "weight", "item", "item_weight").distinct()
    mine = near.withColumnRenamed("weight", "window_weight").join(parts, keys).alias("w")
    theirs = small_side(item_parts.select("item", "shingle", F.col("n").alias("m")), "leak-item-counts").alias("i")
    common = mine.join(theirs, ["item", "shingle"]).groupBy(*keys, "item", "window_weight", "item_weight").agg(F.sum(F.least("n", "m") * F.col("weight")).alias("common"))
    similarity = F.col("common") / (F.col("window_weight") + F.col("item_weight") - F.col("common"))
    names = small_side(own.select("item", "item_id").distinct(), "leak-names")
    caught = common.withColumn("similarity", F.round(similarity, 12)).where(F.col("similarity") >= least).join(names, "item")
    best = F.max(F.struct("similarity", (-F.col("begin")).alias("from")))
    out = caught.groupBy("doc_id", "item_id").agg(best.alias("best"), F.countDistinct("copy", "begin").alias("n_windows"))
    return out.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.from")).alias("start_word"), "n_windows")


def without_benchmark(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that leak no item; rows without doc_id stay."""
    return docs.join(leaks(docs, items, least).select("doc_id").distinct(), "doc_id", "left_anti")
