"""Mixing sources to target weights, by exact quotas of permuted blocks.

The documents of a source are permuted by a hash of their ids and cut into blocks
of that order. A source's quota is the number of block draws that reach its
target: whole passes over the source, then the first blocks of one more pass, of
which the last is cut to the word. A binary tree splits the quotas among output
shards: at each node the left half's draws of each source are hypergeometric given
what is left (together multivariate hypergeometric), so shards have equal numbers
of draws and every quota is met exactly. A shard gets disjoint runs of the
permuted draws, and is shuffled on its own.

Only DataFrame functions; tables of quotas have at most 4096 rows per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.session import stage

WEIGHTS = (5, 2, 1)
#: Words of a shard that one task writes.
TASK_WORDS = 4_000_000
SPACES = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def _key(seed: int, *columns: Column) -> Column:
    return F.md5(F.concat_ws(":", *columns, F.lit(str(seed))).cast("binary"))


def source_targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Sources in code point order, null last, have the given weights, repeating.
    Targets are in proportion to weights, except that none is above ``cap`` times
    the source's size; together they are ``share`` times all sizes. One row per
    source is sorted in one task, so sources must be far fewer than documents.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sums.withColumn("weight", weight).withColumn("_limit", cap * F.col("source_size"))
    # Sources in order of the level at which they are full: a row's level is the
    # one that the rest would have if all before it were full.
    order = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("_left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", F.col("_left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.struct(F.col("_limit") / F.col("weight"), "_level"))).over(every)["_level"]
    target = F.least("_limit", F.coalesce(level * F.col("weight"), F.col("_limit")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(x < 1, F.lit(0.0)).otherwise(series)


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """A hypergeometric number by inversion at ``u``: the good ones among ``draws``
    of ``total`` things of which ``good`` are good."""
    low = F.greatest(F.lit(0).cast("long"), draws - (total - good))
    high = F.least(draws, good)
    bad = total - good
    first = (
        (_log_factorial(good) - _log_factorial(low) - _log_factorial(good - low))
        + (_log_factorial(bad) - _log_factorial(draws - low) - _log_factorial(bad - draws + low))
        - (_log_factorial(total) - _log_factorial(draws) - _log_factorial(total - draws))
    )
    start = F.struct(low.alias("x"), first.alias("log"), F.exp(first).alias("sum"))

    def step(at, x):
        ratio = (good - x + 1) * (draws - x + 1) / (x * (bad - draws + x))
        log = at["log"] + F.log(ratio)
        done = at["sum"] >= u
        return F.struct(F.when(done, at["x"]).otherwise(x).alias("x"), F.when(done, at["log"]).otherwise(log).alias("log"), F.when(done, at["sum"]).otherwise(at["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step)["x"]


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(source, shard, quota) for 2 ** levels shards, from (source, quota).

    The sources of a tree node are one row, so they must fit in a task.
    """
    order = F.struct(F.col("source").isNull().alias("last"), "source", "quota")
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(order)).alias("parts")).select(F.lit(1).cast("long").alias("node"), "parts")
    for _ in range(levels):
        total = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["quota"])
        nodes = nodes.withColumn("_total", total).withColumn("_half", (F.col("_total") / 2).cast("long"))
        empty = F.array().cast("array<bigint>")
        start = F.struct(F.col("_total").alias("total"), F.col("_half").alias("draws"), empty.alias("left"))

        def step(at, part):
            u = F.conv(F.substring(_key(seed, F.col("node").cast("string"), F.size(at["left"]).cast("string")), 1, 12), 16, 10).cast("double") / float(16**12)
            x = _hypergeometric(at["total"], part["quota"], at["draws"], u)
            return F.struct((at["total"] - part["quota"]).alias("total"), (at["draws"] - x).alias("draws"), F.concat(at["left"], F.array(x)).alias("left"))

        nodes = nodes.withColumn("_left", F.aggregate("parts", start, step)["left"])
        left = F.zip_with("parts", "_left", lambda p, x: F.struct(p["last"].alias("last"), p["source"].alias("source"), x.alias("quota")))
        right = F.zip_with("parts", "_left", lambda p, x: F.struct(p["last"].alias("last"), p["source"].alias("source"), (p["quota"] - x).alias("quota")))
        nodes = nodes.select(F.col("node") * 2, F.explode(F.array(F.struct(F.lit(0).alias("side"), left.alias("parts")), F.struct(F.lit(1).alias("side"), right.alias("parts")))).alias("c"))
        nodes = nodes.toDF("node", "c").select((F.col("node") + F.col("c.side")).alias("node"), "c.parts")
    return nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.explode("parts").alias("p")).select("p.source", "shard", "p.quota")


def mix_sources(docs: DataFrame, share: float = 1.5, cap: float = 2.0, levels: int = 4, seed: int = 7, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, source, size,
    source_size, target, taken, draws, an array of (pass, shard, words), and the
    columns to ``keep``, which settle further ties.

    ``size`` counts words, 0 for a null or empty text. Every source takes exactly
    its rounded target: whole passes, then documents in the order of a hash of
    doc_id (ties by doc_id, then size), the last one in part; so no document is
    taken more than ``cap`` times. A null source is a source; a null doc_id sorts
    first among equal hashes. Sources or tables without words take nothing.
    Rows that repeat are documents of their own. Other columns don't matter.
    """
    block = F.substring(_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 32)
    sized = stage(docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"), block.alias("place")).withColumn("block", F.substring("place", 1, 3)), "mix-sizes")
    targets = stage(source_targets(sized, share, cap), "mix-targets")
    words = sized.groupBy("source", "block").agg(F.sum("size").alias("words")).where("words > 0").alias("b")
    blocks = words.join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    blocks = blocks.select("b.source", "b.block", "b.words", "t.source_size", F.floor(F.col("t.target") + 0.5).cast("long").alias("goal"))
    order = Window.partitionBy("source").orderBy("block")
    blocks = blocks.withColumn("start", F.sum("words").over(order) - F.col("words"))
    blocks = blocks.withColumn("passes", F.expr("goal div source_size")).withColumn("rest", F.col("goal") % F.col("source_size"))
    part = F.greatest(F.lit(0).cast("long"), F.least("words", F.col("rest") - F.col("start")))
    blocks = blocks.select("source", "block", "words", "passes", part.alias("part"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda p: F.struct(p.alias("pass"), F.when(p < F.col("passes"), F.col("words")).otherwise(F.col("part")).alias("words")))
    draws = blocks.select("source", "block", F.explode(every).alias("d")).where("d.words > 0").select("source", "block", F.col("d.pass").alias("pass"))
    draws = draws.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("pass", "block")))
    quotas = stage(split_quotas(draws.groupBy("source").agg(F.count("*").alias("quota")), levels, seed), "mix-quotas")
    upto = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    runs = quotas.withColumn("upto", upto).withColumn("after", F.col("upto") - F.col("quota")).alias("r")
    d = draws.alias("d")
    placed = d.join(runs, F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.turn") > F.col("r.after")) & (F.col("d.turn") <= F.col("r.upto")))
    placed = placed.groupBy("d.source", "d.block").agg(F.sort_array(F.collect_list(F.struct("d.pass", "r.shard"))).alias("places"))
    p, b = placed.alias("p"), blocks.alias("b")
    plan = b.join(p, F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.block") == F.col("p.block")), "left")
    plan = stage(plan.select("b.source", "b.block", "b.words", "b.passes", "b.part", "p.places"), "mix-plan").alias("p")
    s, t = sized.alias("s"), targets.alias("t")
    rows = s.join(plan, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.block") == F.col("p.block")), "left")
    rows = rows.join(t, F.col("s.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("s.doc_id", "s.source", *(f"s.{c}" for c in keep), "s.size", "s.place", "t.source_size", "t.target", "p.words", "p.passes", "p.part", "p.places")
    # Only in the block that is cut do documents need an order.
    whole = F.coalesce((F.col("part") == 0) | (F.col("part") == F.col("words")), F.lit(True))
    inside = Window.partitionBy("source").orderBy("place", F.col("doc_id").asc_nulls_first(), "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.where(~whole).withColumn("last", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("part") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    full = rows.where(whole).withColumn("last", F.when(F.col("part") > 0, F.col("size")).otherwise(0).cast("long"))
    both = full.unionByName(cut)
    amount = lambda p: F.when(p["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("last"))
    drawn = F.filter(F.transform("places", lambda p: F.struct(p["pass"].alias("pass"), p["shard"].alias("shard"), amount(p).alias("words"))), lambda p: p["words"] > 0)
    none = F.array().cast("array<struct<pass:bigint,shard:int,words:bigint>>")
    both = both.withColumn("draws", F.coalesce(drawn, none))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    return both.select("doc_id", "source", *keep, "size", "source_size", "target", taken.alias("taken"), "draws")


def mixed_documents(docs: DataFrame, share: float = 1.5, cap: float = 2.0, levels: int = 4, seed: int = 7) -> DataFrame:
    """The documents of the mix: a row of ``docs`` for each time it is drawn, with
    ``shard``, ``pass`` and ``words``. A document that is drawn in part has its
    first words, joined by one blank (and their length as ``n_chars``, if there is
    such a column). A shard is as many tasks as its words need, each sorted by a
    hash, which shuffles it.

    Rows without doc_id, and rows that share one, are documents of their own. Equal
    rows are drawn as often as all of them together. Columns of ``docs`` named like
    the added ones are replaced; other names don't matter. Columns that hold maps
    don't tell rows apart.
    """
    docs = docs.drop("shard", "pass", "words")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    known = docs.select(F.xxhash64(*hashed).alias("row"), "doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    draws = stage(mix_sources(known, share, cap, levels, seed, ["row"]).select("row", "size", F.explode("draws").alias("drawn")), "mix-draws")
    parts = max(1, -(-(draws.agg(F.sum("drawn.words")).first()[0] or 0) // (TASK_WORDS << levels)))
    # Equal rows are interchangeable: one of them meets the draws of all.
    rows = known.select("row", "doc").dropDuplicates(["row"]).join(draws, "row")
    cut = F.col("drawn.words") < F.col("size")
    text = F.col("doc.text")
    own = F.array_join(F.slice(F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+"), 1, F.greatest(F.lit(1), F.col("drawn.words").cast("int"))), " ")
    text = F.when(cut, own).otherwise(text)
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    rows = rows.select(*(c.alias(n) for n, c in columns.items()), F.col("drawn.shard").alias("shard"), F.col("drawn.pass").alias("pass"), F.col("drawn.words").alias("words"))
    local = _key(seed + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("pass").cast("string"))
    part = F.pmod(F.xxhash64("doc_id", "pass"), F.lit(parts))
    return rows.repartition(parts << levels, "shard", part).sortWithinPartitions("shard", local)
