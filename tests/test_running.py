import random

import pytest

from gistmill.operators import running


def expected(rows):
    """(key, pos, text, add) -> running numbers, by a loop."""
    out, state = {}, {}
    for key, pos, text, add in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        n, total, last = state.get(key, (0, 0, object()))
        repeated = text == last
        if not repeated:
            n, total = n + 1, total + add
        state[key] = (n, total, text)
        out[(key, pos)] = (repeated, n, total)
    return out


@pytest.mark.parametrize("largest", [None, 10_000])
@pytest.mark.parametrize("seed", range(4))
def test_matches_loop(spark, seed, largest):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", "c", None]
    rows = [(rng.choice(keys), i, rng.choice(["x", "x", "y", None]), rng.randint(0, 9)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, pos int, text string, add int").repartition(3)
    got = running.running_totals(df, ["key"], ["pos"], {"n": 1, "total": "add"}, compare="text", largest=largest)
    assert {(r.key, r.pos): (r.repeated, r.n, r.total) for r in got.collect()} == expected(rows)


def test_one_key_over_many_partitions(spark):
    """A single value repeated across every partition counts once."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).selectExpr("'k' AS key", "id AS pos", "'same' AS text")
        got = running.running_totals(df, ["key"], ["pos"], {"n": 1}, compare="text").collect()
        assert {r.n for r in got} == {1} and sum(not r.repeated for r in got) == 1
        numbered = running.number_rows(df, [], [df.pos.desc()]).collect()
        assert sorted((r.n, r.pos) for r in numbered) == [(i + 1, 999 - i) for i in range(1000)]
        from pyspark.sql import functions as F

        staged = df.repartitionByRange("key", "pos").select(F.spark_partition_id().alias("p")).distinct().count()
        assert staged > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    df = spark.createDataFrame([], "key string, pos int")
    assert running.number_rows(df, ["key"], ["pos"]).collect() == []


def test_small_batches(spark):
    """Totals carry over Arrow batches of one partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("a" if i < 40 else "b", i, str(i // 3), 1) for i in range(100)]
        df = spark.createDataFrame(rows, "key string, pos int, text string, add int")
        got = running.running_totals(df, ["key"], ["pos"], {"n": 1, "total": "add"}, compare="text")
        assert {(r.key, r.pos): (r.repeated, r.n, r.total) for r in got.collect()} == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
