from types import SimpleNamespace

import pytest

from gistmill import session


def stub(folder, master="local[2]", checkpoints=None):
    conf = SimpleNamespace(get=lambda key, default: folder if folder else default)
    held = SimpleNamespace(isDefined=lambda: checkpoints is not None, get=lambda: checkpoints)
    java = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held))
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="app-1", master=master, _jsc=java))


def test_staging_dir():
    assert session.staging_dir(stub("hdfs://shared/stage")) == "hdfs://shared/stage"
    own = session.staging_dir(stub(None))
    assert own and session.staging_dir(stub(None)) == own
    assert session.staging_dir(stub(None, "yarn", "hdfs://shared/kept")) == "hdfs://shared/kept"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.staging_dir(stub(None, master))


def test_stage_keeps_rows(spark):
    df = spark.range(10).selectExpr("id", "array(struct(id AS a, 'x' AS b)) AS s")
    staged = session.stage(df, "check")
    assert sorted(staged.collect()) == sorted(df.collect())
    assert staged.schema.simpleString() == df.schema.simpleString()


def test_small_side(spark, monkeypatch):
    small = session.small_side(spark.range(5), "few")
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 3)
    large = session.small_side(spark.range(5), "many")
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
    try:
        assert session.spread(df) is df
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
