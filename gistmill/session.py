"""Session helpers: making the package importable on executors, and staging."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1000
_shipped: set[str] = set()
_own_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="gistmill-")) / "gistmill.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before heavy work per row.

    Only for inputs that fill fewer scan splits than there are cores; larger
    ones are left as they are, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def staging_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir`` of the session,
    or the checkpoint directory of its context. Where neither is set, a folder of
    our own, but only with a local master: executors elsewhere would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="gistmill-stage-")
    return _own_folders[application]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back.

    The result has no lineage to recompute, so values that depend on how rows
    were spread over tasks stay the same for every later reader, also when
    executors are lost.
    """
    spark = df.sparkSession
    path = os.path.join(staging_dir(spark), "gistmill", f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, label: str) -> DataFrame:
    """The smaller side of a join, staged and counted: marked for broadcast up
    to ``BROADCAST_ROWS`` rows of ``BROADCAST_BYTES`` in its files together, and
    beyond that left to a shuffle join."""
    staged = stage(df, label)
    size = int(str(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(staged) if size <= BROADCAST_BYTES and staged.count() <= BROADCAST_ROWS else staged


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], times: str) -> DataFrame:
    """Inner join on keys that are unique in ``right``, whose column ``times`` says
    how many rows of ``left`` have them. Both are read twice, so they should be staged.

    Keys of over a thousandth of all those rows, hence at most a thousand, are
    joined by broadcast and their rows stay where they are; the rest is shuffled.
    """
    keys = list(keys)
    limit = max(HOT_KEYS, (right.agg(F.sum(times)).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(right.where(F.col(times) > limit))
    cold = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(times) <= limit), keys)
    return left.join(hot, keys).unionByName(cold)
