"""Incremental corpus building: the batch job, run on newly landed files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gistmill.session import stage
from gistmill.sources.sinks import append_new

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Keeps keys in files beside the executors' memory, so they may outgrow it.
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    transform: Callable[[DataFrame], DataFrame],
    table: str,
    checkpoint: str,
    format: str = "parquet",
) -> StreamingQuery:
    """Run ``transform`` on files that arrived since the last run and append
    the rows that are new. Conversations must land whole.

    A batch that is repeated after a failure adds nothing twice, because rows
    already in the table are left out.
    """
    stream = spark.readStream.schema(schema).format(format).load(landing)

    def write(batch: DataFrame, _: int) -> None:
        append_new(transform(batch), table)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_keyed(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    key: Sequence[str],
    transform: Callable[[DataFrame], DataFrame],
    table: str,
    checkpoint: str,
    format: str = "parquet",
) -> StreamingQuery:
    """Run ``transform`` on landed rows whose ``key`` has not landed before, and add
    the result to ``table``, without reading what the table holds.

    The keys seen so far are the stream's state, kept by hash of the key in the
    checkpoint: a batch touches the state of its own rows only, so its cost does not
    grow with the history. Of rows that share a key the first to land stays, and of
    those that land together any one. A conversation must have landed whole when the
    query runs, and what ``transform`` does must concern one conversation at a time.

    Each batch has its own folder ``batch=n`` of the table, replaced where a batch is
    repeated after a failure, so nothing is added twice or lost. ``checkpoint`` and
    ``table`` must be used together and by one query at a time.
    """
    stream = spark.readStream.schema(schema).format(format).load(landing)

    def write(batch: DataFrame, number: int) -> None:
        # Written first: each action on the batch itself would go through the state.
        transform(stage(batch, "landed")).write.mode("overwrite").parquet(f"{table}/batch={number}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ON_DISK)
    try:
        # The query keeps the settings that it was started with.
        return (
            stream.dropDuplicates(list(key)).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def read_ingested(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The rows of a table of ``ingest_keyed``."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(table)
