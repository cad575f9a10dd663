"""Reconciliation that keeps up with rows as they arrive on either side.

What reconcile() needs to know of a key is small: how many rows each side has, and the first of them. That is an aggregate, so
Spark keeps it as the state of a streaming aggregation, a few values for each key whatever the number of its rows; rows are
combined before they meet the state. Each micro-batch gives the keys that it touched with their new status. The state is kept
by Spark's RocksDB provider, on the executors' disks, so that the keys need not fit in their memory; there are as many stores
as cores, since each of them commits in each micro-batch. A commit writes what changed to the checkpoint, not the store's files.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.functions.money import EXACT, Tolerance, forbid_floats
from tallyframe.operators.reconcile import decide
from tallyframe.sources.scratch import CODEC, shuffles_freed

SHOWN = ("key", "status", "rule", "detail", "n_s", "n_l")


def statuses(statement: DataFrame, ledger: DataFrame, tolerance: Tolerance = EXACT, ordinal: str = "spreadsheet_row") -> DataFrame:
    """reconcile() of two streams (or tables), for output mode `update`: a row for each key that a micro-batch touched. Sides
    are as for reconcile(); rows may come in any order, as the ordinal says which is first. Rows with a null key match nothing."""
    both = []
    for side, rows in (("s", statement), ("l", ledger)):
        forbid_floats(rows, ["gross", "net"])
        both.append(rows.select("key", F.lit(side).alias("side"), F.col(ordinal).alias("ordinal"), F.struct("currency", "gross", "deductions", "net").alias("row")))
    of = lambda side: F.col("side") == side
    known = [F.count_if(of(x)).alias(f"n_{x}") for x in "sl"] + [F.min_by("row", F.when(of(x), F.col("ordinal"))).alias(x) for x in "sl"]
    apart = F.when(F.col("key").isNull(), F.col("side")).alias("apart")  # null keys of both sides are not one key
    return decide(both[0].unionByName(both[1]).groupBy("key", apart).agg(*known).drop("apart"), tolerance)


@contextmanager
def _stream_settings(spark: SparkSession) -> Iterator[None]:
    """What a stream takes over from its session as it starts; the session gets its own settings back."""
    parts, rocks = "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.rocksdb"
    chosen = {
        parts: str(min(int(spark.conf.get(parts)), spark.sparkContext.defaultParallelism)),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{rocks}.changelogCheckpointing.enabled": "true", f"{rocks}.compression": CODEC, f"{rocks}.blockSizeKB": "32",
        "spark.sql.streaming.minBatchesToRetain": "2",
    }
    was = {k: spark.conf.get(k, None) for k in chosen}
    try:
        for k, v in chosen.items():
            spark.conf.set(k, v)
        with shuffles_freed(spark):
            yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep(changed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's changed statuses to a folder of its own under path; a batch that is done again replaces it. Runs
    until all that is there has been taken."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*SHOWN).write.mode("overwrite").option("compression", CODEC).parquet(f"{path}/batch={number}")

    with _stream_settings(changed.sparkSession):
        return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, shown: tuple[str, ...] = SHOWN) -> DataFrame:
    """The statuses as of the last batch, without those of null keys: of each key the one that was written last. shown: the key, and
    those columns that are wanted."""
    rows = spark.read.schema("key string, status string, rule string, detail string, n_s long, n_l long, batch long").option("basePath", path).parquet(f"{path}/batch=*")
    return rows.where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct(*shown[1:]), "batch").alias("x")).select("key", "x.*")
