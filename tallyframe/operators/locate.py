"""Where the rows of a key are: an inverted index from keys to files and records, in buckets.

Entries lie in a folder for each bucket of the key's hash, sorted by key. A search reads the folders of its keys' buckets alone,
and in them the row groups whose range of keys can hold one. A bucket that a frequent key makes large is written by several tasks.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.scratch import CODEC, shuffles_freed

#: Of an index; it is part of the folder names, so that it stays as it was when the index was begun.
BUCKETS = 256


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def append(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Add the places of rows (key, and columns that say where a row is) to an index. Rows without a key have no place in it."""
    placed = rows.where(F.col("key").isNotNull()).withColumn("bucket", _bucket(F.col("key"), buckets))
    with shuffles_freed(rows.sparkSession):
        placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "key").write.mode("append").option("compression", CODEC).partitionBy("bucket").parquet(path)


def locate(spark: SparkSession, path: str, keys: DataFrame, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """The entries of keys (a column `key`; asked twice is asked once). The buckets that keys fall in are found first, of which
    there are at most `buckets`, so that the others are not even listed as inputs; an index that was never written is empty."""
    asked = keys.select("key").where("key IS NOT NULL").distinct()
    hit = sorted(r.bucket for r in asked.select(_bucket(F.col("key"), buckets).alias("bucket")).distinct().collect())
    try:
        entries = spark.read.schema(f"{schema}, bucket int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        entries = spark.createDataFrame([], f"{schema}, bucket int")
    return entries.where(F.col("bucket").isin(hit)).join(asked, "key", "left_semi").drop("bucket")
