"""The lists that people look at; each has a total order and, where it is a screen, a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_files(files: DataFrame, limit: int = 25) -> DataFrame:
    return files.orderBy(F.col("ingested_at").desc(), "content_hash").limit(limit)


def rows_of_file(ledger: DataFrame, content_hash: str, limit: int = 500) -> DataFrame:
    return ledger.where(F.col("source_content_hash") == content_hash).orderBy("key", "mapping_version").limit(limit)


def quarantine_of_file(quarantine: DataFrame, content_hash: str) -> DataFrame:
    return quarantine.where(F.col("source_content_hash") == content_hash).orderBy("spreadsheet_row", "reason")


def quarantine_queue(quarantine: DataFrame, files: DataFrame, limit: int = 500) -> DataFrame:
    """Unresolved rows with their file's sender and name."""
    open_ = quarantine.where(F.col("resolved_at").isNull())
    named = files.select(F.col("content_hash").alias("source_content_hash"), "sender", "filename")
    return open_.join(named, "source_content_hash").orderBy("source_content_hash", "spreadsheet_row", "reason").limit(limit)


def by_key(results: DataFrame) -> DataFrame:
    """Results in the order of their keys' bytes."""
    return results.orderBy("key")


def contracts(mapping_contract: DataFrame) -> DataFrame:
    return mapping_contract.orderBy("sender", F.col("version").desc())


def row_with_source(ledger: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return ledger.where(F.col("key") == key).join(files.withColumnRenamed("content_hash", "source_content_hash").select("source_content_hash", "sender", "filename"), "source_content_hash", "left")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in sorted(tables.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out
