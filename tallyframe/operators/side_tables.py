"""The sides of a reconciliation as tables bucketed and sorted by key: repeated runs join them without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyframe.functions.money import EXACT, Tolerance, forbid_floats
from tallyframe.operators.reconcile import decide, meet, one_per_key


def save_side(side: DataFrame, table: str, path: str, buckets: int, ordinal: str = "spreadsheet_row") -> None:
    """Write a side (see reconcile()), reduced to one row for each key, as a table of the catalog at a path on shared storage: a
    file for each bucket of the key's hash, sorted by key. Rows of a frequent key are reduced before they are dealt out."""
    forbid_floats(side, ["gross", "net"])
    reduced = one_per_key(side, ordinal).repartition(buckets, "key")
    reduced.write.bucketBy(buckets, "key").sortBy("key").mode("overwrite").option("path", path).saveAsTable(table)


def reconcile_tables(statement: DataFrame, ledger: DataFrame, tolerance: Tolerance = EXACT) -> DataFrame:
    """reconcile() of two saved sides: with equally many buckets each pair of buckets is joined where it is read."""
    return decide(meet(statement, ledger), tolerance)
