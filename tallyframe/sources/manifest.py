"""A corpus of statement files with an answer key: one manifest, and a truth document for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.money import MONEY

#: The fields of a canonical row that truth documents state.
CANONICAL = ("key", "currency", "period", "gross", "deductions", "net", "attributes")
_MANIFEST = "variants array<struct<variant_id:string,truth:string>>, holdout array<string>, unmappable array<string>"
_ROW = "struct<key:string,currency:string,period:string,gross:string,deductions:map<string,string>,net:string,attributes:map<string,string>>"
_TRUTH = (
    "variant_id string, family string, source_file string, sheet_name string, currency string, period string, decimal_convention string, date_format string, column_mapping map<string,string>, unmapped_headers array<string>, "
    f"declared_total struct<declared_gross:string,rows_sum_gross:string,agrees_with_rows:boolean,omitted_key:string>, adversarial_cases array<struct<case:string>>, rows array<{_ROW}>"
)


def _truths(spark: SparkSession, folder: str) -> DataFrame:
    reader = spark.read.schema(_TRUTH).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.truth.json")
    return reader.json(folder)


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file of the manifest that has a truth document: position (in the manifest), variant_id, held_out, unmappable,
    source (its path), and what the document states, without its rows. Documents are read side by side, one in one task."""
    manifest = spark.read.schema(_MANIFEST).option("multiLine", True).json(f"{folder.rstrip('/')}/manifest.json")
    listed = manifest.select("holdout", "unmappable", F.posexplode("variants").alias("position", "v")).select("position", F.col("v.variant_id").alias("variant_id"), F.array_contains("holdout", F.col("v.variant_id")).alias("held_out"), F.array_contains("unmappable", F.col("v.variant_id")).alias("unmappable"))
    stated = _truths(spark, folder).withColumn("source", F.concat(F.lit(f"{folder.rstrip('/')}/"), "source_file")).withColumn("adversarial_cases", F.transform("adversarial_cases", lambda c: c["case"]))
    return listed.join(stated.drop("rows", "source_file"), "variant_id")


def read_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Every true row: variant_id, row_index and the canonical fields, amounts exact; a text that is no amount is an error."""
    rows = _truths(spark, folder).select("variant_id", F.posexplode("rows").alias("row_index", "r")).select("variant_id", F.col("row_index").cast("long").alias("row_index"), "r.*")
    return rows.withColumns({"gross": F.col("gross").cast(MONEY), "net": F.col("net").cast(MONEY), "deductions": F.transform_values("deductions", lambda k, v: v.cast(MONEY))})


def require_canonical(rows: DataFrame) -> DataFrame:
    """rows, or an error that names the canonical fields they lack; more fields are no error."""
    missing = sorted(set(CANONICAL) - set(rows.columns))
    if missing:
        raise ValueError(f"these canonical fields are missing: {missing}")
    return rows
