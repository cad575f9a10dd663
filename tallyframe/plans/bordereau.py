"""Files against a ledger, from bytes to statuses: any number of files of one family in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyframe.adapters import Family
from tallyframe.functions.money import EXACT, Tolerance
from tallyframe.operators import canonical, mapping, profile, reports
from tallyframe.operators.reconcile import reconcile
from tallyframe.sources import grid


@dataclass
class Run:
    outcomes: DataFrame  # mapping.assign() of each file
    tagged: DataFrame  # rows of the files that could be mapped, canonical or with a reason
    results: DataFrame
    report: DataFrame  # reports.file_report() of each mapped file


def outcomes_of(rows: DataFrame, family: Family) -> DataFrame:
    """The mapping of each file that has data rows."""
    return mapping.propose(mapping.headers_of(rows), profile.profile_columns(grid.to_cells(rows)), family)


def tag(rows: DataFrame, outcomes: DataFrame, family: Family, sender: canonical.Profile) -> DataFrame:
    """Rows of mappable files with the file's own mapping, canonicalised; a file whose required fields have no column abstains."""
    own = outcomes.where("mappable").select("content_hash", "mapping")
    return canonical.canonicalise(rows.join(own, "content_hash"), None, family, sender)


def run_files(spark: SparkSession, path: str, family: Family, sender: canonical.Profile, ledger: DataFrame, tolerance: Tolerance = EXACT, sheet: str | None = None) -> Run:
    """Read, profile, map, canonicalise and reconcile every file under path. The results have no order; views.by_key() gives them
    that of a screen."""
    rows = grid.read_rows(spark, path, sheet)
    outcomes = outcomes_of(rows, family)
    tagged = tag(rows, outcomes, family, sender)
    results = reconcile(canonical.flat(canonical.accepted(tagged)), ledger, tolerance)
    return Run(outcomes, tagged, results, reports.file_report(tagged, results, sender, family))
