"""Profiles of files need one shuffle of the files' rows, and cells are those of the first column of a header."""

from pyspark.sql import functions as F

from tallyframe.operators import profile
from tallyframe.plans import statements
from tallyframe.sources import grid

ROWS = "content_hash string, sheet string, headers array<string>, row_index long, spreadsheet_row long, cells array<string>"


def test_rows_are_shuffled_once_from_file_to_profile(spark):
    found = profile.profile_columns(grid.to_cells(statements.file_rows(spark, "/root/testdata/sf0.001", together=True)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(content_hash") == plan.count("Exchange ") == 1


def test_cells_of_short_long_and_missing_records(spark):
    rows = spark.createDataFrame([("f", "s", ["a", "b", "a", None], i, i + 2, cells) for i, cells in enumerate((["1", "2", "3", "4", "5"], ["6"], [], None, [None, "7"]))], ROWS)
    got = sorted((r.row_index, r.col_index, r.header, r.raw) for r in grid.to_cells(rows).collect())
    assert got == [(0, 0, "a", "1"), (0, 1, "b", "2"), (1, 0, "a", "6"), (1, 1, "b", ""), (2, 0, "a", ""), (2, 1, "b", ""), (4, 0, "a", ""), (4, 1, "b", "7")]
    assert grid.to_cells(rows.withColumn("headers", F.lit(None).cast("array<string>"))).count() == 0


def test_heads_of_columns_with_blank_cells(spark):
    cells = spark.createDataFrame([("f", "x", i, "\u00a0 " if i % 2 else f"\u00a0{i}.00 GBP" if i < 400 else "late") for i in range(900)], "content_hash string, header string, row_index long, raw string")
    (r,) = profile.profile_columns(cells).collect()
    assert (r.non_empty, r.monetary, r.distinct, r.magnitude, r.magnitude_rank, r.samples[1]) == (200, 1.0, 200, 200, 0, "\u00a02.00 GBP") and len(r.samples) == 20
