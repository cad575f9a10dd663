"""The registered profiles and mappings cover every file and every column with a value."""

from tallyframe.plans import queries, statements

FOLDER = "/root/testdata/sf0.001"


def test_every_column_of_every_file_is_profiled_and_every_file_mapped(spark):
    files = {r["content_hash"] for r in statements.file_rows(spark, FOLDER).select("content_hash").distinct().collect()}
    assert len(files) > 1
    rows = queries.QUERIES["profile_columns"](spark, FOLDER).collect()
    assert {(r["content_hash"], r["header"]) for r in rows} == {(f, h) for f in files for h in statements.HEADERS if h != "Note"}  # notes are blank
    assert {r["content_hash"] for r in queries.mapping_system(spark, FOLDER).collect()} == files
