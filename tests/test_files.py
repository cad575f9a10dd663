import hashlib
import os
from decimal import Decimal

import pytest

from tallyframe.adapters import get_family
from tallyframe.operators import canonical, mapping
from tallyframe.operators.store import Store
from tallyframe.plans.bordereau import outcomes_of, run_files
from tallyframe.sources import grid, render
from tallyframe.streaming.arrivals import ingest_arrivals

FAMILY, SENDER = get_family("insurance"), canonical.Profile("s", "GBP")
GOOD = "Policy Reference,Period,Gross Premium\nPOL-1-00001,2026-01,100.00\nPOL-1-00002,2026-01,not-a-number\nPOL-1-00003,TBC,5.00\n,,\nPOL-1-00004,2026-01,\n"


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(text.encode("utf-8-sig"))
    return path


def test_grid_and_quarantine(spark, tmp_path):
    path = write(tmp_path, "a.csv", GOOD)
    rows = grid.read_rows(spark, path)
    assert [(r.spreadsheet_row, r.cells[0]) for r in rows.orderBy("row_index").collect()] == [(2, "POL-1-00001"), (3, "POL-1-00002"), (4, "POL-1-00003"), (6, "POL-1-00004")]
    assert rows.first().content_hash == hashlib.sha256(open(path, "rb").read()).hexdigest()
    tagged = canonical.canonicalise(rows, {"Policy Reference": "policy_reference", "Period": "period", "Gross Premium": "gross_premium"}, FAMILY, SENDER)
    assert [r.key for r in canonical.accepted(tagged).collect()] == ["POL-1-00001|2026-01"]
    assert canonical.quarantined(tagged).count() == 3
    assert canonical.lineage_rows(canonical.accepted(tagged)).where(~canonical.is_complete()).count() == 0


def test_semicolons_and_short_records():
    assert list(grid.csv_records("a;b;c\n1;2\n;;\n".encode())) == [(1, ["a", "b", "c"]), (2, ["1", "2"])]


def test_mapping_by_shape_and_abstention(spark, tmp_path):
    lines = [f"POL-1-{i:05d},2026-01,{1000 + i}.50,{100 + i}.25,{10 + i % 7}.10" for i in range(40)]
    rows = grid.read_rows(spark, write(tmp_path, "b.csv", "Col A,Col B,Col C,Col D,Col E\n" + "\n".join(lines)))
    outcome = outcomes_of(rows, FAMILY).first()
    assert outcome.mappable and outcome.columns["Col A"] == "policy_reference" and outcome.columns["Col B"] == "period" and outcome.columns["Col C"] == "gross_premium"
    quarters = spark.createDataFrame([("f", "Q1"), ("f", "Q2")], "content_hash string, header string")
    nothing = spark.createDataFrame([], "content_hash string, header string, monetary double, temporal double, samples array<string>, categorical boolean, near_constant boolean, magnitude_rank int")
    assert [r.mappable for r in mapping.propose(quarters, nothing, FAMILY).collect()] == [False]


def test_the_first_of_equal_headers_counts(spark, tmp_path):
    rows = grid.read_rows(spark, write(tmp_path, "e.csv", "Amt,Amt\n1.00,x\n2.00,y\n"))
    assert [(r.header, r.raw) for r in grid.to_cells(rows).orderBy("row_index").collect()] == [("Amt", "1.00"), ("Amt", "2.00")]
    assert rows.first().sheet == "e"


def test_an_absent_sheet_is_an_error(spark):
    rows = spark.createDataFrame([("h", "One", ["a"], 0, ["1"])], "content_hash string, sheet string, headers array<string>, row_index long, cells array<string>")
    book = render.xlsx_files(rows)
    assert [r.cells for r in grid.rows_of(book, "One").collect()] == [["1"]]
    with pytest.raises(Exception, match="no sheet is named"):
        grid.rows_of(book, "Two").collect()


def test_store_round_trip_reset_and_unreadable_tables(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert store.round_trip(Decimal("12345678901234.5678"))
    store.audit("x", "me", "y")
    store.reset()
    assert store.counts()["audit_event"] == 0
    os.makedirs(f"{tmp_path}/t/ingested_file")
    with open(f"{tmp_path}/t/ingested_file/part.parquet", "wb") as f:
        f.write(b"not a table")
    with pytest.raises(Exception):  # not taken for an empty table
        Store(spark, f"{tmp_path}/t").table("ingested_file").count()


def test_ingest_once_repeats_held_and_stream(spark, tmp_path):
    arrivals, root = tmp_path / "in", str(tmp_path / "store")
    arrivals.mkdir()
    text = "Policy Reference,Period,Gross Premium\n" + "\n".join(f"POL-1-{i:05d},2026-01,{i + 1}.00" for i in [*range(30), 3])
    write(arrivals, "x.csv", text)
    write(arrivals, "y.csv", text)
    store = Store(spark, root)
    for _ in range(2):
        ingest_arrivals(spark, str(arrivals), str(tmp_path / "checkpoint"), store, FAMILY, SENDER).awaitTermination()
    counts = store.counts()
    assert (counts["ingested_file"], counts["ledger_row"], counts["quarantine"], counts["audit_event"]) == (1, 29, 2, 2)
    assert store.confirm("s", 1, "insurance", {"a": "tax"}, "me") and not store.confirm("s", 1, "insurance", {"a": "tax"}, "me")


def test_one_file_end_to_end(spark, tmp_path):
    path = write(tmp_path, "c.csv", GOOD)
    ledger = spark.sql("SELECT 'POL-1-00001|2026-01' AS key, 'GBP' AS currency, CAST(100 AS DECIMAL(18,4)) AS gross, CAST(map() AS map<string,decimal(18,4)>) AS deductions, CAST(NULL AS DECIMAL(18,4)) AS net, 1L AS spreadsheet_row")
    run = run_files(spark, path, FAMILY, SENDER, ledger)
    assert [(r.key, r.status) for r in run.results.collect()] == [("POL-1-00001|2026-01", "matched")]
