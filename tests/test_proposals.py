import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyframe.adapters import get_family
from tallyframe.fixtures import corpus
from tallyframe.fixtures.layouts import LAYOUTS
from tallyframe.operators import mapping, proposals
from tallyframe.sources import grid, render


def test_digests_are_those_of_json(spark):
    headers = ['B "quoted"', "a\\b", "É, x", "A"]
    got = spark.createDataFrame([(headers,)], "h array<string>").select(proposals.column_digest(F.col("h"))).first()[0]
    assert got == hashlib.sha256(json.dumps(sorted(headers), ensure_ascii=False).encode()).hexdigest()[:16]


def test_flags_are_never_guessed(spark):
    df = spark.createDataFrame([(" Yes",), ("OFF",), (None,)], "x string")
    assert [r[0] for r in df.select(proposals.strict_flag(F.col("x"))).collect()] == [True, False, None]
    with pytest.raises(Exception, match="neither true nor false"):
        spark.createDataFrame([("flase",)], "x string").select(proposals.strict_flag(F.col("x"))).collect()


def test_unknown_fields(spark):
    df = spark.createDataFrame([("f", {"a": "tax", "b": "nonsense"})], "content_hash string, columns map<string,string>")
    assert [r.field for r in proposals.unknown_fields(df, get_family("insurance")).collect()] == ["nonsense"]


def test_claims_are_kept_in_order(spark):
    headers = spark.createDataFrame([("f", "A"), ("f", "B"), ("g", "A")], "content_hash string, header string")
    asked = spark.createDataFrame([("f", 1, "B", "tax"), ("f", 0, "A", "tax"), ("g", 0, "B", "tax"), ("g", 1, "A", None)], "content_hash string, position int, header string, field string")
    got = {(r.content_hash, r.header, r.field): r.verdict for r in mapping.contain(asked, headers, get_family("insurance")).collect()}
    assert got == {("f", "A", "tax"): "kept", ("f", "B", "tax"): "field already claimed", ("g", "B", "tax"): "unknown header", ("g", "A", None): "unknown field"}


def test_rendered_files_are_the_same_bytes_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("h", "One", ["a", "b"], 1, ['say "x"', "1,5\n2"]), ("h", "One", ["a", "b"], 0, ["<&>", " é"])], "content_hash string, sheet string, headers array<string>, row_index long, cells array<string>")
    for make in (render.csv_files, render.xlsx_files):
        first, second = ({r.path: bytes(r.content) for r in make(rows.repartition(n)).collect()} for n in (1, 3))
        assert first == second
        back = grid.rows_of(make(rows)).orderBy("row_index").collect()
        assert [r.cells for r in back] == [["<&>", "é"], ['say "x"', "1,5\n2"]] and back[0].sheet == "One"
    assert render.save(render.csv_files(rows, bom=True), str(tmp_path)) == 1
    assert (tmp_path / "One.csv").read_bytes().startswith("﻿a,b\n".encode())
    assert grid.read_rows(spark, str(tmp_path / "One.csv")).count() == 2


def test_the_truth_has_as_many_rows_as_its_layouts(spark):
    rows = corpus.truth(spark)
    assert rows.count() == 2333 and rows.where("gross - coalesce(tax, 0) - coalesce(commission, 0) - coalesce(fee, 0) <> net").count() == 0
    assert sum(x.held_out for x in LAYOUTS) == 6
