"""Manifests, kept documents, screens, and the entry without the corpus operators' libraries."""

import json
import subprocess
import sys
from decimal import Decimal as D

import pytest
from conftest import ROOT

from tallyframe.operators import documents, views
from tallyframe.sources import manifest


def write(folder, name, document):
    (folder / name).parent.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(document, indent=2))


def test_cases_and_truth_of_a_corpus(spark, tmp_path):
    listed = [{"variant_id": v, "truth": f"a/{v}.truth.json"} for v in ("v2", "v1", "v3")]
    write(tmp_path, "manifest.json", {"seed": 1, "variants": listed, "holdout": ["v1"], "unmappable": ["v3"]})
    row = {"key": "R1|2026-01", "currency": "GBP", "period": "2026-01", "gross": "10.10", "deductions": {"tax": "0.10"}, "net": None, "attributes": {"peril": "fire"}}
    for v in ("v1", "v2", "v3", "stray"):
        write(tmp_path, f"a/{v}.truth.json", {"variant_id": v, "family": "insurance", "source_file": f"a/{v}.csv", "sheet_name": "S", "currency": "GBP", "decimal_convention": "dot_decimal", "column_mapping": {"GWP": "gross"}, "declared_total": {"declared_gross": "10.10", "agrees_with_rows": True} if v == "v1" else None, "adversarial_cases": [{"case": "repeat", "keys": []}], "rows": [row, row] if v == "v1" else []})
    cases = manifest.read_cases(spark, f"file://{tmp_path}").orderBy("position").collect()
    assert [(c.variant_id, c.held_out, c.unmappable, c.adversarial_cases) for c in cases] == [("v2", False, False, ["repeat"]), ("v1", True, False, ["repeat"]), ("v3", False, True, ["repeat"])]
    assert cases[1].source.endswith("/a/v1.csv") and cases[1].declared_total.declared_gross == "10.10" and cases[0].declared_total is None
    truth = manifest.require_canonical(manifest.read_truth(spark, f"file://{tmp_path}"))
    assert [(r.row_index, r.gross, r.deductions, r.net) for r in truth.orderBy("row_index").collect()] == [(i, D("10.10"), {"tax": D("0.10")}, None) for i in (0, 1)]
    with pytest.raises(ValueError, match="'net'"):
        manifest.require_canonical(truth.drop("net"))


def test_documents_are_kept_and_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    assert documents.read_documents(spark, path).count() == 0
    rows = [('a "b"', '{"z": 1, "a": {"y": [1, null], "x": "é"}}'), ("c", "[]")]
    documents.write_documents(spark.createDataFrame(rows, "name string, document string"), path)
    assert sorted(map(tuple, documents.read_documents(spark, path).collect())) == [('a "b"', '{"a":{"x":"é","y":[1,null]},"z":1}'), ("c", "[]")]
    kept = documents.read_documents(spark, path)
    assert documents.changes(kept, spark.createDataFrame(rows, kept.schema), ["name"]).count() == 0


def test_screens_of_contracts_and_of_a_row(spark):
    contracts = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2)], "sender string, version int")
    assert [tuple(r) for r in views.contracts(contracts).collect()] == [("a", 2), ("a", 1), ("b", 1)]
    ledger = spark.createDataFrame([("k", "h"), ("k", "gone"), ("l", "h")], "key string, source_content_hash string")
    files = spark.createDataFrame([("h", "s", "f.csv")], "content_hash string, sender string, filename string")
    assert sorted((r.source_content_hash, r.filename) for r in views.row_with_source(ledger, files, "k").collect()) == [("gone", None), ("h", "f.csv")]
    assert [r.key for r in views.by_key(spark.createDataFrame([("b",), ("B",), ("é",)], "key string")).collect()] == ["B", "b", "é"]


def test_the_entry_registers_the_rest_without_a_library_of_the_corpus_operators():
    code = "import sys; sys.modules['zstandard'] = None; sys.modules['tokenizers'] = None; import __spark_entry__ as e; n = e.queries(); assert 'reconcile_status' in n and 'op4_pack' not in n and set(e.oracle_sql()) <= set(n)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
