"""Statuses without evidence against those with it, on sides with nulls, odd names and repeats; and a report's single reading of its rows."""

import random
from decimal import Decimal as D

from tallyframe.functions.money import EXACT, Tolerance
from tallyframe.operators import reconcile
from tallyframe.plans import files

SIDE = "key string, currency string, gross decimal(18,4), deductions map<string,decimal(18,4)>, net decimal(18,4), spreadsheet_row long"


def row(r, key, i):
    deductions = r.choice([{"tax": D(5)}, {"tax": D(5)}, {"tax": D(5), "fee": None}, {"fee": D(0), "tax": D(5)}, {"gross": D(5)}, {}, None, {"tax": None}])
    gross = r.choice([D(100), D(100), D("100.02"), None])
    return key, r.choice(["GBP", "GBP", "EUR", None]), gross, deductions, r.choice([D(95), D(95), D(100), None]), i


def test_statuses_without_evidence_are_the_same(spark):
    r = random.Random(8)
    sides = [[], []]
    for i in range(1500):
        one, other = row(r, f"k{i}", i), row(r, f"k{i}", i)
        if i % 9 == 0:  # both hold by themselves
            one, other = ((f"k{i}", "GBP", D(100) + more, {"tax": D(5)}, D(95) + more, i) for more in (D(0), D("0.02")))
        for side, x in zip(sides, (one, r.choice([one, one, other, None])), strict=True):
            side.extend([x] * (2 if i % 50 == 0 else 1) if x else [])
    sides[0].append((None, "GBP", D(1), {}, D(1), 1))
    a, b = (spark.createDataFrame(side, SIDE) for side in sides)
    for tolerance in (EXACT, Tolerance(D("0.05"), ("gross",), "rounding")):
        full = reconcile.reconcile(a, b, tolerance).select("key", "status", "rule")
        light = reconcile.reconcile(a, b, tolerance, evidence=False)
        assert light.columns == full.columns and sorted(map(str, light.collect())) == sorted(map(str, full.collect()))
        assert {x.rule for x in light.select("rule").distinct().collect()} == set(reconcile.RULES)


def test_a_report_reads_the_lines_once_for_its_files(spark):
    found = files.file_report(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # rows come canonical from a table
