from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyframe.functions.money import Tolerance
from tallyframe.operators import reconcile as R

SCHEMA = "key string, currency string, gross decimal(18,4), deductions map<string,decimal(18,4)>, net decimal(18,4), spreadsheet_row long"


def row(key, gross="1000.00", tax="100.00", commission="200.00", net="closes", currency="GBP", n=2):
    d = {k: D(v) for k, v in (("tax", tax), ("commission", commission)) if v is not None}
    closes = D(gross) - sum(d.values())
    return (key, currency, D(gross), d, closes if net == "closes" else None if net is None else D(net), n)


CASES = {
    "same": ([row("a")], [row("a")], "matched", "all_fields_agree"),
    "cent": ([row("a")], [row("a", gross="1000.01")], "mismatch", "field_difference"),
    "commission": ([row("a")], [row("a", commission="250.00")], "mismatch", "field_difference"),
    "only here": ([row("a")], [], "missing", "absent_on_one_side"),
    "only there": ([], [row("a")], "missing", "absent_on_one_side"),
    "twice": ([row("a"), row("a", n=3)], [row("a")], "duplicate", "repeated_key"),
    "currency": ([row("a")], [row("a", currency="EUR")], "review", "currency_disagreement"),
    "arithmetic": ([row("a", net="999.99")], [row("a")], "review", "internal_arithmetic"),
    "one side": ([row("a", tax=None)], [row("a")], "review", "field_present_on_one_side"),
    "no net": ([row("a", net=None)], [row("a")], "review", "field_present_on_one_side"),
}


def nulls(**changed):
    names = ("key", "currency", "gross", "deductions", "net", "n")
    return tuple((dict(zip(names, row("a"), strict=True)) | changed).values())


UNPROVEN = {
    "currency": ([row("a")], [nulls(currency=None)]),
    "both currencies": ([nulls(currency=None)], [nulls(currency=None)]),
    "gross": ([row("a")], [nulls(gross=None)]),
    "both gross and net": ([nulls(gross=None, net=None)], [nulls(gross=None, net=None)]),
    "a deduction": ([row("a")], [nulls(deductions={"tax": D(100), "commission": None})]),
    "all deductions": ([row("a")], [nulls(deductions=None)]),
}


def test_nothing_unproven_matches(spark):
    for name, (left, right) in UNPROVEN.items():
        got = R.reconcile(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA))
        assert [r.status for r in got.collect()] == ["review"], name
    without = nulls(deductions=None, net=D(1000))
    assert [r.status for r in R.reconcile(spark.createDataFrame([without], SCHEMA), spark.createDataFrame([nulls(deductions={}, net=D(1000))], SCHEMA)).collect()] == ["matched"]
    blind = spark.createDataFrame([("k", "matched", [(None,)]), ("l", "matched", None), ("m", "matched", [(True,)])], "key string, status string, discrepancies array<struct<within_tolerance:boolean>>")
    assert {r.key for r in R.false_matched(blind).collect()} == {"k", "l"}


def test_null_keys_match_nothing_and_names_do_not_clash(spark):
    one = spark.createDataFrame([nulls(key=None)], SCHEMA)
    assert [r.status for r in R.reconcile(one, one).collect()] == ["missing", "missing"]
    odd = lambda x: spark.createDataFrame([nulls(deductions={"gross": D(x), "net": D(1)}, net=D(999) - D(x))], SCHEMA)
    assert [r.status for r in R.reconcile(odd(5), odd(5)).collect()] == ["matched"]
    assert [r.status for r in R.reconcile(odd(5), odd(6)).collect()] == ["mismatch"]


def test_each_status(spark):
    for name, (left, right, status, rule) in CASES.items():
        got = R.reconcile(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
        assert [(r.status, r.rule) for r in got] == [(status, rule)], name
        assert got[0].detail


def test_tolerance_and_false_matches(spark):
    a, b = spark.createDataFrame([row("a", tax="100.00")], SCHEMA), spark.createDataFrame([row("a", tax="100.03")], SCHEMA)
    near = R.reconcile(a, b, Tolerance(D("0.05"), ("tax", "net"), "rounding"))
    assert [r.status for r in near.collect()] == ["matched"]
    assert R.false_matched(near).count() == 0
    assert [r.status for r in R.reconcile(a, b).collect()] == ["mismatch"]


def test_totals_add_up(spark):
    rows = spark.range(3000).select(F.lit("f").alias("f"), F.lit(D("0.03")).cast("decimal(18,4)").alias("gross"))
    got = R.batch_totals(rows, spark.createDataFrame([("f", D("90.00"))], "f string, declared decimal(18,4)"), ["f"]).first()
    assert (got.computed, got.agrees, got.rows_summed) == (D("90.0000"), True, 3000)


def test_empty_sides_and_zero_counts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert {r.status: r.n for r in R.by_status(R.reconcile(none, none)).collect()} == dict.fromkeys(R.STATUSES, 0)
