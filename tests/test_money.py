from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import money, period

# fixed values: cells that must be read as these amounts
READ = [
    ("1,234.56", money.DOT, "1234.56"), ("1.234,56", money.COMMA, "1234.56"), ("1234.56", money.DOT, "1234.56"), ("1234,56", money.COMMA, "1234.56"),
    ("1 234,56", money.COMMA, "1234.56"), ("1 234,56", money.COMMA, "1234.56"), ("38,867.16", money.DOT, "38867.16"), ("1.234", money.DOT, "1.23"),
    ("1.234", money.COMMA, "1234.00"), ("(12.34)", money.DOT, "-12.34"), ("(£12.34)", money.DOT, "-12.34"), ("12.34-", money.DOT, "-12.34"), ("(-5)", money.DOT, "5.00"),
    ("0.00499999999999", money.DOT, "0.00"), ("1.00499999999", money.DOT, "1.00"), ("1.00500000001", money.DOT, "1.01"), ("-0,005", money.COMMA, "-0.01"), ("12345678901234.999", money.DOT, "12345678901235.00"), ("7,", money.COMMA, "7.00"),
    ("1.005", money.DOT, "1.01"), ("1.015", money.DOT, "1.02"), ("2.675", money.DOT, "2.68"), ("-1.005", money.DOT, "-1.01"), ("1,234.", money.DOT, "1234.00"),
]
REFUSED = ["1,234,56", "", "   ", "n/a", "TBC", "-", "abc", ".50", "£(12.34)", "(12.34) GBP", ",123", "1,2345", None]


def test_amounts_are_read_exactly_or_refused(spark):
    cases = [(r, c, v) for r, c, v in READ] + [(r, money.DOT, None) for r in REFUSED]
    df = spark.createDataFrame(cases, "raw string, convention string, value string")
    got = df.select("raw", "value", money.money_text(F.when(F.col("convention") == money.DOT, money.parse_amount(F.col("raw"), money.DOT)).otherwise(money.parse_amount(F.col("raw"), money.COMMA))).alias("got")).collect()
    assert [(r.raw, r.got) for r in got] == [(r.raw, r.value) for r in got]


def test_an_amount_too_large_is_null(spark):
    assert spark.range(1).select(money.parse_amount(F.lit("9" * 25), money.DOT)).first()[0] is None


def test_floats_are_refused(spark):
    with pytest.raises(TypeError):
        money.forbid_floats(spark.createDataFrame([(1.0,)], "gross double"), ["gross"])
    with pytest.raises(TypeError):
        money.Tolerance(0.01)


def test_tolerance_covers_only_its_fields(spark):
    t = money.Tolerance(Decimal("0.05"), ("tax",), "rounding")
    df = spark.createDataFrame([("tax", Decimal("0.05")), ("tax", Decimal("0.06")), ("net", Decimal("0.01")), ("net", Decimal("0.00"))], "f string, d decimal(18,4)")
    assert [r[0] for r in df.select(t.accepts(F.col("f"), F.col("d"))).collect()] == [True, False, False, True]


def test_format_and_read_back(spark):
    df = spark.createDataFrame([(Decimal("-1234567.80"),), (Decimal("0.05"),)], "x decimal(18,2)")
    for convention in (money.DOT, money.COMMA):
        shown = money.format_amount(F.col("x"), convention, symbol="€", brackets=True)
        assert all(r.x == r.y for r in df.select("x", money.parse_amount(shown, convention).alias("y")).collect())


PERIODS = [
    ("2026-01", True, "2026-01"), ("2026-01-15", True, "2026-01"), ("15/01/2026", True, "2026-01"), ("01/15/2026", False, "2026-01"), ("01/2026", True, "2026-01"), ("January 2026", True, "2026-01"),
    ("12/2026", True, "2026-12"), ("Sept 2026", True, "2026-09"), ("15 Mar 2026", True, "2026-03"), ("03/04/2026", True, "2026-04"), ("03/04/2026", False, "2026-03"), ("25/03/2026", False, "2026-03"),
    ("2026-13", True, "2026-13"), ("Marzo 2026", True, "2026-03"), ("", True, None), ("TBC", True, None), ("n/a", True, None), ("13/2026", True, None), ("not a date", True, None), ("2026", True, None), (None, True, None),
]


def test_periods(spark):
    df = spark.createDataFrame(PERIODS, "raw string, day_first boolean, month string")
    got = df.select("raw", "month", F.when(F.col("day_first"), period.normalise_period(F.col("raw"), True)).otherwise(period.normalise_period(F.col("raw"), False)).alias("got")).collect()
    assert [(r.raw, r.got) for r in got] == [(r.raw, r.month) for r in got]
