"""The money, month and key functions under names that SQL can call.

Each is a temporary SQL function whose body is the expression that the DataFrame functions build, so that both surfaces are one
rule and a call is planned like any built-in: no Python runs for it.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import money, period, text


def _either(read, name: str, choices: tuple) -> Column:
    """What one of two rules reads, as a column says; null for any other value of it."""
    first, second = choices
    return F.when(F.col(name) == first, read(first)).when(F.col(name) == second, read(second))


def _functions() -> dict[str, tuple[str, Column]]:
    """name: (parameters, body)."""
    raw = F.col("raw")
    conventions = (money.DOT, money.COMMA)
    return {
        "parse_amount": ("raw STRING, convention STRING", _either(lambda c: money.parse_amount(raw, c), "convention", conventions)),
        "format_amount": ("amount DECIMAL(18,4), convention STRING, code STRING", _either(lambda c: F.concat(money.format_amount(F.col("amount"), c), F.when(F.coalesce("code", F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), F.col("code")))), "convention", conventions)),
        "money_text": ("amount DECIMAL(18,4)", money.money_text(F.col("amount"))),
        "normalise_period": ("raw STRING, day_first BOOLEAN", _either(lambda d: period.normalise_period(raw, d), "day_first", (True, False))),
        "looks_like_date": ("raw STRING", period.looks_like_date(raw)),
        "identity_key": ("reference STRING, period STRING", text.identity(F.col("reference"), F.col("period"))),
        "cell_reference": ("sheet STRING, header STRING, row INT", text.cell_reference(F.col("sheet"), F.col("header"), F.col("row"))),
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session's SQL; their names. Registering again replaces them."""
    made = _functions()
    for name, (parameters, body) in made.items():
        frame = spark.createDataFrame([], parameters).select(body.alias("x"))
        written = frame._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {written}")
    return list(made)
