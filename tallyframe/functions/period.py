"""Dates in cells: the reporting month, and whether a cell looks like a date at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.money import strip

# fixed values: the first letters of month names, January to December; sept as well
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_ISO = r"^([0-9]{4})[-/.]([0-9]{1,2})([-/.][0-9]{1,2})?$"
_MONTH_YEAR = r"^([0-9]{1,2})[-/.]([0-9]{4})$"
_DAY = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})$"
_NAMED = r"(?U)^(?:[0-9]{1,2}\s+)?([A-Za-z]{3,9})\s+([0-9]{4})$"
# fixed values: renderings that count as dates
DATE_LIKE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    r"^[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}$",
    r"^[0-9]{4}[/.-][0-9]{1,2}$",
    r"^[0-9]{1,2}[/.-][0-9]{4}$",
    r"(?U)^[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4}$",
    r"(?U)^[A-Za-z]{3,9}\s+[0-9]{4}$",
    r"^[0-9]{4}-[0-9]{2}$",
)


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _dated(year: Column, month: Column) -> Column:
    return F.when(month.between(1, 12), F.format_string("%04d-%02d", year, month))


def normalise_period(raw: Column, day_first: bool) -> Column:
    """The month of a date cell as YYYY-MM, or NULL. The order of day and month is declared; a number above 12 overrules it.
    A month written after its year is not checked."""
    return stripped_period(strip(raw), day_first)


def stripped_period(t: Column, day_first: bool) -> Column:
    """normalise_period() of a text without white space at its ends. It names the text many times: where it is not a column,
    each of them strips it again."""
    a, b, y = (_number(t, _DAY, g) for g in (1, 2, 3))
    month = F.when(a > 12, b).when(b > 12, a).otherwise(b if day_first else a)
    year = F.when(y < 100, y + 2000).otherwise(y)
    word = F.substring(F.lower(F.regexp_extract(t, _NAMED, 1)), 1, 3)
    named = F.array_position(F.array(*map(F.lit, MONTHS)), word).cast("int")
    return (
        F.when(t.rlike(_ISO), F.concat(F.regexp_extract(t, _ISO, 1), F.lit("-"), F.lpad(F.regexp_extract(t, _ISO, 2), 2, "0")))
        .when(t.rlike(_MONTH_YEAR), F.when(t.rlike("^(?:0?[1-9]|1[0-2])[^0-9]"), F.concat(F.regexp_extract(t, _MONTH_YEAR, 2), F.lit("-"), F.lpad(F.regexp_extract(t, _MONTH_YEAR, 1), 2, "0"))))
        .when(t.rlike(_DAY), _dated(year, month))
        .when(t.rlike(_NAMED), _dated(_number(t, _NAMED, 2), named))
    )


def looks_like_date(raw: Column) -> Column:
    return F.coalesce(raw.rlike("|".join(f"(?:{p})" for p in DATE_LIKE)), F.lit(False))


PERIOD_STYLES = {"YYYY-MM": "yyyy-MM", "MM/YYYY": "MM/yyyy", "Month YYYY": "MMMM yyyy"}
DATE_STYLES = {"ISO": "yyyy-MM-dd", "D/M/Y": "dd/MM/yyyy", "M/D/Y": "MM/dd/yyyy", "D Month YYYY": "d MMMM yyyy"}


def format_date(day: Column, style: str) -> Column:
    return F.date_format(day, (DATE_STYLES | PERIOD_STYLES)[style])
