"""Exact amounts as Column expressions. Money is DECIMAL from the cell on; no float takes part."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOT, COMMA = "dot_decimal", "comma_decimal"
#: How amounts are stored.
MONEY = "decimal(18,4)"
# fixed values: minor units of the currencies that are known
MINOR_UNITS = {"GBP": 2, "EUR": 2, "USD": 2}
_MARKS = {DOT: (",", "."), COMMA: (".", ",")}


def strip(raw: Column) -> Column:
    """Without white space at either end, no-break spaces included."""
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


#: Stand before an amount that brackets or a trailing minus negate.
_BRACKETS, _TRAILING = "\x01", "\x02"


def plain(raw: Column) -> Column:
    """An amount's text without white space, symbols and codes, with a mark for brackets and for a trailing minus. What is
    read of a cell is read of this; where more than one thing is read, make it a column first."""
    inner = F.regexp_replace(strip(raw), r"(?s)^\((.*)\)$", f"{_BRACKETS}$1")
    bare = F.regexp_replace(inner, r"(?iU)[£$€\s ]|GBP|EUR|USD", "")
    # most cells are bare already, or have a code behind, which one match tells
    return F.when(raw.rlike(r"^[0-9.,]*\z"), raw).when(raw.rlike(r"^[0-9.,]+ (?:GBP|EUR|USD)\z"), F.substring_index(raw, " ", 1)).otherwise(F.regexp_replace(bare, r"(?s)^(.*)-$", f"{_TRAILING}$1"))


def plain_is_amount(bare: Column, convention: str) -> Column:
    group, mark = _MARKS[convention]
    return F.coalesce(bare.rlike(rf"^{_TRAILING}?{_BRACKETS}?-?([0-9]+|[0-9]{{1,3}}([{group}][0-9]{{3}})+)([{mark}][0-9]*)?$"), F.lit(False))


def plain_amount(bare: Column, convention: str, scale: int = 2, reads: Column | None = None) -> Column:
    """reads: plain_is_amount() of the same text, where it is a column already."""
    group, mark = _MARKS[convention]
    reads = plain_is_amount(bare, convention) if reads is None else reads
    # marks and group signs go, the decimal mark becomes a point; digits after the one that decides the rounding are cut
    # off, so that it is rounded once
    digits = F.replace(bare, F.lit(group), F.lit(""))
    for sign, to in ((mark, "."), (_BRACKETS, ""), (_TRAILING, "")):
        digits = F.replace(digits, F.lit(sign), F.lit(to))
    short = F.concat(F.substring_index(digits, ".", 1), F.lit("."), F.substring(F.substring_index(digits, ".", -1), 1, scale + 1), F.lit("0"))
    value = F.round(F.when(reads, F.when(digits.contains("."), short).otherwise(digits)).try_cast(f"decimal(38,{scale + 2})"), scale)
    negated = bare.startswith(_BRACKETS) | (bare.startswith(_TRAILING) & ~bare.startswith(_TRAILING + _BRACKETS))
    return F.when(negated, -value).otherwise(value).try_cast(f"decimal(18,{scale})")


def is_amount(raw: Column, convention: str) -> Column:
    """Whether a cell is an amount under the declared convention; the convention is never guessed."""
    return plain_is_amount(plain(raw), convention)


def parse_amount(raw: Column, convention: str, scale: int = 2) -> Column:
    """The amount in a cell, rounded half up once to scale, or NULL where it cannot be read exactly.

    `(x)` and `x-` negate, each, on top of a leading minus. Currency symbols and codes are dropped anywhere inside the
    parentheses. A grouped part has one to three digits and then groups of three.
    """
    return plain_amount(plain(raw), convention, scale)


def money_text(amount: Column, scale: int = 2) -> Column:
    return F.round(amount, scale).cast(f"decimal(18,{scale})").cast("string")


def format_amount(amount: Column, convention: str = DOT, symbol: str = "", code: str = "", brackets: bool = False) -> Column:
    """An amount as a statement would write it: grouped, with a symbol before or a code after, negatives by sign or brackets."""
    shown = F.format_number(F.abs(amount).cast("decimal(18,2)"), 2)
    shown = F.translate(shown, ",.", ".,") if convention == COMMA else shown
    dressed = F.concat(F.lit(symbol), shown, F.lit(f" {code}" if code else ""))
    sign = lambda mark: F.when(amount < 0, mark).otherwise("")
    return F.concat(sign("("), dressed, sign(")")) if brackets else F.concat(sign("-"), dressed)


def forbid_floats(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if none of the money columns is a float."""
    wrong = [c for c in columns if isinstance(df.schema[c].dataType, T.FloatType | T.DoubleType)]
    if wrong:
        raise TypeError(f"money columns must be exact decimals, not floats: {wrong}")
    return df


@dataclass(frozen=True)
class Tolerance:
    """A difference up to `absolute` is accepted in the fields it names, and in no other."""

    absolute: Decimal = Decimal(0)
    applies_to: tuple[str, ...] = ()
    reason: str = ""

    def __post_init__(self) -> None:
        if isinstance(self.absolute, float):
            raise TypeError("a tolerance is an exact decimal, not a float")
        if self.absolute < 0:
            raise ValueError("a tolerance is not negative")

    def covers(self, field: Column) -> Column:
        return field.isin(*self.applies_to) if self.applies_to else F.lit(False)

    def accepts(self, field: Column, difference: Column) -> Column:
        return F.when(self.covers(field), F.abs(difference) <= F.lit(self.absolute)).otherwise(difference == 0)

    def text(self, field: Column) -> Column:
        return F.when(self.covers(field), F.lit(f"{self.absolute} ({self.reason})")).otherwise(F.lit("exact match required"))


EXACT = Tolerance()


def add(a: Column, a_currency: Column, b: Column, b_currency: Column, sign: int = 1) -> Column:
    """a + b (or a - b) of one currency; two currencies are an error, as there is no rate."""
    total = (a + b if sign > 0 else a - b).cast(MONEY)
    return F.when(a_currency == b_currency, total).otherwise(F.raise_error(F.concat(F.lit("cannot combine "), a_currency, F.lit(" with "), b_currency)).cast(MONEY))


def magnitude(a: Column) -> Column:
    """An amount without its sign; its currency stays what it is."""
    return F.abs(a).cast(MONEY)
