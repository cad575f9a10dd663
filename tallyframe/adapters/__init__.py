"""Domains ("families"): the fields of a statement, what their columns look like, and how their rows are identified.

The operators know roles only; families are registered here and named by their packs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column

from tallyframe.functions.text import identity

KEY, PERIOD, GROSS, DEDUCTION, NET, ATTRIBUTE = "key", "period", "gross", "deduction", "net", "attribute"


@dataclass(frozen=True)
class Shape:
    """What a field claims of its column's values; None claims nothing."""

    monetary: float | None = None
    temporal: float | None = None
    pattern: str | None = None
    categorical: bool | None = None
    near_constant: bool | None = None
    magnitude_rank: int | None = None


@dataclass(frozen=True)
class Field:
    name: str
    role: str
    required: bool = False
    synonyms: tuple[str, ...] = ()
    shape: Shape = field(default_factory=Shape)


@dataclass(frozen=True)
class Family:
    name: str
    fields: tuple[Field, ...]

    def of_role(self, role: str) -> list[str]:
        return [f.name for f in self.fields if f.role == role]

    def identity(self, reference: Column, period: Column) -> Column:
        return identity(reference, period)


_FAMILIES: dict[str, Family] = {}


def register(family: Family) -> Family:
    _FAMILIES[family.name] = family
    return family


def get_family(name: str) -> Family:
    if not _FAMILIES:
        from tallyframe.adapters import insurance, marketplace  # noqa: F401
    return _FAMILIES[name]


def families() -> list[str]:
    get_family("insurance")
    return sorted(_FAMILIES)
