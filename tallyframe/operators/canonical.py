"""Statement rows to canonical rows with lineage, or to quarantine with a reason.

Input: rows of sources.grid (content_hash, sheet, spreadsheet_row, headers, cells) and a mapping header -> field, of one
layout or, in a column, of each row's own. All of it is one projection: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.adapters import DEDUCTION, GROSS, KEY, NET, PERIOD, Family
from tallyframe.functions.money import COMMA, DOT, MONEY, parse_amount, plain, plain_amount, plain_is_amount, strip
from tallyframe.functions.period import stripped_period
from tallyframe.sources.grid import cell


@dataclass(frozen=True)
class Profile:
    """What a sender declares of its files; none of it is guessed from values. What is None is declared by each row, in a
    column of that name: rows of many senders are read in one plan."""

    sender: str
    currency: str | None
    convention: str | None = DOT
    day_first: bool | None = True
    mapping_version: int = 1


def lineage(profile: Profile, header: Column, raw: Column) -> Column:
    at = F.struct(F.col("sheet").alias("sheet"), F.col("spreadsheet_row").cast("int").alias("row"), header.alias("column"))
    return F.struct(F.col("content_hash").alias("source_content_hash"), at.alias("cell"), F.lit(profile.mapping_version).alias("mapping_version"), raw.alias("raw_value"))


def _blank(raw: Column) -> Column:
    return raw.rlike(r"(?U)^\s*\z")


def canonicalise(rows: DataFrame, mapping: dict[str, str] | None, family: Family, profile: Profile) -> DataFrame:
    """All rows with a non-blank mapped cell: key, currency, period, gross, deductions, net, attributes (each value with its
    lineage), and quarantine_reason and quarantine_raw, null for canonical rows.

    mapping: header -> field; of headers mapped to one field the last one counts. None: each row's own, in a column `mapping`
    (MAP field -> header). Checks in order: period, key, gross unreadable, gross empty, deductions, net, an amount too large
    to store. Blank optional money is null, never zero.
    """
    if mapping is None:
        header = {f.name: F.col("mapping")[f.name] for f in family.fields}
    else:
        header = {f: F.lit(h) for h, f in mapping.items()}

    def first(role: str) -> str | None:
        return next(iter(family.of_role(role)), None)

    key, period, gross, net = (first(r) for r in (KEY, PERIOD, GROSS, NET))
    money = [gross, *[d for d in family.of_role(DEDUCTION) if d in header], *([net] if net in header else [])]
    # one column for each cell, for what is left of an amount without its dress, and for what is read in it; inline() keeps
    # filters on the outcome from repeating the reading, and each of the steps a method of its own in the generated code: the
    # JVM never compiles a method of more than 8,000 bytes
    currency = F.lit(profile.currency) if profile.currency else F.col("currency")
    declared = [name for name, own in (("convention", profile.convention), ("day_first", profile.day_first)) if own is None]
    by_convention = lambda read: read(profile.convention) if profile.convention else F.when(F.col("convention") == DOT, read(DOT)).when(F.col("convention") == COMMA, read(COMMA))
    month_of = lambda t: stripped_period(t, profile.day_first) if profile.day_first is not None else F.when(F.col("day_first"), stripped_period(t, True)).otherwise(stripped_period(t, False))

    def step(df: DataFrame, found: list[Column], *kept: str) -> DataFrame:
        return df.select(*(kept or ["*"]), F.inline(F.array(F.struct(*found))))

    cells = step(rows, [*[cell(h).alias(f"_{f}") for f, h in header.items()], *[h.alias(f"at_{f}") for f, h in header.items()], currency.alias("declared_currency")], "content_hash", "sheet", "spreadsheet_row", *declared)
    cells = cells.withColumnRenamed("declared_currency", "currency")
    header, raw = {f: F.col(f"at_{f}") for f in header}, {f: F.col(f"_{f}") for f in header}
    present = cells.where(F.concat_ws("", *raw.values()) != "")
    absent = F.lit("")
    bare = step(present, [*[plain(raw.get(f, absent)).alias(f"plain_{f}") for f in money], strip(raw.get(period, absent)).alias("dated")])
    known = step(bare, [
        *[F.coalesce(by_convention(lambda c, f=f: plain_is_amount(F.col(f"plain_{f}"), c)), F.lit(False)).alias(f"reads_{f}") for f in money],
        *[_blank(raw.get(f, absent)).alias(f"empty_{f}") for f in (*money, key)],
    ])
    months = step(known, [month_of(F.col("dated")).alias("month")])
    read = months
    for f in money:
        read = step(read, [by_convention(lambda c, f=f: plain_amount(F.col(f"plain_{f}"), c, reads=F.col(f"reads_{f}"))).alias(f"amount_{f}")])
    month, amount = F.col("month"), {f: F.col(f"amount_{f}") for f in money}
    empty, unreadable = {f: F.col(f"empty_{f}") for f in (*money, key)}, {f: ~F.col(f"empty_{f}") & ~F.col(f"reads_{f}") for f in money}

    def tracked(field: str, value: Column) -> Column:
        return F.struct(value.alias("value"), lineage(profile, header.get(field, absent), raw.get(field, absent)).alias("lineage"))

    reason, at_fault = F.when(month.isNull(), F.concat(F.lit(f"{period}: not a date, "), F.when(F.lit(profile.day_first) if profile.day_first is not None else F.col("day_first"), "day").otherwise("month"), F.lit(" first"))), F.when(month.isNull(), raw.get(period, absent))

    def held(when: Column, why: str | Column, what: Column) -> None:
        nonlocal reason, at_fault
        reason, at_fault = reason.when(when, F.lit(why) if isinstance(why, str) else why), at_fault.when(when, what)

    if key in raw:
        held(empty[key], f"{key}: empty, the row has no identity", absent)
    for f in money:
        held(unreadable[f], F.concat(F.lit(f"{f}: not an amount as "), F.lit(profile.convention) if profile.convention else F.col("convention")), raw.get(f, absent))
        if f == gross:
            held(empty[f], f"{f}: empty, nothing to reconcile", absent)
        held(~empty[f] & amount[f].isNull(), f"{f}: too large to store", raw.get(f, absent))

    def entries(pairs: list[Column], kind: str) -> Column:
        return F.map_from_entries(F.array_compact(F.array(*pairs))) if pairs else F.create_map().cast(kind)

    where = "struct<source_content_hash:string,cell:struct<sheet:string,row:int,column:string>,mapping_version:int,raw_value:string>"
    deductions = [F.when(amount[f].isNotNull(), F.struct(F.lit(f).alias("key"), tracked(f, amount[f].cast(MONEY)).alias("value"))) for f in money if f not in (gross, net)]
    described = [f.name for f in family.fields if f.role not in (GROSS, DEDUCTION, NET) and f.name in raw]
    attributes = [F.when(raw[f] != "", F.struct(F.lit(f).alias("key"), tracked(f, raw[f]).alias("value"))) for f in described]
    return read.select(
        "content_hash",
        "sheet",
        "spreadsheet_row",
        family.identity(raw.get(key, F.lit("")), month).alias("key"),
        "currency",
        month.alias("period"),
        tracked(gross, amount[gross].cast(MONEY)).alias("gross"),
        entries(deductions, f"map<string,struct<value:{MONEY},lineage:{where}>>").alias("deductions"),
        (F.when(amount[net].isNotNull(), tracked(net, amount[net].cast(MONEY))) if net in amount else F.lit(None).cast(f"struct<value:{MONEY},lineage:{where}>")).alias("net"),
        entries(attributes, f"map<string,struct<value:string,lineage:{where}>>").alias("attributes"),
        reason.alias("quarantine_reason"),
        at_fault.alias("quarantine_raw"),
    )


def accepted(tagged: DataFrame) -> DataFrame:
    return tagged.where("quarantine_reason IS NULL").drop("quarantine_reason", "quarantine_raw")


def quarantined(tagged: DataFrame) -> DataFrame:
    return tagged.where("quarantine_reason IS NOT NULL").select("content_hash", "spreadsheet_row", F.col("quarantine_reason").alias("reason"), F.col("quarantine_raw").alias("raw_value"))


def flat(canonical: DataFrame) -> DataFrame:
    """The columns that operators.reconcile takes, without lineage."""
    return canonical.select("key", "currency", "period", F.col("gross.value").alias("gross"), F.transform_values("deductions", lambda k, v: v["value"]).alias("deductions"), F.col("net.value").alias("net"), "spreadsheet_row")


def lineage_rows(canonical: DataFrame) -> DataFrame:
    """A row for each value of each canonical row: key, field, source_content_hash, sheet, row, column, mapping_version, raw_value."""
    one = lambda name, tracked: F.array(F.struct(F.lit(name).alias("field"), tracked.alias("lineage")))
    many = lambda column: F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("field"), e["value"]["lineage"].alias("lineage")))
    net = F.when(F.col("net").isNotNull(), one("net", F.col("net.lineage"))).otherwise(F.array().cast(canonical.select(one("net", F.col("net.lineage"))).schema[0].dataType))
    all_of = F.concat(one("gross", F.col("gross.lineage")), many("deductions"), net, many("attributes"))
    return canonical.select("key", F.explode(all_of).alias("x")).select("key", "x.field", "x.lineage.source_content_hash", "x.lineage.cell.sheet", "x.lineage.cell.row", "x.lineage.cell.column", "x.lineage.mapping_version", "x.lineage.raw_value")


def is_complete() -> Column:
    """Whether a row of lineage_rows names a file, a cell and a mapping."""
    return F.coalesce((F.length("source_content_hash") > 0) & (F.length("sheet") > 0) & (F.col("row") > 0) & (F.length("column") > 0) & (F.col("mapping_version") > 0), F.lit(False))


def declared_total(rows: DataFrame, header: str, profile: Profile) -> DataFrame:
    """(content_hash, declared): the last non-empty cell of a column in each file; null if it is no amount."""
    last = F.max_by(F.struct(cell(header).alias("raw")), "row_index").alias("x")
    return rows.where(strip(cell(header)) != "").groupBy("content_hash").agg(last).select("content_hash", parse_amount(F.col("x.raw"), profile.convention).cast(MONEY).alias("declared"))
