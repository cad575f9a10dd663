"""A corpus of statements with a known truth, made by Spark from the layouts: truth rows, files' cells, the other side's
ledger with injected disagreements, and the answer key. Integer arithmetic stands for chance, so every build is the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.adapters import get_family
from tallyframe.fixtures.layouts import LAYOUTS, REPEATING, REPEATS, true_columns
from tallyframe.functions.money import COMMA, MONEY
from tallyframe.functions.period import format_date
from tallyframe.functions.text import identity

# fixed values: what is injected and the status that it requires
INJECTIONS = {
    "absent_from_carrier": "missing",
    "carrier_only": "missing",
    "carrier_row_disagrees_with_itself": "review",
    "deduction_changed_gross_agrees": "mismatch",
    "gross_materially_different": "mismatch",
    "gross_off_by_one_minor_unit": "mismatch",
}
PER_KIND = 3
_SYMBOLS = {"GBP": "£", "EUR": "€", "USD": "$"}
_LAYOUT = "number int, variant string, family string, held_out boolean, unseen boolean, n_rows int, currency string, convention string, day_first boolean, dates string, periods string, style string, file string, footer string, headers array<string>, contents array<string>, mappable boolean"


def layouts(spark: SparkSession) -> DataFrame:
    """One row for each layout."""
    repeats = {REPEATING: len(REPEATS)}
    rows = [(x.number, x.name, x.family, x.held_out, x.unseen, x.rows + repeats.get(x.name, 0), x.currency, x.convention, x.day_first, x.dates, x.periods, x.style, x.file, x.footer, [h for h, _ in x.columns], [c for _, c in x.columns], x.mappable) for x in LAYOUTS]
    return spark.createDataFrame(rows, _LAYOUT)


def _cents(x: Column) -> Column:
    return F.round(x, 2).cast("decimal(18,2)")


def _chosen(column: Column, of: int) -> Column:
    return F.coalesce(*[F.when((F.col("variant") == REPEATING) & (column == r[0]), F.lit(r[of])) for r in REPEATS], column)


def truth(spark: SparkSession) -> DataFrame:
    """One row for each true row of the layouts that can be mapped: variant, row_index, reference, period, key, currency, amounts
    (null where the layout has no column for them), date and the texts of attributes, besides the layout's own columns."""
    rows = layouts(spark).where("mappable").withColumn("row_index", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    rows = rows.withColumns({"k": _chosen(F.col("row_index"), 1).cast("long"), "m": _chosen(F.col("row_index"), 2).cast("long"), "v": F.col("number").cast("long")})
    insurance = F.col("family") == "insurance"
    base = ((F.lit(20_000) + F.pmod(F.col("m") * 7919 + F.col("v") * 104_729 + F.col("m") * F.col("m") * 13, F.lit(880_000))) / 100).cast("decimal(18,2)")
    rows = rows.withColumn("base", F.when(~insurance & (F.pmod("m", F.lit(12)) == 7), -base).otherwise(base))
    rate = (F.lit(15) + F.pmod(F.col("m") * 31 + F.col("v"), F.lit(10))).cast("decimal(4,0)")
    rows = rows.withColumns({
        "tax": F.when(insurance, _cents(F.col("base") * F.lit(12).cast("decimal(4,0)") / 100)),
        "commission": F.when(insurance, _cents(F.col("base") * rate / 100)),
        "fee": F.when(~insurance, _cents(F.col("base") * F.lit(15).cast("decimal(4,0)") / 100)),
    })
    rows = rows.withColumn("gross", (F.col("base") + F.coalesce("tax", F.lit(0))).cast("decimal(18,2)"))
    closes = (F.col("gross") - F.coalesce("tax", F.lit(0)) - F.coalesce("commission", F.lit(0)) - F.coalesce("fee", F.lit(0))).cast("decimal(18,2)")
    month = F.lit(1) + F.pmod(F.col("number"), F.lit(6))
    day = F.make_date(F.lit(2026), month, F.lit(1) + F.pmod(F.col("m"), F.lit(28)).cast("int"))
    rows = rows.withColumns({
        "net": F.when(F.array_contains("contents", "net"), closes),
        "date": day,
        "period": F.date_format(day, "yyyy-MM"),
        "reference": F.concat(F.when(insurance, "POL-").otherwise("ORD-"), F.lpad(F.col("number").cast("string"), 2, "0"), F.lit("-"), F.lpad(F.col("k").cast("string"), 5, "0")),
    })
    return rows.withColumn("key", identity(F.col("reference"), F.col("period")))


def _amount(x: Column) -> Column:
    """An amount as its layout writes it."""
    shown = F.format_number(F.abs(x), 2)
    shown = F.when(F.col("convention") == COMMA, F.translate(shown, ",.", ".,")).otherwise(shown)
    symbol = F.create_map(*[F.lit(s) for e in _SYMBOLS.items() for s in e])[F.col("currency")]
    dressed = F.when(F.col("style") == "symbol", F.concat(symbol, shown)).when(F.col("style") == "nbsp", F.concat(symbol, F.lit(" "), shown)).when(F.col("style") == "code", F.concat(shown, F.lit(" "), "currency")).otherwise(shown)
    return F.when((x < 0) & (F.col("style") == "brackets"), F.concat(F.lit("("), dressed, F.lit(")"))).when(x < 0, F.concat(F.lit("-"), dressed)).otherwise(dressed)


def _dated(styles: str, known: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("string")
    for style in known:
        out = F.when(F.col(styles) == style, format_date(F.col("date"), style)).otherwise(out)
    return out


def file_rows(spark: SparkSession) -> DataFrame:
    """The cells of all files, of unmappable ones too, as sources.grid reads them, with variant, family, currency, convention
    and day_first, which senders declare."""
    rows = truth(spark)
    half = _cents(F.col("commission") * F.lit(6).cast("decimal(4,0)") / 10)
    texts = {
        "key": F.col("reference"), "period": _dated("periods", ("YYYY-MM", "MM/YYYY", "Month YYYY")), "currency": F.col("currency"), "date": _dated("dates", ("ISO", "D/M/Y", "M/D/Y", "D Month YYYY")),
        "holder": F.concat(F.lit("Holder "), F.col("number").cast("string")), "peril": F.element_at(F.array(*map(F.lit, ("Fire", "Flood", "Marine", "Motor", "Liability"))), (F.pmod("m", F.lit(5)) + 1).cast("int")),
        "seller": F.concat(F.lit("S"), F.col("m").cast("string")), "channel": F.when(F.pmod("m", F.lit(2)) == 0, "web").otherwise("app"), "category": F.element_at(F.array(*map(F.lit, ("Books", "Garden", "Toys", "Tools"))), (F.pmod("m", F.lit(4)) + 1).cast("int")),
        **{name: _amount(F.col(name)) for name in ("gross", "tax", "commission", "fee", "net")}, "before_tax": _amount(F.col("base")), "commission_a": _amount(half), "commission_b": _amount((F.col("commission") - half).cast("decimal(18,2)")),
    }
    named = F.create_map(*[x for name, text in texts.items() for x in (F.lit(name), F.coalesce(text, F.lit("")))])
    cells = rows.select("*", named.alias("texts")).select("variant", "family", "file", "currency", "convention", "day_first", "headers", F.col("row_index").cast("long"), F.transform("contents", lambda c: F.col("texts")[c]).alias("cells"))
    # a footer has the word and the total, of all rows or of all but the last
    totals = rows.where("footer <> 'none'").where((F.col("footer") == "all") | (F.col("row_index") < F.col("n_rows") - 1)).groupBy("variant", "family", "file", "currency", "convention", "day_first", "headers", "contents", "style", F.col("n_rows").cast("long").alias("row_index")).agg(F.sum("gross").cast("decimal(18,2)").alias("total"))
    foot = F.transform("contents", lambda c: F.when(c == "key", F.lit("TOTAL")).when(c == "gross", F.col("shown")).otherwise(F.lit("")))
    footers = totals.withColumn("shown", _amount(F.col("total"))).select("variant", "family", "file", "currency", "convention", "day_first", "headers", "row_index", foot.alias("cells"))
    opaque = layouts(spark).where("NOT mappable").withColumn("row_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows").cast("long") - 1)))
    value = lambda _, i: F.when(i < 2, F.concat(F.lit("R"), F.pmod(F.col("row_index") + i, F.lit(9)).cast("string"))).otherwise(F.pmod(F.col("row_index") * 37 + i * 11, F.lit(100)).cast("string"))
    opaque = opaque.select("variant", "family", "file", "currency", "convention", "day_first", "headers", "row_index", F.transform("contents", value).alias("cells"))
    every = cells.unionByName(footers).unionByName(opaque)
    return every.select(F.sha2("variant", 256).alias("content_hash"), F.col("variant").alias("sheet"), "headers", "row_index", (F.col("row_index") + 2).alias("spreadsheet_row"), "cells", "variant", "family", "file", "currency", "convention", "day_first")


def true_mapping(spark: SparkSession) -> DataFrame:
    """(content_hash, variant, held_out, field, header): the column of each field of each layout, null if it has none."""
    rows = [(x.name, x.held_out, f, h) for x in LAYOUTS for f, h in true_columns(x, get_family(x.family)).items()]
    return spark.createDataFrame(rows, "variant string, held_out boolean, field string, header string").withColumn("content_hash", F.sha2("variant", 256))


def _one_per_key(spark: SparkSession) -> DataFrame:
    """The last true row of each key, and whether the file repeats it."""
    of_key = Window.partitionBy("variant", "key")
    last = F.row_number().over(of_key.orderBy(F.col("row_index").desc()))
    return truth(spark).withColumns({"times": F.count("*").over(of_key), "last": last}).where("last = 1")


def injections(spark: SparkSession) -> DataFrame:
    """(variant, key, kind, expected, n): at most PER_KIND of each kind in each file, on keys that it does not repeat."""
    order = Window.partitionBy("variant").orderBy(F.pmod(F.col("k") * 48_271 + F.col("v") * 7, F.lit(2_147_483)), "key")
    chosen = _one_per_key(spark).where("times = 1").withColumn("n", F.row_number().over(order) - 1).where(f"n < {PER_KIND * len(INJECTIONS)}")
    kinds = F.array(*map(F.lit, sorted(INJECTIONS)))
    kind = F.element_at(kinds, F.pmod(F.col("n"), F.lit(len(INJECTIONS))) + 1)
    required = F.create_map(*[F.lit(x) for e in INJECTIONS.items() for x in e])
    rows = chosen.select("variant", "key", "n", "net", kind.alias("kind"))
    # without a net there is no arithmetic that a row could break
    rows = rows.where((F.col("kind") != "carrier_row_disagrees_with_itself") | F.col("net").isNotNull())
    return rows.select("variant", "key", "kind", required[F.col("kind")].alias("expected"), "n")


def carrier_ledger(spark: SparkSession) -> DataFrame:
    """The other side's rows, with what injections() changes, in the columns that operators.reconcile takes."""
    rows = _one_per_key(spark).join(injections(spark).select("key", "kind", "n"), "key", "left")
    rows = rows.where("kind IS NULL OR kind <> 'absent_from_carrier'")
    amount = (F.lit(5000) + F.col("n") * 1733).cast("decimal(18,2)") / 100
    up = F.when(F.col("kind") == "gross_off_by_one_minor_unit", F.lit("0.01").cast("decimal(18,2)")).when(F.col("kind").isin("gross_materially_different", "carrier_row_disagrees_with_itself"), amount).otherwise(F.lit(0))
    more = F.when(F.col("kind") == "deduction_changed_gross_agrees", amount).otherwise(F.lit(0))
    moved = F.when(F.col("kind") == "carrier_row_disagrees_with_itself", F.lit(0)).otherwise(up) - more
    pairs = [F.when(F.col(d).isNotNull(), F.struct(F.lit(d).alias("key"), (F.col(d) + (more if d in ("commission", "fee") else F.lit(0))).cast(MONEY).alias("value"))) for d in ("commission", "fee", "tax")]
    return rows.select("variant", "key", "currency", (F.col("gross") + up).cast(MONEY).alias("gross"), F.map_from_entries(F.array_compact(F.array(*pairs))).alias("deductions"), (F.col("net") + moved).cast(MONEY).alias("net"), F.col("row_index").cast("long").alias("spreadsheet_row"))


def answer_key(spark: SparkSession) -> DataFrame:
    """(variant, key, expected): matched, unless the file repeats the key, unless something is injected."""
    keys = _one_per_key(spark).join(injections(spark).select("key", F.col("expected").alias("injected"), "kind"), "key", "left")
    return keys.select("variant", "key", F.coalesce("injected", F.when(F.col("times") > 1, "duplicate"), F.lit("matched")).alias("expected"), "kind")
