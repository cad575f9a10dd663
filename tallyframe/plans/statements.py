"""A statement and a ledger made from the `lineitem` table, with planted differences, and cells of a statement file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import COMMA, MONEY, format_amount
from tallyframe.functions.text import identity


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is taken of the lines, amounts to the cent. Where lines are shuffled it is these narrow rows, not the texts made of them."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("l_extendedprice", "l_discount", "l_tax")])


def base(spark: SparkSession, sf_dir: str, dealt: DataFrame | None = None) -> DataFrame:
    """One row for each line: ref, period, key, amounts to the cent, b (which decides what is planted) and an ordinal. dealt: lines()
    in other tasks and another order."""
    return _worked_out(lines(spark, sf_dir) if dealt is None else dealt)


def _worked_out(rows: DataFrame, *kept: str) -> DataFrame:
    gross, d, t = (F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax"))
    ref = F.concat(F.lit("ORD-"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit("-"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"))
    rows = rows.select(
        ref.alias("ref"), F.date_format("l_shipdate", "yyyy-MM").alias("period"), F.lit("GBP").alias("currency"), gross.alias("gross"), F.round(gross * d, 2).cast("decimal(18,2)").alias("discount"), F.round(gross * t, 2).cast("decimal(18,2)").alias("tax"),
        ((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 97).alias("b"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", *kept,
    )
    return rows.withColumns({"net": (F.col("gross") - F.col("discount") - F.col("tax")).cast("decimal(18,2)"), "key": identity(F.col("ref"), F.col("period")), "ordinal": F.struct("l_partkey", "l_suppkey", "gross", "l_quantity")})


def sides(rows: DataFrame) -> DataFrame:
    return rows.select("key", "ref", "period", "currency", F.col("gross").cast(MONEY).alias("gross"), F.create_map(F.lit("discount"), F.col("discount").cast(MONEY), F.lit("tax"), F.col("tax").cast(MONEY)).alias("deductions"), F.col("net").cast(MONEY).alias("net"), "ordinal", "l_suppkey")


def statement(spark: SparkSession, sf_dir: str, dealt: DataFrame | None = None) -> DataFrame:
    return sides(base(spark, sf_dir, dealt).where("b <> 4"))


def ledger(spark: SparkSession, sf_dir: str, dealt: DataFrame | None = None) -> DataFrame:
    changed = base(spark, sf_dir, dealt).where("b <> 3").withColumns({
        "gross": F.expr("CASE b WHEN 0 THEN gross + 0.01 WHEN 1 THEN gross + 123.45 WHEN 5 THEN gross + 77 ELSE gross END"),
        "discount": F.expr("CASE b WHEN 2 THEN discount + 5 ELSE discount END"),
        "net": F.expr("CASE b WHEN 0 THEN net + 0.01 WHEN 1 THEN net + 123.45 WHEN 2 THEN net - 5 WHEN 6 THEN NULL ELSE net END"),
        "currency": F.expr("CASE b WHEN 7 THEN 'EUR' ELSE currency END"),
    })
    return sides(changed)


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer key: (key, expected) of planted keys, and of repeated keys, which come first."""
    rows = base(spark, sf_dir).groupBy("key").agg(F.min("b").alias("b"), F.count("*").alias("n"))
    status = F.when(F.col("n") > 1, "duplicate").when(F.col("b") <= 2, "mismatch").when(F.col("b") <= 4, "missing").when(F.col("b") <= 7, "review").otherwise("matched")
    return rows.select("key", status.alias("expected"))


HEADERS = ("Risk Reference", "Underwriting Period", "Gross Written Premium", "IPT Amount", "Commission Payable", "Settlement Amount", "Note")


def file_rows(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Lines as the rows of one statement file per supplier, all text, decimal commas; some cells are spoilt: every 50th
    line's gross, every 60th line's period, every 70th line's gross is blank."""
    # together: the window is over the file itself, so that what is grouped by file, or by file and header, needs no other shuffle.
    # Not where rows are united with others of their file: Spark 4.1 takes such a union for partitioned by file, drops a
    # repartition of it, and may then merge the parts of its sides differently (csv_ranges lost its headers at sf0.1).
    place = Window.partitionBy("content_hash" if together else "l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")  # the ordinal, of lines of one supplier
    named = lines(spark, sf_dir).withColumn("content_hash", F.concat(F.lit("file-"), F.col("l_suppkey").cast("string")))
    rows = _worked_out(named.withColumn("row_index", F.row_number().over(place).cast("long") - 1), "content_hash", "row_index")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    gross = F.when(n % 50 == 0, "n/a").when(n % 70 == 0, "").otherwise(format_amount(F.col("gross"), COMMA, code="GBP"))
    period = F.when(n % 60 == 0, "TBC").otherwise(F.concat(F.substring("period", 6, 2), F.lit("/"), F.substring("period", 1, 4)))
    cells = F.array("ref", period, gross, format_amount(F.col("tax"), COMMA), format_amount(F.col("discount"), COMMA), format_amount(F.col("net"), COMMA), F.lit(""))
    return rows.select("content_hash", F.lit("csv").alias("sheet"), F.array(*map(F.lit, HEADERS)).alias("headers"), "row_index", (F.col("row_index") + 2).alias("spreadsheet_row"), cells.alias("cells"))
