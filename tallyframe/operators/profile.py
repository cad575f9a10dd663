"""What the columns of files hold, as counted fractions of their first non-empty cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import COMMA, DOT, plain, plain_amount, plain_is_amount, strip
from tallyframe.functions.period import looks_like_date

#: Cells of a column that are looked at, and kept as samples; limits of a categorical and of a near-constant column; from
#: what share of amounts a column is money.
HEAD, SAMPLES, RATIO, CATEGORIES, FEW, MONEY_SHARE = 200, 20, 0.2, 30, 3, 0.9


def profile_columns(cells: DataFrame) -> DataFrame:
    """One row for each (content_hash, header) with a non-empty cell among `cells` (content_hash, header, row_index, raw).

    non_empty, monetary (the better share of either convention, a tie is the point's), convention, magnitude (the upper median
    of the amounts), temporal, distinct, distinct_ratio, categorical, near_constant, samples, magnitude_rank (from 0, among
    money columns of the file, largest first). The head of a column is a feature: profiles must not depend on later rows.
    """
    by = ["content_hash", "header"]
    # most cells begin with a visible ASCII character, and are not empty
    full = cells.where(F.ascii("raw").between(33, 126) | (strip(F.col("raw")) != ""))
    head = full.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("row_index"))).where(f"i <= {HEAD}")
    # a step each, so that a cell is stripped of its dress once and read once
    bare = head.select(*by, "i", "raw", plain(F.col("raw")).alias("bare"), looks_like_date(F.col("raw")).alias("dated"))
    bare = bare.select("*", *[plain_is_amount(F.col("bare"), c).alias(f"is_{c}") for c in (DOT, COMMA)])
    read = bare.select(*by, "i", "raw", "dated", *[x for c in (DOT, COMMA) for x in (F.col(f"is_{c}"), F.when(F.col(f"is_{c}"), F.abs(plain_amount(F.col("bare"), c, reads=F.col(f"is_{c}")))).alias(f"v_{c}"))])

    def median(c: str):
        values = F.sort_array(F.collect_list(f"v_{c}"))
        return F.when(F.size(values) > 0, F.get(values, F.floor(F.size(values) / 2).cast("int")))

    counted = read.groupBy(*by).agg(
        F.count("*").alias("non_empty"),
        *[F.avg(F.col(f"is_{c}").cast("int")).alias(f"share_{c}") for c in (DOT, COMMA)],
        *[median(c).alias(f"median_{c}") for c in (DOT, COMMA)],
        F.avg(F.col("dated").cast("int")).alias("temporal"),
        F.size(F.collect_set("raw")).cast("long").alias("distinct"),  # a head is bounded, so its set is; no grouping by values
        F.sort_array(F.collect_list(F.when(F.col("i") <= SAMPLES, F.struct("i", "raw")))).getField("raw").alias("samples"),
    )
    dot = F.col(f"share_{DOT}") >= F.col(f"share_{COMMA}")
    ratio = F.col("distinct") / F.col("non_empty")
    out = counted.select(
        *by, "non_empty", F.greatest(f"share_{DOT}", f"share_{COMMA}").alias("monetary"),
        F.when(F.greatest(f"share_{DOT}", f"share_{COMMA}") > 0, F.when(dot, DOT).otherwise(COMMA)).alias("convention"),
        F.when(dot, F.col(f"median_{DOT}")).otherwise(F.col(f"median_{COMMA}")).alias("magnitude"),
        "temporal", "distinct", ratio.alias("distinct_ratio"), ((ratio <= RATIO) & (F.col("distinct") <= CATEGORIES)).alias("categorical"), (F.col("distinct") <= FEW).alias("near_constant"), "samples",
    )
    is_money = F.col("monetary") >= MONEY_SHARE
    rank = F.row_number().over(Window.partitionBy("content_hash", is_money).orderBy(F.col("magnitude").desc(), "header")) - 1
    return out.withColumn("magnitude_rank", F.when(is_money, rank))
