"""What came of each file, in one grouped pass over its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.adapters import KEY, PERIOD, Family
from tallyframe.functions.money import MONEY, parse_amount, strip
from tallyframe.operators.canonical import Profile
from tallyframe.operators.reconcile import STATUSES


def file_report(tagged: DataFrame, results: DataFrame, profile: Profile, family: Family) -> DataFrame:
    """For each file: content_hash, n_rows, accepted, quarantined, computed, last_amount, declared, difference, agrees, and how many
    of its canonical rows have each status.

    tagged: canonicalise() of the files' rows; results: reconcile() of the canonical ones. computed: the sum of the canonical
    rows' gross. last_amount: the last non-empty cell of the gross column, null if it is no amount. It is the file's declared
    total if its row is a footer: no canonical row, and without a reference or a period; a row that has both is a held row of the
    file, whatever it is held for. A file without a footer declares nothing and agrees. A file all of whose rows are held has
    counts and no sum.
    """
    raw = F.col("gross.lineage.raw_value")
    named = [F.coalesce(strip(F.col("attributes")[f]["value"]) != "", F.lit(False)) for role in (KEY, PERIOD) for f in family.of_role(role)[:1]]
    rows = tagged.select("content_hash", "spreadsheet_row", "key", F.col("quarantine_reason").isNull().alias("ok"), (F.col("quarantine_reason").isNull() | reduce(lambda a, b: a & b, named)).alias("named"), F.col("gross.value").alias("gross"), raw.alias("raw"), (strip(raw) != "").alias("filled"))
    status = results.select(F.col("key").alias("_key"), "status")
    rows = rows.join(status, F.col("ok") & (F.col("key") == F.col("_key")), "left")
    last = F.max_by(F.struct("raw", "named"), F.when(F.col("filled"), F.col("spreadsheet_row")))
    counts = [F.count_if(F.col("ok") & (F.col("status") == s)).alias(s) for s in STATUSES]
    files = rows.groupBy("content_hash").agg(F.count("*").alias("n_rows"), F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("quarantined"), F.sum(F.when(F.col("ok"), F.col("gross"))).cast(MONEY).alias("computed"), last.alias("last"), *counts)
    amount = parse_amount(F.col("last.raw"), profile.convention).cast(MONEY)
    files = files.withColumn("last_amount", amount).withColumn("declared", F.when(~F.col("last.named"), amount))
    difference = (F.col("declared") - F.coalesce("computed", F.lit(0).cast(MONEY))).cast(MONEY)
    return files.select("content_hash", "n_rows", "accepted", "quarantined", "computed", "last_amount", "declared", difference.alias("difference"), F.coalesce(difference == 0, F.lit(True)).alias("agrees"), *STATUSES)
