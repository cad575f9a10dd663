"""Reconciling a statement with a ledger, by key.

Both sides are first reduced to one row for each key (count, first row in input order), so repeated keys never multiply, and
then meet in one full outer join on the same hash of the key. Status and evidence are one CASE in a fixed order: repeated key,
presence, currency, each row's own arithmetic, fields on one side only, differences beyond tolerance. Only what is left matches,
and every test passes on a proven TRUE alone: an unknown currency or gross is never taken for agreement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.money import EXACT, MONEY, Tolerance, forbid_floats

STATUSES = ("matched", "mismatch", "missing", "duplicate", "ambiguous", "review")
RULES = ("repeated_key", "absent_on_one_side", "currency_disagreement", "internal_arithmetic", "field_present_on_one_side", "field_difference", "all_fields_agree")
_DISCREPANCY = f"array<struct<field:string,statement:{MONEY},ledger:{MONEY},difference:{MONEY},within_tolerance:boolean,tolerance_applied:string>>"


def known(deductions: Column) -> Column:
    """The deductions that have an amount; none for a null map. A null amount is an absent deduction, never zero."""
    return F.map_filter(F.coalesce(deductions, F.create_map().cast(f"map<string,{MONEY}>")), lambda k, v: v.isNotNull())


def net_of_deductions(gross: Column, deductions: Column) -> Column:
    total = F.aggregate(F.map_values(known(deductions)), F.lit(0).cast("decimal(28,4)"), lambda a, x: (a + x).cast("decimal(28,4)"))
    return (gross.cast("decimal(28,4)") - total).cast(MONEY)


def arithmetic_holds(gross: Column, deductions: Column, net: Column) -> Column:
    """Whether gross less deductions is net; null where there is no net, false where there is no gross to hold it against."""
    return F.when(net.isNotNull(), F.coalesce(net_of_deductions(gross, deductions) == net, F.lit(False)))


def one_per_key(side: DataFrame, ordinal: str) -> DataFrame:
    """key, n (its rows), r (the first of them)."""
    row = F.struct("currency", "gross", "deductions", "net")
    return side.groupBy("key").agg(F.count("*").alias("n"), F.min_by(row, F.col(ordinal)).alias("r"))


def _fields(row: Column) -> Column:
    """gross, deductions and net as one map, without those that are null. A deduction called gross or net is shown as
    deductions.gross or deductions.net, so that it is compared with its like alone."""
    named = F.transform_keys(known(row["deductions"]), lambda k, v: F.when((k.endswith("gross") | k.endswith("net")) & k.rlike(r"^(deductions\.)*(gross|net)\z"), F.concat(F.lit("deductions."), k)).otherwise(k))
    own = [F.when(row[name].isNotNull(), F.create_map(F.lit(name), row[name].cast(MONEY))).otherwise(F.create_map().cast(f"map<string,{MONEY}>")) for name in ("gross", "net")]
    return F.map_concat(own[0], named, own[1])


def pair(statement: DataFrame, ledger: DataFrame, ordinal: str = "spreadsheet_row") -> DataFrame:
    """key, n_s, n_l (rows on either side, 0 if none), s, l (the first row of each side)."""
    forbid_floats(statement, ["gross", "net"])
    forbid_floats(ledger, ["gross", "net"])
    return meet(one_per_key(statement, ordinal), one_per_key(ledger, ordinal))


def meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """pair() of sides that have one row for each key."""
    both = a.select("key", F.col("n").alias("n_s"), F.col("r").alias("s")).join(b.select("key", F.col("n").alias("n_l"), F.col("r").alias("l")), "key", "full_outer")
    return both.select("key", F.coalesce("n_s", F.lit(0)).alias("n_s"), F.coalesce("n_l", F.lit(0)).alias("n_l"), "s", "l")


def reconcile(statement: DataFrame, ledger: DataFrame, tolerance: Tolerance = EXACT, ordinal: str = "spreadsheet_row", evidence: bool = True) -> DataFrame:
    """One row for each key on either side: key, status, rule, detail, discrepancies, one_sided, candidate_keys, n_s, n_l, s, l; without
    evidence key, status and rule, which take less time.

    Sides have key, currency, gross, deductions (MAP of decimals), net (null if absent) and an ordinal that gives the input's
    order. A field on one side only is never compared with zero. Null deductions, and null amounts among them, are absent. A
    null currency, on either side or both, is no agreement; a row without a gross does not hold by itself. Rows with a null
    key match nothing: they are missing, or duplicate if there are several. Other columns do not matter.
    """
    return decide(pair(statement, ledger, ordinal), tolerance, evidence)


def _same() -> Column:
    """Whether both sides say the same, amount by amount; then only their arithmetic is left to be tested. Not known where a gross or
    the deductions are null."""
    deductions = [f(F.col("s.deductions")) == f(F.col("l.deductions")) for f in (F.map_keys, F.map_values)]
    return F.coalesce((F.col("n_s") == 1) & (F.col("n_l") == 1) & (F.col("s.gross") == F.col("l.gross")) & F.col("s.net").eqNullSafe(F.col("l.net")) & deductions[0] & deductions[1], F.lit(False))


def decide(pairs: DataFrame, tolerance: Tolerance = EXACT, evidence: bool = True) -> DataFrame:
    """reconcile() of the rows that pair() gives."""
    # where only the status is asked for, fields are compared one by one only in rows whose sides are not the same
    pairs = pairs.withColumn("same", F.lit(False) if evidence else _same())
    rows = pairs.withColumns({f"f{x}": F.when(~F.col("same"), _fields(F.col(x))) for x in "sl"})
    single = (F.col("n_s") == 1) & (F.col("n_l") == 1)
    names = F.array_sort(F.array_union(F.map_keys("fs"), F.map_keys("fl")))
    rows = rows.select("*", F.when(single & ~F.col("same"), names).alias("names"), single.alias("single"))

    def compared(f: Column) -> Column:
        x, y = F.try_element_at("fs", f), F.try_element_at("fl", f)
        d = (x - y).cast(MONEY)
        return F.struct(f.alias("field"), x.alias("statement"), y.alias("ledger"), d.alias("difference"), tolerance.accepts(f, d).alias("within_tolerance"), tolerance.text(f).alias("tolerance_applied"))

    in_both = F.filter("names", lambda f: F.map_contains_key("fs", f) & F.map_contains_key("fl", f))
    in_one = F.filter("names", lambda f: F.map_contains_key("fs", f) != F.map_contains_key("fl", f))
    rows = rows.select("*", F.transform(in_both, compared).alias("all_d"), in_one.alias("one_sided"))
    bad_s, bad_l = (F.col(f"{x}.gross").isNull() | ~F.coalesce(arithmetic_holds(F.col(f"{x}.gross"), F.col(f"{x}.deductions"), F.col(f"{x}.net")), F.lit(True)) for x in "sl")
    outside = F.filter("all_d", lambda d: ~F.coalesce(d["within_tolerance"], F.lit(False)))
    rule = (
        F.when((F.col("n_s") > 1) | (F.col("n_l") > 1), "repeated_key")
        .when(~F.col("single"), "absent_on_one_side")
        .when(~F.coalesce(F.col("s.currency") == F.col("l.currency"), F.lit(False)), "currency_disagreement")
        .when(bad_s | (~F.col("same") & bad_l), "internal_arithmetic")
        .when(F.col("same"), "all_fields_agree")
        .when(F.size("one_sided") > 0, "field_present_on_one_side")
        .when(F.size(outside) > 0, "field_difference")
        .otherwise("all_fields_agree")
    )
    rows = rows.select("*", rule.alias("rule"), *[bad_s.alias("bad_s"), outside.alias("outside")] * evidence)
    status = F.when(F.col("rule") == "repeated_key", "duplicate").when(F.col("rule") == "absent_on_one_side", "missing").when(F.col("rule") == "field_difference", "mismatch").when(F.col("rule") == "all_fields_agree", "matched").otherwise("review")
    if not evidence:
        return rows.select("key", F.inline(F.array(F.struct(status.alias("status"), F.col("rule")))))
    text = lambda c: c.cast("decimal(18,2)").cast("string")
    side = F.when(F.col("bad_s"), F.col("s")).otherwise(F.col("l"))
    detail = (
        F.when(F.col("rule") == "repeated_key", F.concat(F.greatest("n_s", "n_l").cast("string"), F.lit(" rows have this key in the "), F.when(F.col("n_s") > 1, "statement").otherwise("ledger")))
        .when(F.col("rule") == "absent_on_one_side", F.concat(F.lit("only in the "), F.when(F.col("n_s") == 0, "ledger").otherwise("statement"), F.lit(": "), F.coalesce(text(F.coalesce(F.col("s.gross"), F.col("l.gross"))), F.lit("no gross"))))
        .when(F.col("rule") == "currency_disagreement", F.concat(F.coalesce("s.currency", F.lit("none")), F.lit(" against "), F.coalesce("l.currency", F.lit("none"))))
        .when(F.col("rule") == "internal_arithmetic", F.concat(F.when(F.col("bad_s"), "statement").otherwise("ledger"), F.lit(": net "), F.coalesce(text(side["net"]), F.lit("none")), F.lit(", gross less deductions "), F.coalesce(text(net_of_deductions(side["gross"], side["deductions"])), F.lit("unknown"))))
        .when(F.col("rule") == "field_present_on_one_side", F.concat(F.lit("on one side only: "), F.array_join("one_sided", ", ")))
        .when(F.col("rule") == "field_difference", F.array_join(F.transform("outside", lambda d: F.concat(d["field"], F.lit(" differs by "), text(d["difference"]))), "; "))
        .otherwise(F.when(F.exists("all_d", lambda d: d["difference"] != 0), F.lit(f"all fields agree within {tolerance.absolute}")).otherwise("all fields agree"))
    )
    shown = F.when(F.col("rule").isin("field_present_on_one_side", "field_difference", "all_fields_agree"), F.col("all_d")).otherwise(F.array().cast(_DISCREPANCY))
    # inline() keeps filters on the outcome from repeating the comparison
    outcome = F.struct(status.alias("status"), F.col("rule"), detail.alias("detail"), shown.alias("discrepancies"), F.when(F.col("rule") == "field_present_on_one_side", F.col("one_sided")).otherwise(F.array().cast("array<string>")).alias("one_sided"), F.when(F.col("rule") == "repeated_key", F.array("key")).otherwise(F.array().cast("array<string>")).alias("candidate_keys"))
    return rows.select("key", "n_s", "n_l", "s", "l", F.inline(F.array(outcome)))


def discrepancies(results: DataFrame) -> DataFrame:
    return results.select("key", "status", F.explode("discrepancies").alias("d")).select("key", "status", "d.*")


def by_status(results: DataFrame) -> DataFrame:
    """(status, n) of all six statuses, zeros included."""
    spark = results.sparkSession
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = results.groupBy("status").agg(F.count("*").alias("n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def unproven() -> Column:
    """Whether a result matches although a compared field is not proven to be within tolerance, or none was compared."""
    proven = F.coalesce((F.size("discrepancies") > 0) & F.forall("discrepancies", lambda d: F.coalesce(d["within_tolerance"], F.lit(False))), F.lit(False))
    return (F.col("status") == "matched") & ~proven


def false_matched(results: DataFrame) -> DataFrame:
    """Unproven matches: there are none unless the CASE is broken."""
    return results.where(unproven())


def batch_totals(rows: DataFrame, declared: DataFrame, by: list[str], amount: str = "gross") -> DataFrame:
    """by, rows_summed, computed, declared, difference, agrees. A batch that declares nothing agrees."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("rows_summed"), F.sum(amount).cast(MONEY).alias("computed"))
    both = sums.join(declared.select(*by, "declared"), by, "left")
    return both.select(*by, "rows_summed", "computed", "declared", (F.col("declared") - F.col("computed")).cast(MONEY).alias("difference"), F.coalesce(F.col("declared") == F.col("computed"), F.lit(True)).alias("agrees"))


def grade(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Results against an answer key (key, expected; other keys are expected to match): key, expected, status, agrees,
    false_match. A key that was not reported has a null status."""
    both = results.select("key", "status").join(expected, "key", "full_outer").withColumn("expected", F.coalesce("expected", F.lit("matched")))
    return both.select("key", "expected", "status", F.col("status").eqNullSafe(F.col("expected")).alias("agrees"), F.coalesce((F.col("status") == "matched") & (F.col("expected") != "matched"), F.lit(False)).alias("false_match"))
