"""Registered queries over files and tables that the given tables are first written to, with DuckDB SQL."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.adapters import get_family
from tallyframe.functions.digests import row_hash, set_digest
from tallyframe.functions.money import COMMA, MONEY, format_amount, money_text
from tallyframe.functions.sql import register
from tallyframe.operators import canonical, documents, reconcile, reports
from tallyframe.operators.side_tables import reconcile_tables, save_side
from tallyframe.operators.store import Store
from tallyframe.plans import queries, statements
from tallyframe.sources.ranges import read_ranges
from tallyframe.sources.scratch import CODEC, scratch_path, shuffles_freed, written
from tallyframe.streaming import incremental

NOTE = 'see\npage "2"; ok'


def csv_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement files written as quoted CSV, with notes of several lines and a blank record after every tenth row, and read
    in byte ranges: every row with its true record number."""
    # together: a file's rows are in one task as they come, so that the window's is the only shuffle
    rows = statements.file_rows(spark, sf_dir, together=True).select(F.col("content_hash").alias("file"), "headers", "row_index", "cells")
    note = F.when(F.col("row_index") % 10 == 3, NOTE).otherwise("")
    cells = F.concat(F.slice("cells", 1, 6), F.array(note))
    text = F.array_join(F.transform(cells, lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))), ";")
    head = F.when(F.col("row_index") == 0, F.concat(F.array_join("headers", ";"), F.lit("\n"))).otherwise("")
    lines = rows.select("file", "row_index", F.concat(head, text, F.when(F.col("row_index") % 10 == 9, "\n").otherwise("")).alias("value"))
    path = scratch_path(spark, "statements")
    with shuffles_freed(spark):
        lines.sortWithinPartitions("file", "row_index").select("file", "value").write.partitionBy("file").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)  # tasks move their files, not the driver all of them
    read = read_ranges(spark, path, "*.txt", hashed=False)
    return read.select(F.regexp_extract("path", "/file=([^/]*)/", 1).alias("file"), "row_index", "spreadsheet_row", F.get("cells", 0).alias("reference"), F.get("cells", 2).alias("gross_raw"), F.get("cells", 6).alias("note"))


def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each file's canonical rows as a set, a sum of their hashes."""
    rows = canonical.accepted(queries._tagged(spark, sf_dir))
    hashed = row_hash(F.col("key"), F.col("currency"), money_text(F.col("gross.value")), money_text(F.col("net.value")))
    return rows.groupBy("content_hash").agg(F.count("*").alias("n_rows"), set_digest(hashed).alias("digest"))


def locate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file stored, then the places of all keys that one side lacks, by the store's index."""
    store = Store(spark, scratch_path(spark, "store"))
    store.ingest(queries._described(spark, sf_dir), queries._tagged(spark, sf_dir))
    asked = statements.expected(spark, sf_dir).where("expected = 'missing'")
    return store.locate(asked).select("key", F.col("source_content_hash").alias("content_hash"), "spreadsheet_row")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each event, around its props: a kind, and a price with marks where the event is worth 50 or more."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    amount = F.col("value").cast("decimal(18,2)")
    price = F.concat(F.lit(', "price": {"amount": '), amount.cast("string"), F.lit(', "marks": ['), (F.col("event_id") % 3).cast("string"), F.lit(', "'), (F.col("event_id") % 5).cast("string"), F.lit('"]}'))
    text = F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('", "props": '), F.col("props"), F.when(amount >= 50, price).otherwise(""), F.lit("}"))
    return events.select("user_id", "event_id", "ts", text.alias("document"))


def document_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event of a user changed against the user's event before, path by path."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _documents(spark, sf_dir).withColumn("before", F.lag("document").over(order))
    return documents.changes(rows.select("event_id", F.col("before").alias("document")), rows.select("event_id", "document"), ["event_id"])


def reconcile_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides saved as tables in buckets of their keys, then reconciled without a shuffle."""
    name = uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for side, rows in (("statement", statements.statement(spark, sf_dir)), ("ledger", statements.ledger(spark, sf_dir))):
        save_side(rows, f"{side}_{name}", scratch_path(spark, side), buckets, "ordinal")
    return reconcile_tables(spark.table(f"statement_{name}"), spark.table(f"ledger_{name}")).select("key", "status", "rule", "detail")


def reconcile_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides arrive in several files each, a third of them at a time; the statuses after the last micro-batch."""
    root, streams, cores = scratch_path(spark, "arriving"), [], spark.sparkContext.defaultParallelism
    each = -(-statements.lines(spark, sf_dir).count() // (3 * cores))
    for side, rows in (("statement", statements.statement(spark, sf_dir)), ("ledger", statements.ledger(spark, sf_dir))):
        sent, path = rows.select("key", "currency", "gross", "deductions", "net", "ordinal"), f"{root}/{side}"
        # written as the lines come, without a shuffle; the files are at least so many as one of three arrivals has cores
        sent.write.option("compression", CODEC).option("maxRecordsPerFile", max(each, 1)).parquet(path)
        n_files = len(spark.read.schema(sent.schema).parquet(path).inputFiles())
        streams.append(spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", -(-n_files // 3)).parquet(path))
    incremental.keep(incremental.statuses(*streams, ordinal="ordinal"), f"{root}/statuses", f"{root}/checkpoint").awaitTermination()
    return incremental.current(spark, f"{root}/statuses", ("key", "status", "rule"))


def amounts_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and months of orders written in many ways and read by SQL alone."""
    register(spark)
    orders = queries._orders(spark, sf_dir)
    raw = queries._dressed(orders, COMMA).join(queries._dates(spark, sf_dir).withColumnRenamed("raw", "month_raw"), "o_orderkey")
    return spark.sql("SELECT o_orderkey, money_text(parse_amount(raw, 'comma_decimal')) AS amount, normalise_period(month_raw, true) AS day_first, normalise_period(month_raw, false) AS month_first, looks_like_date(month_raw) AS dated FROM {raw}", raw=raw)


def _canonical(rows: DataFrame) -> DataFrame:
    """canonicalise() of rows, less the lineage that a report does not read."""
    tagged = canonical.canonicalise(rows, queries.COLUMNS, get_family("insurance"), queries.SENDER)
    value = lambda x: F.struct(x["value"].alias("value"))
    gross = F.struct(F.col("gross.value"), F.struct(F.col("gross.lineage.raw_value")).alias("lineage"))
    return tagged.withColumns({"gross": gross, "net": F.when(F.col("net").isNotNull(), value(F.col("net"))), **{c: F.map_from_arrays(F.map_keys(c), F.arrays_zip(F.map_values(c)["value"].alias("value"))) for c in ("deductions", "attributes")}})


def _footers(tagged: DataFrame) -> DataFrame:
    """A footer for each file, of its total: a cent off where the supplier's number is divisible by five, none where it is by seven."""
    good = canonical.accepted(tagged)
    supplier = F.substring_index("content_hash", "-", -1).cast("long")
    total = (F.sum("gross.value") + F.when(supplier % 5 == 0, F.lit(Decimal("0.01"))).otherwise(F.lit(Decimal("0.00")))).cast("decimal(18,2)")
    totals = good.groupBy("content_hash").agg(total.alias("total")).where(supplier % 7 != 0)
    cells = F.array(F.lit(""), F.lit("Total"), format_amount(F.col("total"), COMMA), *[F.lit("")] * 4)
    return totals.select("content_hash", F.lit("csv").alias("sheet"), F.array(*map(F.lit, statements.HEADERS)).alias("headers"), F.lit(1_000_000_000).cast("long").alias("row_index"), F.lit(1_000_000_002).cast("long").alias("spreadsheet_row"), cells.alias("cells"))


def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of each statement file with a footer: rows, totals, statuses against the ledger."""
    lines = written(_canonical(statements.file_rows(spark, sf_dir)), "canonical")  # for the footers, the results and the report
    tagged = lines.unionByName(written(_canonical(_footers(lines)), "footers"))
    named = F.map_from_entries(F.transform(F.map_entries("deductions"), lambda e: F.struct(F.when(e["key"] == "discount", "commission").otherwise(e["key"]).alias("key"), e["value"].cast(MONEY).alias("value"))))
    ledger = statements.ledger(spark, sf_dir).withColumn("deductions", named).withColumn("spreadsheet_row", F.col("ordinal.l_partkey"))
    results = reconcile.reconcile(canonical.flat(canonical.accepted(tagged)), ledger, evidence=False)
    report = reports.file_report(tagged, results, queries.SENDER, get_family("insurance"))
    amounts = [money_text(F.col(c)).alias(c) for c in ("computed", "declared", "difference")]
    return report.select("content_hash", "n_rows", "accepted", "quarantined", *amounts, "agrees", *reconcile.STATUSES)


QUERIES = {f.__name__: f for f in (csv_ranges, content_digests, locate_rows, document_changes, reconcile_stored, reconcile_incremental, amounts_in_sql, file_report)}

_GOOD_SIDE = queries._FILE + queries._with_rule().removeprefix(queries._LINES).replace("s AS (SELECT * FROM lines WHERE b <> 4)", "s AS (SELECT * FROM good)")
_HASHED = "sha256(" + " || ".join(f"(length({x}) || ':' || {x})" for x in ("key", "currency", queries._text("gross"), queries._text("net"))) + ")"
_LANES = " || ".join(f"format('{{:016x}}', CAST(sum(CAST('0x' || substr(h, {16 * i + 1}, 16) AS UBIGINT)) % 18446744073709551616::HUGEINT AS UBIGINT))" for i in range(4))

ORACLES = {
    "csv_ranges": f"""WITH {queries._FILE} SELECT content_hash AS file, spreadsheet_row - 2 AS row_index, spreadsheet_row + (spreadsheet_row - 2) // 10 AS spreadsheet_row, ref AS reference, gross_raw,
        CASE WHEN (spreadsheet_row - 2) % 10 = 3 THEN 'see' || chr(10) || 'page "2"; ok' ELSE '' END AS note FROM c""",
    "content_digests": f"WITH {queries._FILE} SELECT content_hash, count(*) AS n_rows, {_LANES} AS digest FROM (SELECT content_hash, {_HASHED} AS h FROM good) GROUP BY content_hash",
    "locate_rows": f"""WITH {queries._FILE}, k AS (SELECT key FROM lines GROUP BY key HAVING count(*) = 1 AND min(b) IN (3, 4))
        SELECT key, content_hash, spreadsheet_row FROM good JOIN k USING (key)""",
    "document_changes": """WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, CAST(value AS DECIMAL(18,2)) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, user_id FROM events),
        p AS (SELECT user_id, i, event_id, unnest(['kind', 'props.k', 'price.amount', 'price.marks[0]', 'price.marks[1]']) AS path, unnest(['string', 'number', 'number', 'number', 'string']) AS kind,
              unnest(['"' || event_type || '"', k, CASE WHEN v >= 50 THEN regexp_replace(regexp_replace(CAST(v AS VARCHAR), '0+$', ''), '[.]$', '') END, CASE WHEN v >= 50 THEN CAST(event_id % 3 AS VARCHAR) END, CASE WHEN v >= 50 THEN '"' || (event_id % 5) || '"' END]) AS value FROM e),
        b AS (SELECT n.event_id, n.path, o.value AS old_value, n.value AS new_value, n.kind FROM p n LEFT JOIN p o ON o.user_id = n.user_id AND o.i = n.i - 1 AND o.path = n.path)
        SELECT event_id, path, CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN old_value IS NOT NULL THEN kind END AS old_kind, old_value,
               CASE WHEN new_value IS NOT NULL THEN kind END AS new_kind, new_value FROM b WHERE old_value IS DISTINCT FROM new_value""",
    "amounts_in_sql": f"SELECT a.o_orderkey, amount, day_first, month_first, dated FROM ({queries._SIGNED}) a JOIN ({queries.ORACLES['normalise_period_forms']}) p ON p.o_orderkey = a.o_orderkey JOIN ({queries.ORACLES['date_likeness']}) d ON d.o_orderkey = a.o_orderkey",
    "reconcile_incremental": queries.ORACLES["reconcile_status"],
    "reconcile_stored": f"""WITH {queries._with_rule()} SELECT key, status, rule, CASE rule WHEN 'repeated_key' THEN CAST(greatest(ns, nl) AS VARCHAR) || ' rows have this key in the ' || CASE WHEN ns > 1 THEN 'statement' ELSE 'ledger' END
        WHEN 'absent_on_one_side' THEN 'only in the ' || CASE WHEN ns = 0 THEN 'ledger' ELSE 'statement' END || ': ' || {queries._text('coalesce(sg, lg)')} WHEN 'currency_disagreement' THEN sc || ' against ' || lc
        WHEN 'internal_arithmetic' THEN CASE WHEN sg - sd - st <> sn THEN 'statement: net ' || {queries._text('sn')} || ', gross less deductions ' || {queries._text('sg - sd - st')} ELSE 'ledger: net ' || {queries._text('ln')} || ', gross less deductions ' || {queries._text('lg - ld - lt')} END
        WHEN 'field_present_on_one_side' THEN 'on one side only: net' WHEN 'all_fields_agree' THEN 'all fields agree'
        ELSE concat_ws('; ', CASE WHEN sd <> ld THEN 'discount differs by ' || {queries._text('sd - ld')} END, CASE WHEN sg <> lg THEN 'gross differs by ' || {queries._text('sg - lg')} END, CASE WHEN sn <> ln THEN 'net differs by ' || {queries._text('sn - ln')} END, CASE WHEN st <> lt THEN 'tax differs by ' || {queries._text('st - lt')} END) END AS detail FROM q""",
    "file_report": f"""WITH {_GOOD_SIDE}, sums AS (SELECT content_hash, count(*) AS accepted, sum(gross) AS computed, sum(gross) + CASE WHEN any_value(l_suppkey) % 5 = 0 THEN 0.01 ELSE 0 END AS declared FROM good GROUP BY content_hash),
        n AS (SELECT content_hash, count(*) AS n_rows, any_value(l_suppkey) % 7 <> 0 AS footed FROM c GROUP BY content_hash),
        st AS (SELECT content_hash, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in reconcile.STATUSES)} FROM good JOIN q USING (key) GROUP BY content_hash)
        SELECT content_hash, n_rows + CAST(footed AS BIGINT) AS n_rows, accepted, n_rows + CAST(footed AS BIGINT) - accepted AS quarantined, {queries._text('computed')} AS computed, CASE WHEN footed THEN {queries._text('declared')} END AS declared,
               CASE WHEN footed THEN {queries._text('declared - computed')} END AS difference, NOT footed OR declared = computed AS agrees, {", ".join(reconcile.STATUSES)} FROM n JOIN sums USING (content_hash) JOIN st USING (content_hash)""",
}
