"""What lies on disk and is shuffled while large tables are taken through."""

import hashlib
import itertools
import os
import re
import time

from pyspark.sql import functions as F

from tallyframe.adapters import get_family
from tallyframe.functions.text import frame_digest
from tallyframe.operators import canonical
from tallyframe.operators.store import Store
from tallyframe.plans import queries, statements
from tallyframe.sources import scratch
from tallyframe.streaming import incremental

SF = "/root/testdata/sf0.001"


def shuffle_blocks(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if "shuffle" in str(blocks.apply(i))}


def exchanges(df):
    """The columns of each exchange of a plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [re.search(r"Input \[\d+\]: \[(.*)\]", part)[1] for part in plan.split("\n\n") if re.search(r"^\(\d+\) Exchange", part, re.M)]


def test_shuffles_of_a_written_table_are_freed(spark):
    before, was = shuffle_blocks(spark), spark.conf.get(scratch._CLEANUP)
    table = scratch.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids")), "groups")
    until = time.time() + 20
    while shuffle_blocks(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_blocks(spark) - before and spark.conf.get(scratch._CLEANUP) == was
    assert table.select(F.explode("ids")).count() == 1000


def test_lines_of_files_are_shuffled_before_they_are_texts(spark):
    (sent,) = exchanges(statements.file_rows(spark, SF))
    assert "l_shipdate" in sent and not re.search("ref|period|cells|headers|key#", sent.replace("l_orderkey", "").replace("l_partkey", "").replace("l_suppkey", ""))


def test_rows_prepared_once_are_stored_with_their_lineage(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    tagged = canonical.canonicalise(statements.file_rows(spark, SF), queries.COLUMNS, get_family("insurance"), queries.SENDER)
    rows = store.prepare(tagged)
    assert "array<struct" not in rows.selectExpr("*").schema.simpleString()  # what values share is not repeated for each of them
    for version in (1, 2, 2):
        store.ingest(queries._described(spark, SF, version), rows, replay=version > 1)
    whole = Store(spark, f"file://{tmp_path}/whole")
    whole.ingest(queries._described(spark, SF), tagged)
    stored = lambda s, version=1: sorted(map(str, s.table("ledger_row").where(F.col("mapping_version") == version).drop("ingest", "mapping_version").collect()))
    assert stored(store) == stored(store, 2) == stored(whole) and len(stored(store)) > 5000
    own = {(r.key, r.spreadsheet_row, r.field, r.column, r.raw_value) for r in canonical.lineage_rows(canonical.accepted(tagged)).join(canonical.accepted(tagged).select("key", F.col("spreadsheet_row")), "key").collect()}
    kept = store.table("ledger_row").where("mapping_version = 1").select("key", "spreadsheet_row", "source_content_hash", F.explode("lineage").alias("x"))
    got = kept.select("key", "spreadsheet_row", "x.cell.column", "x.raw_value", (F.col("x.source_content_hash") == F.col("source_content_hash")).alias("same"), "x.cell.sheet", "x.cell.row", "x.mapping_version").collect()
    assert {(r.key, r.spreadsheet_row, r.column, r.raw_value) for r in got} <= {(k, n, c, t) for k, n, _, c, t in own}
    assert all(r.same and r.sheet == "csv" and r.row == r.spreadsheet_row and r.mapping_version == 1 for r in got)


def test_digests_are_counted_in_the_same_pass(spark):
    rows = spark.range(3000).select((F.col("id") % 1000).alias("id"), F.col("id").cast("string").alias("t"))
    hashes = sorted(hashlib.sha256(f'{{"id":{i % 1000},"t":"{i}"}}'.encode()).hexdigest() for i in range(3000))
    parts = ["\n".join(part) for _, part in itertools.groupby(hashes, lambda h: h[:4])]
    want = hashlib.sha256("\n".join(hashlib.sha256(p.encode()).hexdigest() for p in parts).encode()).hexdigest()
    assert tuple(frame_digest(rows.repartition(5, "t"), counted=True).first()) == (want, 3000) and tuple(frame_digest(rows).first()) == (want,)
    assert frame_digest(rows.limit(0), counted=True).first().n == 0


def test_runs_of_the_results_digest_leave_no_shuffles(spark):
    before = shuffle_blocks(spark)
    found = queries.results_digest(spark, SF)
    until = time.time() + 20
    while shuffle_blocks(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_blocks(spark) - before and [r[0] for r in found.collect()][1] == 1


def test_a_commit_of_a_stream_writes_what_changed(spark, tmp_path):
    sides = statements.ledger(spark, SF).select("key", "currency", "gross", "deductions", "net", "ordinal")
    sides.repartition(3).write.parquet(f"{tmp_path}/in")
    side = spark.readStream.schema(sides.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = incremental.keep(incremental.statuses(side, side, ordinal="ordinal"), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    query.awaitTermination()
    kept = [name for _, _, names in os.walk(f"{tmp_path}/checkpoint/state") for name in names]
    assert any(name.endswith(".changelog") for name in kept) and not any(name.endswith(".sst") for name in kept)
    narrow = incremental.current(spark, f"file://{tmp_path}/out", ("key", "status"))
    assert narrow.columns == ["key", "status"] and sorted(narrow.collect()) == sorted(incremental.current(spark, f"file://{tmp_path}/out").select("key", "status").collect())
