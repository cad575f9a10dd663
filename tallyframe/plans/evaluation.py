"""The whole corpus of fixtures through the library, graded against its answer key: the blocks of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.adapters import get_family
from tallyframe.fixtures import corpus
from tallyframe.functions.money import COMMA, DOT, parse_amount
from tallyframe.functions.text import frame_digest
from tallyframe.operators import canonical, mapping, reconcile
from tallyframe.operators.store import Store
from tallyframe.plans.bordereau import outcomes_of, tag

FAMILIES = ("insurance", "marketplace")
DECLARED = canonical.Profile("corpus", None, None, None)


def _both(make) -> DataFrame:
    first, second = (make(get_family(f)) for f in FAMILIES)
    return first.unionByName(second)


def _of(spark: SparkSession, family) -> DataFrame:
    return corpus.file_rows(spark).where(F.col("family") == family.name)


def outcomes(spark: SparkSession) -> DataFrame:
    """The mapping of every file."""
    return _both(lambda family: outcomes_of(_of(spark, family), family))


def tagged(spark: SparkSession) -> DataFrame:
    """The canonical rows and the quarantine of every file that could be mapped."""
    return _both(lambda family: tag(_of(spark, family), outcomes_of(_of(spark, family), family), family, DECLARED))


def results(spark: SparkSession) -> DataFrame:
    """Every file against the other side, with variant and held_out. Rows that only the other side is to have are taken out."""
    only_there = corpus.injections(spark).where("kind = 'carrier_only'").select("key")
    statement = canonical.flat(canonical.accepted(tagged(spark))).join(only_there, "key", "left_anti")
    found = reconcile.reconcile(statement, corpus.carrier_ledger(spark))
    number = F.regexp_extract("key", "^(POL|ORD)-([0-9]+)-", 2).cast("int")
    named = corpus.layouts(spark).select("number", "variant", "family", "held_out")
    return found.withColumn("number", number).join(F.broadcast(named), "number").drop("number")  # eighteen rows


def reconciliation_block(spark: SparkSession) -> DataFrame:
    """By split: rows reconciled, disagreements injected, false matches by the answer key and by the results themselves, and
    rows whose status is not the required one."""
    graded = results(spark).join(corpus.answer_key(spark).select("key", "expected", "kind"), "key", "left").withColumn("expected", F.coalesce("expected", F.lit("matched")))
    return graded.groupBy("held_out").agg(F.count("*").alias("rows"), F.count("kind").alias("injected"), F.count_if((F.col("status") == "matched") & (F.col("expected") != "matched")).alias("false_matched"), F.count_if(F.col("status") != F.col("expected")).alias("status_disagreements"), F.count_if(reconcile.unproven()).alias("unproven_matches"))


def mapping_block(spark: SparkSession) -> DataFrame:
    """By split and method: fields whose column is the true one, of all fields of all files, unmappable ones too."""
    system = outcomes(spark).select(F.lit("system").alias("method"), "content_hash", F.inline("assigned")).drop("combined")
    headers = _both(lambda family: mapping.by_name(mapping.headers_of(_of(spark, family)), family))
    truth = corpus.true_mapping(spark)
    graded = mapping.accuracy(system.unionByName(headers), truth.select("content_hash", "field", "header"))
    splits = truth.select("content_hash", "held_out").distinct()
    return graded.join(splits, "content_hash").groupBy("held_out", "method").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))


def lineage_block(spark: SparkSession) -> DataFrame:
    cells = canonical.lineage_rows(canonical.accepted(tagged(spark)))
    return cells.agg(F.count("*").alias("checked"), F.count_if(~canonical.is_complete()).alias("missing"))


def lineage_gaps(spark: SparkSession, examples: int = 10) -> DataFrame:
    """The first few values without complete lineage, as a report shows them."""
    return canonical.lineage_rows(canonical.accepted(tagged(spark))).where(~canonical.is_complete()).orderBy("key", "field").limit(examples)


def abstention_block(spark: SparkSession) -> DataFrame:
    """Of the files that cannot be mapped: how many abstained, and the rows of theirs that came through."""
    files = corpus.layouts(spark).where("NOT mappable").select(F.sha2("variant", 256).alias("content_hash"))
    rows = tagged(spark).groupBy("content_hash").agg(F.count("*").alias("n"))
    seen = files.join(outcomes(spark).select("content_hash", "mappable"), "content_hash", "left").join(rows, "content_hash", "left")
    return seen.agg(F.count("*").alias("unmappable"), F.count_if(~F.col("mappable")).alias("abstained"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_written"))


def portability_block(spark: SparkSession) -> DataFrame:
    """Rows reconciled by family: one engine for both."""
    return results(spark).groupBy("family").agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "matched").alias("matched"))


def corpus_card(spark: SparkSession) -> DataFrame:
    """By file: true rows, canonical rows and rows in quarantine."""
    seen = tagged(spark).groupBy("content_hash").agg(F.count_if(F.col("quarantine_reason").isNull()).alias("canonical"), F.count_if(F.col("quarantine_reason").isNotNull()).alias("quarantined"))
    named = corpus.layouts(spark).select("variant", F.when(F.col("mappable"), F.col("n_rows")).otherwise(0).alias("true_rows"), F.sha2("variant", 256).alias("content_hash"))
    return named.join(seen, "content_hash", "left").select("variant", "true_rows", F.coalesce("canonical", F.lit(0)).alias("canonical"), F.coalesce("quarantined", F.lit(0)).alias("quarantined"))


def lost_to_quarantine(spark: SparkSession) -> DataFrame:
    """(variant, key): true rows that did not come through, though they were not injected to be missing."""
    there = canonical.accepted(tagged(spark)).select("key")
    return corpus.answer_key(spark).where("expected <> 'missing'").join(there, "key", "left_anti").select("variant", "key")


def totals_block(spark: SparkSession) -> DataFrame:
    """Declared totals of the files that have a footer against the sum of their rows."""
    rows = canonical.accepted(tagged(spark)).groupBy("content_hash").agg(F.sum("gross.value").cast("decimal(18,2)").alias("computed"))
    files = corpus.file_rows(spark).join(outcomes(spark).where("mappable").select("content_hash", "mapping"), "content_hash")
    at = F.array_position("headers", F.coalesce(F.col("mapping")["gross_premium"], F.col("mapping")["gross_sales"])).cast("int") - 1
    last = files.groupBy("content_hash", "variant", "convention").agg(F.max_by(F.struct("cells", at.alias("at")), "row_index").alias("x")).where(F.array_contains("x.cells", "TOTAL"))
    raw = F.get("x.cells", F.col("x.at"))
    declared = F.when(F.col("convention") == DOT, parse_amount(raw, DOT)).otherwise(parse_amount(raw, COMMA))
    return last.select("content_hash", "variant", declared.alias("declared")).join(rows, "content_hash").select("variant", (F.col("declared") == F.col("computed")).alias("agrees"))


def idempotency_block(spark: SparkSession, root: str, times: int = 3) -> DataFrame:
    """All files ingested some times: files stored each time, and the rows of the store's tables at the end. The rows are
    canonicalised once and kept beside the store."""
    store = Store(spark, root)
    rows = tagged(spark)
    rows.write.mode("overwrite").parquet(f"{root}/canonical")
    rows = spark.read.schema(rows.schema).parquet(f"{root}/canonical")
    named = corpus.layouts(spark).where("mappable").select(F.sha2("variant", 256).alias("content_hash"), F.lit("corpus").alias("sender"), F.concat_ws(".", "variant", "file").alias("filename"), "family", F.lit(1).alias("mapping_version"))
    stored = [store.ingest(named, rows) for _ in range(times)]
    counts = [(f"stored, time {i}", n) for i, n in enumerate(stored, 1)] + sorted(store.counts().items())
    return spark.createDataFrame(counts, "what string, n long")


def determinism_block(spark: SparkSession) -> DataFrame:
    """Whether two runs, one over rows dealt differently, have the same digest of canonical rows and of statuses."""
    statuses = [results(spark).select("key", "status", "rule", "detail"), results(spark).repartition(5, "status").select("key", "status", "rule", "detail")]
    return frame_digest(statuses[0]).union(frame_digest(statuses[1])).agg((F.countDistinct("digest") == 1).alias("agrees"))
