"""Files as they arrive: a binary-file stream whose micro-batches go through the batch pipeline, all files of one in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.adapters import Family
from tallyframe.operators import canonical
from tallyframe.operators.store import Store
from tallyframe.plans.bordereau import outcomes_of, tag
from tallyframe.sources import grid

BINARY = "path string, modificationTime timestamp, length long, content binary"


def ingest_arrivals(spark: SparkSession, folder: str, checkpoint: str, store: Store, family: Family, sender: canonical.Profile, pattern: str = "*") -> StreamingQuery:
    """Ingest every new file under folder once; the same bytes under another name are only audited. Runs until all that is
    there has been taken. A replayed batch changes nothing, as the store knows the hashes."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).load(folder)

    def take(batch: DataFrame, _: int) -> None:
        # a file that is there twice in a batch is read once
        named = batch.select(F.sha2("content", 256).alias("content_hash"), F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "content")
        once = named.groupBy("content_hash").agg(F.min_by(F.struct("filename", "path", "content"), "path").alias("f")).select("content_hash", "f.*")
        rows = grid.rows_of(once.select("path", "content"))
        outcomes = outcomes_of(rows, family)
        described = once.drop("path", "content").withColumns({"sender": F.lit(sender.sender), "family": F.lit(family.name), "mapping_version": F.lit(sender.mapping_version)})
        mapped = outcomes.where("mappable").select("content_hash")
        again = named.groupBy("content_hash").agg((F.count("*") - 1).alias("n")).where("n > 0").select("content_hash", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        store.ingest(described.join(mapped, "content_hash", "left_semi"), tag(rows, outcomes, family, sender), "stream")
        store.audit_files("file_reingested", "stream", again)
        store.audit_files("file_abstained", "stream", described.join(mapped, "content_hash", "left_anti"))

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
