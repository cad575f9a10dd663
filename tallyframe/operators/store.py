"""Ledger tables on a shared folder: idempotent ingest, repeated keys held, mapping contracts, audit.

Any number of files is ingested in one plan: those whose hash is known are taken out by one anti-join, the ledger and quarantine
rows of all others are appended with the name of the ingest, and their rows of `ingested_file` are written last, in one write.
Readers join on file and ingest, so rows of an ingest that broke off are invisible, and ingesting its files again is right.
Rows of files lie in folders by the file's hash, so that a file's rows, and the counts of an ingest, are read from its folders alone.
Writers of one folder are assumed to be one at a time; a file system gives no primary key.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.money import MONEY, money_text
from tallyframe.functions.text import mapping_digest
from tallyframe.operators import locate
from tallyframe.sources import scratch

_LINEAGE = "array<struct<source_content_hash:string,cell:struct<sheet:string,row:int,column:string>,mapping_version:int,raw_value:string>>"
SCHEMAS = {
    "ingested_file": "content_hash string, sender string, filename string, family string, mapping_version int, period string, row_count long, quarantined_count long, status string, ingested_at timestamp, object_key string, ingest string",
    "mapping_contract": "sender string, version int, family string, columns map<string,string>, confirmed_by string, confirmed_at timestamp, digest string",
    "ledger_row": f"source_content_hash string, mapping_version int, key string, period string, currency string, gross {MONEY}, deductions map<string,{MONEY}>, net {MONEY}, attributes map<string,string>, lineage {_LINEAGE}, spreadsheet_row long, ingest string",
    "quarantine": "source_content_hash string, spreadsheet_row long, reason string, raw_value string, resolved_at timestamp, resolved_by string, ingest string",
    "audit_event": "at timestamp, event string, actor string, subject string, payload string",
}
#: Where each key's rows are, beside the tables: an index in buckets, of canonical rows and of rows held for a repeated key.
PLACES = "key string, source_content_hash string, spreadsheet_row long, mapping_version int, ingest string"
#: Tables whose rows are those of files.
_BY_FILE = ("ledger_row", "quarantine")
#: Folders of such a table; it is part of their names, so that it stays as it was when a store was begun.
PARTS = 64


def _part(content_hash: Column) -> Column:
    return F.pmod(F.xxhash64(content_hash), F.lit(PARTS)).cast("int")


def _packed(tagged: DataFrame) -> DataFrame:
    """Rows of canonicalise() (with the columns of a join) as an ingest keeps and shuffles them: what the lineages of a row's values
    share, which is all but column and text, stands once."""
    def values(column: str, *path: str) -> Column:
        return reduce(lambda x, name: x[name], path, F.map_values(column))

    def of_each(*path: str) -> Column:
        net = reduce(lambda x, name: x[name], path, F.col("net"))
        return F.concat(F.array(reduce(lambda x, name: x[name], path, F.col("gross"))), values("deductions", *path), F.when(F.col("net").isNotNull(), F.array(net)).otherwise(F.array().cast("array<string>")), values("attributes", *path))

    at = F.col("gross.lineage")
    return tagged.select(
        "content_hash", *[c for c in ("mapping_version",) if c in tagged.columns], "key", "period", "currency", "spreadsheet_row", "quarantine_reason", "quarantine_raw", F.col("gross.value").alias("gross"), F.col("net.value").alias("net"),
        *[F.map_from_arrays(F.map_keys(c), values(c, "value")).alias(c) for c in ("deductions", "attributes")],
        at["cell"]["sheet"].alias("lineage_sheet"), at["cell"]["row"].alias("lineage_row"), at["mapping_version"].alias("lineage_version"),
        of_each("lineage", "cell", "column").alias("value_columns"), of_each("lineage", "raw_value").alias("value_texts"),
    )


def _lineage() -> Column:
    """The lineage of each value of a packed row."""
    at = lambda column: F.struct(F.col("lineage_sheet").alias("sheet"), F.col("lineage_row").alias("row"), column.alias("column"))
    return F.zip_with("value_columns", "value_texts", lambda column, text: F.struct(F.col("source_content_hash"), at(column).alias("cell"), F.col("lineage_version").alias("mapping_version"), text.alias("raw_value")))


def repeated(rows: DataFrame) -> DataFrame:
    """The repeated keys of split_repeated(), each with how many rows have it."""
    return rows.groupBy(*_keyed(rows)).agg(F.count("*").alias("repeats")).where("repeats > 1")


def _keyed(rows: DataFrame) -> list[str]:
    return [*(c for c in ("content_hash",) if c in rows.columns), "key"]


def split_repeated(rows: DataFrame, often: DataFrame | None = None) -> DataFrame:
    """rows with `repeats`: how many rows of the file share the key. All rows of a repeated key are held. Rows of several files
    have a content_hash; null keys, and null hashes, are equal to each other. Counts are added up before they are shuffled, and only
    repeated keys meet the rows again, in a join that Spark splits where a key is frequent; no key's rows are gathered. often: repeated() of the rows,
    where it is a table already: if it is small, the rows themselves are not shuffled."""
    by = _keyed(rows)
    often = repeated(rows) if often is None else often
    a, b = rows.alias("a"), often.alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in by))
    return a.join(b, same, "left").select("a.*", F.coalesce("b.repeats", F.lit(1)).alias("repeats"))


def money_json(deductions):
    """Deductions as JSON with amounts as text, so that no reader makes a float of them."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(deductions, lambda k, v: money_text(v))))))


def lineage_json(lineage):
    """A row's lineage as JSON: one object for each value, in order."""
    return F.to_json(lineage)


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str, content_hash: str | None = None) -> DataFrame:
        """A table's rows; those of files whose ingest did not end are not among them. A table that was never written is empty.
        With a content_hash, a table of files' rows gives that file's, and reads no other folder than its own."""
        df = self._read(name)
        if name not in _BY_FILE:
            return df
        if content_hash is not None:
            df = df.where((F.col("part") == _part(F.lit(content_hash))) & (F.col("source_content_hash") == content_hash))
        return self._done(df.drop("part"), name == "ledger_row")

    def _read(self, name: str) -> DataFrame:
        schema = SCHEMAS[name] + (", part int" if name in _BY_FILE else "")
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _done(self, df: DataFrame, by_version: bool) -> DataFrame:
        """Rows of ingests that ended."""
        done = self.table("ingested_file").select(F.col("content_hash").alias("source_content_hash"), "mapping_version", "ingest")
        return df.join(done, ["source_content_hash", "ingest"] + ["mapping_version"] * by_version, "left_semi").select(*df.columns)

    def locate(self, keys: DataFrame) -> DataFrame:
        """key, source_content_hash, spreadsheet_row, mapping_version: of every stored row of keys (a column `key`), the rows of
        repeated keys among them. Only the index's buckets of these keys are read."""
        return self._done(locate.locate(self.spark, f"{self.root}/key_index", keys, PLACES), True).drop("ingest")

    def append(self, name: str, rows: DataFrame, late: dict[str, Column] | None = None) -> None:
        """Add rows, which have the table's columns, to a table. late: columns that are made of the rows' others as they are written,
        so that what is wide is not shuffled; in a table of files' rows alone."""
        self._write(name, rows, "append", late or {})

    def _write(self, name: str, rows: DataFrame, mode: str, late: dict[str, Column]) -> None:
        columns = [late[c].alias(c) if c in late else F.col(c) for c in self._columns(name)]
        with scratch.shuffles_freed(self.spark):
            if name not in _BY_FILE:
                rows.select(*columns).write.mode(mode).parquet(f"{self.root}/{name}")
                return
            placed = rows.withColumn("part", _part(F.col("source_content_hash"))).hint("rebalance", F.col("part"))  # a large file's folder is written by several tasks
            placed.sortWithinPartitions("part", "source_content_hash").select(*columns, "part").write.mode(mode).option("compression", scratch.CODEC).partitionBy("part").parquet(f"{self.root}/{name}")

    def _columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], SCHEMAS[name]).columns

    def _append(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def audit(self, event: str, actor: str, subject: str, payload: str = "{}") -> None:
        self._append("audit_event", [(datetime.now(timezone.utc), event, actor, subject, payload)])

    def audit_files(self, event: str, actor: str, files: DataFrame, payload=None) -> None:
        """An audit event for each row of files (content_hash)."""
        payload = F.lit("{}") if payload is None else payload
        self.append("audit_event", files.select(F.lit(datetime.now(timezone.utc)).alias("at"), F.lit(event).alias("event"), F.lit(actor).alias("actor"), F.col("content_hash").alias("subject"), payload.alias("payload")))

    def ingest(self, files: DataFrame, tagged: DataFrame, actor: str = "pipeline", replay: bool = False) -> int:
        """Store the canonical rows and the quarantine of files, each once; the number of files that were new.

        files: content_hash, sender, filename, family, mapping_version, a row for each. tagged: canonicalise() of their rows, or
        prepare() of it, where several ingests take the same rows. A file whose bytes are known is only audited, whatever its name. replay: a known file is stored again under a mapping
        version that it does not have yet; older versions stay.
        """
        files = scratch.written(files.dropDuplicates(["content_hash"]), "files")  # found once, and a size that is known lets them be broadcast
        on = ["content_hash", "mapping_version"] if replay else ["content_hash"]
        done = self.table("ingested_file").select(*on).distinct()
        new, known = scratch.written(files.join(done, on, "left_anti"), "new-files"), files.join(done, on, "left_semi")
        self.audit_files("file_reingested", actor, known)
        if new.isEmpty():
            return 0
        ingest, now = uuid.uuid4().hex, datetime.now(timezone.utc)
        on_new = new.select("content_hash", "mapping_version")
        # read several times
        rows = tagged.join(on_new, "content_hash") if "value_columns" in tagged.columns else scratch.written(_packed(tagged.join(on_new, "content_hash")), "ingest")
        good = rows.where("quarantine_reason IS NULL")
        marked = split_repeated(good, scratch.written(repeated(good), "repeated"))
        kept = marked.where("repeats = 1").withColumnRenamed("content_hash", "source_content_hash").withColumn("ingest", F.lit(ingest))
        held = marked.where("repeats > 1").select("content_hash", "spreadsheet_row", F.concat(F.col("repeats").cast("string"), F.lit(" rows of this file have the key "), F.col("key")).alias("reason"), F.col("key").alias("raw_value"))
        refused = rows.where("quarantine_reason IS NOT NULL").select("content_hash", "spreadsheet_row", F.col("quarantine_reason").alias("reason"), F.col("quarantine_raw").alias("raw_value"))
        waiting = held.unionByName(refused).withColumnRenamed("content_hash", "source_content_hash").withColumns({"resolved_at": F.lit(None).cast("timestamp"), "resolved_by": F.lit(None).cast("string"), "ingest": F.lit(ingest)})
        self.append("ledger_row", kept, {"lineage": _lineage()})
        self.append("quarantine", waiting)
        locate.append(marked.select("key", F.col("content_hash").alias("source_content_hash"), "spreadsheet_row", "mapping_version", F.lit(ingest).alias("ingest")), f"{self.root}/key_index")
        parts = [r.part for r in new.select(_part(F.col("content_hash")).alias("part")).distinct().collect()]  # PARTS at most
        written, put_off = (self._read(t).where(F.col("part").isin(parts) & (F.col("ingest") == ingest)).withColumnRenamed("source_content_hash", "content_hash").groupBy("content_hash") for t in _BY_FILE)
        counted = new.join(written.agg(F.count("*").alias("row_count"), F.min("period").alias("period")), "content_hash", "left").join(put_off.agg(F.count("*").alias("quarantined_count")), "content_hash", "left")
        counted = counted.withColumns({"row_count": F.coalesce("row_count", F.lit(0)), "quarantined_count": F.coalesce("quarantined_count", F.lit(0)), "status": F.lit("ingested"), "ingested_at": F.lit(now), "object_key": F.lit(None).cast("string"), "ingest": F.lit(ingest)})
        self.append("ingested_file", counted)  # the commit
        stored = self.spark.read.schema(SCHEMAS["ingested_file"]).parquet(f"{self.root}/ingested_file").where(F.col("ingest") == ingest)
        self.audit_files("file_ingested", actor, stored, F.to_json(F.struct(F.col("quarantined_count").alias("quarantined"), F.col("row_count").alias("rows"))))
        return stored.count()

    def prepare(self, tagged: DataFrame) -> DataFrame:
        """canonicalise() of files' rows as a table that ingest() takes, so that several ingests do not each work them out."""
        return scratch.written(_packed(tagged), "prepared")

    def reset(self) -> None:
        """Every table without rows, as for tests."""
        for name, schema in SCHEMAS.items():
            self._write(name, self.spark.createDataFrame([], schema), "overwrite", {})

    def round_trip(self, amount) -> bool:
        """Whether an exact amount comes back as it was written, to the last of its four decimals."""
        path = f"{self.root}/round_trip"
        self.spark.createDataFrame([(amount,)], f"x {MONEY}").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).first()[0] == amount

    def confirm(self, sender: str, version: int, family: str, columns: dict[str, str], by: str) -> bool:
        """Record a mapping contract; False if this version of the sender's is there already."""
        if not by or version < 1 or not columns:
            raise ValueError("a contract has columns, a version from 1 on and the name of who confirmed it")
        if len(set(columns.values())) < len(columns):
            raise ValueError("two columns have one field")
        if not self.table("mapping_contract").where((F.col("sender") == sender) & (F.col("version") == version)).isEmpty():
            return False
        digest = self.spark.range(1).select(mapping_digest(F.lit(sender), F.lit(version), F.create_map(*[F.lit(x) for e in columns.items() for x in e]))).first()[0]
        self._append("mapping_contract", [(sender, version, family, columns, by, datetime.now(timezone.utc), digest)])
        self.audit("mapping_confirmed", by, f"{sender}/{version}")
        return True

    def rows_of(self, content_hash: str) -> DataFrame:
        return self.table("ledger_row", content_hash).orderBy("mapping_version", "key")

    def counts(self) -> dict[str, int]:
        return {name: self.table(name).count() for name in SCHEMAS}
