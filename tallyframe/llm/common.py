"""Small helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='tallyframe-')}"
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tallyframe/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors. name: of the table, or a path
    of scratch_path(). tidy: Spark removes the shuffle files of the write once it is done, instead of when the driver next collects
    its garbage."""
    path, conf, cleanup = name if "/" in name else scratch_path(df.sparkSession, name), df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(cleanup, "false")
    try:
        if tidy:
            conf.set(cleanup, "true")
        df.write.parquet(path)
    finally:
        if tidy:
            conf.set(cleanup, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(spark: SparkSession, path: str) -> None:
    """Remove the rows of a table of the shared folder that nothing reads any more."""
    spark.range(0).write.mode("overwrite").parquet(path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that clash, in any letter case, with names that an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """(row, doc): the rows of df as structs, each with a number of its own, null and repeated rows too. Written to the
    shared folder, so that a row has the same number whenever it is read."""
    return materialize(df.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")), name)


def crc32_mod(column: str, modulus: int):
    """crc32 of the decimal text of an id, modulo: the fold that labels are split by. Null ids get fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def extended(df: DataFrame, **added: str) -> str:
    """The schema of df with columns added, all nullable."""
    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join(own + [f"{name} {kind}" for name, kind in added.items()])


#: Keys that may be broadcast: their number, and their bytes as text.
BROADCAST_KEYS, BROADCAST_BYTES = 500_000, 8 << 20


def are_few(keys: DataFrame, key: str) -> bool:
    """Whether keys are few and small enough to be sent to every executor; they are read once for that."""
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0))).first()
    return n <= BROADCAST_KEYS and size <= BROADCAST_BYTES


def lacking(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose key is not in keys (one column of that name); a null key is in no keys. keys should be cheap to read
    twice: they are measured, and broadcast if they are few; else both sides are shuffled."""
    return df.join(F.broadcast(keys) if are_few(keys, key) else keys, key, "left_anti")


#: Bytes of an Arrow batch between Spark and a Python worker. Spark's own limit of 64 MB for each direction of each task, in
#: buffers that are not given back, would be most of what an executor has outside its heap.
BATCH_BYTES = 4_000_000


def _give_back() -> None:
    """Return to the system what this worker's allocators hold and do not use; it is kept for the next task otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow, with the session's limit of an Arrow batch lowered to BATCH_BYTES if it has Spark's default. A worker
    that waits for its next task gives back the memory that it does not use."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            _give_back()

    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, "67108864b") == "67108864b":
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about `most` bytes of a text or binary column, a longer row alone: so much is turned into
    Python objects at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        yield batch.slice(first, last - first)
        first = last
