"""Token ids on disk, each document compressed by itself with one shared zstandard dictionary.

Layout of a store, all tables written by Spark so that any file system will do and a lost executor's task is done again:

- `dictionary`: one row, dictionary binary, sha256 string, tokenizer string, vocabulary long, end_id long, item_bytes long;
- `blocks`: part long, block long, dictionary_sha256 string, keys array, offsets array<long>, n_tokens array<long>,
  starts array<long> (ids before each document in its part), first, last (keys), payload binary (zstandard frames, one
  for each document, of little-endian unsigned integers of item_bytes bytes);
- `parts`: part long, base long: ids of all documents in the parts before it.

One document is reached by its key alone: first and last prune blocks in the scan, offsets give its frame.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import in_arrow, slices
from tallyframe.llm.encoding import encoder

#: Of the dictionary's training sample: documents, pieces of each, bytes of a piece.
SAMPLE_DOCUMENTS, SAMPLE_PIECES, SAMPLE_BYTES = 1000, 4, 1024


def _frame_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def train_dictionary(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "key", size: int = 32 << 10) -> bytes:
    """A dictionary from serialized ids of a bounded sample: at most 4 * SAMPLE_DOCUMENTS documents, about a quarter of that,
    chosen by a hash of key and text, and from each SAMPLE_PIECES evenly spaced pieces of SAMPLE_BYTES. It only sets how well frames compress.
    Too little text gives a dictionary of the pieces themselves; none gives an empty one."""
    total = docs.count()
    share = F.lit(min(1.0, SAMPLE_DOCUMENTS / max(1, total)) * (1 << 30)).cast("long")

    def pieces(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, text):
                out = []
                for raw in encode.ids(part.column(text).to_pylist()):
                    step = max(SAMPLE_BYTES, len(raw) // SAMPLE_PIECES // 4 * 4)
                    out += [raw[i : i + SAMPLE_BYTES] for i in range(0, len(raw), step)][:SAMPLE_PIECES]
                yield pa.RecordBatch.from_pydict({"piece": pa.array(out, pa.binary())})

    sample = docs.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(key, text), F.lit(1 << 30)) < share)).select(text).limit(4 * SAMPLE_DOCUMENTS)
    found = sorted(r[0] for r in in_arrow(sample, pieces, "piece binary").collect() if r[0])
    try:
        return zstandard.train_dictionary(size, found).as_bytes()
    except zstandard.ZstdError:  # too few or too small
        return b"".join(found)[:size]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", level: int = 3, partitions: int | None = None, block_bytes: int = 1 << 20, block_documents: int = 1024) -> None:
    """Encode whole texts, append end_id to each, and write them in ascending order of key (nulls first, equal keys by text).

    A null or empty text is the end id alone. Repeated rows are stored as often as they come. An empty table gives an
    empty store. tokenizer: the path of a tokenizer file that every executor can read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    raw = train_dictionary(docs, tokenizer)
    encode = encoder(tokenizer)
    width, digest = encode.dtype.itemsize, hashlib.sha256(raw).hexdigest()
    about = [(bytearray(raw), digest, tokenizer.rpartition("/")[2], encode.size, end_id, width)]
    spark.createDataFrame(about, "dictionary binary, sha256 string, tokenizer string, vocabulary long, end_id long, item_bytes long").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(raw)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["key"].dataType.simpleString()

    def blocks(batches):
        encode, part, block, total = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        compress = zstandard.ZstdCompressor(level=level, dict_data=_frame_dictionary(shared.value), write_checksum=False).compress
        end = np.array([end_id], encode.dtype).tobytes()
        keys, offsets, counts, starts, frames, size, arrow = [], [], [], [], [], 0, None

        def row():
            nonlocal block, size
            out = {"part": [part], "block": [block], "dictionary_sha256": [digest], "keys": pa.array([keys], pa.list_(arrow)), "offsets": pa.array([offsets], pa.list_(pa.int64())), "n_tokens": pa.array([counts], pa.list_(pa.int64())), "starts": pa.array([starts], pa.list_(pa.int64())), "first": pa.array([keys[0]], arrow), "last": pa.array([keys[-1]], arrow), "payload": pa.array([b"".join(frames)], pa.binary())}
            block, size = block + 1, 0
            for x in (keys, offsets, counts, starts, frames):
                x.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            arrow = batch.schema.field("key").type
            for some in slices(batch, "text"):
                for k, ids in zip(some.column("key").to_pylist(), encode.ids(some.column("text").to_pylist()), strict=True):
                    frame = compress(ids + end)
                    keys.append(k)
                    offsets.append(size)
                    counts.append(len(ids) // width + 1)
                    starts.append(total)
                    frames.append(frame)
                    size, total = size + len(frame), total + counts[-1]
                    if size >= block_bytes or len(keys) >= block_documents:
                        yield row()
        if keys:
            yield row()

    ordered = docs.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    schema = f"part long, block long, dictionary_sha256 string, keys array<{kind}>, offsets array<long>, n_tokens array<long>, starts array<long>, first {kind}, last {kind}, payload binary"
    in_arrow(ordered, blocks, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    # One row for each task that wrote blocks: their number, not the data's, is what the window holds.
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{path}/parts")


def _opened(spark: SparkSession, path: str):
    about = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(about["dictionary"])
    if hashlib.sha256(raw).hexdigest() != about["sha256"]:
        raise ValueError(f"the dictionary of {path} does not have its recorded hash")
    return about, raw


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row for each stored document: key, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and, if asked for, ids."""
    about, raw = _opened(spark, path)
    shared, digest, dtype = spark.sparkContext.broadcast(raw), about["sha256"], np.dtype(f"<u{about['item_bytes']}")
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["first"].dataType.simpleString()
    # parts has a row for each task of the writer; Spark broadcasts it if it is small
    based = blocks.drop("first", "last").join(spark.read.parquet(f"{path}/parts"), "part")

    def documents(batches):
        decompress = zstandard.ZstdDecompressor(dict_data=_frame_dictionary(shared.value)).decompress
        for batch in batches:
            for b in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                if b["dictionary_sha256"] != digest:
                    raise ValueError(f"block {b['part']}/{b['block']} was written with another dictionary")
                ends = [*b["offsets"][1:], len(b["payload"])]
                arrays = [np.frombuffer(decompress(b["payload"][o:e], max_output_size=n * dtype.itemsize), dtype).astype("<u4") for o, e, n in zip(b["offsets"], ends, b["n_tokens"], strict=True)]
                if [len(a) for a in arrays] != b["n_tokens"]:
                    raise ValueError(f"block {b['part']}/{b['block']} does not hold the ids that it counts")
                out = {"key": pa.array(b["keys"], batch.schema.field("keys").type.value_type), "start": [b["base"] + s for s in b["starts"]], "n_tokens": b["n_tokens"], "ids_crc32": [zlib.crc32(a.tobytes()) for a in arrays]}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array([a.astype(np.int64) for a in arrays], pa.list_(pa.int64()))} if ids else {}))

    return in_arrow(based, documents, f"key {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def fetch(spark: SparkSession, path: str, key) -> list[list[int]]:
    """The ids of the documents with one key: reads the blocks that may hold it and decompresses its frames alone."""
    about, raw = _opened(spark, path)
    dtype, decompress = np.dtype(f"<u{about['item_bytes']}"), zstandard.ZstdDecompressor(dict_data=_frame_dictionary(raw)).decompress
    at = F.arrays_zip(F.col("keys").alias("key"), F.col("offsets").alias("offset"), F.concat(F.slice("offsets", 2, F.greatest(F.size("offsets") - 1, F.lit(1))), F.array(F.length("payload").cast("long"))).alias("end"), F.col("n_tokens").alias("n"), F.col("starts").alias("start"))
    found = spark.read.parquet(f"{path}/blocks").where((F.col("first") <= F.lit(key)) & (F.col("last") >= F.lit(key)))
    frames = found.select("part", "payload", F.explode(at).alias("x")).where(F.col("x.key") == F.lit(key))
    frames = frames.select("part", "x.start", F.col("x.n").alias("n"), F.expr("substring(payload, cast(x.offset as int) + 1, cast(x.end - x.offset as int))").alias("frame"))
    return [np.frombuffer(decompress(bytes(r.frame), max_output_size=r.n * dtype.itemsize), dtype).tolist() for r in frames.orderBy("part", "start").collect()]
