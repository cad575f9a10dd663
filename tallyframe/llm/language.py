"""Language identification by compression: a text belongs to the language whose dictionary compresses it best.

Each language has a zstandard raw-content dictionary, cut from a bounded sample of its labelled texts. The letters of a
whole text are compressed window by window with every dictionary; the lengths are summed. A text whose best two sums are
close is rejected.
"""

from __future__ import annotations

import functools
import math
import random
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import extended, in_arrow, slices, without
from tallyframe.llm.compression import lengths, letters

UNDETERMINED = "und"
ADDED = {"lang_pred": "string", "score": "double", "margin": "double", "rejected": "boolean"}
WINDOW = 1024


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample: int = 400, piece: int = 512, size: int = 48 << 10, most: int = 1000) -> dict[str, bytes]:
    """language -> dictionary content of at most `size` bytes: the first of the pieces, in a fixed shuffle, of about `sample`
    texts of each language. Texts are chosen by a hash of key and text, equal rows once, and give a piece of at most `piece`
    bytes each, at a place that depends on the text.

    Rows with a null text or language, and texts without letters, teach nothing. More than `most` languages is an error. The
    sample is at most four times as large as named, whatever keys and texts repeat.
    """
    rows = labelled.select(F.col(language).alias("language"), F.col(text).alias("text"), F.col(key).alias("key")).where("language IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("language").count().limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["language"], min(1.0, sample / r["count"]))])
    hashed = rows.withColumn("hash", F.xxhash64("key", "text"))
    unit = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    chosen = hashed.where(unit < share[F.col("language")]).dropDuplicates(["language", "hash"]).limit(4 * sample * len(counts)).select("language", "text")

    def pieces(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            out = []
            for text in batch.column("text").to_pylist():
                b = letters(text)
                at = zlib.crc32(b) % max(1, len(b) - piece + 1)
                out.append(b[at : at + piece])
            yield pa.RecordBatch.from_arrays([batch.column("language"), pa.array(out, pa.binary())], names=["language", "piece"])

    found: dict[str, list[bytes]] = {}
    for r in in_arrow(chosen, pieces, "language string, piece binary").collect():
        if r["piece"]:
            found.setdefault(r["language"], []).append(bytes(r["piece"]))
    contents = {}
    for name in sorted(found):
        own = sorted(found[name])
        random.Random(0).shuffle(own)
        contents[name] = b" ".join(own)[:size]
    return contents


@functools.lru_cache(maxsize=4)
def _measures(contents: tuple[tuple[str, bytes], ...]):
    return [(name, lengths(raw, zstandard.STRATEGY_LAZY2, 4, 4, 16)) for name, raw in contents]


def _one(text: str | None, measures, narrow: float) -> tuple[str, float, float, bool]:
    b = letters(text)
    if not b or not measures or (not any(65 <= c < 128 for c in b) and not any(map(str.isalpha, text))):
        return UNDETERMINED, 0.0, 0.0, True
    windows = [b[i : i + WINDOW] for i in range(0, len(b), WINDOW)]
    totals = sorted((sum(map(measure, windows)), name) for name, measure in measures)
    if len(totals) == 1:
        return totals[0][1], 1.0, 1.0, False
    best, second = totals[0][0], totals[1][0]
    margin = (second - best) / second
    return totals[0][1], 1 / (1 + math.exp(min(700, (best - second) / 4))), margin, margin < narrow


def identify(docs: DataFrame, contents: dict[str, bytes], text: str = "text", narrow: float = 0.004) -> DataFrame:
    """docs with lang_pred, score (0 to 1), margin (of the best sum to the second) and rejected (a margin below `narrow`).

    Null and empty texts and texts without a letter are `und`, score 0, rejected; so is every text if nothing was learnt.
    Equal sums go to the name that sorts first, with margin 0. Very long texts are read whole; rows that repeat get the same
    answer each; an empty table gives an empty one. Columns with the added names, in any letter case, are replaced, others
    stay.
    """
    base = without(docs, list(ADDED))
    model = docs.sparkSession.sparkContext.broadcast(tuple(sorted(contents.items())))

    def run(batches):
        measures = _measures(model.value)
        for batch in (part for whole in batches for part in slices(whole, text)):
            rows = [_one(t, measures, narrow) for t in batch.column(text).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names, *ADDED])

    return in_arrow(base, run, extended(base, **ADDED))
