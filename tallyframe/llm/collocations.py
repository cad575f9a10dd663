"""Collocations by suffix sorting: every phrase's count from one sorted pass over truncated suffixes.

A suffix is a word and up to `most - 1` words after it in the same piece. Equal suffixes of a batch are counted before they are
shuffled by language and first word, and by the second one, too, so that no frequent word makes a task large: the counts of
single words are there already; each task sorts its suffixes in reverse order and reads them once with a stack of the
open prefixes, whose counts are whole when they close. Words too rare for any phrase cut suffixes, as no phrase that is asked
for holds one. The parts of each phrase are joined afterwards.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import are_few, in_arrow, materialize, slices
from tallyframe.llm.words import classes, split

#: Between a key's language and words. Texts' own NUL and SOH characters are written as SOH and a digit of two.
_SEP, _ESCAPES = "\0", (("\1", "\1\2"), ("\0", "\1\3"))
_KINDS = classes(b" \t", b".,;:!?\n\x0b\x0c\r")
#: The map of frequent words: so many bits, whatever the vocabulary. A rare word whose bit is set is only not cut out.
_BITS = 26


def _escaped(texts: pa.Array) -> pa.Array:
    for plain, code in _ESCAPES:
        texts = pc.replace_substring(texts, plain, code)
    return texts


def _plain(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _found(batch: pa.RecordBatch):
    """Languages and words of a batch, the language of each word, and hashes of the languages and words."""
    langs = _escaped(pc.fill_null(batch.column("lang").cast(pa.large_string()), "und"))
    found = split(_escaped(batch.column("text").cast(pa.large_string())), _KINDS)
    return langs, found, np.repeat(np.arange(batch.num_rows, dtype=np.int32), found.counts)


def _hashes(texts: pa.Array) -> np.ndarray:
    """crc32 of each text, which is taken once of equal ones."""
    coded = texts.dictionary_encode()
    return np.fromiter(map(zlib.crc32, coded.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(coded.dictionary))[coded.indices.to_numpy()]


def _counts(langs: pa.Array, texts: pa.Array) -> pa.Table:
    sums = pc.value_counts(pc.binary_join_element_wise(langs, texts, pa.scalar(_SEP, pa.large_string())))
    return pa.table({"key": sums.field("values").cast(pa.string()), "n": sums.field("counts")})


def _word_counts(docs: DataFrame) -> DataFrame:
    """(key, n): language and word, with its count in a batch."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                langs, found, of = _found(some)
                yield from _counts(langs.take(pa.array(of)), found.words).to_batches(max_chunksize=50_000)

    return in_arrow(docs, run, "key string, n long")


def _suffixes(docs: DataFrame, most: int, frequent) -> DataFrame:
    """(key, n): language and words of each suffix of two to most words, with its count in a batch; a task has all those that
    begin with the same two words. On their way they are packed, sorted, as a task's compressed batch for another, which takes
    a third of the bytes of rows. frequent: the map of frequent words, broadcast."""
    tasks = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 15)

    def pack(batch: pa.RecordBatch):
        langs, found, of = _found(batch)
        n = len(found.sizes)
        if not n:
            return
        hashes, of_lang = _hashes(found.words), _hashes(langs)[of]
        bit = (hashes ^ of_lang) & ((1 << _BITS) - 1)
        rare = ((frequent.value[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1) == 0
        ends = rare.copy()  # no suffix goes on after this word
        ends[:-1] |= found.cut[1:] | rare[1:]
        ends[-1] = True
        stops = np.flatnonzero(ends)
        length = np.minimum(np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(n) + 1, most)
        at = np.flatnonzero((length > 1) & ~rare)
        to = ((hashes[at] * 0x9E3779B1 + hashes[at + 1] * 0x85EBCA77 + of_lang[at]) >> 7) % tasks
        order = np.argsort(to.astype(np.uint16), kind="stable")
        at, to = at[order], to[order]
        # Words joined by separators, so that a suffix is a run of bytes.
        place = np.concatenate(([0], np.cumsum(found.sizes + 1)))
        joined = np.zeros(place[-1], np.uint8)
        joined[np.arange(len(found.data), dtype=np.int32) + np.repeat(np.arange(n, dtype=np.int32), found.sizes)] = found.data
        zstd = pa.ipc.IpcWriteOptions(compression="zstd")
        firsts = np.flatnonzero(np.diff(to, prepend=-1))
        for first, last in itertools.pairwise([*firsts, len(at)]):
            own = at[first:last]
            starts, sizes = place[own], place[own + length[own]] - 1 - place[own]
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            data = joined[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)]
            texts = pa.LargeStringArray.from_buffers(len(own), pa.py_buffer(bounds), pa.py_buffer(data))
            sums = _counts(langs.take(pa.array(of[own])), texts).sort_by("key").combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, sums.schema, options=zstd) as out:
                out.write_table(sums)
            yield int(to[first]), sink.getvalue().to_pybytes()

    def packed(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                rows = list(pack(some))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["task", "packed"])

    def unpacked(batches):
        for batch in batches:
            for one in batch.column("packed"):
                yield from pa.ipc.open_stream(one.as_buffer()).read_all().to_batches(max_chunksize=50_000)

    return in_arrow(in_arrow(docs, packed, "task int, packed binary").repartitionById(tasks, "task"), unpacked, "key string, n long")


def _map_of(words: DataFrame) -> np.ndarray:
    """The bits of frequent words (key): at most 2 ** 21 rows, whatever the vocabulary."""
    lang, word = F.substring_index("key", _SEP, 1), F.substring_index("key", _SEP, -1)
    bit = F.crc32(lang.cast("binary")).bitwiseXOR(F.crc32(word.cast("binary"))).bitwiseAND((1 << _BITS) - 1)
    rows = words.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("i")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 31 AS INT)))").alias("bits"))
    out = np.zeros(1 << (_BITS - 5), np.uint32)
    for batch in rows.toArrow().to_batches():
        out[batch.column("i").to_numpy()] = batch.column("bits").to_numpy().astype(np.uint32)
    return out


def _prefix_counts(suffixes: DataFrame, least: int) -> DataFrame:
    """(key, n): the prefixes of two words or more with a count of at least `least`. suffixes are sorted in each task, and a
    task has all suffixes that begin with the same two words."""

    def run(batches):
        stack: list[list] = []  # of the open prefixes, by level: [the words up to it, its count so far]
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = pc.split_pattern(batch.column("key"), _SEP)
            offsets = parts.offsets.to_numpy()
            width = np.diff(offsets)
            deep = int(width.max())
            codes = parts.values.dictionary_encode().indices.to_numpy()
            level = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], width)
            grid = np.full((batch.num_rows, deep), -1, np.int64)
            grid[np.repeat(np.arange(batch.num_rows), width), level] = codes
            first = parts[0].as_py()
            common = 0
            while common < min(len(first), len(stack)) and stack[common][0] == first[common]:
                common += 1
            counts = batch.column("n").to_numpy()
            changed = np.zeros(batch.num_rows, bool)
            closed, runs = [], []  # runs: of each level, where its prefixes begin, and their counts
            for j in range(deep):
                changed[1:] |= grid[1:, j] != grid[:-1, j]
                begins = np.flatnonzero(np.concatenate(([True], changed[1:])))
                runs.append((begins, np.add.reduceat(counts, begins)))
            # Close what the first suffix does not go on with; then add this batch's runs, of which the last stays open.
            while len(stack) > common:
                closed.append(([w for w, _ in stack], stack.pop()[1]))
            last = parts[-1].as_py()
            new_stack: list[list] = []
            for j, (begins, sums) in enumerate(runs):
                if j < common:  # the run goes on from the batch before
                    sums[0] += stack[j][1]
                here = grid[begins, j] >= 0
                stays = len(last) > j
                kept = here & (sums >= least)
                if stays:
                    kept[-1] = False
                    new_stack.append([last[j], int(sums[-1])])
                for i in np.flatnonzero(kept) if j > 1 else ():
                    closed.append((parts[int(begins[i])].as_py()[: j + 1], int(sums[i])))
            stack = new_stack
            yield from _emitted(closed, least)
        yield from _emitted([([w for w, _ in stack[: j + 1]], stack[j][1]) for j in range(len(stack))], least)

    return in_arrow(suffixes, run, "key string, n long")


def _emitted(closed: list, least: int):
    kept = [(_SEP.join(words), n) for words, n in closed if len(words) > 2 and n >= least]
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["key", "n"])


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Counts of all words (key, n), and of all phrases of two to most words that occur at least `least` times (key, n). A key is
    the language and the words, joined."""
    docs = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    words = materialize(_word_counts(docs).groupBy("key").agg(F.sum("n").alias("n")), "phrase-words")
    frequent = docs.sparkSession.sparkContext.broadcast(_map_of(words.where(F.col("n") >= least)))
    suffixes = _suffixes(docs, most, frequent).sortWithinPartitions(F.desc("key"))
    phrases = materialize(_prefix_counts(suffixes, least), "phrases")
    frequent.unpersist()
    return words, phrases


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of two to most words is a candidate if it occurs (a) at least `least` times in its language, inside pieces that end
    at `.,;:!?` and line ends; A-Z are lower-cased. It is cut where floor(1000 * a * n / (l * r)) is lowest, first of equals, with
    l and r the counts of the parts and n that of all words. A candidate that never occurs outside a longer one is left out.
    Order: score, a, both descending, phrase in the order of its bytes. A null text is empty, a null language `und`; texts of
    any length are cut into words at once, a null character is like any other. Repeated rows count as often as they occur, other
    columns are not read, an empty table gives no row. Counts beyond 18 digits are an error.
    """
    return scored(*phrase_counts(docs, text, lang, most, least), least, top)


def scored(words: DataFrame, phrases: DataFrame, least: int, top: int) -> DataFrame:
    """collocations() of the counts that phrase_counts() gives."""
    parts = F.split("key", _SEP)
    cand = phrases.withColumn("parts", parts).withColumns({"lang": F.col("parts")[0], "m": F.size("parts") - 1})
    counts = phrases.unionByName(words.where(F.col("n") >= least))
    piece = lambda first, n: F.array_join(F.concat(F.slice("parts", 1, 1), F.slice("parts", first, n)), _SEP)
    k = F.col("k")
    cuts = cand.select("key", F.col("n").alias("a"), "parts", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select("key", "a", "k", piece(F.lit(2), k).alias("left"), piece(k + 2, F.col("m") - k).alias("right"))
    sided = cuts.join(counts.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    totals = words.groupBy(F.substring_index("key", _SEP, 1).alias("lang")).agg(F.sum("n").alias("total"))
    sided = sided.withColumn("lang", F.substring_index("key", _SEP, 1)).join(F.broadcast(totals) if are_few(totals, "lang") else totals, "lang")
    ratio = F.expr("CAST((CAST(1000 * a AS DECIMAL(19,0)) * CAST(total AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    best = sided.withColumn("score", ratio).groupBy("key").agg(F.min_by(F.struct("score", "a", "l", "r", F.col("total").alias("n")), F.struct("score", "k")).alias("b"))
    longer = cand.where("m > 2").select("n", F.explode(F.array(piece(F.lit(2), F.col("m") - 1), piece(F.lit(3), F.col("m") - 1))).alias("key")).groupBy("key").agg(F.max("n").alias("inside"))
    own = best.join(longer, "key", "left").where("inside IS NULL OR inside < b.a")
    own = own.select(_plain(F.substring_index("key", _SEP, 1)).alias("lang"), _plain(F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), " ")).alias("phrase"), "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
