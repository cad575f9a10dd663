"""Benchmark decontamination with suffix arrays over shards of the training text.

Each run of some megabytes of documents is a shard. Its words become ids of the benchmark's vocabulary (0: not in it), and a
sorted array of its suffixes is built. Every test suffix is looked up by binary search: its neighbours give its longest
verbatim match. Where that reaches a window's length, the range of training suffixes that start with the window gives all its
places; at each of them the longest match with any item is found the other way round, in the benchmark's own suffix array.
Only training suffixes whose next words are all in the benchmark's vocabulary, for at least the shortest window, are sorted: no
other can hold a window. The benchmark is sent to the tasks as a few flat arrays, in blocks of a checked size; a larger
benchmark takes several passes.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import extended, in_arrow, materialize, numbered, slices, without

#: Words of the lower-cased text: digits, a-z and all that is not ASCII, as UTF-8.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
ADDED = {"n_words": "long", "n_hit": "long", "item_ids": "array<string>", "spans": "array<struct<first:long,last:long>>", "longest_match": "long", "longest_at": "long"}
#: Bytes of text in a shard.
SHARD = 4_000_000
#: Bytes of benchmark in one pass. As flat arrays it takes some ten times as much.
BLOCK = 8 << 20


def words(text: bytes | None) -> list[bytes]:
    return WORDS.findall(text.lower()) if text else []


def _sorted_suffixes(stream: np.ndarray, at: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Places in a stream of ids below size, in order of what follows them for depth ids; the stream goes on as far as that."""
    bits = max(1, math.ceil(math.log2(size + 1)))
    packed = max(1, 62 // bits)

    def key(places: np.ndarray) -> np.ndarray:
        """The next few ids in one integer that sorts as they do."""
        out = np.zeros(len(places), np.int64)
        for j in range(packed):
            out = (out << bits) | stream[np.minimum(places + j, len(stream) - 1)]
        return out

    keys = key(at)
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    group = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1]))) if len(at) else np.zeros(0, np.int64)
    for deep in range(packed, depth, packed):
        same = group[1:] == group[:-1]
        tied = np.zeros(len(at), bool)
        tied[1:] |= same
        tied[:-1] |= same
        todo = np.flatnonzero(tied)
        if not len(todo):
            break
        part, g, keys = at[todo], group[todo], key(at[todo] + deep)
        order = np.lexsort((keys, g))
        at[todo], g, keys = part[order], g[order], keys[order]
        new = np.concatenate(([False], (g[1:] == g[:-1]) & (keys[1:] != keys[:-1])))  # splits inside a group
        group[todo] = g
        step = np.zeros(len(at), np.int64)
        step[todo] = new
        group = group + np.cumsum(step)
    return at


def _common(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many ids from a[at] and from b[to] on are equal, up to size."""
    n, left = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(left):
        left = left[n[left] < size[left]]
        left = left[a[np.minimum(at[left] + n[left], len(a) - 1)] == b[np.minimum(to[left] + n[left], len(b) - 1)]]
        n[left] += 1
    return n


def _search(a: np.ndarray, suffixes: np.ndarray, b: np.ndarray, query: np.ndarray, size: np.ndarray, through: bool) -> np.ndarray:
    """How many of the sorted suffixes of a come before a query of so many ids of b; through: or start with it."""
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(suffixes), np.int64)
    while len(todo := np.flatnonzero(low < high)):
        middle = (low[todo] + high[todo]) // 2
        at, to, most = suffixes[middle], query[todo], size[todo]
        n = _common(a, at, b, to, most)
        before = np.where(n == most, through, a[np.minimum(at + n, len(a) - 1)] < b[np.minimum(to + n, len(b) - 1)])
        low[todo[before]] = middle[before] + 1
        high[todo[~before]] = middle[~before]
    return low


def _longest(a: np.ndarray, suffixes: np.ndarray, b: np.ndarray, query: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the length of its longest match among the sorted suffixes of a, and the place of one."""
    low = _search(a, suffixes, b, query, size, False)
    best, place = np.zeros(len(query), np.int64), np.full(len(query), -1, np.int64)
    for near in (low - 1, low) if len(suffixes) else ():
        at = suffixes[np.clip(near, 0, len(suffixes) - 1)]
        n = np.where((near >= 0) & (near < len(suffixes)), _common(a, at, b, query, size), 0)
        better = n > best
        best[better], place[better] = n[better], at[better]
    return best, place


@dataclass
class Queries:
    """The test side, in flat arrays: items' words in one stream with 0 between items, every suffix, the distinct windows."""

    listed: bytes  # the vocabulary's words in order of their ids, from 1 on
    stream: np.ndarray
    suffix_at: np.ndarray  # every test suffix
    suffix_size: np.ndarray  # its words up to the item's end
    suffix_item: np.ndarray
    suffix_window: np.ndarray  # the distinct window that it starts with, -1 if it is shorter
    ordered: np.ndarray  # the suffixes' places, sorted
    at: np.ndarray  # a place of each distinct window
    size: np.ndarray  # its words
    item_first: np.ndarray  # where its items begin in item_of
    item_of: np.ndarray
    names: list[str]
    window: int

    @cached_property
    def vocabulary(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.listed.split(b" "), 1)} if self.listed else {}

    @property
    def depth(self) -> int:
        return int(self.suffix_size.max(initial=1))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "vocabulary"}


def prepare(items: list[tuple[str, bytes | None]], window: int) -> Queries:
    vocabulary: dict[bytes, int] = {}
    parts, starts, lengths, names, n = [np.zeros(1, np.int32)], [], [], [], 1
    for item, text in items:
        ws = words(text)
        if not ws:
            continue
        names.append(item)
        starts.append(n)
        lengths.append(len(ws))
        parts += [np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws), np.int32, len(ws)), np.zeros(1, np.int32)]
        n += len(ws) + 1
    sizes, base = np.array(lengths, np.int64), np.array(starts, np.int64)
    depth = int(sizes.max(initial=1))
    stream = np.concatenate([*parts, np.zeros(depth + 64, np.int32)])
    item = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, left, least = np.repeat(base, sizes) + within, np.repeat(sizes, sizes) - within, np.repeat(np.minimum(sizes, window), sizes)
    # equal windows: those of one size stand together where suffixes are sorted by so many words
    whole = np.flatnonzero(left >= least)
    columns = [np.where(j < least[whole], stream[at[whole] + j], 0) for j in range(window)]
    order = np.lexsort(columns[::-1]) if len(whole) else whole
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = reduce(np.logical_or, [c[order][1:] != c[order][:-1] for c in columns])
    number = np.cumsum(new) - 1
    of = np.full(len(at), -1, np.int64)
    of[whole[order]] = number
    first = whole[order][new]
    pairs = np.unique(np.stack([number, item[whole[order]]]), axis=1) if len(order) else np.zeros((2, 0), np.int64)
    listed = b" ".join(vocabulary)
    return Queries(listed, stream, at, left, item, of, _sorted_suffixes(stream, at, len(vocabulary) + 1, depth), at[first], least[first], np.searchsorted(pairs[0], np.arange(len(first) + 1)), pairs[1], names, window)


class Shard:
    """A suffix array over the words of some documents."""

    def __init__(self, documents: list[list[bytes]], queries: Queries) -> None:
        self.q, get = queries, queries.vocabulary.get
        parts, starts, n = [], [], 0
        gap = np.zeros(1, np.int32)
        for ws in documents:
            starts.append(n)
            parts += [np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws)), gap]
            n += len(ws) + 1
        self.starts = np.array(starts, np.int64)
        self.stream = np.concatenate([*parts, np.zeros(queries.depth + 64, np.int32)])
        self.zeros, at = np.flatnonzero(self.stream == 0), np.flatnonzero(self.stream)
        at = at[self._known(at) >= int(queries.size.min(initial=1))]
        self.suffixes = _sorted_suffixes(self.stream, at, len(queries.vocabulary) + 1, queries.depth)

    def _known(self, at: np.ndarray) -> np.ndarray:
        """How many words from a place on are all in the benchmark's vocabulary."""
        return self.zeros[np.searchsorted(self.zeros, at)] - at

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix, the length of its longest match in this shard and the place of one such match."""
        return _longest(self.stream, self.suffixes, self.q.stream, self.q.suffix_at, self.q.suffix_size)

    def least_places(self, best: np.ndarray, of: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """For some test suffixes, of the places in this shard that match for `best` words, the one in the document with the
        lowest rank, there the first."""
        q = self.q
        low, high = (_search(self.stream, self.suffixes, q.stream, q.suffix_at[of], best[of], through) for through in (False, True))
        width = np.int64(len(self.stream) + 1)
        docs = self.document(self.suffixes)
        row = rank[docs] * width + (self.suffixes - self.starts[docs]) if len(docs) else np.zeros(0, np.int64)
        level, least = np.log2(np.maximum(1, high - low)).astype(np.int64), np.zeros(len(of), np.int64)
        for k in range(int(level.max(initial=0)) + 1):  # row[i]: the least of 2 ** k values from i on
            row = np.minimum(row[: -(1 << k - 1)], row[1 << k - 1 :]) if k else row
            some = level == k
            least[some] = np.minimum(row[low[some]], row[high[some] - (1 << k)])
        order = np.argsort(rank)
        return self.starts[order[least // width]] + least % width

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each occurrence of a window: the window, its place in the shard, in order of place, and the longest match there:
        with any item, if it is as long as a full window, else the short item that it is."""
        q = self.q
        best, _ = self.longest()
        found = np.unique(q.suffix_window[(q.suffix_window >= 0) & (best >= q.size[q.suffix_window])])
        low, high = (_search(self.stream, self.suffixes, q.stream, q.at[found], q.size[found], through) for through in (False, True))
        n = high - low
        window = np.repeat(found, n)
        at = self.suffixes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        order = np.argsort(at, kind="stable")
        window, at = window[order], at[order]
        places, back = np.unique(at, return_inverse=True)
        reach, _ = _longest(q.stream, q.ordered, self.stream, places, np.minimum(self._known(places), q.depth))
        reach = reach[back]
        return window, at, np.where((reach >= q.window) & (q.size[window] == q.window), reach, q.size[window])

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def _annotated(batch: pa.RecordBatch, text: str, queries: Queries) -> pa.RecordBatch:
    """A batch, whose texts are one shard, with the added columns."""
    rows = []
    documents = [words(t) for t in batch.column(text).cast(pa.binary()).to_pylist()]
    shard = Shard(documents, queries)
    window, at, reach = shard.occurrences()
    doc = shard.document(at)
    cut = np.searchsorted(doc, np.arange(len(documents) + 1))
    for i, ws in enumerate(documents):
        a, b = cut[i], cut[i + 1]
        if a == b:
            rows.append((len(ws), 0, [], [], 0, -1))
            continue
        first, last = at[a:b] - shard.starts[i], at[a:b] - shard.starts[i] + queries.size[window[a:b]]
        far = np.maximum.accumulate(last)
        new = np.flatnonzero(np.concatenate(([True], first[1:] > far[:-1])))
        starts, ends = first[new], far[np.concatenate((new[1:] - 1, [len(far) - 1]))]
        items = sorted({queries.names[x] for w in set(window[a:b].tolist()) for x in queries.item_of[queries.item_first[w] : queries.item_first[w + 1]].tolist()})
        longest = int(np.argmax(reach[a:b]))
        rows.append((len(ws), int((ends - starts).sum()), items, [{"first": int(s), "last": int(e) - 1} for s, e in zip(starts, ends, strict=True)], int(reach[a + longest]), int(first[longest])))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.int64(), pa.int64()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *ADDED])


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark's distinct items in blocks of block_bytes at most, an item that is larger alone, one after the other: how
    many there are, and one's items. Items are cut into runs by their running bytes, and runs are put together to blocks."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).distinct()
    size = F.coalesce(F.length("text"), F.lit(0)) + F.octet_length("item") + 64
    total = items.agg(F.sum(size)).first()[0] or 0
    if total <= block_bytes:
        yield 1, [(r[0], r[1]) for r in items.collect()]
        return
    placed = materialize(items.withColumn("at", F.monotonically_increasing_id()), "items")
    part = F.shiftright("at", 33)
    order, half = Window.partitionBy(part).orderBy("at"), max(1, block_bytes // 2)
    # A run begins where the bytes before pass a multiple of half a block, so that it has a block at most; larger items than
    # half a block are runs of their own.
    large = (F.col("size") > half).cast("long")
    runs = placed.select("at", part.alias("part"), size.alias("size"))
    before = F.coalesce(F.sum(F.when(large == 0, F.col("size"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("at", "part", "size", F.floor(before / half).alias("run"), (2 * F.sum(large).over(order) - large).alias("turn"))
    bounds = runs.groupBy("part", "run", "turn").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("size").alias("size")).orderBy("first").collect()
    blocks: list[list] = []
    for r in bounds:
        if blocks and blocks[-1][2] + r["size"] <= block_bytes:
            blocks[-1][1:] = [r["last"], blocks[-1][2] + r["size"]]
        else:
            blocks.append([r["first"], r["last"], r["size"]])
    for first, last, _ in blocks:
        yield len(blocks), [(r[0], r[1]) for r in placed.where(F.col("at").between(first, last)).select("item", "text").collect()]


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", window: int = 10, block_bytes: int = BLOCK) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a window of an item), item_ids (items with an
    occurring window, sorted as strings), spans (merged runs of hit words), longest_match (the longest verbatim match, in
    words, that holds a window; 0 if there is none) and longest_at (the word, from 0, at which it first begins; -1 if there is none).

    A window is `window` consecutive words of an item; an item of fewer words is one window. Null and empty texts and
    items have no words and match nothing. Repeated items count once in item_ids if their ids are equal; a null item id
    stands as an empty string. Repeated documents are each reported. Columns of docs with the added names, in any letter
    case, are replaced. A benchmark of more than block_bytes is searched in several passes over numbered rows, whose
    results are merged by that number, whether keys are null, repeated or neither.
    """
    base, rows, results = without(docs, list(ADDED)), None, []
    for n, items in _blocks(benchmark, block_bytes):
        queries = docs.sparkSession.sparkContext.broadcast(prepare(sorted(items, key=lambda x: (x[0], x[1] or b"")), window))

        def run(batches, queries=queries, text=text if n == 1 else "text"):
            for batch in batches:
                for shard in slices(batch, text, SHARD):
                    yield _annotated(shard, text, queries.value)

        if n == 1:
            return in_arrow(base, run, extended(base, **ADDED))
        if rows is None:
            rows = numbered(base, "rows")
        part = rows.select("row", F.col("doc")[text].alias("text"))
        found = in_arrow(part, run, extended(part, **ADDED)).drop("text")
        results.append(materialize(found.where("n_hit > 0") if results else found, "hits"))  # the first has every row's n_words
        queries.destroy()
    hits = reduce(DataFrame.unionByName, results).groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
        F.max("longest_match").alias("longest_match"), F.min(F.struct((-F.col("longest_match")).alias("n"), "longest_at"))["longest_at"].alias("longest_at"),
    )
    none = F.array().cast("array<struct<first:long,last:long>>")
    merged = F.aggregate("s", none, lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["last"] + 1 >= x["first"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["first"].alias("first"), F.greatest(F.element_at(a, -1)["last"], x["last"]).alias("last"))))).otherwise(F.concat(a, F.array(x))))
    hits = hits.select("row", "n_words", "item_ids", merged.alias("spans"), "longest_match", "longest_at").withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1))
    return rows.join(hits, "row").select("doc.*", *ADDED)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those in which a window of a benchmark item occurs; the columns stay as they are."""
    clashing = [c for c in docs.columns if c.lower() in ADDED]
    if clashing:
        raise ValueError(f"columns {clashing} clash with the report's; rename them first")
    return annotate(docs, benchmark, **options).where("n_hit = 0").select(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK) -> DataFrame:
    """For every test suffix (item_id, start) of the distinct items: n_match, the longest verbatim match in the training text in
    words, and place and at, the key and word of one: of equals that with the smallest key as text, a null key last. 0 and nulls
    if even the first word is absent. Null and empty texts match nothing; other columns of docs are not read. Each task keeps its
    best matches and gives them once, so that the rows that are shuffled do not grow with the number of shards."""
    base, results = docs.select(F.col(key).cast("string").alias("place"), F.col(text).alias("text")), []
    for n, items in _blocks(benchmark, block_bytes):
        queries = docs.sparkSession.sparkContext.broadcast(prepare(items, 1))

        def run(batches, queries=queries):
            q = queries.value
            starts = q.suffix_at - q.suffix_at[np.searchsorted(q.suffix_item, q.suffix_item)] if len(q.suffix_at) else q.suffix_at
            longest, where = np.zeros(len(q.suffix_at), np.int64), [None] * len(q.suffix_at)
            for batch in batches:
                for part in slices(batch, "text", SHARD):
                    keys = part.column("place").to_pylist()
                    shard = Shard([words(t) for t in part.column("text").cast(pa.binary()).to_pylist()], q)
                    best, _ = shard.longest()
                    better = np.flatnonzero((best > 0) & (best >= longest))
                    rank = np.empty(len(keys), np.int64)
                    rank[sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or "", i))] = np.arange(len(keys))
                    places = shard.least_places(best, better, rank)
                    for i, at, doc in zip(better.tolist(), places.tolist(), shard.document(places).tolist(), strict=True):
                        here = (keys[doc] is None, keys[doc] or "", at - int(shard.starts[doc]))
                        if best[i] > longest[i] or here < where[i]:
                            longest[i], where[i] = best[i], here
            names = [q.names[i] for i in q.suffix_item.tolist()]
            yield pa.RecordBatch.from_pydict({"item_id": names, "start": starts, "n_match": longest, "place": pa.array([None if w is None or w[0] else w[1] for w in where], pa.string()), "at": pa.array([w and w[2] for w in where], pa.int64())})

        found = in_arrow(base, run, "item_id string, start long, n_match long, place string, at long")
        results.append(found if n == 1 else materialize(found, "matches"))
        if n > 1:
            queries.destroy()
    order = F.struct((-F.col("n_match")).alias("n"), F.col("place").isNull().alias("none"), "place", "at")
    return reduce(DataFrame.union, results).groupBy("item_id", "start").agg(F.min_by(F.struct("n_match", "place", "at"), order).alias("m")).select("item_id", "start", "m.*")
