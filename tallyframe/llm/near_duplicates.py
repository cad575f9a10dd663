"""MinHash near-duplicates by an inverted join over signature coordinates.

1. A document's words give a set of shingles, the set a signature of `coordinates` minima. Documents with equal sets form a
   class, and one stands for it from here on: copies are never expanded.
2. A document is posted under its (coordinate, value) pairs. Values that one document alone has cannot collide. Two sets of
   Jaccard similarity 0.8 agree in at least `least` of 40 coordinates but for a chance of 2e-10, so, with a document's values in
   order of how many documents share them, all but the last least - 1 of its shared values (the prefix) must hold a common
   value of any pair: only the prefix is posted, and the values that very many documents share are mostly skipped.
3. Long lists are not expanded into all pairs. Their members are first compared with a few pivots, and confirmed links join
   components; a list whose members are all in one component is done: further links in it change nothing. In what is
   left, members outside a list's most frequent component meet all its members, in cells of two blocks: pairs are not
   written out. A list of many cells is first split by a second value, as any pair that may be linked has two common values
   among all but the last least - 2: what shares one frequent value alone meets nowhere. Those of different components are compared, as sets if sizes
   and collisions allow a link.
4. A candidate pair is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import are_few, in_arrow, lacking, materialize, numbered, slices
from tallyframe.llm.components import components

COORDINATES = 40
#: The chance with which a pair at the limit of similarity may collide in too few coordinates.
MISS = 2e-10
#: Lists up to this length have all their pairs compared; longer ones are first compared with about so many pivots.
SHORT_LIST, PIVOTS = 32, 8
#: A block of a long list holds sets of about so many shingles together; a member counts for some more than its own.
CELL_COST, MEMBER_COST = 1_000_000, 100
#: Lists of more cells are split by a second value first; either way finds the same links.
WHOLE_CELLS = 64


def collisions(percent: int, coordinates: int = COORDINATES) -> int:
    """In how many coordinates, at least, two sets of Jaccard similarity percent / 100 agree, but for a chance of MISS: 14 of
    40 for 80. An error if that is fewer than two, as then nothing could be told from the coordinates."""
    least, missed, p = 0, 0.0, percent / 100
    while least < coordinates and (missed := missed + math.comb(coordinates, least) * p**least * (1 - p) ** (coordinates - least)) <= MISS:
        least += 1
    if least < 2:
        raise ValueError(f"{coordinates} coordinates cannot find pairs of similarity {p}; take more")
    return least


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64)


_PLACE, _MASK, _FACTOR, _NAME = _random(64, 1), _random(1024, 2), _random(1024, 3) | np.uint64(1), _random(1024, 4)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """word -> its 64-bit hash; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles: `size` words [^\\x20\\x09-\\x0D]+ in a row, A-Z lower-cased;
    fewer words are one shingle, none give an empty set."""
    get, lengths, hashes = _words.__getitem__, [], []
    for t in texts:
        ws = t.lower().split() if t else []
        lengths.append(len(ws))
        hashes.append(np.fromiter(map(get, ws), np.uint64, len(ws)))
    w = np.concatenate([*hashes, np.zeros(size, np.uint64)])
    n = len(w) - size
    joined = reduce(np.add, (w[j : j + n] * _PLACE[j] for j in range(size)))
    joined, at, out = _mix(joined), 0, []
    for m, own in zip(lengths, hashes, strict=True):
        if m >= size:
            out.append(np.unique(joined[at : at + m - size + 1]))
        elif m:
            out.append(_mix(np.array([(own * _PLACE[:m]).sum() + np.uint64(m)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _texts(batch: pa.RecordBatch, text: str):
    for part in slices(batch, text, 1_000_000):
        yield part, part.column(text).cast(pa.binary()).to_pylist()


def features(docs: DataFrame, text: str, key: str, size: int, coordinates: int = COORDINATES) -> DataFrame:
    """key, n_shingles, a 128-bit hash of the set (set_a, set_b) and the signature: one value for each coordinate."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, texts in _texts(batch, text):
                sets = shingles(texts, size)
                counts = np.array([len(s) for s in sets])
                full = np.flatnonzero(counts)
                signature = np.zeros((len(full), coordinates), np.uint64)
                if len(full):
                    every, starts = np.concatenate(sets), (np.cumsum(counts) - counts)[full]
                    for k in range(coordinates):
                        signature[:, k] = np.minimum.reduceat((every ^ _MASK[k]) * _FACTOR[k], starts) ^ _NAME[k]
                rows = iter(_signed(_mix(signature.ravel())).reshape(-1, coordinates))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "key": part.column(key),
                    "n_shingles": counts,
                    "set_a": [int.from_bytes(d[:8], "little", signed=True) for d in digests],
                    "set_b": [int.from_bytes(d[8:], "little", signed=True) for d in digests],
                    "signature": pa.array([next(rows) if n else None for n in counts], pa.list_(pa.int64())),
                })

    return in_arrow(docs.select(key, text), run, f"key {kind}, n_shingles long, set_a long, set_b long, signature array<long>")


def _sets(docs: DataFrame, text: str, key: str, size: int, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of the wanted documents."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, texts in _texts(batch, text):
                yield pa.RecordBatch.from_pydict({"rep": part.column(key), "shingles": pa.array([_signed(s) for s in shingles(texts, size)], pa.list_(pa.int64()))})

    chosen = docs.select(key, text).join(F.broadcast(wanted) if are_few(wanted, "rep") else wanted, F.col(key) == F.col("rep"), "left_semi")
    return in_arrow(chosen, run, f"rep {kind}, shingles array<long>")


def _prefixes(reps: DataFrame, coordinates: int, least: int) -> DataFrame:
    """(rep, n, posted, extended): of each representative's shared values, in order of how many share them, all but the last
    least - 1 and all but the last least - 2. Of those that have fewer than least, nothing can be linked to another."""
    values = reps.select("rep", F.explode("signature").alias("value"))
    shared = values.groupBy("value").count().where("count > 1")
    own = values.join(shared, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("count", "value"))).alias("v"))
    first = lambda less: F.transform(F.slice("v", F.lit(1), F.size("v") - less), lambda x: x["value"])
    return own.where(F.size("v") >= least).select("rep", first(least - 1).alias("posted"), first(least - 2).alias("extended")).join(reps.select("rep", F.col("n_shingles").alias("n")), "rep")


def _pairs(members: DataFrame, chosen: DataFrame, condition: str) -> DataFrame:
    """Pairs (a, b) of a chosen and any member of one list, in different components and near enough in size. A pair that
    shares several lists is made in the one of its smallest common value only."""
    x, y = chosen.alias("x"), members.alias("y")
    once = "x.value = array_min(array_intersect(x.posted, y.posted))"
    on = F.expr(f"x.value = y.value AND x.c <> y.c AND (NOT y.pivot OR x.rep < y.rep) AND {condition} AND {once}")
    return x.join(y, on).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))


def _alike(common: str, percent: int) -> str:
    return f"100L * {common} >= {percent}L * (na + nb - {common})"


def _linked_in_cells(members: DataFrame, parts: DataFrame, whole: DataFrame, percent: int, least: int) -> DataFrame:
    """Links (u, v) that join all components that any link within the parts joins.

    members: (value, second, rep, c), second 0 for a list that is not split; parts: (value, second, main, outside, inside), a part's most frequent component and into
    how many blocks the members outside it, and all members, are dealt; whole: (rep, signature, shingles, posted, extended).
    Every member outside `main` meets every member in one cell of two blocks, so no pair is written out and a cell holds two
    blocks' sets at most.
    """
    dealt, kind = members.join(parts, ["value", "second"]), whole.schema["rep"].dataType.simpleString()
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = ("rep", "c", "posted", "extended", "signature", "shingles")
    left = dealt.where("c <> main").join(whole, "rep").select(F.col("value").alias("list"), F.col("second").alias("part"), block("outside").alias("i"), F.col("inside"), *held).withColumn("j", every("inside")).drop("inside")
    right = dealt.join(whole, "rep").select("value", "second", block("inside").alias("l"), F.col("outside"), *held).withColumn("k", every("outside")).drop("outside")
    right = right.toDF(*right.columns)  # so that the two sides, of one origin, do not share column ids

    def read(t: pa.Table) -> tuple:
        """reps, components, signatures (a row each), the same with 0 where a value is not posted, or not extended, and the sets."""
        rows = lambda name: [np.asarray(v.values) for v in t.column(name)]
        signature = np.array(rows("signature")).reshape(t.num_rows, -1)
        only = lambda name: np.array([np.where(np.isin(s, p), s, 0) for s, p in zip(signature, rows(name), strict=True)]).reshape(signature.shape)
        return t.column("rep").to_pylist(), t.column("c").to_pylist(), signature, only("posted"), only("extended"), [v.view(np.uint64) for v in rows("shingles")]

    most = np.iinfo(np.int64).max

    def smallest(theirs: np.ndarray, mine: np.ndarray, but: int | None = None) -> np.ndarray:
        """The smallest common value with each of theirs."""
        common = (theirs == mine) & (mine != 0) & (mine != but if but is not None else True)
        return np.where(common, theirs, most).min(axis=1, initial=most)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        u, v, kept = [], [], (left if left.num_rows else right).column("rep").type
        if left.num_rows and right.num_rows:
            value, second = left.column("list")[0].as_py(), left.column("part")[0].as_py()
            reps, own, signature, posted, extended, sets = read(left)
            others, theirs, signatures, posteds, extendeds, near = read(right)
            sizes, names = np.array([len(s) for s in near]), {}
            # which component each is in, as links are found
            ours = np.array([names.setdefault(c, len(names)) for c in own])
            at = np.array([names.setdefault(c, len(names)) for c in theirs])
            for x in range(len(reps)):
                mine = len(sets[x])
                near_enough = (at != ours[x]) & (100 * np.minimum(sizes, mine) >= percent * np.maximum(sizes, mine))
                some = np.flatnonzero(near_enough)
                some = some[(signatures[some] == signature[x]).sum(axis=1) >= least]
                # a pair that shares several parts is compared in the one of its smallest common values
                some = some[smallest(posteds[some], posted[x]) == value]
                if second:
                    some = some[smallest(extendeds[some], extended[x], value) == second]
                for y in some:
                    if at[y] != ours[x]:
                        place = np.minimum(np.searchsorted(sets[x], near[y]), mine - 1)
                        shared = int((sets[x][place] == near[y]).sum())
                        if 100 * shared >= percent * (mine + len(near[y]) - shared):
                            u.append(reps[x])
                            v.append(others[y])
                            joined = at[y]
                            at[at == joined] = ours[x]
                            ours[ours == joined] = ours[x]
        return pa.table({"u": pa.array(u, kept), "v": pa.array(v, kept)})

    return left.groupBy("list", "part", "i", "j").cogroup(right.groupBy("value", "second", "k", "l")).applyInArrow(run, f"u {kind}, v {kind}")


def _mixed(members: DataFrame, by: list[str]) -> DataFrame:
    """Of members (by, rep, n, c): the groups with more than one component, with their length, the most frequent component,
    and into how many blocks the members outside it, and all members, are dealt."""
    held = members.groupBy(*by, "c").agg(F.count("*").alias("size"), F.sum(F.col("n") + MEMBER_COST).alias("cost"))
    every = held.groupBy(*by).agg(F.sum("size").alias("length"), F.count("*").alias("parts"), F.sum("cost").alias("cost"), F.max_by(F.struct("c", "cost"), F.struct("size", "c")).alias("main"))
    blocks = lambda cost: F.ceil(cost / F.lit(CELL_COST))
    return every.where("parts > 1").select(*by, "length", F.col("main.c").alias("main"), blocks(F.col("cost") - F.col("main.cost")).alias("outside"), blocks(F.col("cost")).alias("inside"))


def links(docs: DataFrame, text: str, key: str, size: int, percent: int, reps: DataFrame, coordinates: int, least: int) -> DataFrame | None:
    """(node, component) of representatives that have a link to another."""
    prefixes = materialize(_prefixes(reps, coordinates, least), "prefixes")
    postings = materialize(prefixes.select("rep", "n", "posted", F.explode("posted").alias("value")), "postings")
    sets = materialize(_sets(docs, text, key, size, prefixes.select("rep")), "sets")
    unit = F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) / float(1 << 40)
    sized = f"100L * least(x.n, y.n) >= {percent}L * greatest(x.n, y.n)"

    # first round: short lists have all their pairs, long ones those with some pivots
    lists = postings.groupBy("value").agg(F.count("*").alias("length"), F.min(unit).alias("nearest")).where("length > 1")
    members = postings.join(lists, "value").withColumn("c", F.col("rep"))
    members = members.withColumn("pivot", (F.col("length") <= SHORT_LIST) | (unit <= F.col("nearest")) | (unit < F.lit(float(PIVOTS)) / F.col("length")))
    pairs = _pairs(members, members.where("pivot"), sized)
    signatures = reps.select("rep", "n_shingles", "signature")
    pairs = pairs.join(signatures.toDF("a", "na", "sa"), "a").join(signatures.toDF("b", "nb", "sb"), "b")
    pairs = materialize(pairs.where(F.size(F.array_intersect("sa", "sb")) >= least).select("a", "b", "na", "nb"), "pairs")
    tested = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").withColumn("common", F.size(F.array_intersect("xa", "xb")))
    found = materialize(tested.where(_alike("common", percent)).select(F.col("a").alias("u"), F.col("b").alias("v")), "found")
    grouped = None if found.isEmpty() else components(found)

    # second round: long lists that hold more than one component; those of many cells are split by a second value
    c = postings.withColumn("c", F.col("rep")) if grouped is None else postings.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    lists = materialize(_mixed(c, ["value"]).where(f"length > {SHORT_LIST}").drop("length"), "mixed-lists")
    if lists.isEmpty():
        return grouped
    cells = F.col("outside") * F.col("inside")
    few, many = lists.where(cells <= WHOLE_CELLS).withColumn("second", F.lit(0).cast("long")), lists.where(cells > WHOLE_CELLS)
    split = c.join(many.select("value"), "value").select("value", "rep", "n", "c").join(prefixes.select("rep", "extended"), "rep")
    split = materialize(split.select("value", "rep", "n", "c", F.explode(F.filter("extended", lambda x: x != F.col("value"))).alias("second")), "members")
    members = split.drop("n").unionByName(c.join(few.select("value", "second"), "value").select("value", "rep", "c", "second"))
    parts = materialize(few.unionByName(_mixed(split, ["value", "second"]).drop("length")), "parts")
    whole = signatures.select("rep", "signature").join(sets, "rep").join(prefixes.select("rep", "posted", "extended"), "rep")
    more = materialize(_linked_in_cells(members, parts, whole, percent, least), "links")
    return grouped if more.isEmpty() else components(found.union(more))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id (the smallest key that links reach) and kept (key =
    component_id).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. Null, empty and blank
    texts have empty sets, are linked with nothing and are kept. Rows that repeat a key count as one document. A null key
    is kept, with a null component_id. Other columns of docs do not matter. An empty table gives an empty one. Lower
    similarities need more coordinates; an error says so.
    """
    least = collisions(percent, coordinates)
    feats = materialize(features(docs, text, key, size, coordinates), "features")
    full = feats.where("n_shingles > 0 AND key IS NOT NULL")
    classes = full.groupBy("set_a", "set_b").agg(F.min("key").alias("rep"))
    reps = full.join(classes, [full.set_a == classes.set_a, full.set_b == classes.set_b, full.key == classes.rep], "left_semi")
    reps = materialize(reps.select(F.col("key").alias("rep"), "n_shingles", "signature").dropDuplicates(["rep"]), "representatives")
    grouped = links(docs, text, key, size, percent, reps, coordinates, least)
    if grouped is not None:
        classes = classes.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("rep"))
    rows = feats.select("key", "n_shingles", "set_a", "set_b")
    linked = rows.where("n_shingles > 0").join(classes, ["set_a", "set_b"], "left").select("key", "n_shingles", F.when(F.col("key").isNotNull(), F.col("rep")).alias("component_id"))
    alone = rows.where("n_shingles = 0").select("key", "n_shingles", F.col("key").alias("component_id"))
    return linked.union(alone).select(F.col("key").alias(key), "n_shingles", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each group of near-duplicate rows; the columns stay as they are.

    Rows are compared and dropped one by one, whether their key is null, repeated or neither. A group keeps the row with the
    smallest key, null last; of equal keys the one with the smallest hash of its text, of equal texts any one.
    """
    rows = numbered(docs, "rows")
    texts = rows.select("row", F.col("doc")[text].alias("text"))
    grouped = materialize(near_duplicates(texts, "text", "row", **options).where("n_shingles > 0").select("row", "component_id"), "grouped")
    several = grouped.join(grouped.groupBy("component_id").count().where("count > 1").select("component_id"), "component_id")
    name = F.col("doc")[key]
    order = rows.select("row", F.struct(name.isNull().alias("none"), name.alias("key"), F.xxhash64(F.col("doc")[text]).alias("hash"), "row").alias("o"))
    elected = order.join(several, "row").groupBy("component_id").agg(F.min("o")["row"].alias("row")).select("row")
    dropped = materialize(several.select("row").join(elected, "row", "left_anti"), "dropped")
    return lacking(rows, "row", dropped).select("doc.*")
