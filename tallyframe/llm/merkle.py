"""A Merkle manifest of a table: one tree for each group of rows, a tree over the groups' roots, and a proof for each row.

Superblocks: a row's place in its tree, divided by fanout ** levels, is its bucket. applyInPandas folds `levels` levels of a
bucket at once, the buckets' roots are folded the same way until one node is left, and the proofs go the way back: a bucket's
own lower proof is followed by the upper proof of its root. No task ever holds more than fanout ** levels nodes, so a group
with most of the rows is spread over as many tasks as any others; a billion leaves need three rounds.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import are_few, extended, materialize, without

PROOF = "array<struct<left:string,right:string>>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_hash(*fields: Column) -> Column:
    """sha256, as hex, of the fields joined: `-` for a null, else the bytes of its text, a colon and the text."""
    parts = [F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to; the leaf is proven if it is the manifest's root."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _folds(nodes: list[str], fanout: int, levels: int, whole: bool) -> list[list[str]]:
    """The nodes of a bucket, level by level. A bucket that is a whole tree ends at its root; part of a larger tree goes through
    all levels, as runs of one node are hashed, too, while the tree has several."""
    out = [nodes]
    for _ in range(levels):
        if whole and len(out[-1]) == 1:
            break
        out.append([_hash(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with `at`, each row's place from 0 in the order of some columns, nulls first. It is dealt out by ranges of all of
    them and written once, so that a row keeps its place; only the number of rows of each range comes to the driver."""
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    written = materialize(placed, name)
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r["count"]) for r in written.groupBy(part.alias("part")).count().collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "part long, before long")
    out = written.withColumn("part", part).join(F.broadcast(starts), "part")
    return out.withColumn("at", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before")


def _bucket(span: int) -> Column:
    return F.floor(F.col("index") / span).cast("long").alias("bucket") if span & (span - 1) else F.shiftright("index", span.bit_length() - 1).alias("bucket")


def _rounds(nodes: DataFrame, most: int, fanout: int, levels: int) -> list[DataFrame]:
    """nodes (tree, index, size, node) and the roots of their buckets, round by round, until each tree has one node. most: the
    leaves of the largest tree."""
    span = fanout**levels

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        tree, index, size = (int(rows[c].iloc[0]) for c in ("tree", "index", "size"))
        root = _folds(rows["node"].tolist(), fanout, levels, size <= span)[-1][0]
        return pd.DataFrame({"tree": [tree], "index": [index // span], "size": [-(-size // span)], "node": [root]})

    out = [nodes]
    while most > 1:
        roots = out[-1].select("tree", "index", "size", "node").groupBy("tree", _bucket(span)).applyInPandas(fold, "tree long, index long, size long, node string")
        out.append(materialize(roots, "merkle-roots"))
        most = -(-most // span)
    return out


def _proofs(nodes: DataFrame, upper: DataFrame, fanout: int, levels: int, passed: list[str]) -> DataFrame:
    """nodes with `proof`, up to the top, and the columns `passed` of upper (tree, index, proof and these), whose rows are the
    roots of the nodes' buckets."""
    span = fanout**levels
    columns = [f.name for f in nodes.schema.fields]

    def prove(below: pa.Table, above: pa.Table) -> pa.Table:
        below = below.combine_chunks().sort_by("index")
        if not below.num_rows:
            return pa.table({**{c: below.column(c) for c in columns}, "proof": pa.array([], _STEPS), **{c: pa.array([], pa.string()) for c in passed}})
        folds = _folds(below.column("node").to_pylist(), fanout, levels, below.column("size")[0].as_py() <= span)
        steps = []
        for level in folds[:-1]:
            own = []
            for i in range(len(level)):
                first = i - i % fanout
                own.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
            steps.append(own)
        top = [(s["left"], s["right"]) for s in above.column("proof")[0].as_py()]
        left, right, n = [], [], below.num_rows
        for i in range(n):
            at = i
            for own in steps:
                left.append(own[at][0])
                right.append(own[at][1])
                at //= fanout
            for a, b in top:
                left.append(a)
                right.append(b)
        each = len(steps) + len(top)
        proof = pa.ListArray.from_arrays(pa.array(range(0, each * n + 1, each) if each else [0] * (n + 1), pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
        return pa.table({**{c: below.column(c) for c in columns}, "proof": proof, **{c: pa.array(above.column(c).to_pylist() * n, pa.string()) for c in passed}})

    schema = extended(nodes, proof=PROOF, **dict.fromkeys(passed, "string"))
    key = F.col("index").alias("bucket")
    return nodes.groupBy("tree", _bucket(span)).cogroup(upper.groupBy("tree", key)).applyInArrow(prove, schema)


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "lang", fanout: int = 8, levels: int = 4) -> DataFrame:
    """rows with `subroot`, `root` and `proof`: the hash of their group's tree, that of the tree over the groups, and the
    siblings from the leaf to it, of which those before and after the own node are joined at each level.

    rows: `leaf` (hex digests, such as leaf_hash() gives), key, group, and other columns, which stay. Leaves of a group ascend by
    key, nulls first; while there are several nodes, each `fanout` of them become the hash of their joined hex texts. Groups
    ascend, null first. Rows of one key are put in the order of their leaves; equal rows have equal leaves, and any of them may
    have the earlier place. Leaves are of one size whatever the texts' lengths. Columns named subroot, root, proof, tree, index,
    size, node or at, in any letter case, are left out. An empty table gives no row and has no root.
    """
    added = ["subroot", "root", "proof", "tree", "index", "size", "node", "at"]
    rows = materialize(without(rows, added), "merkle-leaves")
    placed = ranked(rows, [group, key, "leaf"], "merkle-placed")
    groups = ranked(placed.groupBy(group).agg(F.count("*").alias("size"), F.min("at").alias("first")), [group], "merkle-groups")
    total, most = groups.agg(F.count("*"), F.max("size")).first()
    trees = groups.select(F.col(group).alias("of"), "size", "first", F.col("at").alias("tree"))
    trees = F.broadcast(trees) if are_few(groups, group) else trees
    nodes = placed.join(trees, F.col(group).eqNullSafe(F.col("of"))).select(*[f"`{c}`" for c in rows.columns], "tree", (F.col("at") - F.col("first")).alias("index"), "size", F.col("leaf").alias("node"))
    lower = _rounds(nodes, most or 0, fanout, levels)
    over = lower[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(total).cast("long").alias("size"), "node")
    upper = _rounds(over, total, fanout, levels)
    proven = upper[-1].select("tree", "index", F.array().cast(PROOF).alias("proof"), F.col("node").alias("root"), "node")
    for some in reversed(upper[:-1]):
        proven = materialize(_proofs(some, proven, fanout, levels, ["root"]), "merkle-proofs")
    proven = proven.select(F.col("index").alias("tree"), F.lit(0).cast("long").alias("index"), "proof", F.col("node").alias("subroot"), "root")
    for some in reversed(lower[1:-1]):
        proven = materialize(_proofs(some, proven.select("tree", "index", "proof", "subroot", "root"), fanout, levels, ["subroot", "root"]), "merkle-proofs")
    return _proofs(nodes, proven.select("tree", "index", "proof", "subroot", "root"), fanout, levels, ["subroot", "root"]).drop("tree", "index", "size", "node")
