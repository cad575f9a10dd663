"""Manifests against trees that are folded by plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from tallyframe.llm import merkle

SCHEMA = "doc_id long, lang string, leaf string"


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def tree(nodes, fanout):
    """The root and each node's siblings, level by level, by hashing one level after the other."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = range(place - place % fanout, min(place - place % fanout + fanout, len(nodes)))
            proofs[i].append(([nodes[j] for j in run if j < place], [nodes[j] for j in run if j > place]))
            at[i] = place // fanout
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def plain(rows, fanout):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    low = {g: tree([r[2] for r in groups[g]], fanout) for g in order}
    root, high = tree([low[g][0] for g in order], fanout)
    out = []
    for g, over in zip(order, high, strict=True):
        for row, under in zip(groups[g], low[g][1], strict=True):
            out.append((str(row), low[g][0], root, str([("".join(a), "".join(b)) for a, b in under + over])))
    return sorted(out)


def seen(df):
    return sorted((str((r.doc_id, r.lang, r.leaf)), r.subroot, r.root, str([(s.left, s.right) for s in r.proof])) for r in df.collect())


def table(n, seed):
    r = random.Random(seed)
    langs = [None, "", "de", "en", "en", "en", "en", "é", "z"]
    rows = [(i, r.choice(langs), sha(str(i))) for i in range(n)]
    return rows + [(None, "en", sha("x")), (None, "en", sha("y")), (3, "en", sha("tie")), (7, None, sha("same")), (7, None, sha("same"))]


def test_manifest_equals_a_tree_folded_level_by_level(spark):
    for n, fanout, levels in ((0, 8, 4), (200, 2, 1), (300, 3, 2), (150, 8, 1), (150, 8, 4)):
        rows = table(n, n)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert seen(merkle.manifest(df, fanout=fanout, levels=levels)) == plain(rows, fanout)


def test_many_groups_of_one_row_have_a_tree_of_several_rounds(spark):
    rows = [(i, f"g{i:03}", sha(str(i))) for i in range(100)]
    assert seen(merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=2, levels=2)) == plain(rows, 2)


def test_a_proof_holds_for_its_leaf_alone(spark):
    proven = merkle.manifest(spark.createDataFrame(table(100, 1), SCHEMA))
    held = proven.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("own"), (merkle.folded(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).alias("other"))
    assert {(r.own, r.other) for r in held.collect()} == {(True, False)}


def test_fields_nulls_and_long_texts(spark):
    long = "é" * 1_000_000
    rows = spark.createDataFrame([(1, None), (None, ""), (-5, "aé"), (6, long)], "a long, b string")
    got = [r[0] for r in rows.select(merkle.leaf_hash(F.col("a"), F.col("b"))).collect()]
    assert got == [sha("1:1-"), sha("-0:"), sha("2:-53:aé"), sha(f"1:62000000:{long}")]


def test_an_empty_table_and_columns_that_clash(spark):
    rows = spark.createDataFrame([(1, "en", sha("1"), "own", "own", "mine")], f"{SCHEMA}, ROOT string, at string, other string")
    assert merkle.manifest(rows.limit(0)).count() == 0
    one = merkle.manifest(rows).first()
    assert (one.subroot, one.root, one.proof, one.other) == (sha("1"), sha("1"), [], "mine")
