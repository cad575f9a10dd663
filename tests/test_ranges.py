"""CSV files cut into ranges of a few bytes against the same files read from the start."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.digests import row_hash, set_digest
from tallyframe.sources import grid, ranges

PIECES = ['"', '""', '"a\nb"', '"x\r\ny"', "plain", "é", "日本", " ", "\n", "\r\n", "\n\n", "\r", ",", ";", ",,", ";;", '"q""q"', 'a"b', '"open', '\n"', '",', "1.5", "   \n", "\n,;,\n"]


def content(r, n):
    return ("﻿" if r.random() < 0.3 else "") + "".join(r.choice(PIECES) for _ in range(n))


def seen(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.sheet, tuple(r.headers), r.row_index, r.spreadsheet_row, tuple(r.cells)) for r in df.collect())


@pytest.fixture
def cut_small(spark):
    names = {"spark.sql.files.maxPartitionBytes": "37b", "spark.sql.files.openCostInBytes": "1b"}
    was = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_ranges_give_the_rows_of_whole_files(spark, tmp_path, cut_small):
    r = random.Random(3)
    for i in range(40):
        (tmp_path / f"f{i}.csv").write_bytes(content(r, r.randrange(120)).encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "header only.csv").write_bytes(b"a,b\n")
    (tmp_path / "bad bytes.csv").write_bytes(b"a;b\n\xff\xfe;1\n\n2;\"3\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\"\n4;5")
    path = f"file://{tmp_path}"
    assert ranges.range_states(ranges._lines(spark, path, None)).count() > 200
    got, want = seen(ranges.read_ranges(spark, path)), seen(grid.read_rows(spark, path))
    assert got == want and len(got) > 300


def test_lines_keep_their_order_where_states_are_not_broadcast(spark, tmp_path, cut_small, monkeypatch):
    r = random.Random(4)
    for i in range(6):
        (tmp_path / f"f{i}.csv").write_bytes(content(r, 100).encode())
    want = seen(grid.read_rows(spark, f"file://{tmp_path}"))
    monkeypatch.setattr(ranges, "_FEW", 0)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # several ranges, and many lines of each, meet in a task
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
        assert seen(ranges.read_ranges(spark, f"file://{tmp_path}")) == want and len(want) > 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_large_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    r = random.Random(5)
    rows = ["ref,note,amount"]
    for i in range(20_000):
        note = '"' + r.choice(["one\ntwo", 'said ""so""', "a, b\n\n\nc", "x;y"]) + '"'
        rows.append(f"R{i},{note},{i}.50" + ("\n" if i % 7 == 0 else ""))
    (tmp_path / "big.csv").write_text("\n".join(rows))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        many = ranges.read_ranges(spark, f"file://{tmp_path}")
        assert ranges._lines(spark, f"file://{tmp_path}", None).rdd.getNumPartitions() > 50
        cut = seen(many)
        digest = many.select("content_hash").distinct().collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    one = ranges.read_ranges(spark, f"file://{tmp_path}")
    assert cut == seen(grid.read_rows(spark, f"file://{tmp_path}"))
    assert digest == one.select("content_hash").distinct().collect() and len(digest) == 1


def test_true_record_numbers_survive_blank_records(spark):
    files = spark.createDataFrame([("a.csv", bytearray(b"\na,b\n1,2\n\n , \n3,4\n"))], "path string, content binary")
    assert [(r.row_index, r.spreadsheet_row, r.cells) for r in grid.rows_of(files).collect()] == [(0, 3, ["1", "2"]), (1, 6, ["3", "4"])]


def test_digests_of_sets_are_sums_of_their_parts(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("part"), row_hash(F.col("id"), F.lit(None).cast("string")).alias("h"))
    whole = rows.agg(set_digest(F.col("h"))).first()[0]
    assert rows.repartition(13).groupBy("part").agg(set_digest(F.col("h")).alias("d")).agg(set_digest(F.col("d"))).first()[0] == whole
    assert rows.union(rows.limit(1)).agg(set_digest(F.col("h"))).first()[0] != whole != rows.where("part > 0").agg(set_digest(F.col("h"))).first()[0]
    plain = [sum(int(r.h[16 * i : 16 * i + 16], 16) for r in rows.collect()) % 2**64 for i in range(4)]
    assert whole == "".join(f"{x:016x}" for x in plain)


def test_small_files_are_read_once(spark, tmp_path):
    r = random.Random(6)
    for i in range(30):
        (tmp_path / f"a+b %{i}é.csv").write_bytes(content(r, r.randrange(120)).encode())
    (tmp_path / "open.csv").write_bytes(b'a,b\n1,"2\n\n3')
    (tmp_path / "empty.csv").write_bytes(b"")
    path = f"file://{tmp_path}"
    want = seen(grid.read_rows(spark, path))
    found = ranges.read_ranges(spark, path, hashed=False)
    assert seen(found) == want and len(want) > 200
    lines = ranges._lines(spark, path, None)
    plan = ranges._small(lines.where(F.col("size") <= ranges._never_cut(spark)), False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and not any(x in plan for x in ("Aggregate", "Join", "Exchange")) and "content_hash" not in found.columns
    hashed = ranges.read_ranges(spark, path)
    assert seen(hashed) == want
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    of = lambda df: {(x.path, x.content_hash) for x in df.collect()}
    whole = of(hashed)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "37b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        assert of(ranges.read_ranges(spark, path)) == whole
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
