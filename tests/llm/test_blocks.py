"""Bounds of the benchmark's blocks, the longest matches of many shards, and sequences that are full."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, packing


def test_blocks_hold_distinct_items_up_to_their_bound(spark):
    equal = [(1, "x" * 1000)] * 50
    items = spark.createDataFrame([*equal, *[(i, "y" * (i % 900)) for i in range(300)], (999, "z" * 9000)], "item_id long, text string").repartition(5)
    blocks = list(decontaminate._blocks(items, 5000))
    sizes = [sum(len(t) + len(i) + 64 for i, t in some) for _, some in blocks]
    assert {n for n, _ in blocks} == {len(blocks)} and all(s <= 5000 or len(b[1]) == 1 for s, b in zip(sizes, blocks, strict=True))
    held = [x for _, some in blocks for x in some]
    assert len(held) == len(set(held)) == 302 and len(blocks) < 2 * sum(sizes) / 5000 + 12
    assert [n for n, _ in decontaminate._blocks(spark.createDataFrame(equal, "item_id long, text string"), 2000)] == [1]


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_longest_matches_and_their_places_whatever_the_shards(spark, monkeypatch, block_bytes):
    r = random.Random(block_bytes)
    say = lambda n: " ".join(r.choice("a b c d".split()) for _ in range(n))
    items = [(i, say(r.randrange(1, 9))) for i in range(12)] + [(1, None), (77, "never seen")]
    docs = [(r.choice([None, *range(30)]), say(r.randrange(12))) for _ in range(60)] + [(5, "a b c d a b c d"), (3, "a b c d a b c d"), (None, None)]
    monkeypatch.setattr(decontaminate, "SHARD", 40)
    said = [(None if k is None else str(k), re.findall("[a-z]+", t or "")) for k, t in docs]
    want = {}
    for item, text in set(items):
        q = re.findall("[a-z]+", text or "")
        for s in range(len(q)):
            best = (0,)
            for k, w in said:
                for at in range(len(w)):
                    n = 0
                    while at + n < len(w) and s + n < len(q) and w[at + n] == q[s + n]:
                        n += 1
                    if n:
                        best = min(best, (-n, k is None, k or "", at)) if best[0] else (-n, k is None, k or "", at)
            want[str(item), s] = (0, None, None) if not best[0] else (-best[0], None if best[1] else best[2], best[3])
    assert len({i for i, t in items if t}) == len([i for i, t in items if t])
    for parts in (1, 4):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        got = decontaminate.longest_matches(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
        assert {(x.item_id, x.start): (x.n_match, x.place, x.at) for x in got.collect()} == want


def test_all_sequences_of_a_task_are_full_but_its_last(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, "word " * r.randrange(0, 3000)) for i in range(400)], "doc_id long, text string").repartition(2)
    for window in (8, 4096):
        pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, window=window)
        sizes = [x.n for x in pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
        assert len(sizes) <= sum(sizes) // 1024 + 1 + 2 * 10 and all(n == 1024 or n & (n - 1) == 0 for n in sizes)
        whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"), F.sum(F.col("start") * 0 + F.col("length")).alias("k"))
        assert whole.where("n <> m").count() == 0
