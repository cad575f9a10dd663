"""Rows with null and repeated keys are decided one by one."""

import random

from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, near_duplicates, quality

DOCS = "doc_id long, text string, lang string"
GOOD = "one two three four five six seven eight nine ten eleven twelve"
BAD = "too short"


def left(df):
    return sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in df.collect())


def test_quality_judges_rows_with_null_and_repeated_ids(spark):
    rows = [(1, GOOD, "en"), (1, BAD, "en"), (1, GOOD + " a", "en"), (None, GOOD, "en"), (None, BAD, "en"), (None, None, None), (2, BAD, "en")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("own"))
    kept = quality.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert kept.columns == docs.columns and {x.n_words for x in kept.collect()} == {"own"}
    assert left(kept) == [(False, 1, GOOD), (False, 1, GOOD + " a"), (True, 0, GOOD)]


def test_deduplicate_elects_one_row_of_each_group(spark):
    r = random.Random(6)
    say = lambda: " ".join(f"w{r.randrange(400)}" for _ in range(60))
    a, b, c, alone = say(), say(), say(), say()
    near = a + " end"
    rows = [(1, a), (2, near), (2, alone), (3, b), (3, b), (3, b), (None, c), (None, c), (None, near), (None, None), (None, ""), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS).repartition(3)
    kept = near_duplicates.deduplicate(docs, size=4)
    assert kept.columns == docs.columns
    want = [(1, a), (2, alone), (3, b), (None, c), (None, None), (None, ""), (5, ""), (5, "")]
    assert left(kept) == sorted((i is None, i or 0, t or "") for i, t in want)


def test_decontaminate_in_several_passes_judges_each_row(spark):
    r = random.Random(7)
    say = lambda n: " ".join(r.choice("a b c d e f".split()) for _ in range(n))
    items = spark.createDataFrame([(i, say(14)) for i in range(12)], "item_id long, text string")
    first = [x.text for x in items.orderBy("item_id").collect()]
    rows = [(None, "clean one"), (None, first[0]), (1, "clean two"), (1, f"x {first[1]} y {first[2]}"), (1, f"{first[3]} {first[4]}"), (1, "clean two"), (None, None), (2, say(200))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    seen = lambda df: sorted((x.text or "", x.doc_id or -1, x.n_words, x.n_hit, tuple(x.item_ids), tuple(map(tuple, x.spans))) for x in df.collect())
    once = decontaminate.annotate(docs, items)
    several = decontaminate.annotate(docs, items, block_bytes=60)
    assert several.columns == once.columns and seen(several) == seen(once)
    clean = decontaminate.decontaminate(docs, items, block_bytes=60)
    assert clean.columns == docs.columns
    assert left(clean) == left(decontaminate.decontaminate(docs, items)) and (True, 0, "clean one") in left(clean)
