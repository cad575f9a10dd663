"""Phrase counts and scores against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tallyframe.llm import collocations, words

SCHEMA = "doc_id long, text string, lang string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows, least, top, most=5):
    f = {}
    for _, text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            own.update(tuple(w[i : i + m]) for m in range(1, most + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        cands = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in cands.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], c)
        kept = []
        for p, a in cands.items():
            if inside[p] < a:
                score, _, l, r = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, q[2].decode(), -q[1], q[3], q[4], n, -q[0]) for i, q in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def documents(seed, n=120):
    r = random.Random(seed)
    vocabulary = [*"abcdefg", "A", "É", "é", "\0", "\1", "x\1", "a\0", "\1\2", "\1\3", "日本"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " !", "\x0b"]
    rows = [(i, "".join(r.choice(vocabulary) + r.choice(gaps) for _ in range(r.randrange(60))), r.choice(["en", "en", "de", None, "und", ""])) for i in range(n)]
    return [*rows, (None, None, "en"), (1, "", None), (5, "a b c d e f g. " * 40, "en"), (5, "a b c d e f g. " * 40, "en"), (6, "\1\2 \0", "\0\1")]


def test_collocations_equal_plain_counting_whatever_the_batches(spark):
    rows = documents(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'own' AS key", "1 AS N")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = sorted(tuple(x) for x in collocations.collocations(df, least=3, top=25).collect())
            assert got == plain(rows, 3, 25)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_one_long_text_and_no_text(spark):
    rows = [(1, "one two three four " * 50_000, "en")]
    got = [tuple(x) for x in collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == plain(rows, 100, 2000) and len(got) == 5
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, ".", "en")], SCHEMA)).count() == 0


def test_products_may_pass_64_bits(spark):
    phrases = spark.createDataFrame([("en\0a\0b", 3_000_000_000)], "key string, n long")
    counts = spark.createDataFrame([("en\0a", 4_000_000_000), ("en\0b", 5_000_000_000), ("en\0c", 10**15)], "key string, n long")
    got = collocations.scored(counts, phrases, 100, 10).first()
    n = 10**15 + 9_000_000_000
    assert (got.phrase, got.score, got.n) == ("a b", 1000 * 3_000_000_000 * n // (4_000_000_000 * 5_000_000_000), n)


def test_words_of_a_slice_of_texts():
    texts = pa.array(["no", "Aa bB", None, "", "cé  D.e", "f"])[1:]
    found = words.split(texts, words.classes(b" ", b"."))
    assert found.words.to_pylist() == ["aa", "bb", "cé", "d", "e", "f"]
    assert found.counts.tolist() == [2, 0, 0, 3, 1] and found.cut.tolist() == [True, False, True, False, True, True]
    assert found.sizes.tolist() == [2, 2, 3, 1, 1, 1] and bytes(found.data) == "aabbcédef".encode()
    none = words.split(pa.array([], pa.string()), words.classes(b" "))
    assert len(none.words) == 0 and np.array_equal(none.counts, [])
