"""What SQL cannot say: held-out labels, and plain readings of whole tables."""

import itertools
import math
import operator
import zlib
from html.parser import HTMLParser

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import zstandard
from test_text_operators import counts_of, near_groups, windows_of
from tokenizers import Tokenizer

from tallyframe.llm import html_text, language, toxicity
from tallyframe.llm.compression import letters, lengths
from tallyframe.llm.queries import QUERIES

SMALL, FOLDER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


class Reading(HTMLParser):
    """The article's paragraphs of a page whose article is a plain one."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts, self.out = 0, [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag == "br":
            self.parts.append(" ")
        elif tag not in ("b", "i", "a"):
            self.flush()

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "br"):
            self.flush()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_main_texts_of_all_pages_against_a_plain_reading():
    decided = set()
    for page in pq.read_table(f"{FOLDER}/pages.parquet").column("html").to_pylist():
        reading = Reading()
        reading.feed(page)
        reading.flush()
        assert html_text.main_text(page) == "\n\n".join(reading.out)
        decided |= {why for _, _, why in html_text.judged(page)}
    assert {"place", "density", "neighbours"} <= decided


def test_toxicity_on_labels_that_were_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    rows = QUERIES["op5_toxicity"](spark, FOLDER).where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    y = np.array([labels[r.doc_id] for r in rows if labels.get(r.doc_id) in (0, 1)])
    s = np.array([r.score for r in rows if labels.get(r.doc_id) in (0, 1)])
    assert s.min() >= 0 and s.max() <= 1 and len(y) > 500
    better = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + (s[y == 1][:, None] == s[y == 0][None, :]).mean() / 2
    assert better > 0.88 and (s[y == 0] >= 0.5).mean() < 0.02 and (s[y == 1] >= 0.5).mean() > 0.6


def test_toxicity_scores_of_documents_one_by_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    before, after = bytes(range(1, 32)), bytes(range(31, 0, -1))
    how = zstandard.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=19, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    ordinary, toxic = (zstandard.ZstdCompressionDict(d + before + after, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (model.ordinary, model.toxic))
    for d in (ordinary, toxic):
        d.precompute_compress(compression_params=how)

    def length(dictionary, word):
        return len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how).compress(before + b" " + word + b" " + after))

    tried = 0
    for r in sorted(toxicity.score(docs, model).collect(), key=lambda r: (len(r.text or ""), r.doc_id))[::9][:50]:
        words = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in (r.text or "").lower()).encode().split(b" ")
        gains = [length(ordinary, w) - length(toxic, w) for w in words if w]
        counts = [sum(g >= least for g in gains) for least in (2, 3, 4)]
        top = sorted(gains, reverse=True)[:3] or [0]
        x = [100 * c / max(1, len(gains)) for c in counts] + [math.log1p(c) for c in counts] + [top[0], sum(top) / len(top), math.log1p(len(gains)), 1]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, sum(map(operator.mul, x, model.weights)))))))
        assert r.predicted == (r.score >= 0.5)
        tried += bool(gains)
    assert tried > 20


def test_language_on_documents_that_were_held_out(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = QUERIES["op6_language"](spark, SMALL.replace("0.001", "0.01")).collect()
    held = [r for r in rows if r.held_out and truth[r.doc_id] is not None]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_is_the_dictionary_that_compresses_best(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    contents = language.fit(docs)
    measures = {name: lengths(raw, language.zstandard.STRATEGY_LAZY2, 4, 4, 16) for name, raw in contents.items()}
    for r in language.identify(docs, contents).where("lang_pred <> 'und'").collect():
        b = letters(r.text)
        sums = sorted((sum(measure(b[i : i + 1024]) for i in range(0, len(b), 1024)), name) for name, measure in measures.items())
        assert r.lang_pred == sums[0][1]


def test_tokens_of_sections_against_the_tokenizers_offsets(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {}
    for r in QUERIES["op7_token_counts"](spark, SMALL).collect():
        got.setdefault(r.doc_id, []).append((r.first_char, r.n_chars, r.n_tokens))
    tried = 0
    for d in docs.collect():
        whole = "\n".join((d.source or "", d.lang or "", d.text or ""))
        sections = sorted(got[d.doc_id])
        assert sum(n for _, n, _ in sections) == len(whole)
        if not whole.isascii():
            assert sum(n for _, _, n in sections) == len(tokenizer.encode(whole, add_special_tokens=False).ids)
            continue
        tried += 1
        spans, want = tokenizer.encode(whole, add_special_tokens=False).offsets, [0] * len(sections)
        for a, b in spans:
            overlaps = [max(0, min(b, first + n) - max(a, first)) for first, n, _ in sections]
            want[overlaps.index(max(overlaps))] += 1
        assert [n for _, _, n in sections] == want
    assert tried > 20


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    told = stages["language"](spark, docs, SMALL)
    assert len(ids(told)) > 0.9 * docs.where("length(text) > 200").count()
    texts = {r.doc_id: r.text for r in told.collect()}
    good = stages["quality"](spark, told, SMALL)
    failed = set()
    for i, t in texts.items():
        n, _, _, _, repeated = counts_of(t)
        if n < 10 or 100 * repeated > 20 * n:
            failed.add(i)
    assert ids(good) & failed == set() and len(ids(good)) > 0.8 * len(set(texts) - failed)
    texts = {i: texts[i] for i in ids(good)}
    kept = stages["near_duplicates"](spark, good, SMALL)
    assert ids(kept) == {i for i, (_, c) in near_groups(list(texts.items()), 5, 80).items() if i == c}
    texts = {i: texts[i] for i in ids(kept)}
    clean = stages["decontamination"](spark, kept, SMALL)
    assert ids(clean) == {i for i, t in texts.items() if windows_of(t, items)[1] == 0}
    assert clean.columns == docs.columns
    pieces = stages["packing"](spark, clean, SMALL)
    assert ids(pieces) == ids(clean)


def test_no_two_stages_share_a_name():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(a != b for a, b in itertools.combinations(names, 2)) and len(names) == 5
