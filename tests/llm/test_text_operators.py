import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import chat, decontaminate, encoding, html_text, language, near_duplicates, packing, quality, token_counts, token_store, toxicity

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [None, "", " ", "a  b\n\n c", "don't stop'sx 'S", "É\xa0x²³ ½ naïve", "日本語 テスト  x", "a\x1cb \x00 c", "<|endoftext|> <|startoftext|>x", "tab\tnew\r\n x ", "ß'll 12 345!?", "x́y é", "İSTANBUL ΣΑΣ", "…“q”—d", "word " * 3000]
DOCS = "doc_id long, text string"


def whole(path, text):
    t = Tokenizer.from_file(path)
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_gives_the_ids_of_whole_texts(path):
    e = encoding.Encoder(path, keep=8)  # forgets all the time
    assert [np.frombuffer(b, e.dtype).tolist() for b in e.ids(ODD)] == [whole(path, t) for t in ODD]


def windows_of(text, items, size=10):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    hit, found = set(), set()
    for item, t in items:
        ws = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
        k = min(size, len(ws))
        for p in range(len(ws) - k + 1 if k else 0):
            for s in range(len(words) - k + 1):
                if words[s : s + k] == ws[p : p + k]:
                    hit.update(range(s, s + k))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontaminate_against_brute_force(spark):
    r = random.Random(1)
    say = lambda n: " ".join(r.choice("ab c d É f".split()) for _ in range(n))
    items = [(1, say(30)), (2, "Short, ONE"), (3, None), (4, ""), (5, say(12)), (5, say(11)), (60, "a a a a a a a a a a a a")]
    docs = [(i, say(r.randrange(80))) for i in range(40)] + [(100, items[0][1]), (101, "x " + items[4][1] + " short one y"), (102, None), (103, ""), (104, "a " * 200), (104, "a " * 200)]
    d, b = spark.createDataFrame(docs, DOCS + "").withColumn("N_HIT", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *windows_of(t, items)) for i, t in docs)
    got = decontaminate.annotate(d, b).collect()
    assert sorted((x.doc_id, x.n_words, x.n_hit, x.item_ids) for x in got) == want
    unique = spark.createDataFrame([x for i, x in enumerate(docs) if x[0] != 104 or i == len(docs) - 1], DOCS)
    parts = decontaminate.annotate(unique, b, block_bytes=60).collect()
    assert sorted((x.doc_id, x.n_words, x.n_hit, tuple(x.item_ids)) for x in parts) == sorted({(i, n, h, tuple(f)) for i, n, h, f in want})
    assert {x.doc_id for x in decontaminate.decontaminate(unique, b).collect()} == {i for i, _, h, _ in want if not h}
    assert decontaminate.annotate(d, b.limit(0)).where("n_hit > 0").count() == 0
    best = {(x.item_id, x.start): x.n_match for x in decontaminate.longest_matches(unique, b.where("item_id = 1")).collect()}
    assert best[("1", 0)] == 30 and best[("1", 29)] == 1


def test_token_store_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i * 7 % 50, ODD[i % len(ODD)]) for i in range(40)], DOCS).repartition(5)
    path = f"file://{tmp_path}/store"
    token_store.write(docs, path, WORD, end_id=1, block_documents=4, partitions=3)
    start, want = 0, []
    for i, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: x[0]):
        ids = [*whole(WORD, t), 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_store.read(spark, path).collect()) == want
    some = docs.where("length(text) > 3").first()
    assert token_store.fetch(spark, path, some.doc_id) == [[*whole(WORD, some.text), 1]]
    empty = f"file://{tmp_path}/none"
    token_store.write(docs.limit(0), empty, WORD, end_id=1)
    assert token_store.read(spark, empty).count() == 0


def test_fill_is_the_best_subset_sum():
    r = random.Random(2)
    for _ in range(60):
        lengths = [r.randrange(1, 40) for _ in range(r.randrange(1, 9))]
        capacity = r.randrange(1, 90)
        counts = {k: lengths.count(k) for k in lengths}
        best = max(s for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= capacity)
        taken = packing.fill(counts, capacity)
        assert sum(k * n for k, n in taken.items()) == best and all(n <= counts[k] for k, n in taken.items())


def test_packing_places_every_id_once(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 1500)) for i in range(60)] + [(90, None), (91, "")], DOCS).repartition(3)
    pieces = packing.pack(docs, BYTE, 0, window=16).toPandas()
    for i, t in [(r.doc_id, r.text) for r in docs.collect()]:
        ids, own = [*whole(BYTE, t), 0], pieces[pieces.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(own.start, own.length, strict=True)]
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 1024
    sizes = pieces.groupby("sequence_id").length.sum()
    assert sum(1024 - s for s in sizes if s & (s - 1)) < 0.02 * sizes.sum()
    assert packing.pack(docs.limit(0), BYTE, 0).count() == 0


def near_groups(docs, size, percent):
    sets = {}
    for i, t in docs:
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[p : p + size]) for p in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set())
    parent = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[a] = parent[b] = min(parent[a], parent[b])
    return {i: (len(sets[i]), parent[i]) for i in sets}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    base = [f"w{r.randrange(400)}" for _ in range(60)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "lonely text of its own here")]
    for i in range(10, 70):
        ws = list(base)
        for _ in range(r.randrange(3)):
            ws[r.randrange(60)] = f"x{r.randrange(9999)}"
        docs.append((i, " ".join(ws)))
    docs += [(100 + i, " ".join(f"v{r.randrange(50)}" for _ in range(20))) for i in range(20)]
    df = spark.createDataFrame(docs, DOCS).withColumn("Key", F.lit(1))
    want = near_groups(docs, 4, 80)
    # the second: one pivot a list, and cells of several blocks; the third: lists split by a second value, too
    for short, pivots, cost, cells in ((32, 8, 1_000_000, 64), (2, 0, 800, 10_000), (2, 0, 800, 0)):
        for name, value in (("SHORT_LIST", short), ("PIVOTS", pivots), ("CELL_COST", cost), ("WHOLE_CELLS", cells)):
            monkeypatch.setattr(near_duplicates, name, value)
        got = near_duplicates.near_duplicates(df, size=4).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
        assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    assert {x.doc_id for x in near_duplicates.deduplicate(df, size=4).collect()} == {i for i, (_, c) in want.items() if i == c}
    assert near_duplicates.near_duplicates(df.limit(0), size=4).count() == 0


def test_language_and_toxicity_on_made_up_text(spark):
    r = random.Random(4)
    stems = {"aa": ["lomo", "rita", "sano"], "bb": ["krzt", "wschn", "pfulk"]}
    say = lambda lang, n=60: " ".join(r.choice(stems[lang]) + r.choice(stems[lang]) for _ in range(n))
    docs = [(i, say(lang), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    df = spark.createDataFrame(docs, DOCS + ", lang string")
    contents = language.fit(df.where("doc_id < 60"))
    held = language.identify(df.where("doc_id >= 60"), contents).collect()
    assert all(x.lang == x.lang_pred and 0 <= x.score <= 1 and not x.rejected for x in held)
    odd = language.identify(spark.createDataFrame([(1, None), (2, ""), (3, "123 !!")], DOCS), contents).collect()
    assert [(x.lang_pred, x.score, x.rejected) for x in odd] == [("und", 0.0, True)] * 3
    bad = spark.createDataFrame([(i, say("aa", 40) + (" grumblefoo nastybar" * 3 if i % 2 else "")) for i in range(120)] + [(900, None), (901, "")], DOCS)
    marks = bad.where("doc_id < 80").select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    scored = toxicity.score(bad, toxicity.fit(bad, marks)).collect()
    assert all(x.predicted == x.doc_id % 2 for x in scored if x.doc_id < 900)
    assert all(0 <= x.score <= 1 for x in scored)
    nothing = toxicity.score(bad, toxicity.fit(bad, marks.limit(0)))
    assert nothing.count() == 122


def counts_of(text):
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    covered = {q for p, g in enumerate(grams) if grams.count(g) > 1 for q in range(p, p + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_bounds(spark):
    r = random.Random(5)
    texts = [None, "", "a", "a b c d e", "x y z\n\nx y z\n \n", "é" * 50 + " #$ <b>", "a b c d e f a b c d e"] + ["\n".join(" ".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in range(12)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in quality.base_counts(df).collect()}
    assert got == {i: counts_of(t) for i, t in enumerate(texts)}
    cases = [(0, 100), (3, 100), (40, 2000), (0, 5), (5, 5), (1, 100), (30, 2000), (12, 2000), (4, 5)]
    tails = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for x in tails:
        exact = sum(math.comb(x.n, i) * 0.01**i * 0.99 ** (x.n - i) for i in range(x.k + 1))
        assert math.isclose(x.p, exact, rel_tol=1e-9)
    # millions of rejected rows: as many terms as the root of n
    many = spark.createDataFrame([(2_200_000_000, 1_000_000_000_000), (9_990_000_000, 1_000_000_000_000), (9_999_900_000, 1_000_000_000_000)], "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    assert many[0].p == 0 and 0 <= many[1].p < 1e-20 and 0.1 < many[2].p < 0.2


def test_quality_keeps_good_rows_and_drops_bad_ones(spark):
    good, bad = "plain words without any odd marks in them at all here now " * 3, "odd$$$ marks%%% in&&& every*** word||| of### this$$$ text%%% here*** now&&& again|||"
    rows = [(i, f"{i} {bad if i % 5 == 0 else good.replace('odd', str(i))}"[: None if i % 5 == 0 else 55], "en") for i in range(12000)]
    df = spark.createDataFrame(rows, DOCS + ", lang string")
    labels = df.select("doc_id", (F.col("doc_id") % 5 != 0).cast("int").alias("quality"))
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id % 5 = 0").count() == 0 and kept.where("doc_id % 5 <> 0").count() > 0.97 * 9600
    assert quality.judge(df.limit(50), labels.limit(0)).where("kept").count() == 50


def test_chat_parts_and_round_trip(spark, tmp_path):
    parts = f"parts array<{chat.PART}>"
    rows = [(1, 0, "user", "\\### Assistant: </turn> ok <image 0>", None), (1, 1, "assistant", None, [("text", "see \\<", None, None, None, None, None), ("image", None, "s3://i", 56, 30, None, None), ("audio", None, "a", None, None, 2.0, None), ("odd", None, "o", None, None, None, None), ("text", "<turn>", None, None, None, None, None)]), (2, 5, None, None, None), (None, 0, "assistant", "alone", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, " + parts)
    written = chat.format_turns(turns, parts="parts")
    attached = written.where("conv_id = 1 AND turn = 1").first()
    assert [(a.kind, a.ref, a.n_tokens) for a in attached.attachments] == [("image", "s3://i", 4), ("audio", "a", 50), ("other", "o", 0)]
    assert all(attached.formatted[a.at :].startswith(f"<{a.kind} ") for a in attached.attachments) and attached.n_placeholder_tokens == 54
    written.write.parquet(f"{tmp_path}/chat")
    got = {x.conv_id: x for x in chat.read_back(spark, f"{tmp_path}/chat").collect()}
    said = f"user\n{rows[0][3]}\nassistant\nsee \\<<turn>\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].n_turns == 2
    assert (got[1].loss_chars, got[1].loss_sha256) == (12, hashlib.sha256(b"see \\<<turn>").hexdigest())
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[None].loss_chars == 5


PROSE = "The quick fox and the dog was in a house of the king, and it is not for you to be there with them. " * 3
PAGES = {
    "": "",
    "<p>Hi &amp; bye": "Hi & bye",
    "a &lt; b &#38; c": "a < b & c",
    "<script>var x='</p>'</script>y<style>p{}</style>": "y",
    "<article><p>A&nbsp;B</p><div class='related'><p>no</p></div><p>C<b>d</b>e<br>f</article><div>out</div>": "A B\n\nCde f",
    "<!-- <p>x</p> --><p title=\"a>b\">z</p>": "z",
    f"<header>Site</header><div class='cookie-notice'>We use</div><form><input><p>Name</p></form><div><h2>Title</h2><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div><section id=comments><article class=comment><p>{PROSE}</p></article></section><aside>x</aside><footer>f": f"Title\n\n{PROSE.strip()}\n\nShort one.\n\n{PROSE.strip()}",
    "<nav><ul><li><a href=x>one</a></li></ul></nav><main><h1>T</h1><p>text &copy; here</main>": "T\n\ntext © here",
}


def test_html_blocks(spark):
    assert {p: html_text.main_text(p) for p in PAGES} == PAGES
    df = spark.createDataFrame([(1, "u", None), (2, None, "<p>x"), (2, None, "<p>x")], "page_id long, url string, html string")
    assert sorted((x.page_id, x.text, x.n_chars) for x in html_text.digest(df).collect()) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]


def test_tokens_are_attributed_once(spark):
    rows = [(1, "src", "Hello wörld\n\nnext line\nlast"), (2, None, None), (3, "s", "日本\n"), (3, "s", "日本\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = token_counts.token_counts(df, BYTE, ["source", "text"]).toPandas()
    for i, s, t in rows[:2]:
        own = got[got.doc_id == i]
        assert own.n_tokens.sum() == len(whole(BYTE, f"{s or ''}\n{t or ''}")) and own.n_chars.sum() == len(f"{s or ''}\n{t or ''}")
    assert token_counts.attribute(np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 4, 6, 9]))[0].tolist() == [0, 0, 2]
    assert token_counts.attribute(np.array([3]), np.array([5]), np.array([0, 4, 6]))[0].tolist() == [0]  # a tie goes to the earlier
