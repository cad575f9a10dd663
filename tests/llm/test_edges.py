"""Empty tables, clashing columns, repeated rows, ties and very long texts, for each operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import chat, decontaminate, html_text, language, near_duplicates, packing, quality, token_counts, token_store, toxicity

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string"
SAID = [(1, "aa bb cc dd ee ff gg hh ii jj kk", "x"), (1, "aa bb cc dd ee ff gg hh ii jj kk", "x"), (2, "zz yy xx ww vv uu tt ss rr qq pp", "y"), (None, None, None), (3, "", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows, a null, an empty text, and columns named like those that operators add."""
    clashing = {n: F.lit("own") for n in ("N_HIT", "Score", "Predicted", "Lang_Pred", "Kept", "n_words", "n_tokens", "sequence_id", "Main_Text", "component_id", "row", "start", "doc")}
    return spark.createDataFrame(SAID, DOCS).withColumns(clashing)


def model(spark):
    labelled = spark.createDataFrame([(i, "aa bb cc dd" if i % 2 else "zz yy xx ww", "x" if i % 2 else "y") for i in range(20)], DOCS)
    return labelled, language.fit(labelled), toxicity.fit(labelled, labelled.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))


def test_columns_that_clash_are_replaced_or_left_out_and_rows_repeat(spark, docs, tmp_path):
    _, contents, toxic = model(spark)
    items = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj")], "item_id long, text string")
    assert [(x.doc_id, x.n_hit, x.longest_match, x.longest_at) for x in decontaminate.annotate(docs, items).where("n_hit > 0").collect()] == [(1, 10, 10, 0)] * 2
    with pytest.raises(ValueError, match="clash"):
        decontaminate.decontaminate(docs, items)
    path = f"file://{tmp_path}/store"
    token_store.write(docs, path, WORD, end_id=1)
    assert [x.key for x in token_store.read(spark, path).orderBy("start").collect()] == [None, 1, 1, 2, 3]
    near = near_duplicates.near_duplicates(docs, size=4).collect()
    assert sorted((x.doc_id or 0, x.component_id, x.kept) for x in near) == [(0, None, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True)]
    assert near_duplicates.deduplicate(docs, size=4).columns == docs.columns
    pieces = packing.pack(docs, BYTE, 0)
    assert pieces.columns[0] == "doc_id" and pieces.where("doc_id = 1").count() >= 2
    with pytest.raises(ValueError, match="rename"):
        packing.pack(docs, BYTE, 0, key="start")
    scored = toxicity.score(docs, toxic)
    assert len({c.lower() for c in scored.columns}) == len(scored.columns) and scored.where("doc_id = 1").select("score").distinct().count() == 1
    told = language.identify(docs, contents)
    assert [(x.lang_pred, x.rejected) for x in told.where("doc_id = 1").collect()] == [("x", False)] * 2
    assert [x.lang_pred for x in told.where("doc_id = 3 OR doc_id IS NULL").collect()] == ["und"] * 2
    counted = token_counts.token_counts(docs, BYTE, ["text"])
    assert counted.where("doc_id = 1").count() == 2 and counted.where("doc_id IS NULL").first().n_tokens == 0
    judged = quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert sorted((x.doc_id or 0, x.n_words, x.kept) for x in judged.collect()) == [(0, 0, False), (1, 11, True), (1, 11, True), (2, 11, True), (3, 0, False)]
    turns = docs.select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text").withColumn("formatted", F.lit("own"))
    chat.format_turns(turns).write.parquet(f"{tmp_path}/chat")
    assert chat.read_back(spark, f"{tmp_path}/chat").first().n_turns == 5
    assert html_text.extract(docs, "text").where("doc_id = 1").select("main_text").distinct().first()[0] == SAID[0][1]


def test_empty_tables(spark, docs, tmp_path):
    labelled, contents, toxic = model(spark)
    none = docs.limit(0)
    items = spark.createDataFrame([(1, "aa bb")], "item_id long, text string")
    assert decontaminate.annotate(none, items).count() == decontaminate.longest_matches(none.drop("n_words"), items).count() == 0
    assert near_duplicates.deduplicate(none).count() == packing.pack(none, BYTE, 0).count() == 0
    assert toxicity.score(none, toxic).count() == language.identify(none, contents).count() == 0
    assert language.fit(labelled.limit(0)) == {} and toxicity.score(labelled, toxicity.fit(labelled.limit(0), labelled.limit(0).select("doc_id", F.lit(1).alias("toxic")))).count() == 20
    assert token_counts.token_counts(none, BYTE, ["text"]).count() == 0
    assert quality.judge(none, none.select("doc_id", F.lit(1).alias("quality"))).count() == quality.keep_good(none, none.select("doc_id", F.lit(1).alias("quality"))).count() == 0
    turns = none.select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    chat.format_turns(turns).write.parquet(f"{tmp_path}/none")
    assert chat.read_back(spark, f"{tmp_path}/none").count() == 0
    assert html_text.extract(none, "text").count() == 0


def test_ties_and_long_texts(spark):
    contents = {"b": b"same words here " * 20, "a": b"same words here " * 20}
    long = "same words here " * 100_000
    docs = spark.createDataFrame([(1, "same words here"), (2, long)], "doc_id long, text string")
    told = language.identify(docs, contents).orderBy("doc_id").collect()
    assert [(x.lang_pred, x.margin, x.rejected) for x in told] == [("a", 0.0, True)] * 2  # equal sums
    sizes = {x.doc_id: x.n for x in token_counts.token_counts(docs, BYTE, ["text"]).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    packed = {x.doc_id: x.n for x in packing.pack(docs, BYTE, 0).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert packed == {k: n + 1 for k, n in sizes.items()} and sizes[2] > 300_000
    near = {x.doc_id: x.n_shingles for x in near_duplicates.near_duplicates(docs, size=4).collect()}
    assert near == {1: 1, 2: 3}
    items = spark.createDataFrame([(7, "here same words here same words here same words here")], "item_id long, text string")
    hits = {x.doc_id: (x.n_hit, x.longest_match) for x in decontaminate.annotate(docs, items).collect()}
    assert hits[1] == (0, 0) and hits[2] == (300_000 - 2, 10)
    assert {x.doc_id: x.n_words for x in quality.base_counts(docs).collect()} == {1: 3, 2: 300_000}
    assert html_text.main_text("<div>" * 20_000 + "deep") == "deep"


def test_coordinates_follow_the_similarity(spark):
    assert near_duplicates.collisions(80) == 14
    with pytest.raises(ValueError, match="take more"):
        near_duplicates.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), percent=20)


def test_every_kind_of_part():
    flat = chat.Flattener(0, 0)
    for part in ({"type": "document", "ref": "d", "pages": 3}, {"type": "image", "ref": "i", "width": 29, "height": 1}, {"type": "audio", "ref": "a", "seconds": 1.5}, {}):
        flat.visit(part)
    assert [(a["kind"], a["ref"], a["n_tokens"]) for a in flat.attachments] == [("document", "d", 2400), ("image", "i", 2), ("audio", "a", 38)]
    assert "".join(flat.out) == "<document 0><image 1><audio 2>"
