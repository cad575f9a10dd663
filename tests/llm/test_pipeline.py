import corpus_pipeline


def test_stages_filter_and_keep_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= seen and len(left) > 0.3 * len(seen), name
        docs, seen = docs.where(docs.doc_id.isin(sorted(left))), left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == seen
