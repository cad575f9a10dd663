"""The key index, documents as paths, sides in buckets, file reports, and small functions."""

import random
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyframe.adapters import get_family
from tallyframe.functions.money import magnitude
from tallyframe.functions.sql import register
from tallyframe.functions.text import common_subsequence, token_set_ratio
from tallyframe.operators import canonical, documents, locate, reconcile, reports, side_tables
from tallyframe.operators.store import Store, lineage_json, split_repeated
from tallyframe.plans import statements
from tallyframe.plans.bordereau import run_files

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_search_reads_the_buckets_of_its_keys_alone(spark, tmp_path):
    path, schema = f"{tmp_path}/index", "key string, place long"
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"), F.col("id").alias("place"))
    for half in (0, 1):
        locate.append(rows.where(F.col("place") % 2 == half), path)
    asked = spark.createDataFrame([("k7",), ("k7",), ("none",), (None,)], "key string")
    found = locate.locate(spark, path, asked, schema)
    assert sorted(r.place for r in found.collect()) == [i for i in range(5000) if i % 3 and i % 700 == 7]
    scan = next(x for x in plan_of(found).split("\n\n") if "Scan parquet" in x and "PartitionFilters" in x)
    buckets = {r[0] for r in asked.where("key IS NOT NULL").select(locate._bucket(F.col("key"), locate.BUCKETS)).collect()}
    filters = next(x for x in scan.split("\n") if x.startswith("PartitionFilters"))
    assert all(str(b) in filters for b in buckets) and filters.count(",") < len(buckets)  # two of 256
    assert locate.locate(spark, path, spark.createDataFrame([("hot",)], "key string"), schema).count() == 1667
    assert locate.locate(spark, f"{tmp_path}/nothing", asked, schema).count() == 0


def test_places_of_ingests_that_broke_off_are_not_found(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("f", "s", ["Ref", "Period", "GWP"], i + 2, [f"R{i // 2}", "01/2026", "5.00"]) for i in range(4)], "content_hash string, sheet string, headers array<string>, spreadsheet_row long, cells array<string>")
    tagged = canonical.canonicalise(rows, {"Ref": "policy_reference", "Period": "period", "GWP": "gross_premium"}, get_family("insurance"), canonical.Profile("s", "GBP"))
    files = spark.createDataFrame([("f", "s", "f.csv", "insurance", 1)], "content_hash string, sender string, filename string, family string, mapping_version int")
    assert store.ingest(files, tagged) == 1
    locate.append(spark.createDataFrame([("R0|2026-01", "g", 9, 1, "broken")], "key string, source_content_hash string, spreadsheet_row int, mapping_version int, ingest string").withColumn("spreadsheet_row", F.col("spreadsheet_row").cast("long")), f"{store.root}/key_index")
    asked = spark.createDataFrame([("R0|2026-01",)], "key string")
    assert sorted((r.source_content_hash, r.spreadsheet_row) for r in store.locate(asked).collect()) == [("f", 2), ("f", 3)]
    with pytest.raises(ValueError, match="one field"):
        store.confirm("s", 1, "insurance", {"a": "tax", "b": "tax"}, "me")


def test_rows_of_a_file_are_read_from_its_folder(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    names = [f"f{i}" for i in range(40)]
    rows = spark.createDataFrame([(n, "s", ["Ref", "Period", "GWP"], i + 2, [f"R{i}", "01/2026" if i else "TBC", f"{i}.00"]) for n in names for i in range(4)], "content_hash string, sheet string, headers array<string>, spreadsheet_row long, cells array<string>")
    tagged = canonical.canonicalise(rows, {"Ref": "policy_reference", "Period": "period", "GWP": "gross_premium"}, get_family("insurance"), canonical.Profile("s", "GBP"))
    files = rows.select("content_hash").distinct().selectExpr("content_hash", "'s' AS sender", "content_hash AS filename", "'insurance' AS family", "1 AS mapping_version")
    assert store.ingest(files.where("content_hash < 'f3'"), tagged) == 23 and store.ingest(files, tagged) == 17
    stored = store.table("ingested_file").agg(F.count("*"), F.sum("row_count"), F.sum("quarantined_count")).first()
    assert tuple(stored) == (40, 120, 40)
    found = store.rows_of("f7")
    assert [(r.key, r.gross) for r in found.collect()] == [(f"R{i}|2026-01", D(i)) for i in (1, 2, 3)] and "part" not in found.columns
    scan = next(x for x in plan_of(found).split("\n\n") if "Scan parquet" in x and "PartitionFilters" in x)
    own = spark.range(1).select(F.pmod(F.xxhash64(F.lit("f7")), F.lit(64))).first()[0]
    assert f"= {own})" in next(x for x in scan.split("\n") if x.startswith("PartitionFilters"))
    assert [r.source_content_hash for r in store.table("quarantine", "f7").collect()] == ["f7"] and store.rows_of("none").count() == 0
    store.reset()
    assert set(store.counts().values()) == {0}
    assert store.ingest(files.where("content_hash = 'f1'"), tagged) == 1 and store.counts()["ledger_row"] == 3


def test_repeats_are_counted_with_null_keys_and_frequent_keys(spark):
    given = [("f", "hot")] * 300 + [("g", "hot"), ("f", None), ("f", None), (None, None), (None, "k"), (None, "k"), ("g", "once")]
    got = split_repeated(spark.createDataFrame(given, "content_hash string, key string"))
    want = Counter(given)
    assert got.columns == ["content_hash", "key", "repeats"] and sorted(map(str, got.collect())) == sorted(str(Row(content_hash=f, key=k, repeats=want[f, k])) for f, k in given)
    alone = split_repeated(spark.createDataFrame([("a",), ("a",), (None,)], "key string"))
    assert sorted((r.key or "", r.repeats) for r in alone.collect()) == [("", 1), ("a", 2), ("a", 2)]
    assert split_repeated(alone.drop("repeats").limit(0)).count() == 0 and "Window" not in plan_of(got)


DOCUMENT = '{"b": {"x": [1, {"y": null}], "e": {}, "l": []}, "a.b": "t", "q\\"\\\\": true, "n": 1.50, "deep": [[[2]]]}'


def test_paths_of_a_document(spark):
    rows = spark.createDataFrame([(1, DOCUMENT), (2, None), (3, "no json"), (4, "5"), (5, "[]")], "id int, document string")
    got = {(r.id, r.path): (r.kind, r.value) for r in documents.paths(rows, ["id"]).collect()}
    assert got == {
        (1, "b.x[0]"): ("number", "1"), (1, "b.x[1].y"): ("null", "null"), (1, "b.e"): ("object", "{}"), (1, "b.l"): ("array", "[]"), (1, '["a.b"]'): ("string", '"t"'), (1, '["q\\"\\\\"]'): ("boolean", "true"),
        (1, "n"): ("number", "1.5"), (1, "deep[0][0][0]"): ("number", "2"), (3, ""): ("unreadable", "no json"), (4, ""): ("number", "5"), (5, ""): ("array", "[]"),
    }
    assert rows.select(documents.canonical_json(F.lit('{"b": 1, "a": [1, 2]}'))).first()[0] == '{"a":[1,2],"b":1}'


def test_changes_between_documents(spark):
    before = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2}, "same": [1]}'), (None, '{"a": 1}'), (3, '{"gone": 1}')], "id int, document string")
    after = spark.createDataFrame([(1, '{"same": [1], "a": "1", "b": {"d": 2}}'), (None, '{"a": 1.0}'), (4, '{"new": {}}')], "id int, document string")
    got = {(r.id, r.path): (r.change, r.old_value, r.new_value) for r in documents.changes(before, after, ["id"]).collect()}
    assert got == {(1, "a"): ("changed", "1", '"1"'), (1, "b.c"): ("removed", "2", None), (1, "b.d"): ("added", None, "2"), (3, "gone"): ("removed", "1", None), (4, "new"): ("added", None, "{}")}
    assert documents.changes(before.limit(0), after.limit(0), ["id"]).count() == 0


def test_documents_of_a_key_are_parsed_once_and_paths_are_not_shuffled(spark):
    texts = ['{"a": [[["[[[[{"]]]}', '{"a": "\\"[[", "b": {}}', "[[[[", '{"x": [1, [2, [3]]], "y": null}', None]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(texts, texts[1:], strict=False))], "id int, old string, document string")
    found = documents.changes(rows.selectExpr("id", "old AS document"), rows, ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and plan.count("Union") == 1
    got = {(r.id, r.path): (r.change, r.old_value, r.new_value) for r in found.collect()}
    assert got == {
        (0, "a[0][0][0]"): ("removed", '"[[[[{"', None), (0, "a"): ("added", None, '"\\"[["'), (0, "b"): ("added", None, "{}"), (1, "a"): ("removed", '"\\"[["', None), (1, "b"): ("removed", "{}", None), (1, ""): ("added", None, "[[[["), (2, ""): ("removed", "[[[[", None),
        **{(i, p): (("added", None, v) if i == 2 else ("removed", v, None)) for i in (2, 3) for p, v in (("x[0]", "1"), ("x[1][0]", "2"), ("x[1][1][0]", "3"), ("y", "null"))},
    }
    grouped = [rows.groupBy("id").agg(F.max(c).alias("document")) for c in ("old", "document")]  # both sides partitioned by the key
    again = documents.changes(*grouped, ["id"])
    assert "REPARTITION_BY_NUM" in again._jdf.queryExecution().executedPlan().toString() and sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    deep = spark.createDataFrame([(1, "[" * 101 + "]" * 101)], "id int, document string")
    with pytest.raises(ValueError, match="levels"):
        documents.paths(deep, ["id"])
    assert documents.paths(deep.selectExpr("id", "left(document, 150) AS document"), ["id"]).first().kind == "unreadable"


def test_saved_sides_meet_without_a_shuffle(spark, tmp_path):
    a, b = statements.statement(spark, SF), statements.ledger(spark, SF)
    for name, side in (("a", a), ("b", b)):
        side_tables.save_side(side, f"side_{name}", f"file://{tmp_path}/{name}", 6, "ordinal")
    found = side_tables.reconcile_tables(spark.table("side_a"), spark.table("side_b"))
    assert "Exchange" not in plan_of(found) and "SortMergeJoin" in plan_of(found)
    shown = ("key", "status", "rule", "detail")
    assert sorted(map(tuple, found.select(*shown).collect())) == sorted(map(tuple, reconcile.reconcile(a, b, ordinal="ordinal").select(*shown).collect()))


def test_report_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Policy Reference,Period,Gross Premium\nP1,2026-01,10.00\n\nP2,2026-01,5.50\nP3,TBC,1.00\n,Total,15.50\n")
    (tmp_path / "b.csv").write_text("Policy Reference,Period,Gross Premium\nP4,2026-01,7.00\n")
    (tmp_path / "c.csv").write_text("Policy Reference,Period,Gross Premium\n,2026-01,1.00\n")
    ledger = spark.createDataFrame([("P1|2026-01", "GBP", D("10.00")), ("P4|2026-01", "GBP", D("7.01")), ("P9|2026-01", "GBP", D(1))], "key string, currency string, gross decimal(18,4)")
    ledger = ledger.selectExpr("*", "CAST(map() AS map<string,decimal(18,4)>) AS deductions", "CAST(NULL AS decimal(18,4)) AS net", "1L AS spreadsheet_row")
    run = run_files(spark, f"file://{tmp_path}", get_family("insurance"), canonical.Profile("s", "GBP"), ledger)
    got = sorted((r.n_rows, r.accepted, r.quarantined, r.computed, r.last_amount, r.declared, r.difference, r.agrees, r.matched, r.mismatch, r.missing) for r in run.report.collect())
    assert got == [(1, 0, 1, None, D(1), D(1), D(1), False, 0, 0, 0), (1, 1, 0, D(7), D(7), None, None, True, 0, 1, 0), (4, 2, 2, D("15.5"), D("15.5"), D("15.5"), D(0), True, 1, 0, 1)]
    assert reports.STATUSES == reconcile.STATUSES


def test_a_held_row_at_the_end_is_no_footer(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Policy Reference,Period,Gross Premium\nP1,2026-01,10.00\nP2,TBC,5.00\n")
    (tmp_path / "e.csv").write_text("Policy Reference,Period,Gross Premium\nP3,2026-01,10.00\nTotal,,9.00\n")
    ledger = spark.sql("SELECT 'P1|2026-01' AS key, 'GBP' AS currency, CAST(10 AS decimal(18,4)) AS gross, CAST(map() AS map<string,decimal(18,4)>) AS deductions, CAST(NULL AS decimal(18,4)) AS net, 1L AS spreadsheet_row")
    run = run_files(spark, f"file://{tmp_path}", get_family("insurance"), canonical.Profile("s", "GBP"), ledger)
    got = sorted((r.last_amount, r.declared, r.difference, r.agrees) for r in run.report.collect())
    assert got == [(D(5), None, None, True), (D(9), D(9), D(-1), False)]


def test_rows_are_not_shuffled_for_a_few_repeated_keys(spark):
    from tallyframe.operators.store import repeated, split_repeated
    from tallyframe.sources import scratch

    rows = scratch.written(spark.range(20_000).selectExpr("'f' AS content_hash", "CAST(IF(id < 5, 0, id) AS string) AS key"), "rows")
    marked = split_repeated(rows, scratch.written(repeated(rows), "repeated"))
    assert "hashpartitioning" not in plan_of(marked) and "BroadcastHashJoin" in plan_of(marked)
    assert sorted(map(tuple, marked.groupBy("repeats").count().collect())) == [(1, 19_995), (5, 5)]


def by_table(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        above = 0
        for j, d in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequences_by_bits():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abcé ") for _ in range(r.randrange(90))) for _ in "xy")
        assert common_subsequence(a, b) == by_table(a, b)
        exact, bounded = token_set_ratio(a, b), token_set_ratio(a, b, 80)
        assert bounded == exact if exact >= 80 else bounded < 80
    assert token_set_ratio("gross premium", "premium gross") == 100 and token_set_ratio("", "a") == 0


def test_lineage_as_json_and_magnitudes(spark):
    where = "named_struct('source_content_hash', 'h', 'cell', named_struct('sheet', 's', 'row', 2, 'column', 'GWP'), 'mapping_version', 1, 'raw_value', '1,00')"
    got = spark.sql(f"SELECT array({where}) AS lineage, CAST(-2.5 AS DECIMAL(18,4)) AS x").select(lineage_json(F.col("lineage")), magnitude(F.col("x"))).first()
    assert got[0] == '[{"source_content_hash":"h","cell":{"sheet":"s","row":2,"column":"GWP"},"mapping_version":1,"raw_value":"1,00"}]' and got[1] == D("2.5")


def test_functions_in_sql(spark):
    assert "parse_amount" in register(spark) == register(spark)
    got = spark.sql("""SELECT parse_amount('(1.234,50 €)', 'comma_decimal') AS a, parse_amount('1,5', 'dot_decimal') AS b, parse_amount('1', 'other') AS c, format_amount(CAST(-1234.5 AS DECIMAL(18,4)), 'comma_decimal', 'EUR') AS d,
        normalise_period('03/04/2026', false) AS e, identity_key(NULL, '2026-01') AS f, cell_reference('s', 'GWP', 7) AS g, looks_like_date('TBC') AS h""").first()
    assert tuple(got) == (D("-1234.50"), None, None, "-1.234,50 EUR", "2026-03", "|2026-01", "s!GWP:7", False)
    plan = plan_of(spark.sql("SELECT parse_amount(CAST(id AS STRING), 'dot_decimal') FROM range(9)"))
    assert "Python" not in plan and "Arrow" not in plan
