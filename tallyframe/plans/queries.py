"""The registered queries of the reconciliation operators, with DuckDB SQL. Money is shown as text with two decimals."""

from __future__ import annotations

import tempfile
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.adapters import get_family
from tallyframe.fixtures import corpus
from tallyframe.fixtures.layouts import LAYOUTS, REPEATING, REPEATS
from tallyframe.functions import money, period
from tallyframe.functions.text import frame_digest
from tallyframe.operators import canonical, mapping, profile, proposals, reconcile, views
from tallyframe.operators.store import Store, money_json, split_repeated
from tallyframe.plans import evaluation, statements
from tallyframe.sources import grid, render
from tallyframe.sources.scratch import written

SENDER = canonical.Profile("demo", "GBP", money.COMMA, day_first=True)
COLUMNS = dict(zip(statements.HEADERS, ("policy_reference", "period", "gross_premium", "tax", "commission", "net_premium"), strict=False))
#: Amount cells that must be read or refused: (cell, convention).
CASES = [(c, v) for v in (money.DOT, money.COMMA) for c in ("1,234.56", "1.234,56", "1234.56", "1234,56", "1 234,56", "(12.34)", "12.34-", "£ 5.00", "1,234,56", "", "  ", "n/a", "TBC", "-", "abc", ".50", "1,234.", "1.005", "2.675", "12 USD", "(-5)")]
NEAR = money.Tolerance(Decimal("0.05"), ("gross", "net"), "rounding")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("x"), "o_orderdate")


def _dressed(orders: DataFrame, convention: str) -> DataFrame:
    """Each amount as one of six renderings."""
    f = lambda **k: money.format_amount(F.col("x"), convention, **k)
    forms = [f(), f(symbol="£"), f(code="GBP"), F.concat(F.lit("("), f(), F.lit(")")), F.concat(f(), F.lit("-")), F.concat(F.lit(" "), f(symbol="€ "), F.lit(" "))]
    raw = F.lit(None).cast("string")
    for i, form in reversed(list(enumerate(forms))):
        raw = F.when(F.col("o_orderkey") % 6 == i, form).otherwise(raw)
    return orders.select("o_orderkey", raw.alias("raw"))


def parse_amount_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dressed(_orders(spark, sf_dir), money.DOT).select("o_orderkey", money.money_text(money.parse_amount(F.col("raw"), money.DOT)).alias("amount"))


def parse_amount_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dressed(_orders(spark, sf_dir), money.COMMA).select("o_orderkey", money.money_text(money.parse_amount(F.col("raw"), money.COMMA)).alias("amount"))


def parse_amount_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame(CASES, "raw string, convention string")
    read = F.when(F.col("convention") == money.DOT, money.parse_amount(F.col("raw"), money.DOT)).otherwise(money.parse_amount(F.col("raw"), money.COMMA))
    return cases.select("raw", "convention", money.money_text(read).alias("amount"))


def format_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 3 == 0, -F.col("x")).otherwise(F.col("x"))
    return _orders(spark, sf_dir).select("o_orderkey", money.format_amount(x, money.DOT, symbol="£", brackets=True).alias("dot"), money.format_amount(x, money.COMMA, code="EUR").alias("comma"))


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = F.col("o_orderdate"), F.col("o_orderkey") % 8
    raw = F.date_format(d, "yyyy-MM-dd")
    for i, form in enumerate(("MM/yyyy", "dd/MM/yyyy", "MMMM yyyy", "d MMM yyyy", "yyyy.MM", "dd-MM-yy"), 1):
        raw = F.when(n == i, F.date_format(d, form)).otherwise(raw)
    return _orders(spark, sf_dir).select("o_orderkey", F.when(n == 7, "TBC").otherwise(raw).alias("raw"))


def normalise_period_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir).select("o_orderkey", period.normalise_period(F.col("raw"), True).alias("day_first"), period.normalise_period(F.col("raw"), False).alias("month_first"))


def date_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir).select("o_orderkey", period.looks_like_date(F.col("raw")).alias("dated"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonicalise(statements.file_rows(spark, sf_dir), COLUMNS, get_family("insurance"), SENDER)


def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, text = canonical.accepted(_tagged(spark, sf_dir)), money.money_text
    amounts = [text(F.col("gross.value")).alias("gross"), *[text(F.col("deductions")[d]["value"]).alias(d) for d in ("tax", "commission")], text(F.col("net.value")).alias("net")]
    return rows.select("content_hash", "spreadsheet_row", "key", "currency", "period", *amounts, F.size("attributes").alias("n_attributes"), F.col("gross.lineage.raw_value").alias("gross_raw"))


def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.quarantined(_tagged(spark, sf_dir))


def lineage_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical.lineage_rows(canonical.accepted(_tagged(spark, sf_dir)))
    return rows.groupBy("field", "column").agg(F.count("*").alias("n"), F.min("row").alias("first_row"), F.countDistinct("source_content_hash").alias("files"))


def lineage_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without complete lineage: none as they come, and those of every tenth file once its sheet is blanked."""
    rows = canonical.lineage_rows(canonical.accepted(_tagged(spark, sf_dir)))
    spoilt = rows.withColumn("sheet", F.when(F.col("source_content_hash").endswith("0"), "").otherwise(F.col("sheet")))
    return rows.agg(F.lit("as they come").alias("rows"), F.count("*").alias("checked"), F.count_if(~canonical.is_complete()).alias("missing")).union(spoilt.agg(F.lit("spoilt"), F.count("*"), F.count_if(~canonical.is_complete())))


def declared_total_last_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.declared_total(statements.file_rows(spark, sf_dir), "Gross Written Premium", SENDER).select("content_hash", money.money_text(F.col("declared")).alias("declared"))


def internal_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements.ledger(spark, sf_dir)
    holds = reconcile.arithmetic_holds(F.col("gross"), F.col("deductions"), F.col("net"))
    return rows.groupBy(F.coalesce(holds.cast("string"), F.lit("no net")).alias("holds")).agg(F.count("*").alias("n"))


def _results(spark: SparkSession, sf_dir: str, tolerance: money.Tolerance = money.EXACT) -> DataFrame:
    return reconcile.reconcile(statements.statement(spark, sf_dir), statements.ledger(spark, sf_dir), tolerance, ordinal="ordinal")


def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("key", "status", "rule")


def reconcile_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.by_status(_results(spark, sf_dir))


def reconcile_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = reconcile.discrepancies(_results(spark, sf_dir)).where("difference <> 0"), money.money_text
    return d.select("key", "field", *[text(F.col(c)).alias(c) for c in ("statement", "ledger", "difference")], "within_tolerance", "tolerance_applied")


def reconcile_with_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir, NEAR).groupBy("status", "rule").agg(F.count("*").alias("n"))


def reconcile_false_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None among the results; one in a planted table of results, so that the check itself is checked."""
    found = reconcile.false_matched(_results(spark, sf_dir)).select("key", F.lit("results").alias("origin"))
    planted = spark.createDataFrame([("planted", "matched", [(False,)]), ("fine", "matched", [(True,)])], "key string, status string, discrepancies array<struct<within_tolerance:boolean>>")
    return found.union(reconcile.false_matched(planted).select("key", F.lit("planted").alias("origin")))


def reconcile_missing_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).where("status = 'missing'").select("key", "detail")


def reconcile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).where("status = 'duplicate'").select("key", F.col("n_s").alias("in_statement"), F.col("n_l").alias("in_ledger"), "detail")


def reconcile_review_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).where("status = 'review'").select("key", "rule", "detail")


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by supplier and month; each batch declares its exact total but for suppliers divisible by five, which are a cent off, and by seven, which declare none."""
    by, rows = ["l_suppkey", "period"], statements.statement(spark, sf_dir)
    declared = rows.where("l_suppkey % 7 <> 0").groupBy(*by).agg((F.sum("gross") + F.when(F.max("l_suppkey") % 5 == 0, F.lit(Decimal("0.01"))).otherwise(F.lit(Decimal("0.00")))).cast(money.MONEY).alias("declared"))
    totals, text = reconcile.batch_totals(rows, declared, by), money.money_text
    return totals.select(*by, "rows_summed", *[text(F.col(c)).alias(c) for c in ("computed", "declared", "difference")], "agrees")


def repeated_keys_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_repeated(statements.statement(spark, sf_dir)).groupBy((F.col("repeats") > 1).alias("held")).agg(F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_keys"))


def expected_vs_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = reconcile.grade(_results(spark, sf_dir), statements.expected(spark, sf_dir))
    return graded.groupBy("expected", "status").agg(F.count("*").alias("n"), F.count_if("agrees").alias("agreeing"), F.count_if("false_match").alias("false_matches"))


def deductions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.statement(spark, sf_dir).groupBy(money_json(F.col("deductions")).alias("deductions")).agg(F.count("*").alias("n"))


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every file that has a value."""
    found = profile.profile_columns(grid.to_cells(statements.file_rows(spark, sf_dir, together=True)))
    return found.select("content_hash", "header", "non_empty", F.round("monetary", 6).alias("monetary"), "convention", money.money_text(F.col("magnitude")).alias("magnitude"), F.round("temporal", 6).alias("temporal"), "distinct", "categorical", "near_constant")


def magnitude_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.profile_columns(grid.to_cells(statements.file_rows(spark, sf_dir, together=True)))
    return found.where("magnitude_rank IS NOT NULL").groupBy("header", "magnitude_rank").agg(F.count("*").alias("files"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.headers_of(statements.file_rows(spark, sf_dir))


def _insurance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements.file_rows(spark, sf_dir, together=True)
    return mapping.propose(mapping.headers_of(rows), profile.profile_columns(grid.to_cells(rows)), get_family("insurance"))


def mapping_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each header-only method maps of every file."""
    return mapping.by_name(_files(spark, sf_dir), get_family("insurance"))


def mapping_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of each file by header and shape."""
    return _insurance(spark, sf_dir).select("content_hash", F.inline("assigned")).drop("combined")


def unmapped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without a field, with the best fields that were considered."""
    rows = _insurance(spark, sf_dir).select("content_hash", F.inline("unmapped"))
    return rows.select("content_hash", "header", F.array_join(F.transform("considered", lambda c: c["field"]), ",").alias("considered"))


def mapping_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every file of the fixtures that cannot be mapped, the required fields without a column."""
    return evaluation.outcomes(spark).where("NOT mappable").select("content_hash", F.explode("missing").alias("missing"))


def proposal_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five proposals by an outside mapper on every file: two are kept."""
    proposals = [("Note", "peril"), ("Note", "nonsense"), ("Nowhere", "tax"), ("IPT Amount", "tax"), ("Commission Payable", "tax")]
    headers = _files(spark, sf_dir)
    asked = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(h).alias("header"), F.lit(f).alias("field")) for i, (h, f) in enumerate(proposals)])
    made = headers.select("content_hash").distinct().select("content_hash", F.inline(asked))
    return mapping.contain(made, headers, get_family("insurance")).drop("position")


def reconcile_unproven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides equal, then nulls planted in currencies, amounts and deductions: none of it may match."""
    rows = statements.base(spark, sf_dir)
    sides = statements.sides(rows)
    n = F.pmod(F.col("b"), F.lit(11))
    none = F.lit(None)
    tagged = sides.join(rows.groupBy("key").agg(F.min("b").alias("b")), "key")
    pairs = F.map_filter("deductions", lambda k, v: (n != 7) | (k != "tax"))
    theirs = tagged.withColumns({
        "currency": F.when(n.isin(0, 1), none).otherwise(F.col("currency")), "gross": F.when(n.isin(2, 3), none).otherwise(F.col("gross")),
        "deductions": F.when(n == 5, none).when(n == 6, F.transform_values("deductions", lambda k, v: F.when(k != "tax", v))).otherwise(pairs), "net": F.when(n.isin(3, 8, 9), none).otherwise(F.col("net")),
    })
    ours = tagged.withColumns({"currency": F.when(n == 1, none).otherwise(F.col("currency")), "gross": F.when(n == 3, none).otherwise(F.col("gross")), "net": F.when(n.isin(3, 9), none).otherwise(F.col("net"))})
    found = reconcile.reconcile(ours, theirs, ordinal="ordinal")
    wrong = reconcile.false_matched(found).groupBy("rule").agg(F.count("*").alias("unproven"))
    return found.groupBy("status", "rule").agg(F.count("*").alias("n")).join(wrong, "rule", "left").select("status", "rule", "n", F.coalesce("unproven", F.lit(0)).alias("unproven"))


def amounts_rounded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with many decimals, just below and just at half a cent, are rounded once."""
    tail = F.when(F.col("o_orderkey") % 2 == 0, "499999999999999").otherwise("500000000000000")
    return _orders(spark, sf_dir).select("o_orderkey", money.money_text(money.parse_amount(F.concat(F.col("x").cast("string"), tail), money.DOT)).alias("amount"))


def lost_to_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of lines of which no row came through."""
    return statements.base(spark, sf_dir).select("key").distinct().join(canonical.accepted(_tagged(spark, sf_dir)).select("key"), "key", "left_anti")


def _store(spark: SparkSession) -> Store:
    """An empty store in the shared folder; a temporary one only where no shared folder is set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    return Store(spark, f"{root}/store-{uuid.uuid4().hex}")


def _described(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    return statements.file_rows(spark, sf_dir).select("content_hash").distinct().select("content_hash", F.lit("demo").alias("sender"), F.concat("content_hash", F.lit(".csv")).alias("filename"), F.lit("insurance").alias("family"), F.lit(version).alias("mapping_version"))


def ingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the store's tables after every file was ingested three times."""
    store = _store(spark)
    stored = [store.ingest(_described(spark, sf_dir), _tagged(spark, sf_dir)) for _ in range(3)]
    counts = views.table_counts({n: store.table(n) for n in ("ingested_file", "ledger_row", "quarantine", "audit_event")})
    return counts.union(spark.createDataFrame([("times_stored", sum(stored))], "table string, n long"))


def additive_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows by mapping version after every file was stored, stored again under a second version, and that repeated."""
    store = _store(spark)
    rows = store.prepare(_tagged(spark, sf_dir))
    store.ingest(_described(spark, sf_dir), rows)
    for _ in range(2):
        store.ingest(_described(spark, sf_dir, 2), rows, replay=True)
    return store.table("ledger_row").groupBy("mapping_version").agg(F.count("*").alias("n"), F.countDistinct("source_content_hash").alias("files"))


def store_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the screens over a store with every file: the queue of unresolved rows, one file's rows and quarantine, latest files."""
    store = _store(spark)
    store.ingest(_described(spark, sf_dir), _tagged(spark, sf_dir))
    files, waiting, one = store.table("ingested_file"), store.table("quarantine"), "file-1"
    screens = {"latest_files": views.latest_files(files), "file_rows": views.rows_of_file(store.table("ledger_row", one), one), "file_quarantine": views.quarantine_of_file(store.table("quarantine", one), one), "quarantine_queue": views.quarantine_queue(waiting, files)}
    return views.table_counts(screens)


def event_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of events as an audit event, appended twice: nothing is ever replaced."""
    store = _store(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("ts").alias("at"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("actor"), F.col("event_id").cast("string").alias("subject"), F.col("props").alias("payload"))
    for _ in range(2):
        store.append("audit_event", rows)
    return store.table("audit_event").groupBy("event").agg(F.count("*").alias("n"), F.countDistinct("actor").alias("actors"))


def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest for each file: of its rows' own digests, in order."""
    rows = canonical.accepted(_tagged(spark, sf_dir))
    own = F.sha2(F.concat_ws("|", "key", "currency", money.money_text(F.col("gross.value")), money.money_text(F.col("net.value"))), 256)
    return rows.groupBy("content_hash").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(own)), "\n"), 256).alias("digest"))


def family_portability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same engine over another family: sales of orders, with a fee, of which every 13th is paid out a cent short."""
    gross = F.col("o_totalprice").cast("decimal(18,2)")
    fee = F.round(gross * F.lit(15).cast("decimal(4,0)") / 100, 2).cast("decimal(18,2)")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"gross": gross, "fee": fee})
    cells = F.array(F.concat(F.lit("ORD-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")), F.date_format("o_orderdate", "MM/yyyy"), money.format_amount(F.col("gross"), money.DOT, symbol="$"), money.format_amount(F.col("fee"), money.DOT, symbol="$"), money.format_amount((F.col("gross") - F.col("fee")).cast("decimal(18,2)"), money.DOT, symbol="$"))
    headers = ("Order Reference", "Settlement Period", "Gross Sales", "Marketplace Fee", "Seller Payout")
    rows = orders.select(F.lit("sales").alias("content_hash"), F.lit("sales").alias("sheet"), F.array(*map(F.lit, headers)).alias("headers"), (F.col("o_orderkey") + 1).alias("spreadsheet_row"), cells.alias("cells"))
    family = get_family("marketplace")
    tagged = canonical.canonicalise(rows, dict(zip(headers, ("order_reference", "period", "gross_sales", "fee", "payout"), strict=True)), family, canonical.Profile("sales", "USD"))
    short = F.when(F.col("o_orderkey") % 13 == 0, F.lit(Decimal("0.01"))).otherwise(F.lit(Decimal("0.00")))
    key = F.concat(F.lit("ORD-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("|"), F.date_format("o_orderdate", "yyyy-MM"))
    ledger = orders.select(key.alias("key"), F.lit("USD").alias("currency"), F.col("gross").cast(money.MONEY).alias("gross"), F.create_map(F.lit("fee"), (F.col("fee") + short).cast(money.MONEY)).alias("deductions"), (F.col("gross") - F.col("fee") - short).cast(money.MONEY).alias("net"), F.lit(1).cast("long").alias("spreadsheet_row"))
    found = reconcile.reconcile(canonical.flat(canonical.accepted(tagged)), ledger)
    return found.groupBy("status", "rule").agg(F.count("*").alias("n"))


def content_hash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of the bytes of each file of a table."""
    return render.content_hashes(spark, f"{sf_dir}/nation.parquet").select("content_hash")


def rendered_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fixture file rendered as CSV or as a workbook and read back: rows, and those whose cells are as they were."""
    rows = corpus.file_rows(spark)
    files = render.csv_files(rows.where("file = 'csv'")).union(render.xlsx_files(rows.where("file = 'xlsx'")))
    back = grid.rows_of(files).select("sheet", "row_index", F.col("cells").alias("read"))
    return rows.join(back, ["sheet", "row_index"], "full_outer").groupBy(F.col("sheet").alias("variant")).agg(F.count("*").alias("n"), F.count_if(F.col("cells") == F.col("read")).alias("same"))


def truth_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth of every fixture file as a JSON document, read back: rows and the sum of their amounts, exact."""
    files = render.json_files(corpus.truth(spark), "variant", ["key", "currency", "gross", "net"])
    read = render.read_json(files, "variant string, rows array<struct<key:string,currency:string,gross:string,net:string>>")
    lines = read.select("variant", F.explode("rows").alias("r"))
    then = lines.groupBy("variant").agg(F.count("*").alias("n"), F.sum(F.col("r.gross").cast("decimal(18,2)")).cast("decimal(18,2)").alias("gross"))
    now = corpus.truth(spark).groupBy("variant").agg(F.sum("gross").cast("decimal(18,2)").alias("true_gross"))
    return then.join(now, "variant").select("variant", "n", (F.col("gross") == F.col("true_gross")).alias("exact"))


def column_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the shape of every fixture file, of equal shapes the same."""
    rows = corpus.file_rows(spark)
    return proposals.digests(rows).join(rows.select("content_hash", "variant").distinct(), "content_hash").select("variant", "digest")


def recorded_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers recorded for one shape, applied to every file that has it."""
    rows = statements.file_rows(spark, sf_dir)
    digest = proposals.column_digest(F.array(*map(F.lit, statements.HEADERS)))
    recorded = spark.range(3).select(digest.alias("digest"), F.col("id").cast("int").alias("position"), F.element_at(F.array(F.lit("Note"), F.lit("Nowhere"), F.lit("Risk Reference")), (F.col("id") + 1).cast("int")).alias("header"), F.element_at(F.array(F.lit("peril"), F.lit("tax"), F.lit("policy_reference")), (F.col("id") + 1).cast("int")).alias("field"))
    return proposals.replayed(rows, recorded, get_family("insurance")).groupBy("header", "field", "verdict").agg(F.count("*").alias("files"))


def mapper_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mapper would be shown of each file: headers and at most five samples of each."""
    rows = statements.file_rows(spark, sf_dir)
    shown = proposals.payload(mapping.headers_of(rows), profile.profile_columns(grid.to_cells(rows)), get_family("insurance"))
    columns = F.from_json("payload", "columns array<struct<header:string,samples:array<string>>>")["columns"]
    return shown.select("content_hash", F.size(columns).alias("n_columns"), F.array_max(F.transform(columns, lambda c: F.size(c["samples"]))).alias("most_samples"))


def held_out_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which layouts are held out by the rule."""
    return proposals.held_out(corpus.layouts(spark).select("variant", "unseen")).select("variant", "held_out")


def leaked_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of unseen vocabularies that may have been looked at, with one layout planted that leaks two."""
    own = corpus.layouts(spark).select("variant", "unseen", "held_out", "headers")
    planted = spark.createDataFrame([("planted", True, True, ["GWP", "Never Seen", "Period"])], own.schema)
    return proposals.leaked_headers(own.union(planted))


def evaluation_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.reconciliation_block(spark)


def evaluation_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mapping_block(spark)


def evaluation_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.lineage_block(spark)


def evaluation_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.abstention_block(spark)


def evaluation_portability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.portability_block(spark)


def evaluation_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.corpus_card(spark)


def evaluation_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many true rows of the fixtures were lost on the way."""
    return evaluation.lost_to_quarantine(spark).agg(F.count("*").alias("lost"))


def evaluation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.totals_block(spark)


def evaluation_determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.determinism_block(spark)


def evaluation_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.idempotency_block(spark, _store(spark).root)


def results_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over shuffled inputs have one digest; the number of results that it covers."""
    lines, found = statements.lines(spark, sf_dir), []
    for dealt in ((lines, lines), (lines.repartition("l_shipdate"), lines.repartition("l_orderkey", "l_linenumber"))):
        sides = (side(spark, sf_dir, rows) for side, rows in zip((statements.statement, statements.ledger), dealt, strict=True))
        # a run after the other, so that what one shuffles is gone when the next begins
        found.append(written(frame_digest(reconcile.reconcile(*sides, ordinal="ordinal").select("key", "status", "detail"), counted=True), "digest"))
    same = found[0].union(found[1]).agg((F.countDistinct("digest") == 1).alias("agrees"))
    return found[0].select(F.col("n").alias("results_then_agrees")).union(same.select(F.col("agrees").cast("long")))


QUERIES = {f.__name__: f for f in (
    parse_amount_dot, parse_amount_comma, amounts_rounded_once, format_amount, normalise_period_forms, date_likeness, canonical_rows, quarantine_split, lineage_explode, lineage_complete,
    declared_total_last_nonempty, internal_arithmetic, reconcile_status, reconcile_status_counts, reconcile_discrepancies, reconcile_with_tolerance, reconcile_false_matched, reconcile_unproven, reconcile_missing_side,
    reconcile_duplicates, reconcile_review_rules, batch_totals, repeated_keys_held, expected_vs_reported, lost_to_quarantine, deductions_json, profile_columns, magnitude_rank, mapping_methods, mapping_system,
    unmapped_columns, proposal_containment, ingest_idempotent, additive_replay, store_screens, event_audit_log, canonical_digest, family_portability, content_hash_bytes,
    recorded_proposals, mapper_payload,
    results_digest,
)}

#: Checks of the fixtures alone. They read no given table, so they are run by the tests and not registered.
FIXTURE_QUERIES = {f.__name__: f for f in (
    parse_amount_refusals, mapping_abstain, rendered_round_trip, truth_documents, column_digests, held_out_split, leaked_headers,
    evaluation_reconciliation, evaluation_mapping, evaluation_lineage, evaluation_abstention, evaluation_portability, evaluation_corpus, evaluation_lost, evaluation_totals, evaluation_determinism, evaluation_idempotency,
)}

_LINES = """lines AS (SELECT *, CAST(gross - discount - tax AS DECIMAL(18,2)) AS net, ref || '|' || period AS key FROM (
        SELECT *, CAST(round(gross * d, 2) AS DECIMAL(18,2)) AS discount, CAST(round(gross * t, 2) AS DECIMAL(18,2)) AS tax FROM (
        SELECT 'ORD-' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS ref, strftime(l_shipdate, '%Y-%m') AS period, 'GBP' AS currency,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS gross, CAST(l_discount AS DECIMAL(18,2)) AS d, CAST(l_tax AS DECIMAL(18,2)) AS t, (l_orderkey * 31 + l_linenumber) % 97 AS b,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)))"""
_SIDES = _LINES + """, s AS (SELECT * FROM lines WHERE b <> 4),
        l AS (SELECT key, CASE b WHEN 7 THEN 'EUR' ELSE currency END AS currency, CASE b WHEN 0 THEN gross + 0.01 WHEN 1 THEN gross + 123.45 WHEN 5 THEN gross + 77 ELSE gross END AS gross,
              CASE b WHEN 2 THEN discount + 5 ELSE discount END AS discount, tax, CASE b WHEN 0 THEN net + 0.01 WHEN 1 THEN net + 123.45 WHEN 2 THEN net - 5 WHEN 6 THEN NULL ELSE net END AS net FROM lines WHERE b <> 3),
        s1 AS (SELECT key, count(*) AS n, any_value(currency) AS currency, min(gross) AS gross, min(discount) AS discount, min(tax) AS tax, min(net) AS net FROM s GROUP BY key),
        l1 AS (SELECT key, count(*) AS n, any_value(currency) AS currency, min(gross) AS gross, min(discount) AS discount, min(tax) AS tax, min(net) AS net FROM l GROUP BY key),
        p AS (SELECT coalesce(s1.key, l1.key) AS key, coalesce(s1.n, 0) AS ns, coalesce(l1.n, 0) AS nl, s1.currency AS sc, l1.currency AS lc, s1.gross AS sg, l1.gross AS lg, s1.discount AS sd, l1.discount AS ld, s1.tax AS st, l1.tax AS lt, s1.net AS sn, l1.net AS ln FROM s1 FULL JOIN l1 ON s1.key = l1.key)"""


def _with_rule(tolerance: str = "0") -> str:
    return _SIDES + f""", r AS (SELECT *, CASE WHEN ns > 1 OR nl > 1 THEN 'repeated_key' WHEN ns = 0 OR nl = 0 THEN 'absent_on_one_side' WHEN sc <> lc THEN 'currency_disagreement'
        WHEN sg - sd - st <> sn OR lg - ld - lt <> ln THEN 'internal_arithmetic' WHEN (sn IS NULL) <> (ln IS NULL) THEN 'field_present_on_one_side'
        WHEN abs(sg - lg) > {tolerance} OR sd <> ld OR st <> lt OR abs(sn - ln) > {tolerance} THEN 'field_difference' ELSE 'all_fields_agree' END AS rule FROM p),
        q AS (SELECT *, CASE rule WHEN 'repeated_key' THEN 'duplicate' WHEN 'absent_on_one_side' THEN 'missing' WHEN 'field_difference' THEN 'mismatch' WHEN 'all_fields_agree' THEN 'matched' ELSE 'review' END AS status FROM r)"""


def _text(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR)"


_RAW_DATE = """CASE o_orderkey % 8 WHEN 1 THEN strftime(o_orderdate, '%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%B %Y') WHEN 4 THEN strftime(o_orderdate, '%-d %b %Y')
        WHEN 5 THEN strftime(o_orderdate, '%Y.%m') WHEN 6 THEN strftime(o_orderdate, '%d-%m-%y') WHEN 7 THEN 'TBC' ELSE strftime(o_orderdate, '%Y-%m-%d') END"""
_SIGNED = f"SELECT o_orderkey, {_text('CASE WHEN o_orderkey % 6 IN (3, 4) THEN -CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END')} AS amount FROM orders"
_SHOWN = "format('{:,.2f}', abs(CAST(o_totalprice AS DOUBLE)))"
_COMMA = "translate(format('{{:,.2f}}', CAST({} AS DOUBLE)), ',.', '.,')"
_FILE = _LINES + """, f AS (SELECT *, 'file-' || CAST(l_suppkey AS VARCHAR) AS content_hash, l_orderkey + l_linenumber AS m,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, gross, l_quantity) + 1 AS spreadsheet_row FROM lines),
        c AS (SELECT *, CASE WHEN m % 50 = 0 THEN 'n/a' WHEN m % 70 = 0 THEN '' ELSE translate(format('{:,.2f}', CAST(gross AS DOUBLE)), ',.', '.,') || ' GBP' END AS gross_raw,
        CASE WHEN m % 60 = 0 THEN 'TBC' ELSE substr(period, 6, 2) || '/' || substr(period, 1, 4) END AS period_raw FROM f),
        good AS (SELECT * FROM c WHERE m % 60 <> 0 AND m % 50 <> 0 AND m % 70 <> 0)"""
_READ = {"1,234.56": ("1234.56", None), "1.234,56": (None, "1234.56"), "1234.56": ("1234.56", None), "1234,56": (None, "1234.56"), "1 234,56": (None, "1234.56"), "(12.34)": ("-12.34", None), "12.34-": ("-12.34", None), "£ 5.00": ("5.00", None), "1,234.": ("1234.00", None), "1.005": ("1.01", "1005.00"), "2.675": ("2.68", "2675.00"), "12 USD": ("12.00", "12.00"), "(-5)": ("5.00", "5.00")}

ORACLES = {
    "parse_amount_dot": _SIGNED,
    "parse_amount_comma": _SIGNED,
    "parse_amount_refusals": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{v}', {'NULL' if (x := _READ.get(c, (None, None))[v == money.COMMA]) is None else repr(x)})" for c, v in CASES) + ") AS t(raw, convention, amount)",
    "format_amount": f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '(£' || {_SHOWN} || ')' ELSE '£' || {_SHOWN} END AS dot, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '' END || translate({_SHOWN}, ',.', '.,') || ' EUR' AS comma FROM orders",
    "normalise_period_forms": """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN NULL WHEN 6 THEN '20' || strftime(o_orderdate, '%y-%m') ELSE strftime(o_orderdate, '%Y-%m') END AS day_first,
        CASE WHEN o_orderkey % 8 = 7 THEN NULL WHEN o_orderkey % 8 = 6 THEN '20' || CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%y-%d') ELSE strftime(o_orderdate, '%y-%m') END WHEN o_orderkey % 8 = 2 AND day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d') ELSE strftime(o_orderdate, '%Y-%m') END AS month_first FROM orders""",
    "date_likeness": "SELECT o_orderkey, o_orderkey % 8 <> 7 AS dated FROM orders",
    "canonical_rows": f"WITH {_FILE} SELECT content_hash, spreadsheet_row, key, currency, period, {_text('gross')} AS gross, {_text('tax')} AS tax, {_text('discount')} AS commission, {_text('net')} AS net, 2 AS n_attributes, gross_raw FROM good",
    "quarantine_split": f"""WITH {_FILE} SELECT content_hash, spreadsheet_row, CASE WHEN m % 60 = 0 THEN 'period: not a date, day first' WHEN m % 50 = 0 THEN 'gross_premium: not an amount as comma_decimal' ELSE 'gross_premium: empty, nothing to reconcile' END AS reason,
        CASE WHEN m % 60 = 0 THEN 'TBC' WHEN m % 50 = 0 THEN 'n/a' ELSE '' END AS raw_value FROM c WHERE m % 60 = 0 OR m % 50 = 0 OR m % 70 = 0""",
    "lineage_explode": f"""WITH {_FILE}, names(field, col) AS (VALUES ('gross', 'Gross Written Premium'), ('tax', 'IPT Amount'), ('commission', 'Commission Payable'), ('net', 'Settlement Amount'), ('policy_reference', 'Risk Reference'), ('period', 'Underwriting Period'))
        SELECT field, col AS "column", count(*) AS n, CAST(min(spreadsheet_row) AS INTEGER) AS first_row, count(DISTINCT content_hash) AS files FROM good, names GROUP BY ALL""",
    "lineage_complete": f"WITH {_FILE} SELECT 'as they come' AS \"rows\", 6 * count(*) AS checked, CAST(0 AS BIGINT) AS missing FROM good UNION ALL SELECT 'spoilt', 6 * count(*), 6 * count(*) FILTER (l_suppkey % 10 = 0) FROM good",
    "declared_total_last_nonempty": f"WITH {_FILE} SELECT content_hash, CASE WHEN arg_max(gross_raw, spreadsheet_row) = 'n/a' THEN NULL ELSE {_text('arg_max(gross, spreadsheet_row)')} END AS declared FROM c WHERE gross_raw <> '' GROUP BY content_hash",
    "internal_arithmetic": f"WITH {_SIDES} SELECT coalesce(CAST(gross - discount - tax = net AS VARCHAR), 'no net') AS holds, count(*) AS n FROM l GROUP BY ALL",
    "reconcile_status": f"WITH {_with_rule()} SELECT key, status, rule FROM q",
    "reconcile_status_counts": f"WITH {_with_rule()} SELECT e.status, count(q.key) AS n FROM (VALUES ('matched'), ('mismatch'), ('missing'), ('duplicate'), ('ambiguous'), ('review')) AS e(status) LEFT JOIN q ON q.status = e.status GROUP BY e.status",
    "reconcile_discrepancies": f"WITH {_with_rule()}, u AS (SELECT key, unnest(['gross', 'discount', 'tax', 'net']) AS field, unnest([sg, sd, st, sn]) AS x, unnest([lg, ld, lt, ln]) AS y FROM q WHERE rule IN ('field_present_on_one_side', 'field_difference', 'all_fields_agree')) SELECT key, field, {_text('x')} AS statement, {_text('y')} AS ledger, {_text('x - y')} AS difference, false AS within_tolerance, 'exact match required' AS tolerance_applied FROM u WHERE x <> y",
    "reconcile_with_tolerance": f"WITH {_with_rule('0.05')} SELECT status, rule, count(*) AS n FROM q GROUP BY ALL",
    "reconcile_false_matched": "SELECT 'planted' AS key, 'planted' AS origin",
    "reconcile_missing_side": f"WITH {_with_rule()} SELECT key, 'only in the ' || CASE WHEN ns = 0 THEN 'ledger' ELSE 'statement' END || ': ' || {_text('coalesce(sg, lg)')} AS detail FROM q WHERE status = 'missing'",
    "reconcile_duplicates": f"WITH {_with_rule()} SELECT key, ns AS in_statement, nl AS in_ledger, CAST(greatest(ns, nl) AS VARCHAR) || ' rows have this key in the ' || CASE WHEN ns > 1 THEN 'statement' ELSE 'ledger' END AS detail FROM q WHERE status = 'duplicate'",
    "reconcile_review_rules": f"""WITH {_with_rule()} SELECT key, rule, CASE rule WHEN 'currency_disagreement' THEN sc || ' against ' || lc WHEN 'internal_arithmetic' THEN CASE WHEN sg - sd - st <> sn THEN 'statement: net ' || {_text('sn')} || ', gross less deductions ' || {_text('sg - sd - st')}
        ELSE 'ledger: net ' || {_text('ln')} || ', gross less deductions ' || {_text('lg - ld - lt')} END ELSE 'on one side only: net' END AS detail FROM q WHERE status = 'review'""",
    "batch_totals": f"""WITH {_SIDES}, g AS (SELECT l_suppkey, period, count(*) AS rows_summed, sum(gross) AS computed, CASE WHEN l_suppkey % 7 <> 0 THEN sum(gross) + CASE WHEN l_suppkey % 5 = 0 THEN 0.01 ELSE 0 END END AS declared FROM s GROUP BY l_suppkey, period)
        SELECT l_suppkey, period, rows_summed, {_text('computed')} AS computed, {_text('declared')} AS declared, {_text('declared - computed')} AS difference, coalesce(declared = computed, true) AS agrees FROM g""",
    "repeated_keys_held": f"WITH {_SIDES} SELECT n > 1 AS held, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys FROM s1 GROUP BY ALL",
    "expected_vs_reported": f"""WITH {_with_rule()}, k AS (SELECT key, CASE WHEN count(*) > 1 THEN 'duplicate' WHEN min(b) <= 2 THEN 'mismatch' WHEN min(b) <= 4 THEN 'missing' WHEN min(b) <= 7 THEN 'review' ELSE 'matched' END AS expected FROM lines GROUP BY key)
        SELECT expected, status, count(*) AS n, count(*) FILTER (expected = status) AS agreeing, count(*) FILTER (status = 'matched' AND expected <> 'matched') AS false_matches FROM k JOIN q USING (key) GROUP BY ALL""",
    "deductions_json": f"WITH {_SIDES} SELECT '{{\"discount\":\"' || {_text('discount')} || '\",\"tax\":\"' || {_text('tax')} || '\"}}' AS deductions, count(*) AS n FROM s GROUP BY ALL",
    "amounts_rounded_once": f"SELECT o_orderkey, {_text('CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 0.01 END')} AS amount FROM orders",
    "reconcile_unproven": f"""WITH {_LINES}, g AS (SELECT key, count(*) AS c, min(b) % 11 AS n, min(net) AS net FROM lines GROUP BY key),
        r AS (SELECT CASE WHEN c > 1 THEN 'repeated_key' WHEN n IN (0, 1) THEN 'currency_disagreement' WHEN n IN (2, 3) THEN 'internal_arithmetic' WHEN n IN (5, 6, 7) THEN 'bad' WHEN n = 8 THEN 'field_present_on_one_side' ELSE 'all_fields_agree' END AS rule, c, n, key FROM g),
        t AS (SELECT key, min(tax) AS tax, min(discount) AS discount FROM lines GROUP BY key),
        u AS (SELECT CASE WHEN rule = 'bad' THEN CASE WHEN (CASE WHEN n = 5 THEN t.tax + t.discount ELSE t.tax END) <> 0 THEN 'internal_arithmetic' ELSE 'field_present_on_one_side' END ELSE rule END AS rule FROM r JOIN t USING (key))
        SELECT CASE rule WHEN 'repeated_key' THEN 'duplicate' WHEN 'all_fields_agree' THEN 'matched' ELSE 'review' END AS status, rule, count(*) AS n, CAST(0 AS BIGINT) AS unproven FROM u GROUP BY rule""",
    "lost_to_quarantine": f"WITH {_FILE} SELECT DISTINCT key FROM lines WHERE key NOT IN (SELECT key FROM good)",
    "profile_columns": f"""WITH {_FILE}, u AS (SELECT content_hash, spreadsheet_row, unnest(['Risk Reference', 'Underwriting Period', 'Gross Written Premium', 'IPT Amount', 'Commission Payable', 'Settlement Amount']) AS header,
        unnest([ref, period_raw, gross_raw, {_COMMA.format('tax')}, {_COMMA.format('discount')}, {_COMMA.format('net')}]) AS raw, unnest([NULL, NULL, CASE WHEN gross_raw <> 'n/a' THEN gross END, tax, discount, net]) AS x FROM c),
        h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash, header ORDER BY spreadsheet_row) AS i FROM u WHERE raw <> '') WHERE i <= 200),
        g AS (SELECT content_hash, header, count(*) AS n, count(x) AS k, list_sort(list(x) FILTER (x IS NOT NULL)) AS xs, count(DISTINCT raw) AS "distinct", count(*) FILTER (header = 'Underwriting Period' AND raw <> 'TBC') AS dated FROM h GROUP BY ALL)
        SELECT content_hash, header, n AS non_empty, round(k / n, 6) AS monetary, CASE WHEN k > 0 THEN 'comma_decimal' END AS convention, {_text('xs[k // 2 + 1]')} AS magnitude, round(dated / n, 6) AS temporal, "distinct", "distinct" / n <= 0.2 AND "distinct" <= 30 AS categorical, "distinct" <= 3 AS near_constant FROM g""",
    "magnitude_rank": f"""WITH {_FILE}, u AS (SELECT content_hash, spreadsheet_row, unnest(['Gross Written Premium', 'IPT Amount', 'Commission Payable', 'Settlement Amount']) AS header, unnest([gross_raw, 'x', 'x', 'x']) AS raw, unnest([CASE WHEN gross_raw <> 'n/a' THEN gross END, tax, discount, net]) AS x FROM c),
        h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash, header ORDER BY spreadsheet_row) AS i FROM u WHERE raw <> '') WHERE i <= 200),
        g AS (SELECT content_hash, header, count(x) / count(*) AS share, list_sort(list(x) FILTER (x IS NOT NULL)) AS xs, count(x) AS k FROM h GROUP BY ALL),
        m AS (SELECT header, row_number() OVER (PARTITION BY content_hash ORDER BY xs[k // 2 + 1] DESC, header) - 1 AS magnitude_rank FROM g WHERE share >= 0.9)
        SELECT header, CAST(magnitude_rank AS INTEGER) AS magnitude_rank, count(*) AS files FROM m GROUP BY ALL""",
    "mapping_methods": f"""WITH {_FILE}, m(method, header, field) AS (VALUES ('synonym', 'Risk Reference', 'policy_reference'), ('synonym', 'Gross Written Premium', 'gross_premium'), ('synonym', 'IPT Amount', 'tax'), ('synonym', 'Settlement Amount', 'net_premium'), ('fuzzy', 'Underwriting Period', 'period'), ('fuzzy', 'Commission Payable', 'commission'), ('fuzzy', 'Gross Written Premium', 'gross_premium'))
        SELECT method, content_hash, header, field FROM (SELECT DISTINCT content_hash FROM f), m""",
    "mapping_system": f"""WITH {_FILE}, m(header, field) AS (VALUES ('Risk Reference', 'policy_reference'), ('Underwriting Period', 'period'), ('Gross Written Premium', 'gross_premium'), ('IPT Amount', 'tax'), ('Commission Payable', 'commission'), ('Settlement Amount', 'net_premium'))
        SELECT content_hash, header, field FROM (SELECT DISTINCT content_hash FROM f), m""",
    "unmapped_columns": f"WITH {_FILE} SELECT content_hash, 'Note' AS header, 'insured_name' AS considered FROM f GROUP BY content_hash",
    "mapping_abstain": "SELECT sha256(v) AS content_hash, missing FROM (VALUES " + ", ".join(f"('{x.name}', '{m}')" for x in LAYOUTS if not x.mappable for m in (("period", "policy_reference") if x.family == "insurance" else ("order_reference", "period"))) + ") AS t(v, missing)",
    "proposal_containment": f"""WITH {_FILE}, m(header, field, verdict) AS (VALUES ('Note', 'peril', 'kept'), ('IPT Amount', 'tax', 'kept'), ('Note', 'nonsense', 'unknown field'), ('Nowhere', 'tax', 'unknown header'), ('Commission Payable', 'tax', 'field already claimed'))
        SELECT content_hash, header, field, verdict FROM (SELECT DISTINCT content_hash FROM f), m""",
    "ingest_idempotent": f"""WITH {_FILE}, r AS (SELECT *, count(*) OVER (PARTITION BY content_hash, key) AS n FROM good), k AS (SELECT count(DISTINCT content_hash) AS files FROM f)
        SELECT 'ingested_file' AS "table", files AS n FROM k UNION ALL SELECT 'audit_event', 3 * files FROM k UNION ALL SELECT 'times_stored', files FROM k UNION ALL SELECT 'ledger_row', count(*) FROM r WHERE n = 1
        UNION ALL SELECT 'quarantine', (SELECT count(*) FROM c) - (SELECT count(*) FROM r WHERE n = 1)""",
    "additive_replay": f"""WITH {_FILE}, r AS (SELECT *, count(*) OVER (PARTITION BY content_hash, key) AS n FROM good)
        SELECT CAST(v AS INTEGER) AS mapping_version, count(*) AS n, count(DISTINCT content_hash) AS files FROM r, (VALUES (1), (2)) AS t(v) WHERE n = 1 GROUP BY v""",
    "store_screens": f"""WITH {_FILE}, r AS (SELECT *, count(*) OVER (PARTITION BY content_hash, key) AS n FROM good), w AS (SELECT content_hash FROM c WHERE (content_hash, spreadsheet_row) NOT IN (SELECT (content_hash, spreadsheet_row) FROM r WHERE n = 1))
        SELECT 'latest_files' AS "table", least(25, count(DISTINCT content_hash)) AS n FROM f UNION ALL SELECT 'file_rows', least(500, count(*)) FROM r WHERE n = 1 AND content_hash = 'file-1'
        UNION ALL SELECT 'file_quarantine', count(*) FROM w WHERE content_hash = 'file-1' UNION ALL SELECT 'quarantine_queue', least(500, count(*)) FROM w""",
    "event_audit_log": "SELECT event_type AS event, 2 * count(*) AS n, count(DISTINCT user_id) AS actors FROM events GROUP BY event_type",
    "canonical_digest": f"WITH {_FILE} SELECT content_hash, sha256(string_agg(d, chr(10) ORDER BY d)) AS digest FROM (SELECT content_hash, sha256(concat_ws('|', key, currency, {_text('gross')}, {_text('net')})) AS d FROM good) GROUP BY content_hash",
    "family_portability": "SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'mismatch' ELSE 'matched' END AS status, CASE WHEN o_orderkey % 13 = 0 THEN 'field_difference' ELSE 'all_fields_agree' END AS rule, count(*) AS n FROM orders GROUP BY ALL",
    "rendered_round_trip": "SELECT variant, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS same FROM (VALUES " + ", ".join(f"('{x.name}', {x.rows + len(REPEATS) * (x.name == REPEATING) + (x.footer != 'none')})" for x in LAYOUTS) + ") AS t(variant, n)",
    "truth_documents": "SELECT variant, CAST(n AS BIGINT) AS n, true AS exact FROM (VALUES " + ", ".join(f"('{x.name}', {x.rows + len(REPEATS) * (x.name == REPEATING)})" for x in LAYOUTS if x.mappable) + ") AS t(variant, n)",
    "column_digests": "SELECT variant, substr(sha256('[' || list_aggregate(list_transform(list_sort(h), lambda x: '\"' || x || '\"'), 'string_agg', ', ') || ']'), 1, 16) AS digest FROM (VALUES " + ", ".join(f"('{x.name}', [{', '.join(repr(h) for h, _ in x.columns)}])" for x in LAYOUTS) + ") AS t(variant, h)",
    "recorded_proposals": f"WITH {_FILE} SELECT header, field, verdict, (SELECT count(DISTINCT content_hash) FROM f) AS files FROM (VALUES ('Note', 'peril', 'kept'), ('Nowhere', 'tax', 'unknown header'), ('Risk Reference', 'policy_reference', 'kept')) AS t(header, field, verdict)",
    "mapper_payload": f"WITH {_FILE} SELECT content_hash, CAST(7 AS INTEGER) AS n_columns, CAST(least(5, count(*)) AS INTEGER) AS most_samples FROM c GROUP BY content_hash",
    "held_out_split": "SELECT * FROM (VALUES " + ", ".join(f"('{x.name}', {x.held_out})" for x in LAYOUTS) + ") AS t(variant, held_out)",
    "leaked_headers": "SELECT * FROM (VALUES ('planted', 'GWP'), ('planted', 'Period')) AS t(variant, header)",
    # the counts that the reference workload publishes; of the hold-out mapping it has 42 where these fixtures' values give 43
    "evaluation_reconciliation": "SELECT * FROM (VALUES (true, 715::BIGINT, 90::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT), (false, 1616, 195, 0, 272, 0)) AS t(held_out, rows, injected, false_matched, status_disagreements, unproven_matches)",
    "evaluation_mapping": "SELECT * FROM (VALUES " + ", ".join(f"({split}, '{m}', {n}::BIGINT, {total}::BIGINT)" for split, total, counts in (("true", 46, (16, 24, 30, 29, 43)), ("false", 92, (30, 57, 77, 65, 84))) for m, n in zip((*mapping.METHODS, "system"), counts, strict=True)) + ") AS t(held_out, method, correct, total)",
    "evaluation_lineage": "SELECT 13718::BIGINT AS checked, 0::BIGINT AS missing",
    "evaluation_abstention": "SELECT 2::BIGINT AS unmappable, 2::BIGINT AS abstained, 0::BIGINT AS rows_written",
    "evaluation_portability": "SELECT * FROM (VALUES ('insurance', 1606::BIGINT, 1152::BIGINT), ('marketplace', 725, 638)) AS t(family, rows, matched)",
    "evaluation_corpus": "SELECT variant, CAST(n AS INTEGER) AS true_rows, CAST(n AS BIGINT) AS canonical, CAST(q AS BIGINT) AS quarantined FROM (VALUES " + ", ".join(f"('{x.name}', {(x.rows + len(REPEATS) * (x.name == REPEATING)) * x.mappable}, {int(x.footer != 'none')})" for x in LAYOUTS) + ") AS t(variant, n, q)",
    "evaluation_lost": "SELECT 0::BIGINT AS lost",
    "evaluation_totals": "SELECT * FROM (VALUES ('ins_08_total_footer_disagrees', false), ('ins_09_total_agrees_rows_transposed', true)) AS t(variant, agrees)",
    "evaluation_determinism": "SELECT true AS agrees",
    "evaluation_idempotency": "SELECT * FROM (VALUES ('stored, time 1', 16::BIGINT), ('stored, time 2', 0), ('stored, time 3', 0), ('audit_event', 48), ('ingested_file', 16), ('ledger_row', 2329), ('mapping_contract', 0), ('quarantine', 6)) AS t(what, n)",
    "results_digest": f"WITH {_SIDES} SELECT count(*) AS results_then_agrees FROM p UNION ALL SELECT 1",
}
