"""Statuses after any split into micro-batches, and sheets read row by row."""

import io
import random
import tracemalloc
import zipfile
from decimal import Decimal as D

import pytest

from tallyframe.operators import reconcile
from tallyframe.sources import grid
from tallyframe.streaming import incremental

SIDE = "key string, currency string, gross decimal(18,4), deductions map<string,decimal(18,4)>, net decimal(18,4), spreadsheet_row long"


def rows(r, n):
    out = []
    for i in range(n):
        gross = D(r.choice([100, 100, 200]))
        out.append((r.choice([f"k{r.randrange(60)}", f"k{i + 100}", None if i % 40 == 0 else "k1"]), r.choice(["GBP", "GBP", "GBP", "EUR", None]), gross, {"tax": D(5)}, r.choice([gross - 5, gross - 5, None, D(1)]), i))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_statuses_after_any_split_equal_those_of_all_rows(spark, tmp_path, seed):
    r = random.Random(seed)
    sides = {name: rows(r, 150) for name in ("statement", "ledger")}
    tables = {name: spark.createDataFrame(x, SIDE) for name, x in sides.items()}
    streams = {}
    for name, x in sides.items():
        r.shuffle(x)
        for i, part in enumerate(x[j::4] for j in range(4)):
            spark.createDataFrame(part, SIDE).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i}")
        streams[name] = spark.readStream.schema(SIDE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
    root = f"file://{tmp_path}"
    for late in (False, True):  # a second run finds nothing new
        changed = incremental.statuses(streams["statement"], streams["ledger"])
        query = incremental.keep(changed, f"{root}/out", f"{root}/checkpoint")
        query.awaitTermination()
        assert late or query.lastProgress["batchId"] >= 3
    want = reconcile.reconcile(tables["statement"], tables["ledger"])
    shown = lambda df: sorted((x.key, x.status, x.rule, x.detail, x.n_s, x.n_l) for x in df.where("key IS NOT NULL").collect())
    assert shown(incremental.current(spark, f"{root}/out")) == shown(want) and len(shown(want)) > 60
    whole = incremental.statuses(tables["statement"], tables["ledger"])
    nulls = lambda df: sorted((x.status, x.n_s, x.n_l) for x in df.where("key IS NULL").collect())
    assert nulls(whole) == nulls(want) and nulls(want)


def test_state_is_on_disk_in_as_many_stores_as_cores(spark, tmp_path):
    spark.createDataFrame(rows(random.Random(3), 50), SIDE).write.parquet(f"{tmp_path}/in")
    side = spark.readStream.schema(SIDE).parquet(f"{tmp_path}/in")
    names = ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(names[0], "23")
    try:
        was = [spark.conf.get(k) for k in names]
        query = incremental.keep(incremental.statuses(side, side), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
        assert [spark.conf.get(k) for k in names] == was
        query.awaitTermination()
    finally:
        spark.conf.set(names[0], "4")
    (state,) = query.lastProgress["stateOperators"]
    assert state["numShufflePartitions"] == spark.sparkContext.defaultParallelism == 4
    assert any(k.startswith("rocksdb") for k in state["customMetrics"])


def workbook(n, blank_every):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Ref</t></si><si><r><t>Gr</t></r><r><t>oß</t></r></si></sst>")
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'.encode())
            for i in range(n):
                text = "" if blank_every and i % blank_every == 0 else f'<c r="B{i + 2}"><v>{i}.50</v></c>'
                f.write(f'<row r="{i + 2}">{text}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def test_rows_of_a_sheet_have_their_true_numbers():
    name, records = grid.xlsx_records(workbook(7, 3))
    assert (name, list(records)) == ("S", [(1, ["Ref", "Groß"]), (3, ["", "1.5"]), (4, ["", "2.5"]), (6, ["", "4.5"]), (7, ["", "5.5"])])


def test_a_large_sheet_is_never_whole_in_memory():
    content = workbook(150_000, 0)
    tracemalloc.start()
    _, records = grid.xlsx_records(content)
    n = sum(1 for _ in records)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 150_001 and peak < 3_000_000
