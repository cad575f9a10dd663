"""CSV files of any size, read in byte ranges: the same records, numbers and cells as if each file were read from its start.

Spark's text source cuts files into ranges of whole lines; whether a range begins inside a quoted cell depends on all before it.
So a first pass sums up each range as a function of that state (is it inside at the end, how many records begin), for either
state; a window over a file's ranges composes the functions; a second pass cuts each range at true record boundaries. What
crosses a boundary is at most one piece at either end of a range, and the pieces of a record are joined by its number. Ranges
are as long as `spark.sql.files.maxPartitionBytes` says. A record has to fit in memory, a file need not. Files that are too small
to be ever cut need none of this: each is read once, record by record.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from itertools import chain, groupby
from operator import itemgetter
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.digests import row_hash, set_digest
from tallyframe.sources.scratch import written

_DELIMITERS = (",", ";")
_SPECIAL = {d: re.compile(f'["\r{d}]') for d in _DELIMITERS}
#: Characters of finished records that are parsed at once.
_PARSED = 1 << 20
#: Ranges and files whose table may be broadcast.
_FEW = 200_000
_CHANGED = "the files or their ranges changed while they were read"


def walk(line: str, delimiter: str, inside: bool) -> tuple[bool, list[int]]:
    """Of a line without its line feed, that begins inside a quoted cell or not: whether its end is inside, and where records
    begin in it. A carriage return outside quotes ends a record, too."""
    starts = [] if inside else [0]
    if '"' not in line and "\r" not in line:
        return inside, starts
    state, at = "quoted" if inside else "start", 0
    for found in _SPECIAL[delimiter].finditer(line):
        if found.start() > at and state in ("start", "closing"):
            state = "plain"
        at, c = found.end(), found[0]
        if state == "quoted":
            state = "closing" if c == '"' else state
        elif c == '"':
            state = "quoted" if state in ("start", "closing") else state
        elif c == "\r":
            state = "start"
            if at < len(line):
                starts.append(at)
        else:
            state = "start"
    return state == "quoted", starts


def cells_of(text: str, delimiter: str) -> list[list[str]]:
    """Every record of a text that begins at a record."""
    csv.field_size_limit(sys.maxsize)
    return [[c.strip() for c in r] for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)]


def _lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return reader.text(path).select(place.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_path").alias("url"))


def _never_cut(spark: SparkSession) -> int:
    """Bytes of a file up to which it is one range, whatever else is read: Spark's ranges are no shorter than the smaller of these."""
    conf = spark._jsparkSession.sessionState().conf()
    return min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())


def _each(batches):
    """(path, start, line) of each line, decoded; a file's byte order mark is left out."""
    last = None
    for batch in batches:
        for path, start, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "line")), strict=True):
            line = raw.decode("utf-8", errors="replace")
            if (path, start) != last:
                last, line = (path, start), line.removeprefix("\ufeff") if start == 0 else line
            yield path, start, line


def _delimiter(line: str) -> str:
    return ";" if line.count(";") > line.count(",") else ","


_SUMMARY = "path string, start long, delimiter string, " + ", ".join(f"ends_{d}_{s} boolean, records_{d}_{s} long" for d in (0, 1) for s in (0, 1))


def _summaries(batches):
    """Of each range: for either delimiter and either state at its start, the state at its end and how many records begin."""
    now, own, delimiter = None, [], None

    def out():
        return [*now, delimiter, *[x for pair in own for x in pair]]

    rows = []
    for path, start, line in _each(batches):
        if (path, start) != now:
            if now:
                rows.append(out())
            now, own = (path, start), [[bool(s), 0] for _ in _DELIMITERS for s in (0, 1)]
            delimiter = None if start else _delimiter(line)
        plain = '"' not in line and "\r" not in line
        for i, pair in enumerate(own):
            if plain:
                pair[1] += not pair[0]
            else:
                pair[0], begun = walk(line, _DELIMITERS[i // 2], pair[0])
                pair[1] += len(begun)
    if now:
        rows.append(out())
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), *[pa.bool_(), pa.int64()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)


def range_states(lines: DataFrame) -> DataFrame:
    """(path, start, delimiter, inside, records): whether each range begins inside a quoted cell, and how many records have
    begun before it. A row for each range, not for each line, meets in the window of a file."""
    ranges = lines.mapInArrow(_summaries, _SUMMARY)
    delimiter = F.max("delimiter").over(Window.partitionBy("path"))
    pick = lambda name, s: F.when(F.col("delimiter") == ",", F.col(f"{name}_0_{s}")).otherwise(F.col(f"{name}_1_{s}"))
    ranges = ranges.withColumn("delimiter", delimiter).select("path", "start", "delimiter", *[pick(n, s).alias(f"{n}_{s}") for n in ("ends", "records") for s in (0, 1)])
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # A range either fixes the state at its end, or keeps it, or turns it round; only turns since the last fixed state count.
    turns = F.coalesce(F.sum(F.when(F.col("ends_0") & ~F.col("ends_1"), 1).otherwise(0)).over(before), F.lit(0))
    ranges = ranges.withColumn("turns", turns)
    fixes = F.col("ends_0") == F.col("ends_1")
    fixed = F.last(F.when(fixes, F.struct(F.col("ends_0").alias("to"), F.col("turns"))), ignorenulls=True).over(before)
    ranges = ranges.withColumn("fixed", fixed)
    inside = F.coalesce(F.col("fixed.to"), F.lit(False)) != ((F.col("turns") - F.coalesce(F.col("fixed.turns"), F.lit(0))) % 2 == 1)
    ranges = ranges.withColumn("inside", inside).withColumn("own", F.when(F.col("inside"), F.col("records_1")).otherwise(F.col("records_0")))
    return ranges.select("path", "start", "delimiter", "inside", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("records"))


#: within: how many finished records with a value the range has before this one. text: a piece of a record that crosses ranges.
_RECORDS = "path string, start long, record long, within long, cells array<string>, text string"


class _Cutter:
    """Cuts one range at record boundaries; add() takes its lines, done() gives the last rows."""

    def __init__(self, path: str, start: int, delimiter: str, inside: bool, records: int) -> None:
        self.path, self.start, self.delimiter, self.inside, self.before, self.begun = path, start, delimiter, inside, records, records
        self.head, self.whole, self.open, self.size, self.within = [], [], [], 0, 0
        self.leading = inside

    def add(self, line: str):
        at_inside, starts = walk(line, self.delimiter, self.inside)
        self.inside = at_inside
        if self.leading:
            self.head.append(line[: starts[0]] if starts else line + "\n")
            if not starts and at_inside:
                return
            self.leading = False
            line, starts = (line[starts[0] :], [s - starts[0] for s in starts]) if starts else ("", [])
            if not starts:
                return
        if starts:
            self.whole += self.open
            self.begun += len(starts)
            self.whole.append(line[: starts[-1]])
            self.open = [line[starts[-1] :] + "\n"]
        else:
            self.open.append(line + "\n")
        self.size += len(line)
        if self.size > _PARSED:
            yield from self._parsed(1)

    def _parsed(self, left: int):
        """Rows of the finished records; `left` of those begun are not among them."""
        text, self.whole, self.size = "".join(self.whole), [], 0
        found = cells_of(text, self.delimiter)
        first = self.begun - left - len(found) + 1
        for i, cells in enumerate(found):
            if any(cells):
                yield self.path, self.start, first + i, self.within, cells, None
                self.within += 1

    def done(self):
        if self.head:
            yield self.path, self.start, self.before, 0, None, "".join(self.head)
        if not self.inside:
            self.whole, self.open = self.whole + self.open, []
        yield from self._parsed(1 if self.open else 0)
        if self.open:
            yield self.path, self.start, self.begun, self.within, None, "".join(self.open)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _RECORDS.split(", ")])


def _cut(batches):
    cutter, rows = None, []

    def with_states():
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "start", "line", "delimiter", "inside", "records")]
            yield from zip(*columns, strict=True)

    for path, start, raw, delimiter, inside, records in with_states():
        line = raw.decode("utf-8", errors="replace")
        if cutter is None or (cutter.path, cutter.start) != (path, start):
            if cutter:
                rows += cutter.done()
            cutter = _Cutter(path, start, delimiter, inside, records)
            line = line.removeprefix("\ufeff") if start == 0 else line
        rows += cutter.add(line)
        if len(rows) >= 5_000:
            yield _batch(rows)
            rows = []
    if cutter:
        rows += cutter.done()
    yield _batch(rows)


_WHOLE = "path string, record long, within long, headers array<string>, cells array<string>"


def _whole(batches):
    """The records with a value of files that are one range each, whose lines follow each other; headers are the first of them."""
    csv.field_size_limit(sys.maxsize)

    def texts(lines):
        for _, start, raw in lines:
            if start:
                raise ValueError(_CHANGED)
            line = raw.decode("utf-8", errors="replace")
            yield line

    def ended(lines):
        for line in lines:
            yield from io.StringIO(line + "\n", newline="") if "\r" in line else (line + "\n",)

    def batch():
        of = pa.array([i for i, _, _, _ in rows], pa.int32())  # a file's name and headers are made once
        columns = [pa.array(names, pa.string()).take(of), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(heads, pa.list_(pa.string())).take(of), pa.array([r[3] for r in rows], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _WHOLE.split(", ")])

    every = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("url", "start", "line")), strict=True))
    rows, names, heads = [], [], []
    for url, lines in groupby(every, itemgetter(0)):
        lines, name, head, within = texts(lines), unquote(url), None, 0
        first = next(lines).removeprefix("\ufeff")
        for record, found in enumerate(csv.reader(ended(chain([first], lines)), delimiter=_delimiter(first)), 1):
            cells = [c.strip() for c in found]
            if not any(cells):
                continue
            head = cells if head is None else head
            if not names or names[-1] != name:
                names.append(name)
                heads.append(head)
            rows.append((len(names) - 1, record, within, cells))
            within += 1
            if len(rows) >= 5_000:
                yield batch()
                rows, names, heads = [], [], []
    yield batch()


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small; else joined like any other."""
    return F.broadcast(df) if df.count() <= _FEW else df


def _cut_lines(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(path, start, record, within, cells, text): the finished records with a value, and the pieces of others, of each range."""
    few = states.count() <= _FEW
    known = states.withColumnRenamed("path", "of").withColumnRenamed("start", "from")
    # a shuffle does not keep the order of a range's lines, which is put back
    lines, known = (lines, F.broadcast(known)) if few else (lines.withColumn("place", F.monotonically_increasing_id()), known)
    # A range that the first pass did not see (other settings, another file) is an error, not a gap.
    joined = lines.join(known, (F.col("path") == F.col("of")) & (F.col("start") == F.col("from")), "left")
    unknown = F.raise_error(F.lit(_CHANGED)).cast("boolean")
    joined = joined.withColumn("inside", F.when(F.col("of").isNull(), unknown).otherwise(F.col("inside")))
    if not few:
        joined = joined.repartition("path", "start").sortWithinPartitions("path", "start", "place")
    return joined.select("path", "start", "line", "delimiter", "inside", "records").mapInArrow(_cut, _RECORDS)


def _crossing(ranges: DataFrame, states: DataFrame) -> DataFrame:
    """The records that cross ranges, joined from their pieces, under the range in which they begin."""
    pieces = ranges.select("path", "start", F.inline("pieces")).groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("start", "within", "text"))).alias("pieces"))
    delimiters = states.groupBy("path").agg(F.max("delimiter").alias("delimiter"))
    whole = pieces.select("path", F.col("pieces")[0]["start"].alias("start"), "record", F.col("pieces")[0]["within"].alias("within"), F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"))

    def parse(batches):
        for batch in batches:
            rows = []
            for path, start, record, within, text, delimiter in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "record", "within", "text", "delimiter")), strict=True):
                found = cells_of(text, delimiter)
                if found and any(found[0]):
                    rows.append((path, start, record, within, found[0], None))
            yield _batch(rows)

    return whole.join(delimiters, "path").mapInArrow(parse, _RECORDS).drop("text")


def read_ranges(spark: SparkSession, path: str, glob: str | None = None, hashed: bool = True) -> DataFrame:
    """grid.read_rows() for CSV files, cut into ranges: the first record with a value is the header, row_index counts the data
    records from 0, spreadsheet_row is the true number of the record, blank ones counted. Short records are padded.

    content_hash is not of the file's bytes, which would have to be read in order, but of its records: the sum of the hashes of
    their numbers and cells, the same however the file is cut. Without hashed it is left out, and small files are read once. Else, and
    where a file is cut, files are read again: for the ranges' states; for the header, hash and number of records of each range and
    the pieces at its ends; and for the rows.
    """
    lines, least = _lines(spark, path, glob), _never_cut(spark)
    small = _small(lines.where(F.col("size") <= least), hashed)
    rows = small.unionByName(_large(lines.where(F.col("size") > least), hashed))
    index = F.col("before") + F.col("within") - 1
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.size("headers") - F.size("cells"), F.lit(0))))
    sheet = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return rows.where(index >= 0).select("path", *["content_hash"] * hashed, sheet.alias("sheet"), "headers", index.alias("row_index"), F.col("record").alias("spreadsheet_row"), padded.alias("cells"))


def _record_hash() -> Column:
    return row_hash(F.col("record"), F.to_json("cells"))


def _of_records(digest: Column) -> Column:
    return F.concat(F.lit("records-"), digest).alias("content_hash")


def _small(lines: DataFrame, hashed: bool) -> DataFrame:
    """(path, headers, content_hash, before, record, within, cells) of the records of files that are one range each."""
    rows = lines.select("url", "start", "line").mapInArrow(_whole, _WHOLE).withColumn("before", F.lit(0).cast("long"))
    if hashed:
        files = rows.groupBy(F.col("path").alias("of")).agg(_of_records(set_digest(_record_hash())))
        rows = rows.join(files, F.col("path") == F.col("of")).drop("of")
    return rows


def _large(lines: DataFrame, hashed: bool) -> DataFrame:
    """The same of files that may be cut."""
    states = written(range_states(lines), "range-states")
    cut = _cut_lines(lines, states)
    whole = F.col("text").isNull()
    digest = set_digest(F.when(whole, _record_hash())) if hashed else F.lit(None).cast("string")
    sums = cut.groupBy("path", "start").agg(
        F.count_if(whole).alias("n"), F.min(F.when(whole, F.col("record"))).alias("record"), F.min_by("cells", F.when(whole, F.col("record"))).alias("cells"), digest.alias("digest"),
        F.collect_list(F.when(~whole, F.struct("record", "within", "text"))).alias("pieces"),
    )
    ranges = written(sums, "ranges")
    crossing = written(_crossing(ranges, states), "crossing-records")
    every = ranges.select("path", "start", "n", "record", "cells", "digest").unionByName(crossing.select("path", "start", F.lit(1).cast("long").alias("n"), "record", "cells", _record_hash().alias("digest")))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    places = every.groupBy("path", "start").agg(F.sum("n").alias("n")).select(F.col("path").alias("of"), F.col("start").alias("from"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    files = every.groupBy(F.col("path").alias("of")).agg(F.min_by("cells", "record").alias("headers"), *[_of_records(set_digest(F.col("digest")))] * hashed)
    rows = cut.where(whole).drop("text").unionByName(crossing)
    rows = rows.join(_few(places), (F.col("path") == F.col("of")) & (F.col("start") == F.col("from"))).drop("of")
    rows = rows.join(_few(files), F.col("path") == F.col("of"))
    return rows.select("path", "headers", *["content_hash"] * hashed, "before", "record", "within", "cells")
