"""Text of references, keys and digests."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_reference(sheet: Column, column: Column, row: Column) -> Column:
    return F.concat(sheet, F.lit("!"), column, F.lit(":"), row.cast("string"))


def identity(reference: Column, period: Column) -> Column:
    """The key that both sides build: a reference and its period."""
    return F.concat(F.coalesce(reference, F.lit("")), F.lit("|"), F.coalesce(period, F.lit("")))


def normalise_header(header: str) -> str:
    """Accents folded, lower case, runs of anything else than letters and digits as one space."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", header) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", plain.lower()).strip()


def mapping_digest(sender: Column, version: Column, columns: Column) -> Column:
    """Sixteen hex digits of a mapping: its sender, version and sorted header=field entries (a MAP)."""
    entries = F.array_join(F.transform(F.array_sort(F.map_entries(columns)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return F.substring(F.sha2(F.concat_ws("|", sender, version.cast("string"), entries), 256), 1, 16)


def token_set_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Similarity 0 to 100 of two texts as sets of words: the best of the common words against either side, and of both
    sides, by the share of characters in a longest common subsequence. Exact from `least` on; what cannot reach it by length, or
    cannot beat the best so far, is not compared, and the result is then below `least`, too."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, own, other = sorted(x & y), sorted(x - y), sorted(y - x)
    if common and (not own or not other):
        return 100.0
    base = " ".join(common)
    left, right = " ".join([*common, *own]), " ".join([*common, *other])
    pairs = [(left, right)] + ([(base, left), (base, right)] if base else [])
    bounded = sorted(((200.0 * min(len(p), len(q)) / max(1, len(p) + len(q)), p, q) for p, q in pairs), reverse=True)
    best = 0.0
    for bound, p, q in bounded:
        if bound <= best or bound < least:
            break
        best = max(best, 200.0 * common_subsequence(p, q) / max(1, len(p) + len(q)))
    return best


def common_subsequence(a: str, b: str) -> int:
    """The length of a longest common subsequence. A row of the usual table is one integer, whose zero bits are the columns
    where the length grows; a character of b updates all columns by one addition."""
    full = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def frame_digest(df: DataFrame, counted: bool = False) -> DataFrame:
    """One row, digest (and n, the number of rows): of all rows of df in any order. Rows are hashed each, hashes sorted inside parts by
    their first digits, the parts' digests sorted: no task holds all rows' hashes. They are shuffled as bytes."""
    hashed = df.select(F.unhex(F.sha2(F.to_json(F.struct(*df.columns)), 256)).alias("h"))
    texts = F.transform(F.array_sort(F.collect_list("h")), lambda h: F.lower(F.hex(h)))
    lists = hashed.groupBy(F.lower(F.hex(F.substring("h", 1, 2))).alias("p")).agg(F.sha2(F.array_join(texts, "\n"), 256).alias("d"), *[F.count("*").alias("n")] * counted)
    return lists.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"), *[F.coalesce(F.sum("n"), F.lit(0)).alias("n")] * counted)
