"""Digests of sets of rows that need no order: the sum of wide hashes of the rows, lane by lane.

A row's sha256 is four lanes of 64 bits; a set's digest is the sum of its rows' lanes, each modulo 2 ** 64. It is an aggregate
like any sum: parts are combined before the shuffle, it is the same however rows are dealt out, and a row that is there twice
counts twice. No list of hashes is ever gathered. The digest of a union is the same sum over the digests of its parts.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(*columns: Column) -> Column:
    """sha256, as hex, of the columns' texts, each with its length before it, `-` for a null."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(reduce(F.concat, parts), 256)


def set_digest(hashed: Column) -> Column:
    """The digest, an aggregate, of rows with a hash, or of sets with a digest; null for none."""
    lanes = [F.sum(F.conv(F.substring(hashed, 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")) % F.lit(Decimal(2**64)) for i in range(4)]
    return F.concat(*[F.lower(F.lpad(F.conv(lane.cast("string"), 10, 16), 16, "0")) for lane in lanes])
