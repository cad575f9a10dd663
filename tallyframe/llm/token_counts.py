"""Token counts of fields and sections, from one encoding of the whole document.

The fields of a row are joined to one document, cut into sections, and encoded once. Each token covers a span of the document;
spans are joined with the sections' intervals. A token that crosses a boundary belongs to the section that has most of its
bytes, and to the earlier of two that have as many: every token is counted once, so sections add up to the document.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import in_arrow
from tallyframe.llm.encoding import encoder

SCHEMA = "field string, section long, first_char long, n_chars long, n_tokens long, n_crossing long"


@lru_cache(maxsize=2)
def _bytes_of_ids(path: str) -> np.ndarray:
    """The number of bytes of each id: in a byte-level vocabulary a token has a letter for each byte."""
    tokenizer = encoder(path).literal
    out = np.zeros(encoder(path).size, np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = len(token)
    return out


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token [start, end), and whether it crosses a boundary. bounds: the sections' starts and the end."""
    last = len(bounds) - 2
    first = np.clip(np.searchsorted(bounds, starts, side="right") - 1, 0, last)
    final = np.clip(np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right") - 1, 0, last)
    section = first.copy()
    for i in np.flatnonzero(first != final):
        parts = np.arange(first[i], final[i] + 1)
        section[i] = parts[np.argmax(np.minimum(bounds[parts + 1], ends[i]) - np.maximum(bounds[parts], starts[i]))]
    return section, first != final


def token_counts(docs: DataFrame, tokenizer: str, fields: list[str], key: str = "doc_id", separator: str = "\n", section: str | None = "\n") -> DataFrame:
    """One row for each section of each row of docs: key, field, section (its number in the field), first_char (its place in
    the joined document, in code points), n_chars, n_tokens, and n_crossing (those of n_tokens that cross a boundary).

    tokenizer: the path of a byte-level tokenizer file that every executor can read. section: a pattern after whose matches a
    field is cut; None leaves fields whole. A separator, as a section's end, belongs to the section before it. Null and
    empty fields are sections of no character. Repeated rows are counted each, very long texts whole; an empty table gives an
    empty one. Columns that are not fields are left out.
    """
    cut = re.compile(section) if section else None
    source = docs.select(F.col(key), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"_{i}") for i, f in enumerate(fields)])

    def run(batches):
        encode, widths = encoder(tokenizer), _bytes_of_ids(tokenizer)
        if encode.mode != "spaced":
            raise ValueError("token spans need a byte-level tokenizer that keeps white space")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                rows = list(zip(*(some.column(f"_{i}").to_pylist() for i in range(len(fields))), strict=True))
                rows = [[*(v + separator for v in row[:-1]), row[-1]] for row in rows]
                keys, names, numbers, firsts, sizes, counts, crossing = [], [], [], [], [], [], []
                for k, row, raw in zip(some.column(key).to_pylist(), rows, encode.ids(["".join(row) for row in rows]), strict=True):
                    pieces = []
                    for name, value in zip(fields, row, strict=True):
                        ends = [m.end() for m in cut.finditer(value) if 0 < m.end() < len(value)] if cut else []
                        pieces += [(name, i, value[a:b]) for i, (a, b) in enumerate(zip([0, *ends], [*ends, len(value)], strict=True))]
                    spans = np.cumsum(widths[np.frombuffer(raw, encode.dtype)])
                    bounds = np.concatenate(([0], np.cumsum([len(p[2].encode()) for p in pieces])))
                    if (spans[-1] if len(spans) else 0) != bounds[-1]:
                        raise ValueError("the tokens do not cover the document")
                    own, crosses = attribute(np.concatenate(([0], spans[:-1])) if len(spans) else spans, spans, bounds)
                    chars = [len(p[2]) for p in pieces]
                    keys += [k] * len(pieces)
                    names += [p[0] for p in pieces]
                    numbers += [p[1] for p in pieces]
                    firsts += [0, *np.cumsum(chars)[:-1].tolist()]
                    sizes += chars
                    counts += np.bincount(own, minlength=len(pieces)).tolist()
                    crossing += np.bincount(own[crosses], minlength=len(pieces)).tolist()
                kinds = (batch.schema.field(key).type, pa.string(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, names, numbers, firsts, sizes, counts, crossing), kinds, strict=True)], names=[key, *(x.split()[0] for x in SCHEMA.split(", "))])

    return in_arrow(source, run, f"`{key}` {source.schema[key].dataType.simpleString()}, {SCHEMA}")
