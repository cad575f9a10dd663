"""Packing of token sequences by minimum bin slack.

Each task encodes its documents and cuts whole sequences off their fronts. The remainders wait in a window; while it is
full, sequences are filled: the largest waiting remainder is taken, and a subset-sum over bitsets (one big integer for
each length, so that the counts can be backtracked) picks the multiset of other remainders that comes closest to the
capacity. What slack is left is filled by cutting one of the remainders that still wait. So all sequences of a task are full but
for its last ids, fewer than a sequence, which are cut at powers of two, as these need no padding. There is no shuffle:
sequence ids hold the task's number in their upper bits.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import in_arrow, slices
from tallyframe.llm.encoding import encoder

#: Bits of a sequence id below the task's number.
LOCAL_BITS = 33
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], capacity: int, lengths: list[int] | None = None) -> dict[int, int]:
    """The multiset of lengths, from counts, with the largest sum up to capacity: length -> how many.

    reach[i] has a bit for each sum that the first i choices can make. Choices are lengths with powers of two of their
    counts, largest first; it stops at the first that reaches capacity exactly. lengths: those of counts in ascending order.
    """
    limit, reach, choices = (1 << (capacity + 1)) - 1, [1], []
    lengths = sorted(counts) if lengths is None else lengths
    for at in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[at]
        n, k = min(counts[length], capacity // length), 1
        while n > 0:
            k = min(k, n)
            choices.append((length, k))
            reach.append((reach[-1] | reach[-1] << length * k) & limit)
            n, k = n - k, k * 2
        if reach[-1] >> capacity & 1:
            break
    total, taken = reach[-1].bit_length() - 1, defaultdict(int)
    for i in range(len(choices), 0, -1):
        length, k = choices[i - 1]
        if not reach[i - 1] >> total & 1:
            taken[length] += k
            total -= length * k
    return dict(taken)


class Packer:
    """Takes documents' ids one after the other and gives pieces: (document, start, ids, document's size, sequence, offset)."""

    def __init__(self, capacity: int, window: int, first: int) -> None:
        self.capacity, self.window, self.next, self.waiting = capacity, window, first, 0
        self.rest: dict[int, deque] = defaultdict(deque)
        #: How many remainders of each length wait, and the lengths in ascending order.
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc, ids: np.ndarray):
        n, whole = len(ids), len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield doc, start, ids[start : start + self.capacity], n, self._sequence(), 0
        if whole < n:
            self._wait(n - whole, (doc, whole, ids[whole:].copy(), n))  # not a view, which would keep all ids
            if self.waiting >= self.window:
                yield from self.drain(self.window // 2)

    def _wait(self, length: int, piece: tuple) -> None:
        if length not in self.counts:
            insort(self.lengths, length)
        self.counts[length] = self.counts.get(length, 0) + 1
        self.rest[length].append(piece)
        self.waiting += 1

    def _next(self, length: int) -> tuple:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.waiting -= 1
        return self.rest[length].popleft()

    def _take(self) -> list:
        largest = self.lengths[-1]
        out = [self._next(largest)]
        for length, n in fill(self.counts, self.capacity - largest, self.lengths).items():
            out += [self._next(length) for _ in range(n)]
        return out

    def drain(self, until: int = 0):
        while self.waiting > until:
            taken = self._take()
            slack = self.capacity - sum(len(p[2]) for p in taken)
            if slack and self.waiting:  # all that wait are longer than the slack: one of them is cut to fill it
                length = self.lengths[-1]
                doc, start, ids, n = self._next(length)
                taken.append((doc, start, ids[:slack], n))
                self._wait(length - slack, (doc, start + slack, ids[slack:], n))
                slack = 0
            size = self.capacity - slack
            if not slack:
                yield from self._placed(taken, [size])
            else:  # the last ids of a task; a power of two is not padded
                yield from self._placed(taken, [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1])

    def _placed(self, pieces: list, sizes: list[int]):
        pieces = deque(pieces)
        for size in sizes:
            sequence, offset = self._sequence(), 0
            while offset < size:
                doc, start, ids, n = pieces.popleft()
                if len(ids) > size - offset:
                    cut = size - offset
                    pieces.appendleft((doc, start + cut, ids[cut:], n))
                    ids = ids[:cut]
                yield doc, start, ids, n, sequence, offset
                offset += len(ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", capacity: int = 1024, window: int = 4096) -> DataFrame:
    """One row for each piece: key, start (the document's ids before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers), doc_tokens (the document's ids), sequence_id and offset in the sequence.

    tokenizer: the path of a tokenizer file that every executor can read. A null or empty text has the end id alone. Every
    id lies in one piece. Sequences hold `capacity` ids, but for ten at most at the end of each task, which hold a power of two.
    Repeated rows are packed as documents of their own; an empty table gives an empty one. Other columns of docs are left out; the key must not be named like one of the columns that are added. window: remainders that wait at most.
    """
    if key.lower() in (x.split()[0] for x in SCHEMA.split(", ")):
        raise ValueError(f"the key {key!r} is named like a column of the result; rename it first")
    source = docs.select(F.col(key), F.col(text))

    def run(batches):
        encode = encoder(tokenizer)
        packer = Packer(capacity, window, TaskContext.get().partitionId() << LOCAL_BITS)
        kind = None

        def rows(pieces):
            out = [(doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset) for doc, start, ids, n, sequence, offset in pieces]
            if out:
                names = [key, *(x.split()[0] for x in SCHEMA.split(", "))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [kind] + [pa.int64()] * 6, strict=True)], names=names)

        end = np.array([end_id], encode.dtype)
        for batch in batches:
            kind = batch.schema.field(key).type
            for part in slices(batch, text):
                encoded = encode.ids(part.column(text).to_pylist())
                yield from rows(p for doc, raw in zip(part.column(key).to_pylist(), encoded, strict=True) for p in packer.add(doc, np.concatenate((np.frombuffer(raw, encode.dtype), end))))
        yield from rows(packer.drain())

    return in_arrow(source, run, f"`{key}` {source.schema[key].dataType.simpleString()}, {SCHEMA}")
