"""Words of many texts at once, as arrays: texts are cut by a class for each byte, and A-Z are lower-cased on the way."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Classes of bytes. Bytes of 128 and more are always parts of words, so that UTF-8 is never cut inside a character.
WORD, GAP, BREAK = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def classes(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(gaps)], out[list(breaks)] = GAP, BREAK
    return out


@dataclass
class Words:
    words: pa.Array  # every word of all texts, in order
    sizes: np.ndarray  # of each, in bytes
    data: np.ndarray  # their bytes, joined
    counts: np.ndarray  # how many words each text has
    cut: np.ndarray  # of each word, whether a text begins or a break lies before it


def split(texts: pa.Array, kinds: np.ndarray) -> Words:
    """The words of texts (a null has none): runs of bytes of the class WORD."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first:last]
    bounds = offsets - first
    kind = kinds[raw]
    inside = kind == WORD
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    data = _LOWER[raw[inside]]
    place = np.append(np.cumsum(inside, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)[starts] - 1, len(data)).astype(np.int64)
    sizes = np.diff(place)
    counts = np.diff(np.searchsorted(starts, bounds))
    cut = np.zeros(len(starts), bool)
    texts_begin = (np.cumsum(counts) - counts)[counts > 0]
    cut[texts_begin] = True
    if (kinds == BREAK).any():
        seen = np.searchsorted(np.flatnonzero(kind == BREAK), starts)
        cut[1:] |= seen[1:] != seen[:-1]
    words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(place), pa.py_buffer(data))
    return Words(words, sizes, data, counts, cut)
