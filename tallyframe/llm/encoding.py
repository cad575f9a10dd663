"""Whole-text encoding with a public tokenizer file, with a bounded memory of pieces already encoded.

Words follow Zipf's law, so most of a corpus consists of pieces seen before. Texts are cut, many at a time, only at places
where the tokenizer itself always cuts; each distinct piece is looked up once and, if it is new, encoded by the tokenizers
library; the ids of a text are the joined ids of its pieces: the same ids as encoding the whole text in one call.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Chunks of more characters are encoded each time.
LONGEST_KEPT = 64
#: Characters of the texts that are encoded together.
GROUP_CHARS = 4_000_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿªµº"
#: Characters for which Python's classes and the tokenizer's agree, so that pieces can be cut further.
_PLAIN = re.compile(rf"[\n -~¡-©«-±´¶-¸»¿×÷{_LETTERS}]*")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_TWO_SPACES = re.compile(r"\s\s")
#: Python counts the last four as white space and the tokenizers do not; the first marks cuts here.
_SEPARATORS = re.compile("[\0\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


_LETTER_OF_BYTE = _byte_letters()


class _Words(dict):
    """pre-token -> its ids as bytes, in two generations, so that what is not used again goes. Long ones, which seldom come
    again, are not kept: so many entries are a bound in bytes, too."""

    def __init__(self, encode, keep: int) -> None:
        self.encode, self.keep, self.old = encode, keep, {}

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is None:
            ids = self.encode(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class _Known:
    """Chunks already encoded, in Arrow and numpy arrays of a few bytes each: chunks[i] has ids[starts[i] : starts[i] + sizes[i]]."""

    def __init__(self, dtype: np.dtype, keep: int) -> None:
        self.keep, self.turn = keep, 0
        self.chunks, self.ids = pa.array([], pa.large_string()), np.zeros(0, dtype)
        self.starts, self.sizes, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def numbers(self, chunks: pa.Array, encode) -> np.ndarray:
        """The place of each chunk, each once in chunks, after those that are missing have been encoded and added."""
        self.turn += 1
        if len(self.chunks) > self.keep:  # keep the half that was used last
            self._only(np.sort(np.argsort(self.used, kind="stable")[len(self.used) // 2 :]))
        found = pc.index_in(chunks, value_set=self.chunks)
        new = chunks.filter(found.is_null())
        at = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = np.arange(len(self.chunks), len(self.chunks) + len(new))
        ids = [encode(x) for x in new.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.ids.itemsize
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes, self.used = np.concatenate((self.sizes, sizes)), np.concatenate((self.used, np.zeros(len(ids), np.int64)))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), self.ids.dtype)))
        self.chunks = pa.concat_arrays([self.chunks, new])
        self.used[at] = self.turn
        return at

    def _only(self, kept: np.ndarray) -> None:
        short = pc.less_equal(pc.utf8_length(self.chunks), LONGEST_KEPT).to_numpy(zero_copy_only=False)
        kept = kept[short[kept]]
        self.chunks, sizes = self.chunks.take(pa.array(kept)), self.sizes[kept]
        starts = np.cumsum(sizes) - sizes
        self.ids = self.ids[np.arange(sizes.sum()) + np.repeat(self.starts[kept] - starts, sizes)]
        self.starts, self.sizes, self.used = starts, sizes, self.used[kept]


class Encoder:
    """ids(texts) gives, for each text, its token ids as little-endian bytes of self.dtype.

    keep: chunks of texts that are remembered, about; those not used for longest are forgotten.
    """

    def __init__(self, path: str, keep: int = 400_000) -> None:
        self.literal = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: Strings that the tokenizer takes as one id wherever they stand; texts that hold one are encoded whole.
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = added
        self.size = self.literal.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        pre, model, post = spec["pre_tokenizer"] or {}, spec["model"], spec["post_processor"] or {}
        kinds = [p["type"] for p in pre.get("pretokenizers", [pre])]
        self.mode = "plain"
        if model["type"] == "BPE" and post.get("type", "ByteLevel") == "ByteLevel":
            if kinds == ["ByteLevel"] and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]:
                self.mode = "spaced"
            elif kinds == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["invert"] and model.get("end_of_word_suffix"):
                self.mode = "words"
        self.tokenize = self.literal.model.tokenize
        self.words, self.known = _Words(self._word, keep // 20), _Known(self.dtype, keep)

    def _whole(self, text: str) -> bytes:
        return np.array(self.literal.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        shown = (word if word.isascii() else word.encode().decode("latin-1")).translate(_LETTER_OF_BYTE)
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk: of its pre-tokens where Python cuts them as the tokenizer does, else of the whole."""
        if chunk.isascii():
            if chunk.isalpha() if self.mode == "words" else chunk[:1] == " " and chunk[1:].isalpha():
                return self._word(chunk.lower() if self.mode == "words" else chunk)
        elif not _PLAIN.fullmatch(chunk):
            return self._whole(chunk)
        words = _WORD.findall(chunk.lower()) if self.mode == "words" else _SPACED.findall(chunk)
        return b"".join(map(self.words.__getitem__, words))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out, some, chars = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(map(text.__contains__, self.added)) or not (self.mode == "words" and not _separated(text) or self.mode == "spaced" and _spaced_once(text)):
                out[i] = self._whole(text)
                continue
            some.append(i)
            chars += len(text)
            if chars > GROUP_CHARS:
                self._cut(texts, some, out)
                some, chars = [], 0
        if some:
            self._cut(texts, some, out)
        return out

    def _cut(self, texts: list[str | None], some: list[int], out: list[bytes]) -> None:
        """Encode some texts together: they are cut at spaces, and each distinct chunk is looked up once."""
        spaced = self.mode == "spaced"
        whole = pa.array([texts[i] if spaced else texts[i].replace("\n", " ") if _printed(texts[i]) else " ".join(texts[i].split()) for i in some], pa.large_string())
        pieces = pc.split_pattern(whole, " ")
        bounds = pieces.offsets.to_numpy()
        coded = pieces.values.dictionary_encode()
        encode = (lambda x: self.chunk(" " + x)) if spaced else (lambda x: self.chunk(x) if x else b"")
        number = self.known.numbers(coded.dictionary, encode)[coded.indices.to_numpy()]
        every, starts, sizes = self.known.ids, self.known.starts, self.known.sizes
        if spaced:  # a chunk has the space before it; the first one of a text has none
            first = bounds[:-1]
            ids = [self.chunk(x) if x else b"" for x in pieces.values.take(pa.array(first)).to_pylist()]
            number[first] = np.arange(len(starts), len(starts) + len(ids))
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // every.itemsize
            starts, sizes = np.concatenate((starts, len(every) + np.cumsum(n) - n)), np.concatenate((sizes, n))
            every = np.concatenate((every, np.frombuffer(b"".join(ids), self.dtype)))
        n = sizes[number]
        ends = np.concatenate(([0], np.cumsum(n)))
        joined = every[np.arange(ends[-1]) + np.repeat(starts[number] - ends[:-1], n)].tobytes()
        width = self.dtype.itemsize
        for i, a, b in zip(some, ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist(), strict=True):
            out[i] = joined[a * width : b * width]


def _printed(text: str) -> bool:
    """Whether the white space of a text is spaces and line feeds alone, and none of the separators is in it."""
    return text.replace("\n", "").isprintable()


def _separated(text: str) -> bool:
    return not _printed(text) and _SEPARATORS.search(text) is not None


def _spaced_once(text: str) -> bool:
    """Whether no white space stands next to other white space and none of the separators is in a text."""
    if _printed(text):
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text)
    return not (_TWO_SPACES.search(text) or _SEPARATORS.search(text))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker; its memory serves all tasks that the worker runs."""
    return Encoder(path)
