"""Shared by the classifiers that compare compressed lengths."""

from __future__ import annotations

import zstandard

#: ASCII letters and all bytes of other characters stay, the rest are spaces.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Fixed frames around each window that the dictionaries hold too, so that even a window of one word is compressed.
BEFORE, AFTER = bytes(range(1, 32)), bytes(range(31, 0, -1))


def letters(text: str | None) -> bytes:
    """Lower-cased words of letters, one space between."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split())


def lengths(raw: bytes, strategy: int, min_match: int, search_log: int, target_length: int, window_log: int = 18, hash_log: int = 16, chain_log: int = 17):
    """A function that gives the compressed length of a window with raw as its dictionary's content. Of a content longer than
    2^chain_log bytes only parts are found again."""
    raw += BEFORE + AFTER
    parameters = zstandard.ZstdCompressionParameters(window_log=window_log, hash_log=hash_log, chain_log=chain_log, search_log=search_log, min_match=min_match, target_length=target_length, strategy=strategy, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    compress = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress
    return lambda window: len(compress(BEFORE + window + AFTER))
