"""Token ids of a byte-level vocabulary, remembered by word within a bound."""

from __future__ import annotations

import re

import numpy as np

from lodestone.llm._common import held
from lodestone.llm.packing import _BYTES, _Memo

#: Of texts in which only these characters occur, letters, digits and white space are the same classes in Python's
#: expressions as in the tokenizer's, so that they can be encoded part by part; other texts go to the tokenizer whole.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u017f\\u2010-\\u2027\\u2030-\\u205e]*").fullmatch
#: Digits that Python counts as letters.
_NUMBERS = "²³¹¼½¾"
#: The vocabulary's own parts of a text: endings, a word, a number or signs with the space before them, white space.
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_{_NUMBERS}]+| ?[\d{_NUMBERS}]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


class ByteEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer encodes them by default."""

    def __init__(self, path: str, cache_parts: int = 300_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = re.compile("|".join(re.escape(t.content) for t in added)).search if added else lambda text: None
        self._model = self._tokenizer.model
        self._part_ids = _Memo(self._encode_part, cache_parts).__getitem__

    def _encode_part(self, part: str) -> bytes:
        shown = part.encode().decode("latin-1").translate(_BYTES)
        return np.array([t.id for t in self._model.tokenize(shown)], "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if _PLAIN(text) and not self._added(text):
            return b"".join(map(self._part_ids, _PARTS(text)))
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> ByteEncoder:
    """One encoder for each Python worker."""
    return held((ByteEncoder, path), lambda: ByteEncoder(path))
