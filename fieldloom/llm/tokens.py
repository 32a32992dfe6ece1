"""Whole-text tokenizing with a memory of short chunks.

A public tokenizer's pre-tokenizer cuts every text at some places whatever stands around
them: from non-space to space, after a lone line end, and where a run of Latin letters
meets ASCII that isn't a letter. So a text can be cut there, and a distinct chunk needs
the library only once; the ids are those of encoding the whole text. Most chunks are
one word.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Chunks kept in memory at once (two generations of half as many), and the longest that is kept.
CACHE_CHUNKS, CACHE_CHARS = 600_000, 32

#: Letters of Latin scripts up to U+024F, but for U+0130, which lower-cases to two characters;
#: and ASCII that ends a run of letters.
_LETTER = "a-zA-ZÀ-ÖØ-öø-įı-ɏ"
_ENDS = r"(?=[\x00-@\[-`{-\x7f]|\Z)"
_WORDS = re.compile(rf"[{_LETTER}]+{_ENDS}|[^ \n\r\t]+")
_SPACED = re.compile(rf" ?[{_LETTER}]+{_ENDS}|\n(?=\S)|[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
#: White space other than what the chunks are cut at; such texts are encoded in one go.
_ODD = re.compile(r"[^\S \n\r\t]")
_WORD = re.compile(rf" ?[{_LETTER}]+")


def _byte_letters() -> list[str]:
    """The byte-level form: printable bytes stand for themselves, the others for 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b if b in plain else 256 + others.index(b)) for b in range(256)]


_BYTES = _byte_letters()


class _Odd(Exception):
    pass


class ChunkEncoder(dict):
    """Token ids of texts; a dict from chunk to its ids' little-endian 32-bit bytes.

    When the dict is full it becomes the older generation, and starts anew; chunks that
    come again are taken back from there, so that common ones stay.

    ``spaces``: whether the tokenizer keeps white space (byte-level) or drops it.
    """

    def __init__(self, tokenizer_file: str, spaces: bool):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.limit = CACHE_CHUNKS
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.spaces = spaces
        self.cut = (_SPACED if spaces else _WORDS).findall

    def __missing__(self, chunk: str) -> bytes:
        data = self.older.get(chunk)
        if data is None:
            data = self._encode(chunk)
        if len(chunk) <= CACHE_CHARS:
            if 2 * len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[chunk] = data
        return data

    def _encode(self, chunk: str) -> bytes:
        if _WORD.fullmatch(chunk):
            # One pre-token: the model alone, on its byte-level form.
            piece = chunk if self.spaces else chunk.lower()
            piece = piece.replace(" ", _BYTES[32]) if piece.isascii() else "".join([_BYTES[b] for b in piece.encode()])
            return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()
        if self.spaces and _ODD.search(chunk):
            raise _Odd
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def forget(self) -> None:
        """Drop all chunks; the tokenizer stays."""
        self.clear()
        self.older = {}

    def ids(self, text: str | None, end: int | None = None) -> np.ndarray:
        """uint32 ids of the whole text (None: empty), then ``end``."""
        tail = b"" if end is None else end.to_bytes(4, "little")
        try:
            data = b"".join(map(self.__getitem__, self.cut(text or "")))
        except _Odd:
            data = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.frombuffer(data + tail, "<u4")


_KEPT: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(tokenizer_file: str, spaces: bool) -> ChunkEncoder:
    """This process's encoder for a tokenizer."""
    key = (tokenizer_file, spaces)
    if key not in _KEPT:
        _KEPT[key] = ChunkEncoder(tokenizer_file, spaces)
    return _KEPT[key]
