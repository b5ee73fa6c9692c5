"""Exact word-cached encoding with the ``tokenizers`` library.

Both vocabularies split a text into independent pre-tokens before merging, so
the ids of a text are the ids of its pieces in order. Pieces are cut only at
boundaries that are pre-token boundaries whatever stands around them; a piece
goes through the library when a worker first meets it, and texts with any
other white space go through it whole. A piece that is a word of letters, or
one with closing signs behind it, is one pre-token or two and goes straight to
the library's model.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np

from .common import only_cache

#: Pieces a worker remembers; the cache starts over when it is full.
CACHE_PIECES = 800_000

#: Signs that may close a piece: with nothing but such signs behind its letters, they are one pre-token.
CLOSING = '.,;:!?)"'

_loaded: dict[tuple, "Encoder"] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_LETTERS = _byte_letters()
#: White space other than a plain space or line break, as far as any library may see it.
_ODD = re.compile("[\x01\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def _regular(text: str) -> bool:
    """Only single spaces and line breaks, each between two other characters."""
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ("  ", "\n\n", " \n", "\n ")) and not _ODD.search(text)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Ids by piece; a piece that is asked for and not there is worked out and kept."""

    def __init__(self, encoder: "Encoder"):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        found = self.encoder.ids_of(piece)
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Encode texts to little-endian id arrays of ``dtype``.

    ``words`` is true for vocabularies that drop white space (pieces are words);
    otherwise a piece keeps the one space before it.
    """

    def __init__(self, path: str, words: bool, dtype: str = "<u4"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.words, self.dtype = words, np.dtype(dtype)
        self.known = _Known(self)
        self.plain = None
        if words:
            # The same vocabulary without its normalizer, for words that normalization leaves alone.
            self.plain = Tokenizer.from_file(path)
            self.plain.encode_special_tokens = True
            self.plain.normalizer = normalizers.Sequence([])
        # The line break that opens a line; pieces never hold it elsewhere.
        (stop,) = (0,) if words else self.lib.encode("\n", add_special_tokens=False).ids
        self.model, self.tails = (self.plain or self.lib).model, {"": b""}
        self.raw = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.lib.get_vocab_size())]
        self.stop = self.raw[stop]

    def _library(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 2048):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.lib.encode_batch_fast(texts[i : i + 2048], add_special_tokens=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        parts = [self._pieces(t) if _regular(t) else None for t in texts]
        slow = iter(self._library([t for t, p in zip(texts, parts, strict=True) if p is None]))
        # A text's first piece is cached with a line break before it, which is cut off again.
        get, skip = self.known.__getitem__, 0 if self.words else self.dtype.itemsize
        return [next(slow) if p is None else b"".join(map(get, p))[skip:] for p in parts]

    def ids_of(self, piece: str) -> bytes:
        """Ids of a piece, worked out anew."""
        head = piece.rstrip(CLOSING)
        opening = not self.words and piece[0] == "\n"
        word = head[1:] if opening else head
        if self.words:
            word = word.lower()
        if not word.isalpha() or (self.words and not word.isascii() and not (unicodedata.is_normalized("NFC", word) and "\u03a3" not in head and "\u0130" not in head)):
            if opening:
                return self.stop + (self._library([piece[1:]])[0] if len(piece) > 1 else b"")
            return self._library([piece if self.words else " " + piece])[0]
        if head != piece:
            tail = piece[len(head) :]
            if (more := self.tails.get(tail)) is None:
                if len(self.tails) > 1000:
                    self.tails.clear()
                more = self.tails[tail] = self._model_ids(tail)
            return self.known[head] + more
        if opening:
            return self.stop + self._model_ids(word)
        return self._model_ids(word if self.words else " " + word)

    def _model_ids(self, pre_token: str) -> bytes:
        """Ids of one pre-token, straight from the library's model."""
        if not pre_token.isascii():
            pre_token = "".join(map(_LETTERS.__getitem__, pre_token.encode()))
        elif pre_token[0] == " ":
            pre_token = _LETTERS[32] + pre_token[1:]
        return b"".join([self.raw[t.id] for t in self.model.tokenize(pre_token)])

    def _pieces(self, text: str) -> list[str]:
        if self.words:
            return text.replace("\n", " ").split(" ")
        return ("\n" + text.replace("\n", " \n")).split(" ")


def encoder(path: str, words: bool, dtype: str = "<u4") -> Encoder:
    """The worker's own encoder, kept across tasks until another operator's run there."""
    key = (path, words, dtype)
    only_cache("tokens", _loaded.clear)
    if key not in _loaded:
        _loaded[key] = Encoder(path, words, dtype)
    return _loaded[key]


def crc_combiner() -> Callable[[int, int, int], int]:
    """``combine(a, b, n)``: crc32 of two byte strings joined, the second ``n`` bytes long.

    Appending zero bits moves the register by a linear map; the maps of 8, 16,
    32, ... bits are kept as one table per register byte.
    """

    def apply(matrix: list[int], vector: int) -> int:
        total, i = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[i]
            vector >>= 1
            i += 1
        return total

    step = [0xEDB88320] + [1 << i for i in range(31)]  # one bit
    for _ in range(3):
        step = [apply(step, v) for v in step]
    maps: list[list[list[int]]] = []

    def tables(k: int) -> list[list[int]]:
        nonlocal step
        while len(maps) <= k:
            maps.append([[apply(step, b << shift) for b in range(256)] for shift in (0, 8, 16, 24)])
            step = [apply(step, v) for v in step]
        return maps[k]

    def combine(a: int, b: int, n: int) -> int:
        k = 0
        while n:
            if n & 1:
                t0, t1, t2, t3 = tables(k)
                a = t0[a & 255] ^ t1[a >> 8 & 255] ^ t2[a >> 16 & 255] ^ t3[a >> 24]
            n >>= 1
            k += 1
        return a ^ b

    return combine
