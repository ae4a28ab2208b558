"""Fast exact encoding with a public tokenizer file.

A text is cut before each run of ASCII white space.  Both vocabularies split
words there before any merge, so the ids of a text are the ids of its pieces in
order.  Each distinct piece is encoded once and its ids are kept; a text is then
put together by array lookups.  Texts with other white space, or with the string
of a special token, go through the tokenizer whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ODD = re.compile("[\x1c-\x1f\x85\xa0  -​    　﻿]|<\\|")
#: A word of Latin letters, then punctuation: two pre-tokens of either vocabulary.
SIMPLE = re.compile("( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceEncoder:
    """Encodes texts to unsigned 32-bit ids.

    `keep` bounds the pieces remembered in one Python worker; beyond it they are
    forgotten and learned again, which changes the time taken and nothing else.
    `lower` is True for the vocabulary that ignores case and white space.
    """

    def __init__(self, path: str, lower: bool = False, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.lower, self.keep = self.tokenizer.model, lower, keep
        self.letters = byte_letters()
        self.space = self.letters[32]
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.marks: dict[str, list[int]] = {}
        self.flat, self.starts, self.sizes = array("I"), array("q"), array("q")

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _word(self, word: str) -> list[int]:
        shown = word.replace(" ", self.space) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(shown)]

    def _add(self, piece: str) -> int:
        """Learns a piece.  A word before punctuation takes the ids of the bare word if that is known."""
        m = SIMPLE.fullmatch(piece)
        if m is None:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        else:
            word, marks = m.groups()
            if marks and (at := self.index.get(word)) is not None:
                ids = self.flat[self.starts[at] : self.starts[at] + self.sizes[at]].tolist()
            else:
                ids = self._word(word.strip(" ").lower() if self.lower else word)
            if marks:
                if marks not in self.marks:
                    self.marks[marks] = self._word(marks)
                ids = ids + self.marks[marks]
        self.index[piece] = at = len(self.starts)
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        return at

    def _block(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """data: the bytes of some texts; bounds: where each begins, and the end."""
        space = SPACE[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[bounds[:-1][bounds[:-1] < len(data)]] = True
        at = np.flatnonzero(begins).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, np.int32(len(data)))), pa.py_buffer(data)).dictionary_encode()
        seen = pieces.dictionary.to_pylist()
        if len(self.index) + len(seen) > self.keep:
            self._forget()
        get, add = self.index.get, self._add
        places = np.fromiter((x if (x := get(p)) is not None else add(p) for p in seen), np.int64, len(seen))
        codes = places[pieces.indices.to_numpy(zero_copy_only=False)]
        flat, starts, sizes = np.array(self.flat, np.uint32), np.array(self.starts), np.array(self.sizes)
        size = sizes[codes]
        ends = np.cumsum(size)
        ids = flat[np.repeat(starts[codes] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.append(0, ends)[np.searchsorted(at, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: pa.Array, block: int = 8_000_000) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        out: list[np.ndarray] = []
        values = texts.fill_null("").to_pylist()
        begin = 0
        while begin < len(values):
            end, size, odd, raw = begin, 0, [], []
            while end < len(values) and (end == begin or size < block):
                if ODD.search(values[end]):
                    odd.append(end - begin)
                raw.append(b"" if odd and odd[-1] == end - begin else values[end].encode())
                size += len(raw[-1])
                end += 1
            bounds = np.cumsum([0, *map(len, raw)])
            got = self._block(np.frombuffer(b"".join(raw), np.uint8), bounds)
            for i in odd:
                got[i] = self.whole(values[begin + i])
            out += got
            begin = end
        return out


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, lower: bool = False) -> PieceEncoder:
    """One encoder for each Python worker, so that what it learned serves later tasks."""
    if (path, lower) not in _encoders:
        _encoders[path, lower] = PieceEncoder(path, lower)
    return _encoders[path, lower]
