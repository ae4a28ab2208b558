"""Word shingles of whole texts as 64-bit numbers, in array operations over a batch."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[str], lower: bool = True) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts in one array, and where each text's words begin and end."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    begins[edge] = inside[edge]
    at = np.flatnonzero(begins)
    upto = np.append(0, np.cumsum(inside))
    offsets = np.append(upto[at], upto[-1]).astype(np.int32)
    array = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return array, np.searchsorted(at, bounds)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    array, cuts = words(texts)
    coded = array.dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    return hashes[coded.indices.to_numpy(zero_copy_only=False)], cuts


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text.  With fewer words than `size`, all words make one."""
    hashes, cuts = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for k in range(size):
            rolled = mix64(rolled + hashes[k : k + len(rolled)] + np.uint64(0x9E3779B97F4A7C15))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                h = np.array([b - a], np.uint64)
                for x in hashes[a:b]:
                    h = mix64(h + x + np.uint64(0xD1B54A32D192ED03))
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
