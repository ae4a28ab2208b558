"""Runs of repeated words: stretches that repeat with a period, found by a dictionary of basic factors.

For each power of two, every position of a text gets the name of the factor of that length that
begins there; names of the double length are pairs of names.  The next occurrence of a factor is
its successor.  Inside a run, factors about as long as its period recur at exactly that distance,
so consecutive positions whose successors lie equally far, and no further than twice the factor's
length, are arithmetic progressions that propose a period.  A proposal is extended to both sides
as far as the period holds, and counts once, however many lengths propose it.

Positions whose factor occurs once in the text are left out of all longer lengths, so ordinary
prose is done after a few of them.  All texts of a batch are named together, each with names of
its own.  Whole texts are looked at; the work for n words is n log n at most.

Defined cases: a null text counts as empty and has no run; words are split at ASCII white space
and compared byte by byte; a null doc_id counts as an empty text where its checksum is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.llm.common import crc32_mod, small_batches

LEAST_WORDS = 6
LEAST_TIMES = 4
RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A name for each key in its place, and the place of the next equal key (-1: none)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    names = np.empty(len(keys), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)]) if len(keys) else keys
    after = np.full(len(keys), -1, np.int64)
    after[order[:-1][same]] = order[1:][same]
    return names, after


def proposals(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, word after the last, period) of progressions, length by length.

    words: a number for each word; texts that follow one another share no number.
    """
    at = np.arange(len(words))
    names, size = words.astype(np.int64), 1
    while len(at):
        names, after = _named(names)
        gap = np.where(after >= 0, at[after] - at, 0)
        near = (gap > 0) & (gap <= 2 * size)
        # stretches of positions side by side with the same distance
        new = np.ones(len(at), bool)
        new[1:] = (gap[1:] != gap[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        good = near[first] & (count > gap[first])
        first, count = first[good], count[good]
        yield at[first], at[first] + count - 1 + gap[first] + size, gap[first]
        # a factor of the double length recurs only if both its halves do
        recurs = after >= 0
        recurs[after[recurs]] = True
        place = np.full(len(words) + size, -1, np.int64)
        place[at[recurs]] = np.flatnonzero(recurs)
        left = np.flatnonzero(recurs)
        right = place[at[left] + size]
        both = right >= 0
        left, right = left[both], right[both]
        names, at, size = names[left] * (len(words) + 1) + names[right], at[left], 2 * size


def _extended(words: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The longest stretch around a proposal in which words a period apart are equal; looks at twice as many words each time."""
    step = 16
    while end < len(words):
        take = min(step, len(words) - end)
        differs = np.flatnonzero(words[end : end + take] != words[end - period : end - period + take])
        end += int(differs[0]) if len(differs) else take
        if len(differs):
            break
        step *= 2
    step = 16
    while start > 0:
        take = min(step, start)
        differs = np.flatnonzero(words[start - take : start] != words[start - take + period : start + period])
        start -= take - 1 - int(differs[-1]) if len(differs) else take
        if len(differs):
            break
        step *= 2
    return start, end


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) in order of start, then period."""
    found: set[tuple[int, int, int]] = set()
    for starts, ends, periods in proposals(words):
        for start, end, period in zip(starts.tolist(), ends.tolist(), periods.tolist(), strict=True):
            start, end = _extended(words, start, end, period)
            if end - start >= max(LEAST_WORDS, LEAST_TIMES * period):
                found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def best_run(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run that repeats most often, by the exact ratio of its length and period; found is in order."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run keeps its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def repeated(words: list[bytes], h: int) -> list[bytes]:
    """Words with a planted repetition for one in ten checksums: from a word on, some words over and over."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _rows(texts: list[list[bytes]]) -> Iterator[tuple]:
    """The result's columns for each text of a batch."""
    sizes = np.array([len(t) for t in texts], np.int64)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    numbers, _ = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    numbers = numbers.astype(np.int64) + np.repeat(np.arange(len(texts)), sizes) * (numbers.max(initial=0) + 1)
    by_text: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs(numbers):
        k = int(np.searchsorted(cuts, start, "right")) - 1
        by_text[k].append((start - int(cuts[k]), length, period))
    for words, found in zip(texts, by_text, strict=True):
        best = best_run(found)
        stay = words if best is None else [w for w, k in zip(words, kept_words(len(words), found), strict=True) if k]
        facts = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        yield len(found), *facts, sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), sha256(b" ".join(stay)).hexdigest()


def with_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", planted: Column | None = None) -> DataFrame:
    """(doc_id, n_runs, the run that repeats most, digests of all runs and of the text with each run cut to one period).

    planted: a checksum for each row, if repetitions are to be planted by it first; see `repeated`.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"), (F.lit(1) if planted is None else planted).cast("long").alias("h"))
    names = ["doc_id", *(c.split()[0] for c in RESULT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                # bytes split at ASCII white space alone
                texts = [repeated((t or b"").split(), h) for t, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist(), strict=True)]
                columns = list(zip(*_rows(texts), strict=True))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return rows.mapInArrow(run, "doc_id long, " + RESULT)


def op13(docs: DataFrame) -> DataFrame:
    return with_runs(docs, planted=crc32_mod(F.col("doc_id"), 1 << 32))
