"""Packing: hierarchical multi-length packing inside each task.

A document is encoded and cut into full windows of the longest tier; its rest is
routed to the shortest tier that holds it.  From the longest tier down, a window
is opened with a rest, its gap is filled with the largest rests of shorter tiers
that fit, and what still gapes is filled with the head of a shorter rest, whose
tail is routed again.  What is left at the end of a task is laid out in windows
whose lengths are powers of two, so no sequence needs padding.  Windows of a tier
are grouped into steps with equal token counts.

Each task packs its own documents, so nothing is shuffled; sequence ids carry the
task's number in their upper bits.  A task holds the ids of `BUFFER` rests at
most.  Defined cases: a null text is empty and gives the end id alone; a null
doc_id and repeated rows are packed as they come; other columns do not matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsieve.llm.common import small_batches
from feedsieve.llm.tokenize import encoder

TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 1 << 16
BUFFER = 8192
TASK_BITS = 40
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_id long"


class Packer:
    """One task's packing.  A rest is (length, doc_id, start, ids, doc_tokens)."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.first = task << TASK_BITS
        self.sequences = 0
        self.opened = dict.fromkeys(tiers, 0)
        self.steps = 0
        self.step_of: dict[int, int] = {}
        self.rests: dict[int, list[tuple]] = {t: [] for t in tiers}
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        top, n = self.tiers[0], len(ids)
        whole = n - n % top
        for a in range(0, whole, top):
            self._emit([(top, doc_id, a, ids[a : a + top], n)], top)
        if n > whole:
            self._route((n - whole, doc_id, whole, ids[whole:], n))

    def _tier(self, length: int) -> int:
        return min(t for t in self.tiers if t >= length)

    def _route(self, rest: tuple) -> None:
        self.rests[self._tier(rest[0])].append(rest)
        self.held += 1

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        if self.opened[tier] % max(1, self.step_tokens // tier) == 0:
            self.step_of[tier] = self.first + self.steps
            self.steps += 1
        self.opened[tier] += 1
        offset = 0
        for length, doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, length, zlib.crc32(ids.tobytes()), doc_tokens, self.first + self.sequences, offset, tier, self.step_of[tier]))
            offset += length
        self.sequences += 1

    def _put(self, lists: dict[int, tuple[list, list]], rest: tuple) -> None:
        sizes, rests = lists[self._tier(rest[0])]
        at = bisect_right(sizes, rest[0])
        sizes.insert(at, rest[0])
        rests.insert(at, rest)

    def pack(self, last: bool = False) -> None:
        """Fills windows from the rests at hand; those that cannot fill one wait, or are laid out if they are the last."""
        lists = {}
        for t in self.tiers:
            rests = sorted(self.rests[t], key=lambda r: r[0])
            lists[t] = ([r[0] for r in rests], rests)
        waiting: list[tuple] = []
        for k, tier in enumerate(self.tiers):
            sizes, rests = lists[tier]
            while rests:
                sizes.pop()
                window = [rests.pop()]
                gap = tier - window[0][0]
                for t in self.tiers[k:]:
                    s, r = lists[t]
                    while gap and (at := bisect_right(s, gap)):
                        s.pop(at - 1)
                        window.append(r.pop(at - 1))
                        gap -= window[-1][0]
                if gap:  # no whole rest fits: every rest left is longer than the gap, so the shortest one is cut
                    source = next((lists[t] for t in reversed(self.tiers[k:]) if lists[t][1]), None)
                    if source is None:
                        waiting += window
                        continue
                    source[0].pop(0)
                    length, doc_id, start, ids, n = source[1].pop(0)
                    window.append((gap, doc_id, start, ids[:gap], n))
                    self._put(lists, (length - gap, doc_id, start + gap, ids[gap:], n))
                self._emit(window, tier)
        self.rests, self.held = {t: [] for t in self.tiers}, 0
        if not last:
            for rest in waiting:
                self._route(rest)
        else:
            self._lay_out(waiting)

    def _lay_out(self, rests: list[tuple]) -> None:
        left = sum(r[0] for r in rests)
        rests = rests[::-1]
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            left -= size
            window, need = [], size
            while need:
                length, doc_id, start, ids, n = rests.pop()
                take = min(need, length)
                window.append((take, doc_id, start, ids[:take], n))
                if take < length:
                    rests.append((length - take, doc_id, start + take, ids[take:], n))
                need -= take
            self._emit(window, self._tier(size))

    def take(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        cols = list(zip(*self.rows, strict=True)) or [[]] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def pack(docs: DataFrame, path: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path), Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                packer.add(doc_id, np.concatenate((ids, end)))
            if packer.held >= BUFFER:
                packer.pack()
            yield packer.take()
        packer.pack(last=True)
        yield packer.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
