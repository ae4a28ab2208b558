"""Language-model scoring: word counts of the whole corpus, and a gated recurrent network.

Counts.  Each part of the input (a few million characters of one task) gives one row
for each of its distinct words; a window over the words sums the training counts, and
every part gets the counts of its own words back.  Rows grow with the distinct words of
the parts, not with the words of the documents.

Network.  A gated recurrent unit reads the last word and predicts the next one in two
factors: a softmax over classes, then a softmax over the words of the class.  The most
frequent words fill the head classes.  All other words lie in a class for their count's
magnitude, within which a word has its share of the class's training count.  Words
without training count make a class of their own.  Within it, a word has an equal share among as
many unseen words as the counts of rare ones let expect (`unseen_words`), or a little more if its
spelling is likely: each byte given the one before it, by counts over the words that occur once
in a part.  So the probabilities of all words add up to one, if there are no more unseen words.

Training.  Every part trains on all its training documents, each in one of the rounds, by
truncated backpropagation, in windows with the state carried over, from shared weights;
the parts' weights are averaged after each round.  A word's own document is left out of its
count when its class is chosen as a training target, or unknown words would never be seen.
Long documents go through several lanes in segments; a segment begins with the state that
the round's first weights have there.  Scoring carries the state through the whole document.

Words are told apart by 64-bit hashes.  Defined cases: a null text is empty and has its
end token alone; repeated rows count each time; a null doc_id is hashed as an empty text;
without training documents all counts are zero and the network stays as initialised; an
empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsieve.llm.common import checkpoint, crc32_mod, dropped, small_batches, written
from feedsieve.llm.shingles import words

FOLDS, HELD_OUT = 7, 2
PART_CHARS = 12_000_000
END_KEY = 0x656E64
HEAD, WIDTH = 4096, 64
#: Upper ends of the count classes after the unknown class; the last is open.
LEVELS = (1, 2, 3, 5, 8, 16, 32, 64, 256)
TAILS = len(LEVELS) + 2
SUFFIXES = 128
HIDDEN = 16
#: The part of the unknown class that is shared equally; the rest goes by spelling.
EQUAL = 0.9
ROUNDS, LANES, STEPS = 3, 512, 16
#: So many weights are averaged at once.
FAN_IN = 16
SEGMENT = 2048
RATE = 16e-3
LN10 = float(np.log(10))


def spelled_pairs(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring bytes of words as 16-bit numbers, a blank before and after each word; and where each word's pairs begin."""
    data = np.frombuffer(" ".join(["", *names, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    # words hold no blanks, so each blank but the last is before a word
    return data[:-1].astype(np.int64) * 256 + data[1:], np.flatnonzero(data == 32)[:-1]


def spelling_of(counts: np.ndarray) -> np.ndarray:
    """Log10 probability of each byte after each other one, from counts of pairs; a blank ends a word and does not follow a blank."""
    n = counts.reshape(256, 256).astype(np.float64) + 0.1
    n[32, 32] = 0
    with np.errstate(divide="ignore"):
        return np.log10(n / n.sum(1, keepdims=True))


def spelled(spelling: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Log10 probability of each word, byte by byte to its end."""
    if not len(names):
        return np.zeros(0)
    pairs, begins = spelled_pairs(names)
    return np.add.reduceat(spelling.ravel()[pairs], begins)


def unseen_words(once: float, twice: float) -> float:
    """How many words the corpus has not shown, by those that it has shown once and twice (Chao's lower bound); one at least."""
    return max(1.0, once * once / (2 * twice) if twice else once * max(0.0, once - 1) / 2)


def unknown(spelling: np.ndarray, names: np.ndarray, unseen: float) -> np.ndarray:
    """Log10 probability of each unknown word within its class."""
    return np.logaddexp(np.log(EQUAL / unseen), np.log1p(-EQUAL) + spelled(spelling, names) * LN10) / LN10


def word_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the distinct words, codes of all words, bounds of the texts, the distinct words)."""
    array, cuts = words(texts)
    coded = array.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    keys = pd.util.hash_array(names, categorize=False).view(np.int64) if len(names) else np.zeros(0, np.int64)
    return keys, coded.indices.to_numpy(zero_copy_only=False), cuts, names


def suffix_classes(names: np.ndarray) -> np.ndarray:
    """The class of each word's last two characters; each pair of these is hashed once."""
    ends = [w[-2:] for w in names]
    of = {x: zlib.crc32(x.encode("utf-8", "surrogatepass")) % SUFFIXES for x in set(ends)}
    return np.fromiter(map(of.__getitem__, ends), np.int64, len(ends))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches with the number of their part: a task's rows in order, cut after PART_CHARS characters."""
    part, size = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        yield part, batch
        size += batch.column("text").nbytes
        if size >= PART_CHARS:
            part, size = part + 1, 0


def in_parts(rows: DataFrame) -> DataFrame:
    """The rows with their parts, written once, as a later scan of the input may be cut elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int64()), *batch.columns], ["part", *batch.schema.names])

    return written(rows.mapInArrow(run, "part long, doc_id long, held_out boolean, text string"), "parts")


def part_words(placed: DataFrame) -> DataFrame:
    """(part, piece, word, n): training count of each distinct word of each part; the end token is a word.

    A part that is read in several tasks or stretches gives its words once in each of these pieces.
    Part -1 has the pairs of bytes (as words) in training words that occur once in a piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, names = None, [], [], []
        piece = TaskContext.get().partitionId() << 24

        def rows(part, word, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), part)), pa.array(np.full(len(word), piece)), pa.array(word), pa.array(n.astype(np.int64))], ["part", "piece", "word", "n"])

        def out():
            unique, at, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            n = np.bincount(where, np.concatenate(counts)).astype(np.int64)
            once = at[(n == 1) & (unique != END_KEY)]
            pairs = np.bincount(spelled_pairs(np.concatenate(names)[once])[0], minlength=1 << 16) if len(once) else np.zeros(1 << 16, np.int64)
            yield rows(now, unique, n)
            yield rows(-1, np.flatnonzero(pairs), pairs[pairs > 0])

        for part, batch in ((p, b.filter(pc.equal(b.column("part"), p))) for b in batches for p in pc.unique(b.column("part")).to_pylist()):
            if part != now and keys:
                yield from out()
                keys, counts, names, piece = [], [], [], piece + 1
            now = part
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            k, codes, cuts, w = word_keys(batch.column("text").to_pylist())
            n = np.bincount(codes, np.repeat(train, np.diff(cuts)), minlength=len(k)) if len(k) else np.zeros(0)
            keys += [k, np.array([END_KEY])]
            counts += [n, np.array([train.sum()])]
            names += [w, np.array([""], object)]
        if keys:
            yield from out()

    return placed.mapInArrow(run, "part long, piece long, word long, n long")


def level(c: np.ndarray) -> np.ndarray:
    """Tail class of a count: 0 for none."""
    return np.where(c <= 0, 0, 1 + np.searchsorted(LEVELS, c, "left"))


@dataclass
class Corpus:
    """What the whole corpus tells: totals, the head words by rank, and the count mass of each tail class."""

    tokens: int
    distinct: int
    head: np.ndarray
    head_counts: np.ndarray
    mass: np.ndarray
    kinds: np.ndarray
    spelling: np.ndarray
    #: One at least; tests and callers that do not score unknown words leave it out.
    unseen: float = 1.0

    @property
    def slots(self) -> int:
        return len(self.head)

    @property
    def classes(self) -> int:
        return -(-HEAD // WIDTH) + TAILS

    @property
    def codes(self) -> int:
        return HEAD + TAILS * SUFFIXES


def corpus_of(counts: DataFrame) -> Corpus:
    own = counts.where("part >= 0 and first and c > 0")
    pairs = np.zeros(1 << 16)
    for r in counts.where("part = -1 and first").select("word", "c").collect():
        pairs[r["word"]] = r["c"]
    top = own.orderBy(F.desc("c"), "word").limit(HEAD).select("word", "c").toPandas()
    tail = sum(((F.col("c") > x).cast("int") for x in LEVELS), F.lit(1))
    mass, kinds = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in own.groupBy(tail.alias("k")).agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("n")).collect():
        mass[r["k"]], kinds[r["k"]] = r["m"], r["n"]
    tokens, distinct, unseen = int(mass.sum()), int(kinds.sum()), unseen_words(float(kinds[1]), float(kinds[2]))
    c = top["c"].to_numpy(np.int64)
    np.subtract.at(mass, level(c), c)
    np.subtract.at(kinds, level(c), 1)
    return Corpus(tokens, distinct, top["word"].to_numpy(np.int64), c, mass, kinds, spelling_of(pairs), unseen)


CODED = "part long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, tail double, codes binary, targets binary, turn int"


def encode(placed: DataFrame, counts: DataFrame, corpus: Corpus) -> DataFrame:
    """Each document as 16-bit codes, with its base score and the fixed factor of its tail words."""
    order = np.argsort(corpus.head)
    head, rank = corpus.head[order], np.arange(len(order))[order]
    norm = float(corpus.tokens + corpus.distinct + 1)
    spelling, unseen = corpus.spelling, corpus.unseen

    def run(docs, table):
        known, by = np.unique(table["word"].to_numpy(), return_index=True)
        count = table["c"].to_numpy()[by]

        def facts(keys):
            # looked up in ascending order, as neighbours are then at hand
            order, place = np.argsort(keys), np.empty(len(keys), np.int64)
            place[order] = np.searchsorted(known, keys[order])
            c = count[place]
            at = np.minimum(np.searchsorted(head, keys), max(0, len(head) - 1))
            is_head = head[at] == keys if len(head) else np.zeros(len(keys), bool)
            return c, np.where(is_head, rank[at] if len(head) else 0, -1)

        end_c, end_rank = (x[0] for x in facts(np.array([END_KEY])))
        out: list[list] = [[] for _ in range(8)]
        for begin in range(0, docs.num_rows, 500):
            some = docs.slice(begin, 500)
            keys, codes, cuts, names = word_keys(some["text"].to_pylist())
            c, r = facts(keys)
            suffix = np.zeros(len(keys), np.int64)
            suffix[r < 0] = suffix_classes(names[r < 0])
            base = np.log10((c + 1) / norm)
            tail = np.where(r >= 0, 0.0, np.log10(np.maximum(c, 1) / np.maximum(corpus.mass[level(c)], 1)))
            tail[c <= 0] = unknown(spelling, names[c <= 0], unseen)
            code = np.where(r >= 0, r, HEAD + level(c) * SUFFIXES + suffix).astype("<u2")
            less = np.where(r >= 0, r, HEAD + level(c - 1) * SUFFIXES + suffix).astype("<u2")
            end_code = end_rank if end_rank >= 0 else HEAD + int(level(np.array([end_c]))[0]) * SUFFIXES
            for i, (d, h) in enumerate(zip(some["doc_id"].to_pylist(), some["held_out"].to_pylist(), strict=True)):
                w = codes[cuts[i] : cuts[i + 1]]
                end = np.array([end_code], "<u2")
                end_tail = 0.0 if end_rank >= 0 or end_c <= 0 else float(np.log10(end_c / max(corpus.mass[level(np.array([end_c]))[0]], 1)))
                row = (d, h, len(w) + 1, int((c[w] > 0).sum()) + int(end_c > 0), float(base[w].sum() + np.log10((end_c + 1) / norm)), float(tail[w].sum()) + end_tail, np.append(code[w], end).tobytes(), b"" if h else np.append(less[w], end).tobytes())
                for o, v in zip(out, row, strict=True):
                    o.append(v)
        # every training document has its turn in one round; copies stand side by side and are dealt over the rounds
        turn = [-1] * len(out[0])
        for k, i in enumerate(sorted((i for i, h in enumerate(out[1]) if not h), key=lambda i: zlib.crc32(out[7][i]))):
            turn[i] = k % ROUNDS
        out.append(turn)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int32())
        part = docs["part"][0].as_py() if docs.num_rows else 0
        return pa.Table.from_arrays([pa.array([part] * len(out[0]), pa.int64()), *[pa.array(o, k) for o, k in zip(out, kinds, strict=True)]], [x.split()[0] for x in CODED.split(", ")])

    return placed.groupBy("part").cogroup(counts.where("part >= 0").select("part", "word", "c").groupBy("part")).applyInArrow(run, CODED)


def start_weights(corpus: Corpus, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = lambda *s, k=0.1: (rng.standard_normal(s) * k).astype(np.float32)
    heads = HEAD // WIDTH
    masses = np.zeros(corpus.classes)
    c = np.zeros(HEAD)
    c[: corpus.slots] = corpus.head_counts
    masses[:heads] = c.reshape(heads, WIDTH).sum(1)
    masses[heads] = corpus.kinds[1]
    masses[heads + 1 :] = corpus.mass[1:]
    bias = np.log((masses + 1) / (masses + 1).sum())
    word = np.where(c > 0, np.log(np.maximum(c, 1)), -30.0)  # a slot without a word takes no probability
    return {"x": n(corpus.codes + 1, 3 * HIDDEN), "u": n(HIDDEN, 3 * HIDDEN, k=HIDDEN**-0.5), "wc": n(HIDDEN, corpus.classes, k=0.05), "bc": bias.astype(np.float32), "v": n(heads, HIDDEN, WIDTH, k=0.05), "bv": (word.reshape(heads, WIDTH) - word.reshape(heads, WIDTH).max(1, keepdims=True)).astype(np.float32)}


def _biased(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Output weights of the classes and of the words in them, with the biases as a last row."""
    return np.concatenate((w["wc"], w["bc"][None])), np.concatenate((w["v"], w["bv"][:, None]), axis=1)


def _with_one(h: np.ndarray) -> np.ndarray:
    """The states, one a row, with a last column of ones for the biases."""
    out = np.ones((*h.shape[:-1], HIDDEN + 1), h.dtype)
    out[..., :HIDDEN] = h
    return out.reshape(-1, HIDDEN + 1)


def _wide(weights: np.ndarray) -> bool:
    """Whether logits may come near the range of single precision.  States lie between -1 and 1, so the weights bound them."""
    return bool(np.abs(weights).sum(-2).max() > 60)


def _exponentials(z: np.ndarray, goal: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Turns logits into exponentials in place, each row's up to a factor; the rows' sums, and the log probability of each row's goal."""
    if wide:
        z -= z.max(-1, keepdims=True)
    aim = z[np.arange(len(goal)), goal]
    sums = np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype)
    return sums, aim - np.log(sums)


#: The class of each code.
CLASSES = np.concatenate((np.arange(HEAD) // WIDTH, HEAD // WIDTH + np.arange(TAILS * SUFFIXES) // SUFFIXES)).astype(np.uint16)


def class_of(codes: np.ndarray) -> np.ndarray:
    return CLASSES[codes]


def lanes_of(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Documents laid in lanes, longest first on the shortest lane: codes, first-word flags, used flags, and the documents of each lane."""
    import heapq

    heap = [(0, k) for k in range(lanes)]
    held: list[list[int]] = [[] for _ in range(lanes)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (size + len(docs[i]), k))
    steps = max((s for s, _ in heap), default=0)
    codes, first, used = np.zeros((steps, lanes), np.int32), np.zeros((steps, lanes), bool), np.zeros((steps, lanes), bool)
    for k, own in enumerate(held):
        at = 0
        for i in own:
            n = len(docs[i])
            codes[at : at + n, k], first[at, k], used[at : at + n, k] = docs[i], True, True
            at += n
    return codes, first, used, held


def _inputs(codes: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The word before each word; a document begins with a sign of its own."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[0] = start
    before[first] = start
    return before


def states(w: dict, inputs: np.ndarray, first: np.ndarray, h: np.ndarray, keep: list | None = None, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hidden states of a window, and the last one.  Where `first` is set the state is new: zero, or the next row of `begin`, in the order of steps and lanes.

    The lanes of a unit lie side by side, so a gate of all lanes is in one piece.  Both gates and the
    tanh are worked out of one kind of exponential: 1 / (1 + exp(-a)), and twice that of 2a, less one.
    """
    kind, gates = w["u"].dtype, 2 * HIDDEN
    signs = np.repeat(np.array([-1, -1, -2], kind), HIDDEN)
    u = np.ascontiguousarray((w["u"] * signs).T)
    x = np.empty((len(inputs), 3 * HIDDEN, len(h)), kind)
    np.multiply(np.take(w["x"], inputs, axis=0).transpose(0, 2, 1), signs[:, None], out=x)
    out = np.empty((len(inputs), HIDDEN, len(h)), kind)
    before, inner = (np.empty_like(out) for _ in range(2)) if keep is not None else (None, None)
    g = np.empty((3 * HIDDEN, len(h)), kind)
    h, at = np.ascontiguousarray(h.T, kind), 0
    with np.errstate(over="ignore"):  # a gate of zero
        for t, new in enumerate(first.any(1).tolist()):
            if new:
                h = h * ~first[t]
                if begin is not None:
                    n = int(first[t].sum())
                    h[:, first[t]] = begin[at : at + n].T
                    at += n
            np.matmul(u, h, out=g)
            if keep is not None:
                before[t], inner[t] = h, g[gates:]
            zr, n = x[t, :gates], x[t, gates:]
            zr += g[:gates]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            g[gates:] *= zr[HIDDEN:]
            n += g[gates:]
            np.exp(n, out=n)
            n += 1
            np.divide(2, n, out=n)
            n -= 1
            h = np.subtract(h, n, out=out[t])
            h *= zr[:HIDDEN]
            h += n
    if keep is not None:
        inner *= kind.type(-0.5)
        keep += [before, x, inner]
    return out.transpose(0, 2, 1), h.T


def _by_class(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The places of head words in order of their class, and each class that occurs with the bounds of its places."""
    order = np.argsort(kind.astype(np.uint16, copy=False), kind="stable")  # numbers of 16 bits are sorted without comparisons
    ends = np.searchsorted(kind[order], np.arange(HEAD // WIDTH + 1)).tolist()
    return order[: ends[-1]], [(k, a, b) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]


def log_probs(w: dict, h: np.ndarray, codes: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Natural log probability of each word's class and, for head words, of the word in it; so many rows at once as a core's cache holds."""
    kind, flat, (wc, v) = class_of(codes), _with_one(h), _biased(w)
    out, wide = np.empty(len(codes)), _wide(wc)
    for a in range(0, len(codes), rows):
        out[a : a + rows] = _exponentials(flat[a : a + rows] @ wc, kind[a : a + rows], wide)[1]
    order, spans = _by_class(kind)
    own, goal, inner, wide = flat[order], codes[order] % WIDTH, np.empty(len(order)), _wide(v)
    for k, begin, end in spans:
        for a in range(begin, end, rows):
            s = slice(a, min(end, a + rows))
            inner[s] = _exponentials(own[s] @ v[k], goal[s], wide)[1]
    out[order] += inner
    return out


def gradients(w: dict, inputs: np.ndarray, first: np.ndarray, used: np.ndarray, targets: np.ndarray, h0: np.ndarray, begin: np.ndarray | None = None) -> tuple[dict, np.ndarray, np.ndarray, float]:
    """Gradients of the mean negative log probability over one window, the input rows that `x` has them for, the last state, and that mean."""
    kept: list = []
    hs, last = states(w, inputs, first, h0, kept, begin)
    before, gates, inner = kept
    flat, goal, use = _with_one(hs), targets.ravel(), used.ravel()
    kind, total, (wc, v), number = class_of(goal), max(1, int(use.sum())), _biased(w), w["u"].dtype
    grad = {k: np.zeros_like(w[k]) for k in ("v", "bv")}
    # exponentials less the sum at the goal are the errors of a row times its sum, which narrow matrices are divided by instead
    d = flat @ wc
    sums, found = _exponentials(d, kind, _wide(wc))
    loss = -float(found[use].sum(dtype=np.float64))
    d[np.arange(len(goal)), kind] -= sums
    weight = (use / total / sums).astype(number)[:, None]
    both = d.T @ (flat * weight)
    grad["wc"], grad["bc"] = np.ascontiguousarray(both[:, :HIDDEN].T), both[:, HIDDEN].copy()
    dh = (d @ w["wc"].T) * weight
    order, spans = _by_class(np.where(use, kind, HEAD // WIDTH))
    own, goal = flat[order], goal[order] % WIDTH
    d, back = np.empty((len(order), WIDTH), number), np.empty((len(order), HIDDEN), number)
    for k, a, b in spans:
        np.matmul(own[a:b], v[k], out=d[a:b])
    sums, found = _exponentials(d, goal, _wide(v))
    loss -= float(found.sum(dtype=np.float64))
    d[np.arange(len(goal)), goal] -= sums
    weight = (1 / total / sums).astype(number)[:, None]
    own *= weight
    for k, a, b in spans:
        both = own[a:b].T @ d[a:b]
        grad["v"][k], grad["bv"][k] = both[:HIDDEN], both[HIDDEN]
        np.matmul(d[a:b], w["v"][k].T, out=back[a:b])
    back *= weight
    dh[order] += back
    dh = np.ascontiguousarray(dh.reshape(hs.shape).transpose(0, 2, 1))
    z, r, n = (gates[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
    # what a state's error is multiplied by for each gate
    to_n = (1 - z) * (1 - n * n)
    to_z = (before - n) * (z * (1 - z))
    to_r = inner * (r * (1 - r))
    # side by side: errors of the candidate's recurrent part, of both gates, and of the candidate
    e = np.empty((len(inputs), 4 * HIDDEN, len(h0)), number)
    du, dz, dr, dn = (e[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
    u = np.ascontiguousarray(np.roll(w["u"], HIDDEN, axis=1))
    carry = np.zeros((HIDDEN, len(h0)), number)
    for t, new in zip(range(len(inputs) - 1, -1, -1), first.any(1).tolist()[::-1], strict=True):
        carry += dh[t]
        np.multiply(carry, to_n[t], out=dn[t])
        np.multiply(carry, to_z[t], out=dz[t])
        np.multiply(dn[t], to_r[t], out=dr[t])
        np.multiply(dn[t], r[t], out=du[t])
        carry *= z[t]
        carry += u @ e[t, : 3 * HIDDEN]
        if new:
            carry *= ~first[t]
    grad["u"] = np.roll((before @ e[:, : 3 * HIDDEN].transpose(0, 2, 1)).sum(0), -HIDDEN, axis=1)
    # each input word's errors, summed for one unit's gate after the other
    here = np.zeros(len(w["x"]), bool)
    here[inputs] = True
    rows, which = np.flatnonzero(here), (np.cumsum(here) - 1)[inputs.ravel()]
    grad["x"] = np.empty((len(rows), 3 * HIDDEN), number)
    for k in range(3 * HIDDEN):
        grad["x"][:, k] = np.bincount(which, e[:, HIDDEN + k].ravel(), len(rows))
    return grad, rows, last, loss / total


def boundary_states(w: dict, inputs: list[np.ndarray], size: int = SEGMENT, lanes: int = 256) -> list[np.ndarray]:
    """The state of each document before every `size`-th word, the state carried through it from its beginning."""
    out = [np.zeros((-(-len(x) // size), HIDDEN), np.float32) for x in inputs]
    order = sorted((i for i in range(len(inputs)) if len(inputs[i]) > size), key=lambda i: -len(inputs[i]))
    for begin in range(0, len(order), lanes):
        some = order[begin : begin + lanes]
        h = np.zeros((len(some), HIDDEN), np.float32)
        for k in range(1, -(-len(inputs[some[0]]) // size)):
            live = [i for i in some if len(inputs[i]) > k * size]
            h = h[: len(live)]
            words = np.stack([inputs[i][(k - 1) * size : k * size] for i in live], axis=1)
            for a in range(0, size, 64):
                _, h = states(w, words[a : a + 64], np.zeros(words[a : a + 64].shape, bool), h)
            for j, i in enumerate(live):
                out[i][k] = h[j]
    return out


def train_part(w: dict, docs: list[np.ndarray], goals: list[np.ndarray], rate: float = RATE) -> dict:
    """One pass of truncated backpropagation with Adam over some documents, all of each.

    Long documents are cut into segments, or a few of them would run on in lanes of their own.  A
    segment begins with the state that its document has there under the weights that the pass
    began with, so no state is lost at a cut.
    """
    w = {k: v.copy() for k, v in w.items()}
    start = len(w["x"]) - 1
    before = [np.concatenate((np.array([start]), d[:-1])) for d in docs]
    carried = boundary_states(w, before)
    cuts = [(i, a) for i, d in enumerate(docs) for a in range(0, len(d), SEGMENT)]
    words, aims = ([many[i][a : a + SEGMENT] for i, a in cuts] for many in (before, goals))
    tokens = sum(map(len, words))
    lanes = min(LANES, max(16, tokens // (128 * STEPS)), max(1, len(words)))
    inputs, first, used, held = lanes_of(words, lanes)
    targets = np.zeros_like(inputs)
    place: dict[tuple[int, int], np.ndarray] = {}
    for k, own in enumerate(held):
        at = 0
        for j in own:
            targets[at : at + len(aims[j]), k] = aims[j]
            i, a = cuts[j]
            place[at, k] = carried[i][a // SEGMENT]
            at += len(aims[j])
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    h = np.zeros((lanes, HIDDEN), np.float32)
    for t, a in enumerate(range(0, len(inputs), STEPS), 1):
        s = slice(a, a + STEPS)
        live = used[s].any(0)
        at, of = np.nonzero(first[s])
        begin = np.stack([place[a + x, y] for x, y in zip(at.tolist(), of.tolist(), strict=True)]) if len(at) else None
        grad, rows, last, _ = gradients(w, inputs[s][:, live], first[s][:, live], used[s][:, live], targets[s][:, live], h[live], begin)
        h[live] = last
        scale = min(1.0, 1.0 / (float(np.sqrt(sum(np.vdot(g, g) for g in grad.values()))) + 1e-9))
        step, unbias = rate / (1 - 0.9**t), 1 / (1 - 0.99**t)
        for k, g in grad.items():
            at = rows if k == "x" else slice(None)  # words that did not occur are left alone
            mk, vk = m[k][at], v[k][at]
            g *= scale
            mk *= 0.9
            mk += 0.1 * g
            g *= g
            g *= 0.01
            vk *= 0.99
            vk += g
            np.multiply(vk, unbias, out=g)
            np.sqrt(g, out=g)
            g += 1e-8
            np.divide(mk, g, out=g)
            g *= step
            w[k][at] -= g
            if k == "x":
                m[k][at], v[k][at] = mk, vk
    return w


def _packed(w: dict) -> bytes:
    return b"".join(v.astype("<f4").tobytes() for v in w.values())


def _unpacked(raw: bytes, like: dict) -> dict:
    flat, at, out = np.frombuffer(raw, "<f4"), 0, {}
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).copy()
        at += v.size
    return out


def train(coded: DataFrame, corpus: Corpus, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Rounds of training in every part, each on the documents whose turn it is, with averaged weights after each."""
    spark = coded.sparkSession
    w = start_weights(corpus)
    like = {k: np.zeros(v.shape, np.float32) for k, v in w.items()}
    parts = max(1, coded.rdd.getNumPartitions())
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(_packed(w))
        rate = RATE / (1 + r)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a part's rows lie side by side, as they were written group by group
            total, n = None, 0.0
            for _, rows in groupby((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda row: row[0]):
                codes, targets = ([np.frombuffer(x, "<u2").astype(np.int32) for x in c] for c in list(zip(*rows, strict=True))[1:])
                size = float(sum(map(len, codes)))
                new = np.frombuffer(_packed(train_part(_unpacked(shared.value, like), codes, targets, rate)), "<f4").astype(np.float64) * size
                total, n = new if total is None else total + new, n + size
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], ["task", "n", "w"])

        def mean(rows: pa.Table) -> pa.Table:
            n = rows.column("n").to_numpy()
            total = sum(np.frombuffer(raw, "<f4") * np.float32(k / n.sum()) for k, raw in zip(n.tolist(), rows.column("w").to_pylist(), strict=True))
            return pa.table({"task": pa.array([rows.column("task")[0].as_py() // FAN_IN], pa.int64()), "n": [n.sum()], "w": pa.array([total.astype("<f4").tobytes()], pa.binary())})

        means = coded.where(F.col("turn") == r).select("part", "codes", "targets").mapInArrow(learn, "task long, n double, w binary")
        # tasks' weights meet in a tree, so neither a task nor the driver reads more than FAN_IN of them at once
        left = parts
        while left > 1:
            means = means.groupBy(F.floor(F.col("task") / FAN_IN)).applyInArrow(mean, "task long, n double, w binary")
            left = -(-left // FAN_IN)
        found = means.collect()
        shared.destroy()
        if found:
            n = sum(x["n"] for x in found)
            w = _unpacked(sum(np.frombuffer(x["w"], "<f4").astype(np.float64) * (x["n"] / n) for x in found).astype("<f4").tobytes(), like)
    return w


def document_scores(w: dict, docs: list[np.ndarray], lanes: int = 384, window: int = 128) -> np.ndarray:
    """Natural log probability of whole documents (tail words: of their class), state carried from window to window."""
    lanes = max(1, min(lanes, len(docs)))
    codes, first, used, held = lanes_of(docs, lanes)
    inputs = _inputs(codes, first, len(w["x"]) - 1)
    found = np.zeros(codes.shape, np.float32)
    h = np.zeros((lanes, HIDDEN), np.float32)
    for a in range(0, len(codes), window):
        s = slice(a, a + window)
        live = used[s].any(0)
        out = np.zeros(codes[s].shape, np.float32)
        hs, last = states(w, inputs[s][:, live], first[s][:, live], h[live])
        out[:, live] = log_probs(w, hs, codes[s][:, live].ravel()).reshape(hs.shape[:2])
        found[s] = out
        h[live] = last
    result = np.zeros(len(docs))
    for k, own in enumerate(held):
        at = 0
        for i in own:
            result[i] = found[at : at + len(docs[i]), k].sum(dtype=np.float64)
            at += len(docs[i])
    return result


def encoded(docs: DataFrame) -> tuple[Corpus, DataFrame]:
    """What the whole corpus tells, and all documents as codes."""
    small_batches(docs.sparkSession)
    placed = in_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    pieces = written(part_words(placed), "words")
    # summed before they meet, as a common word has a row in every piece; the join back splits such a word's rows
    totals = pieces.groupBy("word").agg(F.sum("n").alias("c"), F.min("piece").alias("least"))
    counts = checkpoint(pieces.join(totals, "word").select("part", "word", "c", (F.col("least") == F.col("piece")).alias("first")))
    dropped(pieces)
    corpus = corpus_of(counts)
    coded = checkpoint(encode(placed, counts, corpus))
    dropped(placed)
    return corpus, coded


def score(docs: DataFrame) -> DataFrame:
    """Counts, base score and the network's score of every document."""
    spark = docs.sparkSession
    corpus, coded = encoded(docs)
    weights = spark.sparkContext.broadcast(_packed(train(coded, corpus)))
    like = {k: np.zeros(v.shape, np.float32) for k, v in start_weights(corpus).items()}
    tokens = corpus.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _unpacked(weights.value, like)
        # codes are small, and many documents at once fill the lanes beside long ones
        for batch in _gathered(batches, 4000):
            s = document_scores(w, [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column("codes").to_pylist()])
            total = s / LN10 + batch.column("tail").to_numpy()
            cols = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([tokens] * batch.num_rows, pa.int64()), batch.column("base_score"), pa.array(total)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    found = coded.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "tail", "codes")
    return found.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about so many rows, or fewer if these are large."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def op7(docs: DataFrame) -> DataFrame:
    return score(docs)
