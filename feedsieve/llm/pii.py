"""Personal data: fixed patterns, and a skip-chain conditional random field.

The patterns give the base spans, which always stay.  The field finds what patterns miss:
entities broken by blanks or other signs, whole ones that a pattern swallows with the digits
after them and then fails, and repeats of an entity in another form.  Its
nodes are the tokens that hold a digit or an at sign, or stand beside a lone at sign.
Nodes carry shape features; chain edges join neighbouring tokens; skip edges join a token
with earlier ones that are equal or share most of the four-digit windows of the shorter
one.  A window points at its last occurrence only, so edges grow with the tokens' digits,
never with their pairs.  Tokens under a base span are known and clamped, and loopy message
passing carries their labels along both kinds of edges through each document.

A fifth label, `secret`, is for keys beside a word that names one (`SECRET`); the field
finds their repeats without that word.  Secrets have columns of their own.

Weights are trained here by pseudo-likelihood, on about `TRAIN_DOCS` distinct texts drawn
by a hash (a parameter of `fit`).  As the patterns name all that they can see, each training
text gets copies of some of its entities, broken so that no pattern matches, in random
places; the field learns to label these from the clamped tokens, and to leave the rest of
the numbers alone.

Defined cases: a null text is empty; repeated rows are scanned row by row; a null
doc_id stays null; an empty table gives no rows, and the field then adds nothing; texts
may be of any length; other columns, whatever their names, are kept by `redact`.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsieve.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Matches begin at the first digit of a run, where the plain pattern also begins; the look-behind keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile("[0-9@]")
#: A word that names a secret, and the secret after it.
SECRET = re.compile(r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_-]{20,})")
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*|[^\x20\x09-\x0D0-9@]+(?=[\x20\x09]{1,3}@[\x20\x09])|(?<=@[\x20\x09])[^\x20\x09-\x0D0-9@]+)")
EDGES = ".,;:!?\"'()[]{}<>#*$%&|"
LABELS = ("none", *KINDS, "secret")
TRAIN_DOCS = 3000
SURE = 0.9
ROUNDS = 12
#: Neighbours lie at most so many signs apart.
NEAR = 3
WINDOW = 4
#: Broken copies for each training text that has an entity.
COPIES = 6
#: The share of card and phone copies that are whole and swallowed.
SWALLOWED = 0.5
#: Tokens that one training text gives at most.
TRAIN_TOKENS = 200
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, secrets string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    if "@" in text:
        done = 0
        for m in AT.finditer(text):
            a = m.start()
            while a > done and text[a - 1] in LOCAL:
                a -= 1
            if a < m.start():
                out.append((0, a, m.end()))
                done = m.end()
    for m in IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{LABELS[k + 1]}:{a}:{b}" for k, a, b in sorted(spans))


@dataclass
class Tokens:
    """Tokens of one document: core spans, features, and edges between their numbers."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


#: Digits in a token are told apart by these upper ends.
DIGITS = (0, 1, 2, 3, 4, 6, 8, 11, 15, 19)
N_FEATURES = 43


def _shape(raw: str, core: str, digits: str) -> list:
    n = len(digits)
    size = [0] * (len(DIGITS) + 1)
    size[next((i for i, d in enumerate(DIGITS) if n <= d), len(DIGITS))] = 1
    parts = re.split("[^0-9]+", core) if n else []
    inner = [len(p) for p in parts if p]
    letters = sum(c.isalpha() for c in core)
    signs = {c for c in core if not c.isalnum()}
    hexes = letters + n == len(core) and letters > 0 and n > 0 and all(c in "0123456789abcdefABCDEF" for c in core)
    return [
        1, *size, "@" in raw, core == "@", "@" in core and "." in core.rpartition("@")[2], "." in core, "-" in signs, bool(signs & set("/_,:;|")), "[" in core, "(" in raw, ")" in raw, "+" in raw, letters > 0, n == len(core) > 0,
        len(inner) == 1, len(inner) == 2, len(inner) == 3, len(inner) == 4, len(inner) > 4, len(inner) == 4 and all(x == 4 for x in inner), len(inner) == 4 and all(x <= 3 for x in inner) and all(int(p) <= 255 for p in parts if p), bool(inner) and inner[-1] == 4 and len(inner) in (2, 3, 4) and max(inner) <= 4 and 7 <= n <= 13,
        16 <= n <= 19 and luhn(digits), 16 <= n <= 19 and not luhn(digits), hexes and len(core) >= 20, letters + n >= 20 and letters > 0 and n > 2, n == 0 and "." in core,
    ]


def tokens_of(text: str) -> Tokens:
    spans, rows, chain, skip = [], [], [], []
    last_of: dict[str, int] = {}
    digits_of: list[int] = []
    last_end = -9
    for m in TOKEN.finditer(text):
        raw = m[0]
        core = raw.strip(EDGES)
        if not core:
            continue
        i = len(spans)
        a = m.start() + len(raw) - len(raw.lstrip(EDGES))
        digits = "".join(c for c in core if "0" <= c <= "9")
        shape = _shape(raw, core, digits)
        near = m.start() - last_end <= NEAR
        if near and rows:
            chain.append((i - 1, i))
        # the features of the tokens on both sides, as far as they are near: number of digits, at sign, all digits
        rows.append(shape + [near, 0, 0, 0, 0, 0])
        if near and i:
            rows[i][-4], rows[i][-3] = rows[i - 1][1 + 4] or rows[i - 1][1 + 3], rows[i - 1][12] or rows[i - 1][13]
            rows[i - 1][-5], rows[i - 1][-2], rows[i - 1][-1] = 1, shape[1 + 4] or shape[1 + 3], shape[12] or shape[13]
        found: dict[int, int] = {}
        windows = max(1, len(digits) - WINDOW + 1)
        if len(digits) >= WINDOW:
            for k in {digits[x : x + WINDOW] for x in range(len(digits) - WINDOW + 1)}:
                if (j := last_of.get(k)) is not None:
                    found[j] = found.get(j, 0) + 1
                last_of[k] = i
        same = last_of.get(f"={core.lower()}")
        last_of[f"={core.lower()}"] = i
        skip += [(j, i) for j, n in found.items() if j != same and 5 * n >= 3 * min(windows, digits_of[j])]
        if same is not None:
            skip.append((same, i))
        digits_of.append(windows)
        spans.append((a, a + len(core)))
        last_end = m.end()
    return Tokens(spans, np.array(rows, np.float32).reshape(-1, N_FEATURES), chain, skip)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(label's number less one, start, end) of secrets beside a word that names them."""
    return [(len(KINDS), *m.span(1)) for m in SECRET.finditer(text)]


def token_labels(tokens: Tokens, base: list[tuple[int, int, int]]) -> np.ndarray:
    """0 outside known spans, else the kind's number plus one; tokens and spans both lie in order of their places."""
    out = np.zeros(len(tokens.spans), np.int64)
    starts = [a for a, _ in tokens.spans]
    for k, a, b in base:
        i = max(0, bisect_right(starts, a) - 1)
        while i < len(starts) and starts[i] < b:
            if tokens.spans[i][1] > a and not out[i]:
                out[i] = k + 1
            i += 1
    return out


def broken(kind: int, entity: str, draw: random.Random) -> str:
    """An entity in a form that the patterns do not match."""
    digits = re.sub("[^0-9]", "", entity)
    if kind == 0:
        return draw.choice((entity.replace("@", " @ "), entity.replace("@", "@ "), entity.replace("@", " @")))
    if kind == 1:
        return draw.choice(("[.]", " . ", ",", "-", ". ")).join(entity.split("."))
    if kind == 2:
        return draw.choice((".", "  ", "/", "_", " - ")).join(digits[x : x + 4] for x in range(0, len(digits), 4))
    if kind == 3:
        head, area, rest = digits[:-10], digits[-10:-7], digits[-7:]
        last = f"{rest[:3]}-{rest[3:]}" if len(rest) == 7 else rest
        return draw.choice((f"{head} ({area}) {last}", f"({area}) {last}", f"{area}-{last}", f"{area}/{last}", f"{head}/{area}/{last}"))
    return draw.choice((entity, f"({entity})", f"{entity},"))


def swallowed(kind: int, entity: str, draw: random.Random) -> str:
    """What follows a card or phone number so that the pattern, which takes all it can, ends with too many digits and fails."""
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    if kind == 3:
        ip = ".".join(str(draw.randrange(256)) for _ in range(4))
        return " " + draw.choice((ip, ip, f"20{number(2)}-0{draw.randint(1, 9)}-{draw.randint(10, 28)}", number(draw.randint(6, 10))))
    return draw.choice((" ", "-")) + number(draw.randint(4, 8))


def with_broken_copies(text: str, copies: int = COPIES) -> tuple[str, list[tuple[int, int, int]]]:
    """A training text with broken copies of some of its entities, and where these lie.

    A copy goes between two words, or instead of its entity, so that also broken entities without
    a clear one are seen.  Some copies of card and phone numbers are whole, but stand before digits
    that the pattern takes too.  Drawn by the text alone.
    """
    draw = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    known = base_spans(text) + secret_spans(text)
    edits: list[tuple[int, int, int, str, str]] = []
    gaps = [m.start() for m in re.finditer(" ", text)] or [len(text)]
    for k, a, b in draw.choices(known, k=copies) if known else ():
        whole = k in (2, 3) and draw.random() < SWALLOWED
        entity, tail = (text[a:b], swallowed(k, text[a:b], draw)) if whole else (broken(k, text[a:b], draw), "")
        at = draw.choice(gaps)
        if k < len(KINDS) and draw.random() < 0.15:
            edits.append((a, b, k, entity, tail))
        elif not any(x <= at < y for _, x, y in known):
            edits.append((at, at, k, f" {entity}", tail))
    out, at, lies = [], 0, []
    size = 0
    for a, b, k, entity, tail in sorted(edits):
        if a < at:
            continue
        out += [text[at:a], entity, tail]
        size += a - at
        lies.append((k, size + len(entity) - len(entity.lstrip()), size + len(entity)))
        size += len(entity) + len(tail)
        at = b
    return "".join([*out, text[at:]]), sorted(lies, key=lambda x: x[1])


@dataclass
class Field:
    """Node weights and the log potentials of chain and skip edges (label of the earlier token, of the later one)."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def training_rows(text: str, most: int = TRAIN_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Features and neighbours' labels of a text's tokens that no pattern knows, and their labels; of more than `most` tokens, that many drawn by the text.

    Each token comes twice, with the labels of all neighbours and with those of clamped ones alone:
    were they always all given, its own features would hardly be learned.
    """
    text, lies = with_broken_copies(text)
    tokens = tokens_of(text)
    given = token_labels(tokens, base_spans(text) + secret_spans(text))
    labels = np.where(given > 0, given, token_labels(tokens, lies))
    n = len(LABELS)
    around, clear = np.zeros((2, len(labels), 3 * n), np.float32)
    for side, edges in ((0, tokens.chain), (2, tokens.skip)):
        for i, j in edges:
            for known, a, b, at in ((given[i], i, j, side), (given[j], j, i, side + (side == 0))):
                around[b, at * n + labels[a]] += 1
                clear[b, at * n + labels[a]] += known > 0
    free = np.flatnonzero(given == 0)
    if len(free) > most:
        free = np.array(sorted(random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass"))).sample(free.tolist(), most)))
    x = np.concatenate([np.concatenate((tokens.features, seen), axis=1)[free] for seen in (around, clear)])
    return np.minimum(x, 127).astype(np.int8), np.tile(labels[free], 2).astype(np.int8)


def fit_rows(x: np.ndarray, labels: np.ndarray, steps: int = 500, rate: float = 0.05, decay: float = 2e-4) -> Field:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels, by Adam."""
    n = len(LABELS)
    weights = np.zeros((N_FEATURES + 3 * n, n))
    weights[0, 0] = 4  # nothing is personal data until seen
    if len(labels):
        x, hot = x.astype(np.float64), np.eye(n)[labels]
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        for t in range(1, steps + 1):
            z = x @ weights
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ (p - hot) / len(x) + decay * weights
            # an edge has one potential, read from both ends
            c = slice(N_FEATURES, N_FEATURES + n), slice(N_FEATURES + n, N_FEATURES + 2 * n), slice(N_FEATURES + 2 * n, None)
            g[c[0]] = (g[c[0]] + g[c[1]].T) / 2
            g[c[1]] = g[c[0]].T
            g[c[2]] = (g[c[2]] + g[c[2]].T) / 2
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            weights -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w = weights.astype(np.float32)
    return Field(w[:N_FEATURES], w[N_FEATURES : N_FEATURES + n], w[N_FEATURES + 2 * n :])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """Fits the field on at most `train_docs` distinct texts with digits or at signs: those with the smallest hashes.

    Rows of features are made in tasks, at most TRAIN_TOKENS from a text; only they come to the driver.
    """
    small_batches(docs.sparkSession)
    some = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    drawn = some.select("h").distinct().orderBy("h").limit(train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, tuple[bytes, bytes]] = {}
            for h, t in zip(*(batch.column(c).to_pylist() for c in ("h", "text")), strict=True):
                if h not in seen:
                    seen[h] = tuple(a.tobytes() for a in training_rows(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), *[pa.array([v[k] for v in seen.values()], pa.binary()) for k in (0, 1)]], ["h", "x", "labels"])

    made = some.join(F.broadcast(drawn), "h").select("h", "text").mapInArrow(run, "h long, x binary, labels binary")
    got = made.groupBy("h").agg(F.first("x").alias("x"), F.first("labels").alias("labels")).orderBy("h").collect()
    x, labels = (np.frombuffer(b"".join(r[c] for r in got), np.int8) for c in ("x", "labels"))
    return fit_rows(x.reshape(-1, N_FEATURES + 3 * len(LABELS)), labels)


def beliefs(field: Field, many: list[Tokens], known: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Label probabilities of all tokens, by loopy sum-product over the documents' graphs at once.  known: labels of clamped tokens, else 0."""
    sizes = [len(t.spans) for t in many]
    first = np.cumsum([0, *sizes])
    n = field.weights.shape[1]
    if not first[-1]:
        return [np.zeros((0, n), np.float32) for _ in many]
    unary = np.concatenate([t.features for t in many]) @ field.weights
    given = np.concatenate(known)
    clamped = given > 0
    unary[clamped] = -60
    unary[clamped, given[clamped]] = 0
    ends, kinds = [], []
    for t, at in zip(many, first, strict=False):
        for k, edges in enumerate((t.chain, t.skip)):
            ends += [(i + at, j + at) for i, j in edges]
            kinds += [k] * len(edges)
    score = unary
    if ends:
        e = np.array(ends)
        source, target = np.concatenate((e[:, 0], e[:, 1])), np.concatenate((e[:, 1], e[:, 0]))
        back = np.concatenate((np.arange(len(e)) + len(e), np.arange(len(e))))
        pair = np.stack((field.chain, field.skip))[np.array(kinds)]
        pair = np.concatenate((pair, pair.transpose(0, 2, 1)))
        message = np.zeros((len(source), n), np.float32)
        for _ in range(rounds):
            score = unary.copy()
            np.add.at(score, target, message)
            out = (score[source] - message[back])[:, :, None] + pair
            top = out.max(1, keepdims=True)
            new = (top + np.log(np.exp(out - top).sum(1, keepdims=True)))[:, 0]
            message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        score = unary.copy()
        np.add.at(score, target, message)
    p = np.exp(score - score.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return [p[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def added_spans(tokens: Tokens, p: np.ndarray, base: list[tuple[int, int, int]], sure: float = SURE) -> list[tuple[int, int, int]]:
    """Spans of surely labelled tokens outside base spans; neighbours of one kind make one span."""
    out: list[tuple[int, int, int]] = []
    label = p.argmax(1)
    taken = token_labels(tokens, base)
    last = -2
    for i in np.flatnonzero((label > 0) & (p.max(1) >= sure) & (taken == 0)).tolist():
        a, b = tokens.spans[i]
        k = int(label[i]) - 1
        if out and last == i - 1 and out[-1][0] == k and a - out[-1][2] <= NEAR + 2:
            out[-1] = (k, out[-1][1], b)
        else:
            out.append((k, a, b))
        last = i
    return out


def scan(texts: list[str], field: Field) -> list[tuple[list, list, list]]:
    """(base spans, added spans, secrets) of each text."""
    base, tokens, known, at = [], [], [], []
    for i, t in enumerate(texts):
        if ANY.search(t):
            base.append(base_spans(t))
            tokens.append(tokens_of(t))
            known.append(token_labels(tokens[-1], base[-1] + secret_spans(t)))
            at.append(i)
    out: list[tuple[list, list, list]] = [([], [], []) for _ in texts]
    for i, b, t, p in zip(at, base, tokens, beliefs(field, tokens, known), strict=True):
        more = added_spans(t, p, b)
        out[i] = (b, [x for x in more if x[0] < len(KINDS)], [x for x in more if x[0] == len(KINDS)])
    return out


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts, digest of the base spans and all spans of each document."""
    small_batches(docs.sparkSession)
    field = field or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, more, secrets in scan(batch.column(1).fill_null("").to_pylist(), field):
                n = [sum(k == j for k, _, _ in base) for j in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more), len(secrets), written(secrets)))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{LABELS[k + 1].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """All documents, in their own columns, with personal data replaced in `text`."""
    small_batches(docs.sparkSession)
    field = field or fit(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = scan([t or "" for t in texts], field)
            new = [t if t is None else redacted(t, base + more + secrets) for t, (base, more, secrets) in zip(texts, found, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op5(docs: DataFrame) -> DataFrame:
    return find(docs)
