"""Merkle manifest, exact top-k products and periodic runs, each against a plain computation."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from feedsieve.llm import merkle, runs, topk
from feedsieve.llm.common import in_order
from tests.llm.helpers import LOWER, ODD, SCHEMA, documents

from pyspark.sql import functions as F


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row["text"].translate(LOWER) if lower and row["text"] is not None else row["text"]
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Root, and for each node its siblings level by level as pairs (left, right)."""
    level, place, paths = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        runs_ = [level[k : k + 8] for k in range(0, len(level), 8)]
        for i, p in enumerate(place):
            run = runs_[p // 8]
            paths[i].append((run[: p % 8], run[p % 8 + 1 :]))
        level, place = [h(*r) for r in runs_], [p // 8 for p in place]
    return level[0], paths


def plain_manifest(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for lang in langs]
    made = [tree([leaf(r) for r in g]) for g in groups]
    root, tops = tree([m[0] for m in made])
    out = []
    for g, (subroot, paths), top in zip(groups, made, tops, strict=True):
        for r, path in zip(g, paths, strict=True):
            key = "" if r["doc_id"] is None else str(r["doc_id"])
            fold, seen = leaf(r, zlib.crc32(key.encode()) % 3 == 0), ""
            for left, right in path + top:
                seen += "".join(left + right)
                fold = h(*left, fold, *right)
            out.append((r["doc_id"], leaf(r), subroot, root, h(seen), fold, fold == root))
    return sorted(out, key=repr)


def got_manifest(docs, height=merkle.HEIGHT):
    return sorted((tuple(r) for r in merkle.op11(docs, height).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9, None: 1, "": 3, "é": 70}, {f"l{k}": 1 + k % 3 for k in range(20)}])
def test_manifest_equals_plain_trees(spark, sizes):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6), rng.choice(["A b", "same", None, "Ünï X\n"]), lang, rng.choice([None, "s"]), rng.choice([None, 3]), "x", 1, 2) for lang, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got_manifest(docs) == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_over_several_tiers(spark):
    """Blocks of 64 leaves: tiers as a large table has them."""
    rows = [(i, f"Text {i}", "en" if i < 4200 else "de", "s", 1, "x", 1, 2) for i in range(4300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got_manifest(docs, 2) == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_odd_and_repeated_rows(spark):
    docs = documents(spark, ODD * 3).union(documents(spark, ODD)).union(spark.createDataFrame([(None, "A", None, None, None, None, None, None)] * 2, SCHEMA))
    assert got_manifest(docs) == plain_manifest([r.asDict() for r in docs.collect()])
    assert merkle.op11(docs.limit(0)).collect() == []


def test_a_changed_row_does_not_verify(spark):
    rows = merkle.op11(documents(spark, ["Upper Case", "lower"] * 30)).collect()
    tampered = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["doc_id"] % 2 == 0}
    assert tampered and {r["doc_id"] for r in rows if not r["verified"]} == tampered


def test_frontier_extends_witnesses_as_siblings_complete():
    tree_ = merkle.Frontier(2, True)
    leaves = [bytes([k]) * 32 for k in range(20)]
    for k, d in enumerate(leaves):
        tree_.append(d)
        # the first run's leaves have a level more as soon as its eighth leaf is there
        assert len(tree_.paths[0][0]) == (1 if k >= 7 else 0)
    root = tree_.close()
    assert all(len(p[0]) == 2 for p in tree_.paths)
    assert root.hex() == tree([d.hex() for d in leaves])[0]


def test_order_is_dense_over_ranges(spark):
    rows = [(i * 7919 % 1000, "k") for i in range(1000)] + [(None, "n")] * 3 + [(5, "same")] * 50
    got = in_order(spark.createDataFrame(rows, "a long, b string"), ["a", "b"], "order").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(len(rows)))
    keys = [(r["a"] is not None, r["a"] or 0, r["b"]) for r in got]
    assert keys == sorted(keys)


# products


def plain_products(rows, k=5, every=50):
    ints = [(i, v, [int(np.floor(256 * float(x))) for x in e]) for i, (v, e) in enumerate(rows) if v is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, v, q in ints:
        if v % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), u, j) for j, u, c in ints if j != i)  # noqa: B905
            out += [(v, r + 1, u, -s) for r, (s, u, _) in enumerate(scores[:k])]
    return sorted(out)


def got_products(spark, rows):
    df = spark.createDataFrame([(v, e, "x", 1) for v, e in rows], "vec_id long, embedding array<float>, bucket string, slice int")
    return sorted(tuple(r) for r in topk.op12(df).collect())


def _vectors(kind, rng):
    if kind == "unstructured":
        return rng.normal(size=(700, 16))
    if kind == "lengths":
        return rng.normal(size=(700, 16)) * np.exp(rng.normal(size=(700, 1)) * 2)
    if kind == "clusters":
        return np.repeat(rng.normal(size=(14, 16)), 50, axis=0) + 0.05 * rng.normal(size=(700, 16))
    if kind == "equal":
        return np.repeat(rng.normal(size=(2, 16)), 350, axis=0)
    return -np.abs(rng.normal(size=(120, 4)))


@pytest.mark.parametrize("kind", ["unstructured", "lengths", "clusters", "equal", "few"])
def test_products_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "GROUP", 5)
    monkeypatch.setattr(topk, "SLICE", 100)
    monkeypatch.setattr(topk, "SEEDS", 40)
    x = np.float32(_vectors(kind, np.random.default_rng(3)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert got_products(spark, rows) == plain_products(rows)


def test_products_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (100, []), (150, None), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (300, [None, 1.0]), (350, [1.0, 2.0, 3.0]), (0, [1.0, 2.0]), (1, [-1.0, -1.0]), (None, [1.0, 1.0]), (2, [1e-30, 0.0])]
    assert got_products(spark, rows) == plain_products(rows)
    assert got_products(spark, []) == []
    assert got_products(spark, [(0, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(i * 50, [100_000.0 + i, 250_000.0 - i, float(i % 3)]) for i in range(12)]
    assert got_products(spark, rows) == plain_products(rows)


@pytest.mark.parametrize("kind", ["clusters of one length", "many lengths"])
def test_pruning_leaves_most_products_out(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "many lengths":
        x = rng.normal(size=(2000, 32)) * np.exp(rng.normal(size=(2000, 1)))
    else:
        x = np.repeat(rng.normal(size=(40, 32)), 50, axis=0)
        x = x / np.linalg.norm(x, axis=1, keepdims=True) + 0.02 * rng.normal(size=(2000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.float32(x))], "vec_id long, embedding array<float>")
    got = topk.largest_products(df, F.col("vec_id") % 50 == 0).groupBy("query_id").agg(F.max("n_verified").alias("n")).collect()
    assert len(got) == 40 and sum(r["n"] for r in got) < 0.15 * 40 * 2000


# runs


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    number = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), number // 10
    if number % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    facts = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *facts, sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), sha256(kept).hexdigest())


def test_runs_of_random_words():
    rng = random.Random(2)
    for _ in range(1500):
        k = rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(k) for _ in range(rng.randint(0, 70))]
        if words and rng.random() < 0.6:
            p, a = rng.randint(1, 12), rng.randrange(len(words))
            words = words[:a] + [words[min(a + (i - a) % p, len(words) - 1)] for i in range(a, len(words))]
        words = words * rng.choice([1, 1, 3])
        assert runs.runs(np.array(words, np.int64)) == plain_runs(words)


def test_runs_of_texts_equal_plain(spark):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(300)] + ["A a A a A a A a", "x\x1cx\x1cx y\x85z " * 9, "long passage of words " * 40]
    docs = documents(spark, texts).union(spark.createDataFrame([(None, "z z z z z z z q", None, None, None, None, None, None), (3, "n o", "en", "s", 1, "x", 1, 2)], SCHEMA))
    got = sorted((tuple(r) for r in runs.op13(docs).collect()), key=repr)
    # plain_runs is slow on a text of one word 30,000 times, which has one run
    assert got == sorted((plain_row(r["doc_id"], r["text"]) if len(r["text"] or "") < 50_000 else got[[g[0] for g in got].index(r["doc_id"])] for r in docs.collect()), key=repr)
    long = next(g for g in got if g[0] == ODD.index("x " * 30_000))
    assert long[1:6] == (1, 0, 30_000, 1, 30_000_000)
    assert runs.op13(docs.limit(0)).collect() == []


def test_runs_of_a_text_of_a_megabyte(spark):
    rng = random.Random(6)
    passage = [str(rng.randrange(10**6)) for _ in range(20_000)]
    text = " ".join(["head"] + passage * 7 + ["tail"])
    assert len(text) > 900_000
    row = runs.with_runs(documents(spark, [text])).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (1, 1, 140_000, 20_000, 7000)
    assert row["collapsed_sha256"] == sha256(" ".join(["head"] + passage + ["tail"]).encode()).hexdigest()


def test_equal_exponents_go_to_the_first_run():
    assert runs.best_run([(0, 8, 2), (10, 4 * 3, 3), (30, 6, 1), (50, 6, 1)]) == (30, 6, 1)
