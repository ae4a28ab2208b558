import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedsieve.llm import ann, lm, ngram_join, substring_dedup
from feedsieve.llm.components import components
from tests.llm.helpers import LOWER, ODD, SCHEMA, WORD, documents


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed, families=6, copies=25, words=60):
    """Families of near copies around the threshold, all with one shared passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(25)]
    out = []
    for _ in range(families):
        base = [word() for _ in range(words)] + passage
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "percent", "light"), [(3, 90, 2), (5, 80, 8)])
def test_join_equals_brute_force(spark, monkeypatch, k, percent, light):
    monkeypatch.setattr(ngram_join, "LIGHT", light)  # most tokens count as frequent
    texts = ODD + near_texts(k)
    docs = documents(spark, texts)
    got = ngram_join.join(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(texts, k, percent)
    kept = ngram_join.keep_one(docs, k, percent)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute_components(texts, k, percent)})


def test_large_groups_of_near_copies_make_few_pairs(spark, monkeypatch):
    """Two thousand copies of one text with up to four words changed: most lie just under the threshold, few pairs are looked at."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(100)]
    texts = [" ".join(base)] * 300
    for _ in range(2000):
        t = list(base)
        for i in rng.sample(range(100), rng.choice((1, 2, 3, 3, 4, 4))):
            t[i] = word() if rng.random() < 0.9 else "same"
        texts.append(" ".join(t))
    seen = spark.sparkContext.accumulator(0)
    plain = ngram_join._filtered

    def counted(pairs, nodes, percent):
        pairs = pairs.persist()
        seen.add(pairs.count())
        return plain(pairs, nodes, percent)

    monkeypatch.setattr(ngram_join, "_filtered", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.op2(documents(spark, texts)).collect()}
    sets = [shingles(t, 3) for t in texts]
    tokens = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(texts), len(tokens)), np.float32)
    for i, s in enumerate(sets):
        m[i, [tokens[g] for g in s]] = 1
    n = m.sum(1)
    common = m @ m.T
    link = 100 * common >= 90 * (n[:, None] + n[None, :] - common)
    root = np.arange(len(texts))
    while True:
        least = np.where(link, root[None, :], len(texts)).min(1)
        if (least == root).all():
            break
        root = least
    assert [got[i] for i in range(len(texts))] == root.tolist()
    assert 200 < len(set(root.tolist())) and seen.value < 40 * len(texts)


def test_join_of_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.op2(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d", "en", "s", 1, "x", 1, 2), (7, "a b c d", "en", "s", 1, "x", 1, 2), (7, "a b c d", "en", "s", 1, "x", 1, 2)], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.op2(rows).collect()) == [(0, 7), (7, 7), (7, 7)]
    assert ngram_join.keep_one(rows, 3, 90).count() == 1


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_small_tables_of_edges_lie_in_few_partitions(spark):
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        found = components(spark.createDataFrame([(i, i + 1) for i in range(50) if i % 10], "a long, b long"))
        assert found.rdd.getNumPartitions() <= 2
        assert {r["node"]: r["root"] for r in found.collect()} == {i: i if i == 0 else (i - 1) // 10 * 10 + 1 for i in range(1, 51)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_join_leaves_no_shuffle_files_but_those_of_its_result(spark):
    folder = spark.conf.get("spark.local.dir")
    held = lambda: {f for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")}
    before, key = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    found = ngram_join.join(documents(spark, near_texts(3, families=2, copies=6)), 3, 90)
    for _ in range(60):
        if not (left := held() - before):
            break
        time.sleep(0.5)
    assert not left
    assert spark.conf.get(key) == "false"  # the session is as it was
    assert found.count() == found.count() and len(found.collect()) == len(found.collect())


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    line = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    shared, sentence = line(55), line(12) + "."
    verse = "\n".join(line(4) for _ in range(8))
    texts = [*ODD, f"{line(5)}\n{shared}\n{line(30)}", f"{shared.upper()}\n{line(9)}", f"{line(25)}. {sentence} {line(30)}", f"{line(31)}. {sentence} {line(4)}", f"{shared}\n{shared}", f"{verse}\n{line(9)}.", f"{line(3)}.\n\n{verse}\n{line(7)}! {sentence} {shared}"]
    docs = documents(spark, texts)
    # units again, by splitting instead of matching
    units = []
    for i, t in enumerate(texts):
        at, n = 0, 0
        for piece in re.split(r"(\n)|(?<=[.!?])(?![.!?])", t or ""):
            if piece and (words := piece.translate(LOWER).split()) and piece != "\n":
                units.append((i, n, at, at + len(piece), tuple(words)))
                n += 1
            at += len(piece or "")
    first = {}
    for i, n, a, b, w in units:
        first.setdefault(w, (i, a))
    runs = []
    for i, n, a, b, w in units:
        if first[w] != (i, a):
            if runs and runs[-1][0] == i and runs[-1][1] == n - 1:
                runs[-1][1:4] = [n, runs[-1][2], b]
                runs[-1][4] += len(w)
            else:
                runs.append([i, n, a, b, len(w), first[w][0]])
    want = [(i, a, b, kept) for i, _, a, b, words, kept in runs if words >= substring_dedup.MIN_WORDS]
    got = substring_dedup.op6(docs).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["kept_doc_id"]) for r in got) == sorted(want)
    n = len(ODD)
    assert {n + 1, n + 4, n + 6} <= {w[0] for w in want} and not {n, n + 2, n + 3, n + 5} & {w[0] for w in want}
    taken = docs.withColumnsRenamed({"kept": "removed", "rid": "row", "n_words": "cut"})
    gone = substring_dedup.remove(taken)
    assert gone.columns == [*taken.columns, "removed_"]
    clean = {r["doc_id"]: r for r in gone.collect()}
    for i, t in enumerate(texts):
        cut = sorted((a, b) for d, a, b, _ in want if d == i)
        assert [tuple(x) for x in clean[i]["removed_"] or []] == cut
        keep, at = "", 0
        for a, b in cut:
            keep, at = keep + t[at:a], b
        assert clean[i]["text"] == (None if t is None else keep + t[at:])
    odd = spark.createDataFrame([(None, shared, "en", "s", 1, "x", 1, 2), (7, shared, "en", "s", 1, "x", 1, 2), (7, shared, "en", "s", 1, "x", 1, 2)], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["kept_doc_id"]) for r in substring_dedup.op6(odd).collect()) == [(0, 7), (7, 7)]
    assert substring_dedup.op6(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("module", "step"), [(ngram_join, "_first_pairs"), (substring_dedup, "checkpoint"), (lm, "corpus_of")])
def test_rows_stay_told_apart_when_a_later_scan_is_cut_elsewhere(spark, monkeypatch, tmp_path, module, step):
    texts = near_texts(4, families=3, copies=8)
    documents(spark, texts).repartition(8).write.parquet(str(tmp_path / "d"))
    plain, least = getattr(module, step), "spark.sql.files.minPartitionNum"

    def between(*args):
        out = plain(*args)
        spark.conf.set(least, "8")
        return out

    monkeypatch.setattr(module, step, between)
    run = {ngram_join: ngram_join.op2, substring_dedup: substring_dedup.op6, lm: lm.op7}[module]
    keep = {ngram_join: ("doc_id", "n_shingles", "component_id"), substring_dedup: ("doc_id", "start", "end", "kept_doc_id"), lm: ("doc_id", "n_tokens", "n_known", "base_score")}[module]
    got = []
    try:
        for first in ("1", "8"):
            spark.conf.set(least, first)
            got.append(sorted(map(tuple, run(spark.read.parquet(str(tmp_path / "d"))).select(*keep).collect())))
    finally:
        spark.conf.unset(least)
    if module is ngram_join:
        assert got[0] == brute_components(texts, 3, 90)
    assert len(got[0]) == len(got[1])
    assert all(a == pytest.approx(b, rel=1e-9) for a, b in zip(*got, strict=True))


def test_nearest(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 24)) * 2
    m = np.concatenate((centres[rng.integers(0, 10, 1500)] + rng.normal(size=(1500, 24)), np.tile(centres[0], (40, 1))))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0] * 3), (5004, [None] + [1.0] * 23), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = ann.op3(df).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits, total = 0, 0
    for q in range(0, len(m), 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(m)), -np.round(s, 12)))[:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - x) < 1e-9 for _, v, x in own)
        hits += len({v for _, v, _ in own} & set(best.tolist()))
        total += 5
    assert hits / total >= 0.9
    assert max(r["n_scored"] for r in got) < len(m)
    twice = ann.op3(spark.createDataFrame([*rows[:60], (0, rows[1][1]), (50, rows[50][1])], "vec_id long, embedding array<double>")).collect()
    assert sorted(r["query_id"] for r in twice) == [0] * 10 + [50] * 10
    assert {(r["query_id"], r["vec_id"]) for r in twice if r["rank"] == 1 and r["score"] > 0.999999} >= {(0, 1), (50, 50)}
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "row": F.lit("r"), "vec": F.lit(3), "unit": F.lit(None)})
    assert ann.op3(few).count() == 2
    assert ann.op3(df.limit(0)).count() == 0
    # a shorter vector counts as filled up with zeros, as query and as candidate
    mixed = spark.createDataFrame([(0, [3.0, 4.0]), (1, [3.0, 4.0, 0.0]), (2, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in sorted(ann.op3(mixed).collect(), key=lambda r: r["rank"])] == [(1, pytest.approx(1.0)), (2, pytest.approx(0.0))]
    assert df.where(F.col("vec_id") == 0).count() == 1
