import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedsieve.llm import lm, mixing, packing, pii, quality, token_io, toxicity
from feedsieve.llm.common import shared_folder
from feedsieve.llm.queries import tokenizer_path
from tests.llm.helpers import LOWER, ODD, SCHEMA, WORD, bucket, documents


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def encoded(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TEXTS = [*ODD, "It's a <|endoftext|> test  here, isn't it?  2024!!", *(f"word{i} " * (i * 7 % 900) + "The end." for i in range(60))]


def test_packing_gives_every_id_once(spark):
    want = encoded("byte_bpe_50k.json", TEXTS, 0)
    rows = packing.pack(documents(spark, TEXTS).repartition(3), tokenizer_path("byte_bpe_50k.json")).collect()
    for i, ids in enumerate(want):
        pieces = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == [sum(x["length"] for x in pieces[:k]) for k in range(len(pieces))]
        assert sum(r["length"] for r in pieces) == len(ids) == pieces[0]["doc_tokens"]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        size = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert size <= 1024 and size & (size - 1) == 0  # no padding
    assert packing.pack(empty(spark), tokenizer_path("byte_bpe_50k.json")).count() == 0
    odd = documents(spark, ["a b"]).union(documents(spark, ["a b"])).union(documents(spark, ["c"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted((r["doc_id"] is None, r["start"]) for r in packing.pack(odd, tokenizer_path("byte_bpe_50k.json")).collect() if r["start"] == 0) == [(False, 0), (False, 0), (True, 0)]


def test_token_files_round_trip(spark):
    want = encoded("word_bpe_49k.json", TEXTS, 2)
    docs = documents(spark, TEXTS).repartition(5)
    starts = np.append(0, np.cumsum([len(x) for x in want]))
    got = sorted(token_io.op10(docs, tokenizer_path("word_bpe_49k.json")).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(i, starts[i], len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(want)]
    files = token_io.write(docs, shared_folder(spark, "t"), tokenizer_path("word_bpe_49k.json"), lower=True)
    some = token_io.read(spark, files, [3, 40], with_ids=True).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in some} == {i: want[i].tolist() for i in (3, 40)}
    assert token_io.op10(empty(spark), tokenizer_path("word_bpe_49k.json")).count() == 0
    odd = documents(spark, ["a b"]).union(documents(spark, ["a b"])).union(documents(spark, ["c"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = token_io.op10(odd, tokenizer_path("word_bpe_49k.json")).collect()
    assert sorted(r["start"] for r in rows) == [sum(sorted(x["n_tokens"] for x in rows if x["start"] < r["start"])) for r in sorted(rows, key=lambda r: r["start"])] and len(rows) == 3


def test_reader_opens_only_needed_frames_and_checks_them(tmp_path):
    path = f"file://{tmp_path}/x.zst"
    w = token_io.Writer(path, 2, frame_bytes=64)
    docs = {i: np.arange(i * 10, i * 10 + i * 7, dtype=np.uint32) for i in range(30)}
    for d, ids in docs.items():
        w.add(d, ids)
    w.close()
    r = token_io.Reader(path)
    row = r.rows_of(29)[0]
    assert (r.ids(row) == docs[29]).all() and r.fetched <= 2 * 29 * 7 // 64 + 2
    assert all((token_io.Reader(path).ids(token_io.Reader(path).rows_of(d)[0]) == ids).all() for d, ids in docs.items() if len(ids))
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(open(tmp_path / "x.zst", "rb"), read_across_frames=True).read()
    assert plain == b"".join(x.astype("<u2").tobytes() for x in docs.values())
    raw = bytearray((tmp_path / "x.zst").read_bytes())
    raw[20] ^= 1
    (tmp_path / "x.zst").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017  the frame's own or the table's checksum
        token_io.Reader(path).ids(1)


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    places = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(places))


def test_quality_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [*ODD, *("\n".join(" ".join(rng.choice(["a", "b", "cc", "d#", "É"]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(25))) for _ in range(80)), " ".join(f"clean{i}" for i in range(200))]
    docs = documents(spark, texts)
    rows = sorted(quality.op9(docs).collect(), key=lambda r: r["doc_id"])
    for r, t in zip(rows, texts, strict=True):
        m = measures(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (*m, failed)
        assert not (failed and r["kept"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [r["doc_id"] for r in rows if r["kept"]]
    table = {r["rule"]: r for r in quality.ablation(quality.ledger(docs)).collect()}
    bits = [r["fail_bits"] & quality.mask(quality.POLICIES["v2"]) for r in rows]
    assert table["few_words"]["failed_alone"] == sum(b == quality.mask(["few_words"]) for b in bits)
    assert table["symbols"]["kept_without"] == sum(b in (0, quality.mask(["symbols"])) for b in bits)
    assert quality.op9(empty(spark)).count() == 0


def plain_spans(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 16 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 8 <= len(d) <= 15):
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("a0125.-+@ ()9") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("1" * 200_000 + "@" + "a" * 200_000) == []


def entity_texts(n, seed=8):
    """Texts with clear entities, numbers that are none, and secrets beside their word."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = digits(15)
        return next(d + x for x in "0123456789" if pii.luhn(d + x))

    def wrong_card():
        d = digits(16)
        return d if not pii.luhn(d) else wrong_card()

    make = {0: lambda: f"{word()}.{digits(2)}@mail{digits(1)}.example.com", 1: lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), 2: card, 3: lambda: f"+1 ({digits(3)}) 555-{digits(4)}", 4: lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"'}
    other = (lambda: f"version {digits(1)}.{digits(1)}", lambda: digits(2), wrong_card, lambda: f"in {rng.randrange(1900, 2030)}", lambda: f"{digits(4)} items")
    out = []
    for i in range(n):
        w = [word() for _ in range(60)]
        for k in rng.sample(range(5), rng.randrange(1, 4)):
            w[rng.randrange(60)] = make[k]()
        for f in rng.sample(other, 2):
            w[rng.randrange(60)] = f()
        out.append(" ".join(w))
    return out


def test_field_finds_broken_entities(spark):
    texts = [*ODD, *entity_texts(400)]
    field = pii.fit(documents(spark, texts + texts[len(ODD) :][:50]))
    true = false = missed = 0
    for t in entity_texts(400, seed=9):
        t, lies = pii.with_broken_copies(t)
        base = pii.base_spans(t)
        assert base == plain_spans(t)
        known = base + pii.secret_spans(t)
        lies = [x for x in lies if not any(x[1] < d and c < x[2] for _, c, d in known)]
        got = [x for xs in pii.scan([t], field)[0][1:] for x in xs if not any(x[1] < d and c < x[2] for _, c, d in known)]
        same = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
        hits = sum(any(same(x, y) for y in lies) for x in got)
        true, false, missed = true + hits, false + len(got) - hits, missed + sum(not any(same(x, y) for x in got) for y in lies)
    assert true > 200 and true / (true + false) >= 0.9 and true / (true + missed) >= 0.8


def test_field_finds_whole_entities_that_a_pattern_swallows(spark):
    """A phone number before an address: the pattern takes both, counts too many digits, and fails."""
    field = pii.fit(documents(spark, entity_texts(600, seed=3)))
    draw, found, wrong = random.Random(8), 0, 0
    for _ in range(60):
        phone = f"+1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}"
        text = f"please call {phone} {draw.randint(1, 255)}.{draw.randint(1, 255)}.7.9 said the note"
        base, more, _ = pii.scan([text], field)[0]
        assert [k for k, _, _ in base] == [1]
        found += [(text[a:b], k) for k, a, b in more] == [(phone, 3)]
        wrong += any(k != 3 for k, _, _ in more)
    assert found >= 54 and wrong <= 2


def test_personal_data_keeps_base_spans(spark):
    clear = entity_texts(150)
    broken = [pii.with_broken_copies(t)[0] for t in entity_texts(60, seed=10)]
    texts = [*ODD, *clear, *broken, "1 " * 50_000 + "x@y.example.com"]
    docs = documents(spark, texts).union(documents(spark, texts[-1:]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = {r["doc_id"]: r for r in pii.op5(docs).collect()}
    assert len(rows) == len(texts) + 1 and rows[None]["n_email"] == 1
    for i, t in enumerate(texts):
        base, r = plain_spans(t or ""), rows[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == j for x in base) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(r["spans"].split(",")) or not base
        assert all(re.fullmatch(r"(email|ip|card|phone):\d+:\d+", x) for x in r["spans"].split(",") if x)
    assert sum(r["n_added"] for r in rows.values()) > 10
    assert sum(r["n_secret"] for r in rows.values()) >= sum("token = " in (t or "") for t in texts)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert clean.where(f"doc_id < {len(ODD) + len(clear)} AND text LIKE '%@mail%'").count() == 0
    assert pii.op5(empty(spark)).count() == 0


def all_labellings(unary, edges):
    """Label probabilities by going through every labelling."""
    n, k = unary.shape
    p = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(m[y[i], y[j]] for i, j, m in edges))
        for i in range(n):
            p[i, y[i]] += w
    return p / p.sum(1, keepdims=True)


@pytest.mark.parametrize(("skip", "error"), [([(1, 3)], 1e-4), ([(0, 1), (1, 3), (0, 3)], 0.08)])
def test_messages_equal_enumeration(skip, error):
    """Exact where the graph has no loop, near where it has one."""
    rng = np.random.default_rng(3)
    k = len(pii.LABELS)
    field = pii.Field(np.eye(pii.N_FEATURES, k, dtype=np.float32), rng.normal(size=(k, k)).astype(np.float32) * 0.7, rng.normal(size=(k, k)).astype(np.float32) * 0.7)
    x = np.zeros((5, pii.N_FEATURES), np.float32)
    x[:, :k] = rng.normal(size=(5, k))
    chain = [(1, 2), (3, 4)]
    known = np.array([2, 0, 0, 0, 0])
    unary = x[:, :k].astype(float)
    unary[0] = -60
    unary[0, 2] = 0
    want = all_labellings(unary, [(i, j, field.chain) for i, j in chain] + [(i, j, field.skip) for i, j in skip])
    got = pii.beliefs(field, [pii.Tokens([(i, i + 1) for i in range(5)], x, chain, skip)], [known], rounds=60)[0]
    assert np.abs(got - want).max() < error


def test_skip_edges_join_equal_and_similar_tokens():
    t = pii.tokens_of("id 4845168114407329 x 4845  1681 y " + "z " * 50 + "(4845168114407329), 99 1234")
    assert (0, 3) in t.skip and {(0, 1), (0, 2)} <= set(t.skip)
    assert not any(5 in e or 4 in e for e in t.skip)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = [word() for _ in range(40)]
        if bad:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["zzvile", "zzscum", "qqfoul" + word()])
        texts.append(" ".join(w))
        labels.append((i, int(bad if rng.random() > 0.02 else not bad)))
    docs = documents(spark, [*texts, *ODD])
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.op4(docs, table).collect()}
    assert len(rows) == len(texts) + len(ODD)
    assert all(r["held_out"] == (bucket(d, 4) == 2) and r["predicted"] == (r["score"] >= 0.3) for d, r in rows.items())
    held = [d for d in range(900) if rows[d]["held_out"]]
    right = sum(rows[d]["predicted"] == (d % 5 == 0) for d in held)
    assert right / len(held) > 0.95
    assert all(rows[900 + k]["predicted"] == 0 for k in range(len(ODD)))
    assert toxicity.op4(empty(spark), table).count() == 0
    assert toxicity.op4(docs, table.limit(0)).count() == len(rows)


def test_label_model_recovers_known_voters():
    """Rates, balance and correlations of voters drawn from a known model; posteriors are those of Bayes' rule."""
    rng = np.random.default_rng(4)
    n, prior = 20_000, 0.2
    rates = np.array([[0.02, 0.05, 0.10, 0.03, 0.04], [0.50, 0.60, 0.40, 0.30, 0.45]])
    truth = (rng.random(n) < prior).astype(int)
    votes = (rng.random((n, 5)) < rates[truth]).astype(float)
    votes = np.column_stack((votes, np.where(rng.random(n) < 0.95, votes[:, 4], 1 - votes[:, 4])))  # the last one repeats its neighbour
    gold = np.where(rng.random(n) < 0.2, np.where(rng.random(n) < 0.97, truth, 1 - truth), -1)
    model = toxicity.fit_label_model(votes, gold)
    assert np.abs(model.rates[:, :5] - rates).max() < 0.05 and abs(model.prior - prior) < 0.03
    assert model.correlations[4, 5] > 0.5 and np.abs(model.correlations[:4]).max() == 0
    assert model.discount[0] == 1 and model.discount[4] < 0.7
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.92
    # every combination of votes of the voters that are independent, by Bayes' rule
    alone = toxicity.LabelModel(model.rates[:, :4], model.prior, np.ones(4), np.zeros((4, 4)))
    for v in itertools.product((0, 1), repeat=4):
        like = [np.prod([r if x else 1 - r for r, x in zip(alone.rates[c], v, strict=True)]) * (alone.prior if c else 1 - alone.prior) for c in (0, 1)]
        assert abs(alone.posterior(np.array([v], float))[0] - like[1] / sum(like)) < 1e-9


def test_toxicity_of_repeated_rows_and_labels(spark):
    texts = [f"word{i % 7} zzbad{i % 2} text" if i % 4 == 0 else f"word{i % 7} fine text" for i in range(400)]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id = 0")).union(docs.where("doc_id = 0")).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(4, 1)] * 300 + [(8, 0)]
    rows = toxicity.op4(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == 403 and len({r["score"] for r in rows if r["doc_id"] in (0, None)}) == 1
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    taught = toxicity.training_rows(docs, table).collect()
    assert len(taught) == sum(bucket(i, 4) != 2 for i in range(400))
    assert toxicity.unlabelled_rows(docs, table).count() == 0


def test_language_model(spark):
    rng = random.Random(7)
    chain = {w: [rng.choice("abcdefgh") * 2 for _ in range(2)] for w in (c * 2 for c in "abcdefgh")}
    texts = []
    for _ in range(300):
        w = ["aa"]
        while len(w) < 60:
            w.append(rng.choice(chain[w[-1]]))
        texts.append(" ".join(w))
    texts += ODD
    docs = documents(spark, texts).union(spark.createDataFrame([(None, None, None, None, None, None, None, None)], SCHEMA))
    rows = {r["doc_id"]: r for r in lm.op7(docs).collect()}
    assert (rows[None]["held_out"], rows[None]["n_tokens"]) == (False, 1)
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for t in texts]
    counts = {}
    for i, ws in enumerate(tokens):
        if bucket(i, 7) != 2:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    counts[None] += 1  # the end of the row without an id
    total = sum(counts.values())
    for i, ws in enumerate(tokens):
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (bucket(i, 7) == 2, len(ws), sum(w in counts for w in ws), total)
        assert abs(r["base_score"] - sum(np.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in ws)) < 1e-6 * len(ws)
        assert r["score"] < 0
    held = [i for i in range(300) if rows[i]["held_out"]]
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)
    assert lm.op7(empty(spark)).count() == 0


def test_network_trains_on_every_training_document(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 7 + j) % 500}" for j in range(20_000)) for i in range(20)] + ["one copy"] * 30
    seen = spark.sparkContext.accumulator(0)
    plain = lm.train_part

    def counted(w, docs, goals, rate):
        seen.add(sum(map(len, goals)))
        return plain(w, docs[:1], goals[:1], rate)

    monkeypatch.setattr(lm, "train_part", counted)
    docs = documents(spark, texts).coalesce(1)
    corpus, coded = lm.encoded(docs)
    lm.train(coded, corpus)
    assert seen.value == corpus.tokens == sum(len(t.split()) + 1 for i, t in enumerate(texts) if bucket(i, 7) != 2)


def a_network(rng):
    c = lm.Corpus(10**6, 10**5, np.arange(lm.HEAD), np.sort(rng.integers(300, 9000, lm.HEAD))[::-1].copy(), np.full(lm.TAILS, 1e4), np.full(lm.TAILS, 1e3), lm.spelling_of(rng.integers(0, 9, 1 << 16)))
    return c, {k: v.astype(np.float64) for k, v in lm.start_weights(c).items()}


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    _, w = a_network(rng)
    codes, inputs = rng.integers(0, 60, (6, 3)), rng.integers(0, 50, (6, 3))
    first = np.zeros((6, 3), bool)
    first[0] = first[3, 1] = True
    begin = np.concatenate((np.zeros((3, lm.HIDDEN)), rng.normal(size=(1, lm.HIDDEN))))
    args = (inputs, first, np.ones((6, 3), bool), codes, np.zeros((3, lm.HIDDEN)), begin)
    grad = lm.gradients(w, *args)[0]
    for k, at in (("u", (3, 5)), ("wc", (2, 1)), ("bc", (0,)), ("v", (0, 2, 3)), ("bv", (1, 2))):
        old, e = w[k][at], 1e-3
        w[k][at] = old + e
        up = lm.gradients(w, *args)[3]
        w[k][at] = old - e
        down = lm.gradients(w, *args)[3]
        w[k][at] = old
        assert abs((up - down) / 2 / e - grad[k][at]) < 1e-4


def plain_window(w, inputs, first, targets, h0):
    """Loss and gradients of one window, lane by lane as rows, each class's softmax written out in steps."""
    sigmoid = lambda x: 0.5 * np.tanh(0.5 * x) + 0.5
    size, heads, h, kept, out = lm.HIDDEN, lm.HEAD // lm.WIDTH, h0, [], []
    x = w["x"][inputs]
    for t in range(len(inputs)):
        h = h * ~first[t][:, None]
        g = h @ w["u"]
        zr = sigmoid(x[t, :, : 2 * size] + g[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(x[t, :, 2 * size :] + r * g[:, 2 * size :])
        kept.append((h, z, r, n, g[:, 2 * size :]))
        h = n + z * (h - n)
        out.append(h)
    hs = np.stack(out)
    flat, goal = hs.reshape(-1, size), targets.ravel()
    kind = np.where(goal < lm.HEAD, goal // lm.WIDTH, heads + (goal - lm.HEAD) // lm.SUFFIXES)
    grad, loss = {k: np.zeros_like(v) for k, v in w.items()}, 0.0

    def errors(z, aim):
        p = np.exp(z - z.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        place = np.arange(len(aim)), aim
        lost = -float(np.log(p[place]).sum()) / len(goal)
        p[place] -= 1
        return p / p.dtype.type(len(goal)), lost

    d, lost = errors(flat @ w["wc"] + w["bc"], kind)
    loss += lost
    grad["wc"], grad["bc"], dh = flat.T @ d, d.sum(0), d @ w["wc"].T
    order = np.argsort(kind, kind="stable")
    ends = np.searchsorted(kind[order], np.arange(heads + 1))
    for k in range(heads):
        at = order[ends[k] : ends[k + 1]]
        if len(at):
            d, lost = errors(flat[at] @ w["v"][k] + w["bv"][k], goal[at] % lm.WIDTH)
            loss += lost
            grad["v"][k], grad["bv"][k] = flat[at].T @ d, d.sum(0)
            dh[at] += d @ w["v"][k].T
    dh, carry, dx = dh.reshape(hs.shape), np.zeros_like(h0), []
    for t in range(len(inputs) - 1, -1, -1):
        h, z, r, n, gn = kept[t]
        dnew = dh[t] + carry
        dn = dnew * (1 - z) * (1 - n * n)
        dz, dr = dnew * (h - n) * z * (1 - z), dn * gn * r * (1 - r)
        dg = np.concatenate((dz, dr, dn * r), axis=1)
        grad["u"] += h.T @ dg
        dx.append(np.concatenate((dz, dr, dn), axis=1))
        carry = (dnew * z + dg @ w["u"].T) * ~first[t][:, None]
    order = np.argsort(inputs.ravel(), kind="stable")
    rows, begins = np.unique(inputs.ravel()[order], return_index=True)
    grad["x"][rows] = np.add.reduceat(np.ascontiguousarray(np.concatenate(dx[::-1])[order].T), begins, axis=1).T
    return grad, loss


def a_window(rng, c, lanes=280):
    """Codes of a window about as uneven as words are, and a few new documents."""
    size = lm.STEPS, lanes
    draw = lambda: np.where(rng.random(size) < 0.6, lm.HEAD ** rng.random(size) - 1, rng.integers(lm.HEAD, c.codes, size)).astype(np.int32)
    first = rng.random((lm.STEPS, lanes)) < 0.01
    return draw(), first, draw(), rng.uniform(-0.5, 0.5, (lanes, lm.HIDDEN))


@pytest.mark.parametrize("times", [1, 40])
def test_gradients_equal_plain_ones(times):
    """Also with weights so large that exponentials of plain logits would leave single precision."""
    rng = np.random.default_rng(4)
    c, w = a_network(rng)
    w = {k: v * (times if k in ("wc", "v") else 1) for k, v in w.items()}
    if times > 1:
        w["wc"][:] *= 40
        assert lm._wide(np.concatenate((w["wc"], w["bc"][None])))
    inputs, first, targets, h = a_window(rng, c)
    grad, rows, _, loss = lm.gradients(w, inputs, first, np.ones_like(first), targets, h)
    plain, expected = plain_window(w, inputs, first, targets, h)
    assert abs(loss - expected) < 1e-6 * expected and (rows == np.unique(inputs)).all()
    for k, g in grad.items():
        assert np.allclose(g, plain[k][rows] if k == "x" else plain[k], rtol=1e-5, atol=1e-6 * np.abs(plain[k]).max()), k
    some = np.concatenate((targets.ravel()[:900], np.arange(lm.HEAD)))
    states = rng.uniform(-1, 1, (len(some), lm.HIDDEN)).astype(np.float32)
    single = {k: v.astype(np.float32) for k, v in w.items()}
    assert np.allclose(lm.log_probs(single, states, some, rows=700), lm.log_probs(w, states.astype(np.float64), some), rtol=1e-4, atol=1e-3)


def test_a_window_costs_less_than_a_plain_one():
    """CPU time against the same window in plain steps, so the machine's speed cancels out."""
    rng = np.random.default_rng(5)
    c, w = a_network(rng)
    w = {k: v.astype(np.float32) for k, v in w.items()}
    inputs, first, targets, h = a_window(rng, c)
    h, used = h.astype(np.float32), np.ones_like(first)

    def cost(work):
        began = time.thread_time()
        work()
        return time.thread_time() - began

    pairs = [(cost(lambda: lm.gradients(w, inputs, first, used, targets, h)), cost(lambda: plain_window(w, inputs, first, targets, h))) for _ in range(25)]
    ours, plain = (min(x) for x in zip(*pairs, strict=True))
    assert ours < 0.75 * plain


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    c, w = a_network(rng)
    h = rng.normal(size=(1, lm.HIDDEN))
    tails = np.arange(lm.TAILS) * lm.SUFFIXES + lm.HEAD
    codes = np.concatenate((np.arange(lm.HEAD), tails))
    p = np.exp(lm.log_probs(w, np.repeat(h, len(codes), 0), codes))
    assert abs(p.sum() - 1) < 1e-6 and abs(p[: lm.HEAD].sum() - 1) > 1e-3
    assert np.allclose((10**c.spelling).sum(1), 1)
    # words of at most two letters of an alphabet of three, and all that is longer, by the chance of each beginning
    table = lm.spelling_of(np.where(np.isin(np.arange(1 << 16) % 256, [32, 97, 98]), 50, 0) * 1e9)
    words = [x + y for x in "ab" for y in ["", *"ab"]]
    begun = sum(10 ** (table[32, ord(x)] + table[ord(x), ord(y)]) * (1 - 10 ** table[ord(y), 32]) for x in "ab" for y in "ab")
    assert abs((10 ** lm.spelled(table, np.array(words, object))).sum() + begun - 1) < 1e-6


def plain_score(w, codes):
    """One document, word by word."""
    h, total, last = np.zeros(lm.HIDDEN), 0.0, len(w["x"]) - 1
    for c in codes:
        g, x = h @ w["u"], w["x"][last]
        z, r = (1 / (1 + np.exp(-(x[k : k + lm.HIDDEN] + g[k : k + lm.HIDDEN]))) for k in (0, lm.HIDDEN))
        n = np.tanh(x[2 * lm.HIDDEN :] + r * g[2 * lm.HIDDEN :])
        h = (1 - z) * n + z * h
        classes = h @ w["wc"] + w["bc"]
        k = c // lm.WIDTH if c < lm.HEAD else lm.HEAD // lm.WIDTH + (c - lm.HEAD) // lm.SUFFIXES
        total += classes[k] - np.log(np.exp(classes).sum())
        if c < lm.HEAD:
            inner = h @ w["v"][k] + w["bv"][k]
            total += inner[c % lm.WIDTH] - np.log(np.exp(inner).sum())
        last = c
    return total


def test_scores_in_lanes_and_carried_states_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    c, w = a_network(rng)
    docs = [rng.integers(0, c.codes, n) for n in (1, 700, 3, 260, 40, 129, 2)]
    got = lm.document_scores(w, docs, lanes=3, window=50)
    assert np.allclose(got, [plain_score(w, d) for d in docs], rtol=1e-5)
    inputs = [np.concatenate(([c.codes], d[:-1])) for d in docs]
    at = lm.boundary_states(w, inputs, size=128, lanes=2)
    whole = lm.states(w, inputs[1][:, None], np.zeros((700, 1), bool), np.zeros((1, lm.HIDDEN)))[0][:, 0]
    assert np.allclose(at[1][1:], whole[127::128][: len(at[1]) - 1], atol=1e-5) and not at[1][0].any()


def test_unknown_words_cost_their_spelling(spark):
    """Held-out texts with more unknown words have a lower score a token, and junk a lower one than words."""
    rng = random.Random(3)
    known = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    texts = []
    for i in range(700):
        w = [rng.choice(known) for _ in range(40)]
        for _ in range(i % 20 if bucket(i, 7) == 2 else rng.randrange(3)):
            w[rng.randrange(40)] = "".join(rng.choice("abcdefgh") for _ in range(8))
        texts.append(" ".join(w))
    junk = next(i for i in range(700, 800) if bucket(i, 7) == 2)
    texts += ["x"] * (junk - 700) + [" ".join("#%{}~^"[rng.randrange(6)] * 9 + str(k) for k in range(40))]
    rows = [r for r in lm.op7(documents(spark, texts)).collect() if r["held_out"] and r["n_tokens"] > 20]
    share = np.array([1 - r["n_known"] / r["n_tokens"] for r in rows])
    score = np.array([r["score"] / r["n_tokens"] for r in rows])
    assert np.corrcoef(share, score)[0, 1] < -0.8
    assert min(rows, key=lambda r: r["score"] / r["n_tokens"])["doc_id"] == junk


def test_mixing_meets_target_and_budget(spark):
    texts = [" ".join(["w"] * (1 + i % 40)) for i in range(600)]
    docs = documents(spark, texts, source=lambda i: None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 4}")
    rows = mixing.mix(docs, entropy=0.97, max_repeats=None, block_tokens=200).collect()
    sizes = {}
    for i, t in enumerate(texts):
        s = None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 4}"
        sizes[s] = sizes.get(s, 0) + len(t.split()) + 1
    total = sum(sizes.values())
    a = rows[0]["exponent"]
    weights = {s: (n / total) ** a for s, n in sizes.items()}
    norm = sum(weights.values())
    share = np.array([w / norm for w in weights.values()])
    assert abs(-(share * np.log(share)).sum() - 0.97 * np.log(len(share))) < 1e-6
    for s, w in weights.items():
        used = sum(r["n_tokens"] for r in rows if r["source"] == s)
        quota = round(w / norm * total)
        assert quota - 41 <= used <= quota
        times = {}
        for r in rows:
            if r["source"] == s:
                times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        assert max(times.values()) <= quota // sizes[s] + 1
    assert mixing.op1(empty(spark)).count() == 0
    whole = mixing.mix_documents(docs, entropy=0.9, cover=True)
    assert whole.columns == docs.columns and whole.select("doc_id").distinct().count() == 600
    assert mixing.op1(documents(spark, ODD)).count() > 0


@pytest.mark.parametrize(("tilt", "side"), [(1, 1), (4, -1)])
def test_exponent_meets_the_target_from_both_sides(spark, monkeypatch, tilt, side):
    """Sources that are too even are sharpened, others levelled; blocks are dealt as a plain recomputation deals them."""
    monkeypatch.setattr(mixing, "STRETCH_BLOCKS", 4)  # many stretches a pass
    sizes = {"a": 90 * tilt, "b": 80, "c": 100, None: 70}
    texts, of = [], []
    for s, n in sizes.items():
        texts += ["w " * (5 + i % 7) for i in range(n)]
        of += [s] * n
    docs = documents(spark, texts, source=lambda i: of[i])
    rows = mixing.mix(docs, entropy=0.95, max_repeats=4.0, block_tokens=100, exponents=(0.0, 8.0))
    got = rows.collect()
    tokens = {s: sum(len(t.split()) + 1 for t, o in zip(texts, of, strict=True) if o == s) for s in sizes}
    total, a = sum(tokens.values()), got[0]["exponent"]
    assert (a > 1) == (side > 0) and a != 1
    share = {r["source"]: r for r in mixing.shares(rows).collect()}
    w = np.array([share[s]["weight"] for s in sizes])
    assert abs(w.sum() - 1) < 1e-9 and abs(-(w * np.log(w)).sum() - 0.95 * np.log(4)) < 1e-6
    assert all(abs(share[s]["share"] - share[s]["weight"]) < 0.02 for s in sizes)
    for s, n in tokens.items():
        own = [r for r in got if r["source"] == s]
        quota = round(share[s]["weight"] * total)
        whole, rest = quota // n, quota % n
        for p in range(whole):
            assert sorted(r["doc_id"] for r in own if r["pass"] == p) == [i for i, o in enumerate(of) if o == s]
        last = [r for r in own if r["pass"] == whole]
        assert rest - 12 < sum(r["n_tokens"] for r in last) <= rest and all(r["pass"] <= whole for r in own)
        # documents of a block are taken from its head on
        taken = {}
        for r in last:
            taken.setdefault(r["block"], []).append(r["place"])
        assert all(sorted(x) == list(range(1, len(x) + 1)) for x in taken.values())
    same = mixing.mix(documents(spark, ["w"] * 40, source=lambda i: f"s{i % 4}"), entropy=0.5)
    assert {r["exponent"] for r in same.collect()} == {1.0} and same.count() == 40


def test_mixture_says_what_stood_in_its_way(spark):
    sizes = [90, 80, 100, 70]
    docs = documents(spark, ["w w w"] * 340, source=lambda i: f"s{next(k for k in range(4) if i < sum(sizes[: k + 1]))}")
    facts = lambda **how: mixing.mix(docs, block_tokens=50, **how).first()
    own = facts()
    p = np.array(sizes) / 340
    natural = -(p * np.log(p)).sum() / np.log(4)
    assert own["limited_by"] == "target" and 0 < own["exponent"] < 1
    assert abs(own["entropy"] - (1 + natural) / 2) < 1e-9 and abs(own["entropy"] - own["target_entropy"]) < 1e-9
    even = facts(entropy=0.5)  # less even than the sources are: they are not sharpened
    assert (even["limited_by"], even["exponent"]) == ("exponents", pytest.approx(1.0, abs=1e-6)) and even["entropy"] > 0.9
    skewed = documents(spark, ["w w w"] * 400, source=lambda i: "a" if i < 390 else f"b{i % 2}")
    held = mixing.mix(skewed, entropy=1.0, max_repeats=2.0, block_tokens=50).first()
    assert held["limited_by"] == "repeats" and held["entropy"] < held["target_entropy"]


def test_mixing_keeps_columns_of_any_name(spark):
    docs = documents(spark, ["a b", "c", None, "d e f"] * 5).withColumnsRenamed({"kept": "row", "rid": "block", "n_words": "pass"})
    docs = docs.union(docs.limit(3)).withColumn("odd.name", F.lit(1))
    out = mixing.mix_documents(docs, entropy=0.9, cover=True, exponents=(0.0, 1.0))
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 20 and out.count() >= 23


def test_covering_keeps_the_limit_on_repeats(spark):
    # a source of ten words beside one that holds a third of all tokens
    source = lambda i: "tiny" if i < 10 else "hot" if i < 210 else f"s{i % 6}"
    docs = documents(spark, ["w"] * 10 + ["w " * 30] * 600, source=source)
    times = {r["doc_id"]: r["count"] for r in mixing.mix_documents(docs, entropy=0.9, max_repeats=4.0, cover=True).groupBy("doc_id").count().collect()}
    assert len(times) == 610 and max(times.values()) <= 4


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    good = [" ".join(f"w{(i * 37 + j * 11) % 997}x{j}" for j in range(80)) for i in range(12)]
    docs = documents(spark, [*good, good[0], good[1] + " tail", "short", None])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(at.select("doc_id").distinct().count())
        if k < 4:
            assert at.columns == docs.columns
    assert counts == [14, 12, 12, 12, 12]
    assert pipeline.run(spark, str(tmp_path)).count() > 0
