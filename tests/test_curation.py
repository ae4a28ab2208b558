import random
import re

import pytest
from pyspark.sql import functions as F

from feedsieve.functions import keys, predicates
from feedsieve.functions import vocab as V
from feedsieve.functions.matchers import known_words, term_count, term_match
from feedsieve.operators import curate as C
from feedsieve.operators import dedup as D

ITEM = "arrival long, observed_s long, source_id string, source_name string, title string, link string, summary string, published_s long, published_has_tz boolean, official boolean, impact int, guid string, year int"


def item(arrival, title, summary="", link="", official=False, impact=40, observed=1_000_000, published=None, source="x", guid=None):
    return (arrival, observed, source, source, title, link, summary, observed - 3600 if published is None else published, True, official, impact, guid, 2026)


def judge(spark, titles, **how):
    rows = spark.createDataFrame([item(i, t, **how) for i, t in enumerate(titles)], ITEM)
    return {r["arrival"]: r for r in predicates.with_gates(rows).collect()}


@pytest.mark.parametrize(
    ("gate", "yes", "no"),
    [
        ("is_upcoming_speech", ["Powell to testify before Congress", "Trump will speak at noon", "Lagarde scheduled remarks on rates"], ["Powell spoke to senators", "Local mayor to speak", "Bitcoin to rally"]),
        ("is_forecast", ["Bitcoin could reach $200K", "Analysts expect cuts", "Bank raises price target on Apple"], ["CPI prints 3.2%, hotter than forecast", "Fed cuts rates"]),
        ("is_technical_analysis", ["Golden cross forms on ETH", "BTC tests key support at $50,000"], ["SEC support for new rules grows"]),
        ("is_memecoin_pump", ["Pepe soars 40%"], ["Dogecoin listed on exchange", "Bitcoin soars 4%"]),
        ("has_real_event", ["Visa acquires startup", "OPEC meets", "Bitcoin falls"], ["Visa thoughts", "Smallcoin falls"]),
        ("is_historical", ["Lessons from the 2021 bull market", "Why 2022 changed crypto"], ["Yields hit highest since 2021", "Fed cuts rates"]),
        ("is_routine_move", ["Market wrap for Tuesday", "Stocks up 0.4%"], ["Fed cuts rates"]),
        ("is_ad", ["Sponsored: buy now", "Best coins to buy"], ["Fed cuts rates"]),
        ("matches_keywords", ["Gold climbs", "S&P 500 slips"], ["Canada boils"]),
    ],
)
def test_gates(spark, gate, yes, no):
    got = judge(spark, yes + no)
    assert [got[i][gate] for i in range(len(yes + no))] == [True] * len(yes) + [False] * len(no)


def test_noise_rules_and_exemptions(spark):
    titles = ["In 2019 the token began", "Opinion on money", "Why is money round"]
    assert [judge(spark, titles)[i]["noise_rule"] for i in range(3)] == ["R", "B", "D"]
    assert [judge(spark, titles, official=True)[i]["noise_rule"] for i in range(3)] == [None] * 3
    assert judge(spark, ["Fed cuts rates"], link="https://a/learn/x")[0]["noise_rule"] == "U"


#: Headlines by the class that they stand for.
NOISE = [
    "In 2019 Visa opened its first lab", "The 2018 credit crunch revisited", "Back in 2016 miners were few", "Looking back at the dot-com years", "Year in review: coins and banks",
    "This day in history: the first block", "What happened to the old exchanges", "The rise and fall of a lender", "Op-ed: taxes are too high", "In my opinion banks are wrong",
    "Experts say prices mislead", "Editorial: rules are overdue", "Why is money round",
]
NEWS = ["The Fed cuts rates by 25 basis points", "SEC sues exchange over staking", "Visa acquires payments startup for $2bn", "Bitcoin falls 8% after CPI release", "ECB holds rates, signals pause"]


def test_example_headlines(spark):
    got = judge(spark, NOISE + NEWS)
    assert all(got[i]["noise_rule"] for i in range(len(NOISE))), [NOISE[i] for i in range(len(NOISE)) if not got[i]["noise_rule"]]
    assert [(t, got[len(NOISE) + i]["reject_reason"]) for i, t in enumerate(NEWS)] == [(t, None) for t in NEWS]


@pytest.mark.parametrize(
    ("title", "reason"),
    [
        ("Bitcoin could hit $300K by winter", "horoscope"), ("Analysts expect gold to climb", "non_news"), ("BTC eyes support at $40K, resistance at $45K", "non_news"), ("Shiba soars 60% overnight", "memecoin"),
        ("Sponsored: win free coins today", "ad"), ("A recipe for plum pie", "off_topic"), ("Ceasefire talks resume near the border", "no_anchor"), ("Gold steady ahead of data", "no_event"),
    ],
)
def test_reasons_of_examples(spark, title, reason):
    assert judge(spark, [title])[0]["unpublished"] == reason
    assert judge(spark, ["Ceasefire talks push oil prices up"])[0]["unpublished"] is None


def test_score(spark):
    got = judge(spark, ["Fed approves spot ETF for Bitcoin, Ethereum", "Nikkei outlook", "Quiet day"], impact=40)
    assert [got[i]["score"] for i in range(3)] == [40 + 36 + 10, 0, 40]


def test_null_texts_do_not_fail(spark):
    rows = spark.createDataFrame([(1, 0, None, None, None, None, None, None, True, False, 10, None, 2026)], ITEM)
    assert predicates.with_gates(rows).first()["reject_reason"] == "off_topic"


def test_terms_match_whole_words_longest_first(spark):
    df = spark.createDataFrame([("canada boil core cpi, eur/usd ada",)], "t string")
    words = ("ada", "oil", "core cpi", "cpi", "eur/usd")
    assert df.select(term_count(F.col("t"), words)).first()[0] == 3
    assert df.select(term_match(F.col("t"), ("oil",))).first()[0] is False


def story(spark, titles):
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    return [r[0] for r in df.select(keys.story_key(F.col("t"))).collect()]


@pytest.mark.parametrize(("a", "b", "same"), [("BTC drops to $59K", "Bitcoin falls to $59,000", True), ("Rate at 7,25%", "Rate at 7.25%", True), ("Meta announces glasses", "Meta unveils glasses", True), ("Meta announces glasses", "Meta cancels glasses", False), ("Bitcoin surges", "BTC surges", False)])
def test_story_keys(spark, a, b, same):
    x, y = story(spark, [a, b])
    assert (x == y) is same


def test_subject_key_ignores_numbers(spark):
    df = spark.createDataFrame([("SpaceX IPO raises $10bn",), ("SpaceX IPO raises $12bn",), ("Zuckerberg sells",)], "t string")
    a, b, c = (r[0] for r in df.select(keys.subject_key(F.col("t"))).collect())
    assert a == b != c


def test_uid_prefers_guid_then_link(spark):
    df = spark.createDataFrame([("g", "l", "s", "t"), ("", "l", "s", "t"), (None, None, "s", "t")], "g string, l string, s string, t string")
    assert len({r[0] for r in df.select(keys.uid(*map(F.col, "glst"))).collect()}) == 3


def test_age(spark):
    rows = [(0, 3600 * h, tz) for h, tz in ((1, True), (24, True), (25, True), (None, True), (1, False), (-1, True)) if h is not None]
    df = spark.createDataFrame([(10**6, 10**6 - s if s else None, tz) for _, s, tz in rows] + [(10**6, None, True)], "observed_s long, published_s long, published_has_tz boolean")
    assert [r[0] for r in df.select(predicates.age_reason()).collect()] == [None, None, "old", "naive_date", "future", "no_date"]


@pytest.mark.parametrize(("window", "most", "strict"), [(6, 1, False), (12, 2, True), (5, 3, True)])
def test_windows_equal_a_plain_loop(spark, window, most, strict):
    rng = random.Random(window)
    rows = [(f"k{rng.choice('aabc')}", rng.randrange(200), i) for i in range(400)]
    want, state = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        held = [x for x in state.get(k, []) if (t - x < window if strict else t - x <= window)]
        want[i] = len(held) < most
        state[k] = held + [t] * want[i]
    df = spark.createDataFrame(rows, "key string, t long, arrival long")
    got = D.accept_window(df, "key", "t", window, most, strict)
    assert {r["arrival"]: r["accepted"] for r in got.collect()} == want


def test_windows_of_a_hot_key_are_cut_at_silences(spark):
    """One key with most of the times: its segments lie in many parts, and none has more than its own times."""
    rng, t, rows = random.Random(5), 0, []
    for i in range(6000):
        t += rng.choice((1, 1, 1, 2, 30))
        rows.append(("hot" if i % 20 else f"k{i % 7}", t, i))
    rows += [(None, x, 10_000 + x) for x in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "key string, t long, arrival long")
    times = df.select(F.col("key").alias("_key"), F.col("t").alias("_time"), F.lit(1).alias("_n"))
    cut = D.segments(times, 6).groupBy("_key", "_segment").agg(F.min("_time").alias("a"), F.max("_time").alias("b"), F.count("*").alias("n")).collect()
    plain, last = {}, {}
    for k, x, _ in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if k not in last or x - last[k] > 6:
            plain.setdefault(k, []).append([x, x, 0])
        plain[k][-1][1:] = [x, plain[k][-1][2] + 1]
        last[k] = x
    assert sorted((r["_key"] or "", r["a"], r["b"], r["n"]) for r in cut) == sorted((k or "", *s) for k, many in plain.items() for s in many)
    assert len(plain["hot"]) > 500 and len(plain[None]) == 1
    want, state = {}, {}
    for k, x, i in sorted(rows, key=lambda r: (r[1], r[2])):
        held = [y for y in state.get(k, []) if x - y <= 6]
        want[i] = len(held) < 1
        state[k] = held + [x] * want[i]
    assert {r["arrival"]: r["accepted"] for r in D.accept_window(df, "key", "t", 6).collect()} == want


def test_exact_dedup_keeps_first_arrival(spark):
    df = spark.createDataFrame([("u", 0, 2), ("u", 0, 1), ("v", 0, 3), ("u", 30, 4)], "uid string, cycle_s long, arrival long")
    ledger = spark.createDataFrame([("v",)], "uid string")
    assert sorted(r["arrival"] for r in D.exact_dedup(df, ledger).collect()) == [1, 4]


def test_budget_equals_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(d, i, rng.randrange(101), rng.random() < 0.2, rng.choice((1, 2))) for d in range(6) for i in range(60)]
    want = {}
    for d in range(6):
        used, limit = 0, 25
        for _, i, impact, official, cost in [r for r in rows if r[0] == d]:
            left = limit - used
            ok = left > max(1, limit // 5) or (left > 0 and (official or impact >= 50)) or (left <= 0 and (official or impact >= 80))
            want[d, i] = ok
            used += cost * ok
    df = spark.createDataFrame(rows, "day long, seq long, impact int, official boolean, cost int")
    assert {(r["day"], r["seq"]): r["passed"] for r in C.daily_budget(df, 25).collect()} == want


def test_curate_caps_a_burst(spark):
    names = ["Visa", "Oracle", "Netflix", "Walmart", "Chevron", "Broadcom", "Palantir", "Exxon"]
    rows = spark.createDataFrame([item(i, f"{n} acquires rival for cash, SEC approves", observed=10_000_020 + i, guid=str(i)) for i, n in enumerate(names)], ITEM)
    assert C.curate(rows, cycle_seconds=3600).count() == 3
    assert C.curate(rows, most=0, cycle_seconds=3600).count() == 8


def test_hot_key_is_folded_by_times_not_rows(spark):
    rows = [("", i // 500, i) for i in range(20_000)] + [("a", 3, 1)]
    df = spark.createDataFrame(rows, "key string, t long, arrival long")
    got = D.accept_window(df, "key", "t", 5, 2)
    want, held = set(), []
    for _, t, i in rows[:-1]:
        held = [x for x in held if t - x <= 5]
        if len(held) < 2:
            held.append(t)
            want.add(i)
    accepted = got.where("accepted AND key = ''")
    assert {r["arrival"] for r in accepted.collect()} == want and got.count() == len(rows)
    assert D.accept_window(df, "key", "t", 5, 2, skip_empty=True).where("accepted").count() == len(rows)


def test_funnel_adds_up(spark):
    names = ["Visa", "Oracle", "Netflix", "Walmart", "Chevron"]
    rows = [item(i, f"{n} acquires rival for cash, SEC approves", observed=10_000_020 + i, guid=str(i)) for i, n in enumerate(names)]
    rows += [item(10 + i, "Visa acquires rival for cash, SEC approves", observed=10_000_040 + i, guid=f"v{i}") for i in range(3)]
    rows += [item(20, "A recipe for pie", observed=10_000_050, guid="r"), item(21, "SEC sues", observed=10_000_060, published=1, guid="o"), item(22, "Visa again", observed=20_000_000, guid="z")]
    got = {r["cycle_s"]: r.asDict() for r in C.full_funnel(spark.createDataFrame(rows, ITEM), cycle_seconds=3600).collect()}
    first = got[min(got)]
    assert (first["fetched"], first["old"], first["kept"], first["new"], first["over_cap"], first["queued"]) == (10, 1, 8, 8, 5, 3)
    # with the cycle full after three, nothing more is looked at; without a cap the retellings are
    open_ = {r["cycle_s"]: r for r in C.full_funnel(spark.createDataFrame(rows, ITEM), most=0, cycle_seconds=3600).collect()}[min(got)]
    assert (open_["story_dup"], open_["queued"], open_["over_cap"]) == (3, 5, 0) and len(got) == 2
    assert all(r["new"] == r["story_dup"] + r["subject_capped"] + r["over_cap"] + r["queued"] for r in got.values())


def test_write_up_and_record(spark, tmp_path):
    base = "uid string, story_key string, source_id string, source_name string, title string, summary string, link string, official boolean, published_s long, observed_s long, year int, is_upcoming_speech boolean, score int, arrival long, day long"
    row = lambda i, official=False, score=50: (f"u{i}", f"s{i}", "x", "Wire", f"Visa buys lab {i} for $5bn", "", f"https://a.example/{i}", official, 0, 86400 + i, 2026, False, score, i, 1)
    queued = spark.createDataFrame([row(0, True, 90), row(1), row(2), row(3), row(4, score=20), row(5, score=10)], base)
    text = "ПРЕФИКС: ⚡️\nТЕКСТ: Visa покупает лабораторию за $5 млрд\nТИКЕРЫ: V"
    generated = spark.createDataFrame([("u0", "m", text), ("u1", "m", '{"prefix": "", "text": "Visa покупает лабораторию за $5 млрд", "tickers": ""}'), ("u2", "m", "ТЕКСТ: мало"), ("u4", "m", text), ("u5", "m", text)], "uid string, provider string, raw string")
    got = {r["uid"]: r for r in C.write_up(queued, generated, limit=5).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"u0": "sent", "u1": "sent", "u2": "too_few_words", "u3": "no_text", "u4": "sent", "u5": "budget"}
    assert got["u0"]["editor_used"] and not got["u1"]["editor_used"] and "Visa покупает" in got["u0"]["post"] and "«" not in got["u0"]["post"]
    paths = [str(tmp_path / x) for x in ("sent", "archive", "rejected")]
    C.record(C.write_up(queued, generated, limit=5), *paths)
    C.record(C.write_up(queued, generated, limit=5), *paths)
    sent = spark.read.parquet(paths[0])
    assert sorted(r["uid"] for r in sent.collect()) == ["u0", "u1", "u4"]
    archive = spark.read.parquet(paths[1])
    assert "dt" in archive.columns and archive.where("uid = 'u1'").first()["editor_used"] is False and archive.count() == 3
    assert sorted(r["outcome"] for r in spark.read.parquet(paths[2]).collect()) == ["budget", "no_text", "too_few_words"]
    seen = C.write_up(queued, generated, limit=5, ledger=sent.where("uid = 'u0'"))
    assert {r["uid"]: r["outcome"] for r in seen.collect()} == {"u0": "seen", "u1": "sent", "u2": "too_few_words", "u3": "no_text", "u4": "sent", "u5": "sent"}
    left = C.status_metrics(sent.withColumn("sent_s", F.unix_seconds("sent_at")), F.lit(86400 + 100), limit=10).first()
    assert (left["budget_used"], left["budget_left"], left["published"]) == (3, 7, 3)


def test_terms_that_are_looked_up_equal_terms_that_are_searched_for(spark):
    rng = random.Random(5)
    vocabularies = (V.TIER1, V.CATALYST, V.EVENT, V.RELEVANT)
    parts = [t for v in vocabularies for t in v] + ["the", "a-b", "x", "'", "etf's", "bitcoins", "2024", "банк", ""]
    texts = ["".join(rng.choice(parts) + rng.choice((" ", " ", "-", "", ", ", "'", "  ")) for _ in range(rng.randint(0, 9))) for _ in range(800)]

    def searched(text, terms):
        whole = sorted((t for t in terms if re.fullmatch("[a-z0-9 '-]+", t)), key=lambda t: -len(t))
        found = re.findall("(?<![a-z0-9])(?:" + "|".join(map(re.escape, whole)) + ")(?![a-z0-9])", text)
        return len(set(found)) + sum(t in text for t in terms if t not in whole)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("w", known_words(F.col("t"), *vocabularies))
    wanted = [c for v in vocabularies for c in (term_count(F.col("t"), v, F.col("w")), term_match(F.col("t"), v))]
    for i, *got in df.select("i", *wanted).collect():
        n = [searched(texts[i], v) for v in vocabularies]
        assert got == [x for k in n for x in (k, k > 0)], texts[i]
