"""What is emitted, against one loop over cycles; ledgers and streams under failures."""

import random

import pytest
from pyspark.sql import functions as F

from feedsieve.operators import curate as C
from feedsieve.operators import emission as M
from feedsieve.operators import posts
from feedsieve.functions import text as T
from feedsieve.plans.items import redelivered
from feedsieve.sources import feeds, ledgers
from feedsieve.streaming import stream as S
from tests.test_curation import ITEM, item

CANDIDATE = "cycle_s long, rank int, arrival long, uid string, story_key string, subject_key string, title string"
HOUR = 3600


def loop(rows, most, sent=()):
    """What a poller does, cycle after cycle, with everything in memory."""
    seen, stories, subjects, out = {u for _, u, _, _ in sent}, [(c, s) for c, _, s, _ in sent], [(c, j) for c, _, _, j in sent], {}
    filled = {}
    for c, _, _, _ in sent:
        filled[c] = filled.get(c, 0) + 1
    for cycle, _, arrival, uid, story, subject, _ in sorted(rows, key=lambda r: r[:3]):
        if uid in seen:
            out[arrival] = "seen"
        elif most > 0 and filled.get(cycle, 0) >= most:
            out[arrival] = "cycle_cap"
        elif any(s == story and cycle - c <= 6 * HOUR for c, s in stories):
            out[arrival] = "story"
        elif sum(j == subject and cycle - c < 12 * HOUR for c, j in subjects) >= 2:
            out[arrival] = "subject"
        else:
            out[arrival] = "queued"
            seen.add(uid)
            stories.append((cycle, story))
            subjects.append((cycle, subject))
            filled[cycle] = filled.get(cycle, 0) + 1
    return out


def deliveries(seed, n=2000, hours=200, stories=60, subjects=9):
    """Entries that a feed delivers for some hours, and sometimes once more days later."""
    rng = random.Random(seed)
    rows = {}
    while len(rows) < n:
        uid, first = f"u{len(rows)}", rng.randrange(hours)
        story, subject = f"s{rng.randrange(stories)}", f"j{rng.randrange(subjects)}"
        for k in [*range(rng.randint(1, 8)), *rng.choice([[], [], [90]])]:
            rows[first + k, uid] = (story, subject)
    made, rank = [], {}
    for i, ((at, uid), (story, subject)) in enumerate(rows.items()):
        rank[at] = rank.get(at, 0) + 1
        made.append((at * HOUR + 10_000_800, rank[at], i, uid, story, subject, "t"))
    return made


@pytest.mark.parametrize(("seed", "most", "slice_hours"), [(1, 3, 60), (2, 0, 80), (3, 1, 24000)])
def test_emission_equals_one_loop(spark, seed, most, slice_hours):
    rows = deliveries(seed)
    got = M.decided(spark.createDataFrame(rows, CANDIDATE), M.Limits(most), slice_hours=slice_hours).collect()
    assert {r["arrival"]: r["outcome"] for r in got} == loop(rows, most) and len(got) == len(rows)
    queued = [r["uid"] for r in got if r["outcome"] == "queued"]
    assert len(queued) == len(set(queued)) > 50
    # what was passed over in one cycle is queued in another
    assert most == 0 or {r["uid"] for r in got if r["outcome"] == "cycle_cap"} & set(queued)


def test_emission_goes_on_from_what_was_sent(spark):
    rows = deliveries(5, 600)
    first = min(r[0] for r in rows)
    sent = [(first - 2 * HOUR, "x", "s1", "j1"), (first, "y", "s2", "j1"), (first, "z", "s3", "j2")]
    table = spark.createDataFrame(sent, "cycle_s long, uid string, story_key string, subject_key string")
    got = M.decided(spark.createDataFrame(rows, CANDIDATE), M.Limits(3), table, slice_hours=100).collect()
    assert {r["arrival"]: r["outcome"] for r in got} == loop(rows, 3, sent)


def test_emission_of_nothing_and_of_one_hot_key(spark):
    assert M.decided(spark.createDataFrame([], CANDIDATE)).count() == 0
    rows = [(HOUR * (i % 40), i, i, f"u{i % 700}", "", "", "t") for i in range(3000)]
    rows = list({(r[0], r[3]): r for r in rows}.values())
    got = M.decided(spark.createDataFrame(rows, CANDIDATE), M.Limits(2), slice_hours=20).collect()
    assert {r["arrival"]: r["outcome"] for r in got} == loop(rows, 2)


def test_state_forgets_what_is_over():
    state = M.State(M.Limits(3))
    for k in range(20_000):
        state.visit(k * HOUR, f"u{k}", k * HOUR - 1, f"s{k}", f"j{k}")
    assert len(state.marks) <= 1100 and len(state.uids) <= 1100
    assert len(state.at(20_000 * HOUR)) == 12


def test_coupling_where_steps_alone_differ(spark):
    """A story whose first copy the cap cuts is not told yet, so its second copy is queued."""
    rows = [(0, 1, 0, "a", "s0", "j0", ""), (0, 2, 1, "b", "s1", "j1", ""), (HOUR, 1, 2, "c", "s1", "j1", "")]
    got = M.decided(spark.createDataFrame(rows, CANDIDATE), M.Limits(1)).collect()
    assert {r["arrival"]: r["outcome"] for r in got} == {0: "queued", 1: "cycle_cap", 2: "queued"}


@pytest.mark.parametrize("most", [3, 0])
def test_the_fold_sees_few_rows_of_crowded_cycles(spark, monkeypatch, most):
    """Copies that are delivered in three cycles: what it takes to decide does not grow with their number."""
    rng = random.Random(7)
    rows = []
    for first, s in {(rng.randrange(60), rng.randrange(40)) for _ in range(150)}:
        for copy in range(20):
            rows += [(HOUR * (first + k) + 10_000_800, rng.random(), f"u{first}-{s}-{copy}", f"s{s}", f"j{s % 9}") for k in range(3)]
    rows.sort()
    rank, made = {}, []
    for i, (cycle, _, uid, story, subject) in enumerate(rows):
        rank[cycle] = rank.get(cycle, 0) + 1
        made.append((cycle, rank[cycle], i, uid, story, subject, "t"))
    frame = spark.createDataFrame(made, CANDIDATE)
    narrowed, seen = M.narrowed, []

    def counted(rows):
        left = narrowed(rows, 0)
        seen.append((M.contenders(rows).count(), left.count()))
        return left

    monkeypatch.setattr(M, "narrowed", counted)
    got = M.decided(frame, M.Limits(most), slice_hours=20).collect()
    assert {r["arrival"]: r["outcome"] for r in got} == loop(made, most) and len(got) == len(made)
    (once, left), groups = seen[0], len({(r[0], r[4], r[5]) for r in made})
    assert left < 3 * groups < once < len(made)


def test_a_story_that_never_ends_takes_few_passes(spark, monkeypatch):
    """Its copies go out every seven hours, in a beat that each slice takes over from the one before."""
    rows = [(HOUR * i, 1, i, f"u{i}", "s", f"j{i}", "") for i in range(700)]
    frame = spark.createDataFrame(rows, CANDIDATE)
    passes, run = [], type(frame).mapInPandas
    monkeypatch.setattr(type(frame), "mapInPandas", lambda *how: passes.append(1) or run(*how))
    got = M.decided(frame, M.Limits(3), slice_hours=20).collect()
    assert {r["arrival"]: r["outcome"] for r in got} == loop(rows, 3)
    assert len(passes) <= 6


def test_what_was_sent_is_not_emitted_days_later(spark):
    rows = [(HOUR * 24 * 30, 1, 0, "x", "s0", "j0", ""), (HOUR * 24 * 30, 2, 1, "y", "s0", "j0", ""), (0, 1, 2, "z", "s1", "j1", "")]
    sent = spark.createDataFrame([(0, "x", "s0", "j0")], "cycle_s long, uid string, story_key string, subject_key string")
    got = M.decided(spark.createDataFrame(rows, CANDIDATE), M.Limits(3), sent).collect()
    assert {r["arrival"]: r["outcome"] for r in got} == {0: "seen", 1: "queued", 2: "queued"} == loop(rows, 3, [(0, "x", "s0", "j0")])


@pytest.mark.parametrize("few", [100_000, 0])
def test_entries_are_judged_once_and_delivered_often(spark, monkeypatch, few):
    """A content is judged once, whatever is missing in it, and decisions on the deliveries are as if each had been judged."""
    good, at = "acquires rival for cash, SEC approves", 10_000_800
    rows = [item(i, f"{n} {good}", observed=at + 900 * i, published=at - 60, guid=f"g{i % 17}", link=link, official=i % 5 == 0) for i, (n, link) in enumerate((n, link) for n in TITLES for link in (None, "https://x.example/LEARN/1", "https://x.example/story/2", "") for _ in range(3))]
    rows += [item(100 + i, None, summary=None, observed=at + i, published=None if i % 2 else at, guid=None, link=None, official=True) for i in range(4)]
    entries = spark.createDataFrame(rows, ITEM)
    monkeypatch.setattr(C, "FEW_CONTENTS", few)
    seen, with_gates = [], C.predicates.with_gates

    def counted(frame, *how):
        seen.append(frame.count())
        return with_gates(frame, *how)

    monkeypatch.setattr(C.predicates, "with_gates", counted)
    got = C.decisions_of_deliveries(entries, redelivered, cycle_seconds=HOUR).collect()
    assert len(seen) == 1 and seen[0] <= 2 * 2 * len(TITLES) + 1
    expected = C.decisions(redelivered(entries), cycle_seconds=HOUR).collect()
    pairs = lambda found: sorted((r["arrival"], r["cycle_s"], r["uid"], r["rank"], r["story_key"], r["subject_key"], r["outcome"]) for r in found)
    assert pairs(got) == pairs(expected) and {r["outcome"] for r in got} >= {"queued", "seen", "story"}


TITLES = ["Visa", "Oracle", "Netflix", "Walmart", "Chevron"]


def test_curate_retries_and_emits_once(spark):
    rows = [item(10 * h + i, f"{n} acquires rival for cash, SEC approves", observed=10_000_800 + HOUR * h + i, published=10_000_000, guid=str(i)) for h in range(3) for i, n in enumerate(TITLES)]
    got = C.curate(spark.createDataFrame(rows, ITEM), cycle_seconds=HOUR).collect()
    assert sorted(r["uid"] for r in got) == sorted({r["uid"] for r in got}) and len(got) == 5
    assert sorted(r["arrival"] for r in got) == [0, 1, 2, 13, 14]


def test_stale_items_count_as_seen(spark):
    good, at = "Visa acquires rival for cash, SEC approves", 10_000_800
    rows = [item(1, good, observed=at, published=at - 30 * HOUR, guid="g"), item(2, good, observed=at + HOUR, published=at, guid="g"), item(3, good, observed=at, published=at - 60, guid="h")]
    assert [r["arrival"] for r in C.curate(spark.createDataFrame(rows, ITEM), cycle_seconds=HOUR).collect()] == [3]
    official = [item(1, "Lessons from the 2021 bull market: SEC sues", observed=at, official=True)]
    assert C.kept(spark.createDataFrame(official, ITEM), cycle_seconds=HOUR).count() == 1


def batches(at=10_000_820):
    names = [["Visa", "Oracle"], ["Netflix", "Walmart"]]
    return [[item(2 * k + i, f"{n} acquires rival for cash, SEC approves", observed=at + 7 * HOUR * k + i, guid=f"{k}{i}") for i, n in enumerate(pair)] for k, pair in enumerate(names)]


@pytest.mark.parametrize("fails", ["emit", "after_emit", "ledger"])
def test_a_killed_batch_ends_with_one_row_in_each_table(spark, tmp_path, monkeypatch, fails):
    sent, rejected, out = (str(tmp_path / x) for x in ("sent", "rejected", "out"))
    write = S.to_folder(out)
    broken = {"on": False}

    def emit(rows, batch_id):
        if broken["on"] and fails == "emit":
            raise RuntimeError("killed")
        write(rows, batch_id)
        if broken["on"] and fails == "after_emit":
            raise RuntimeError("killed")

    append = ledgers.append_sent

    def appended(rows, path, days=None):
        n = append(rows, path, days)
        if broken["on"] and fails == "ledger":
            raise RuntimeError("killed")
        return n

    monkeypatch.setattr(ledgers, "append_sent", appended)
    run = S.curate_batch(sent, rejected, emit)
    for k, rows in enumerate(batches()):
        frame = spark.createDataFrame([*rows, item(90 + k, "Visa again", observed=rows[0][1], published=1, guid=f"old{k}")], ITEM)
        if k == 1:
            broken["on"] = True
            with pytest.raises(RuntimeError):
                run(frame, k)
            broken["on"] = False
            if fails == "ledger":  # what was emitted is in the ledger, so the batch that is run again has nothing to emit
                run(frame, 100)
                assert spark.read.parquet(f"{out}/batch=100").count() == 0
                continue
        run(frame, k)
    assert sorted(r["guid"] for r in spark.read.parquet(*[f"{out}/batch={k}" for k in range(2)]).collect()) == ["00", "01", "10", "11"]
    assert spark.read.parquet(sent).count() == spark.read.parquet(sent).select("uid").distinct().count() == 4
    assert spark.read.parquet(rejected).select("uid").distinct().count() == spark.read.parquet(rejected).count() == 2


def test_ledgers_are_read_by_day_and_compacted(spark, tmp_path):
    path = str(tmp_path / "sent")
    row = lambda uid, day: (uid, "s", "x", "t", "l", day)
    frame = lambda rows: spark.createDataFrame([row(*r) for r in rows], "uid string, story_key string, source_id string, title string, link string, day long").withColumn("sent_at", F.timestamp_seconds(F.col("day") * 86400 + 5))
    for k in range(4):
        ledgers.append_sent(frame([(f"u{d}{k}", 19_000 + d) for d in range(3)]), path)
    assert ledgers.append_sent(frame([("u00", 19_002), ("new", 19_002)]), path) == 1
    late = ledgers.read(spark, path, ledgers.SENT, F.date_from_unix_date(F.lit(19_002)))
    assert sorted(r["uid"] for r in late.collect()) == ["new", *[f"u2{k}" for k in range(4)]]
    assert len(late.inputFiles()) < len(ledgers.read(spark, path, ledgers.SENT).inputFiles()) or "PartitionFilters: [isnotnull(dt" in late._jdf.queryExecution().toString()
    day = spark.range(1).select(F.date_from_unix_date(F.lit(19_002)).cast("string")).first()[0]
    assert ledgers.compact(spark, path, day) == 2
    assert len(list((tmp_path / "sent").glob("dt=*/part-*"))) == 2 + 5
    assert ledgers.read(spark, path, ledgers.SENT).select("uid").distinct().count() == 13 == ledgers.read(spark, path, ledgers.SENT).count()


def _land(df, path):
    df.coalesce(1).write.mode("append").parquet(str(path))


def test_windows_start_from_a_ledger(spark, tmp_path):
    schema = "story_key string, cycle_s long, arrival long"
    _land(spark.createDataFrame([("a", 10 * 86400, 1), ("b", 10 * 86400, 2), ("a", 10 * 86400 + 7 * HOUR, 3)], schema), tmp_path / "in")
    earlier = spark.createDataFrame([("a", 10 * 86400 - HOUR), ("b", 10 * 86400 - 7 * HOUR), ("c", 5)], "story_key string, cycle_s long")
    live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = S.stream_story_dedup(live, earlier=earlier).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r["arrival"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: False, 2: True, 3: True}


@pytest.mark.parametrize("files", [1, 4])
def test_stream_counters_equal_batch(spark, tmp_path, files):
    titles = ["Visa acquires rival, SEC approves", "A recipe for pie", "Why 2022 changed crypto", "Bitcoin could hit $300K by winter"]
    rows = [item(i, titles[i % 4], observed=10_000_800 + 600 * i, published=1 if i % 7 == 0 else None) for i in range(60)]
    frame = spark.createDataFrame(rows, ITEM)
    for k in range(files):
        _land(frame.where(f"floor(arrival * {files} / 60) = {k}"), tmp_path / "in")
    live = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, make, batch, key in (("funnel", S.stream_funnel, C.funnel(C.judged(frame, HOUR)), ["cycle_s"]), ("source", S.stream_source_counts, C.per_source_counts(frame.withColumn("cycle_s", C.cycle_start(F.col("observed_s"), HOUR))), ["cycle_s", "source_id"])):
        latest = {}
        keep = lambda df, _: latest.update({tuple(r[k] for k in key): r.asDict() for r in df.collect()})  # noqa: B023, E731
        make(live, HOUR).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        assert latest == {tuple(r[k] for k in key): r.asDict() for r in batch.collect()}


def test_alerts_follow_a_calendar_that_changes(spark, tmp_path):
    from feedsieve.operators import calendar as A
    from tests.test_events_and_text import raw

    # target of the 1h alert: 13:00 UTC
    state = {"entries": [{"tz": "UTC", "time": "2026-01-15 14:00"}]}
    posts_, at = [], 1768485600
    run = S.alert_batch(lambda s: A.load(raw(s, *state["entries"])), str(tmp_path / "fired"), lambda df, _: posts_.extend(df.collect()))
    tick = lambda minutes: spark.createDataFrame([(at - HOUR + 60 * minutes,)], "tick_s long")
    state["entries"] = [{"tz": "UTC", "time": "2026-01-15 14:00", "status": "cancelled"}]
    run(tick(1), 0)
    assert posts_ == []
    state["entries"] = [{"tz": "UTC", "time": "2026-01-15 14:30"}]  # moved by half an hour
    run(tick(10), 1)
    assert posts_ == []
    run(tick(31), 2)
    run(tick(32), 3)
    assert len(posts_) == 1 and posts_[0]["event_id"].endswith("T1430Z")


def test_recent_once_and_stream_items(spark, tmp_path):
    schema = "uid string, observed_at timestamp"
    for rows in ([("a", 1_000_000), ("b", 1_000_001), ("a", 1_000_002)], [("a", 1_000_050), ("c", 1_000_060)]):
        _land(spark.createDataFrame(rows, "uid string, s long").select("uid", F.timestamp_seconds("s").alias("observed_at")), tmp_path / "in")
    live = feeds.stream_items(spark, str(tmp_path / "in"), schema)
    assert live.isStreaming and live.columns == ["uid", "observed_at"]
    S.recent_once(live).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["uid"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_post_gates(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    hour = lambda h: F.lit(h * HOUR)
    assert one(posts.is_recent(hour(1), hour(2), 1)) and not one(posts.is_recent(hour(1), hour(3), 1)) and not one(posts.is_recent(F.lit(None).cast("long"), hour(3), 1))
    assert one(posts.gated_prefix(F.lit("⚡ x"), F.lit(False), F.lit(True))) == posts.BOLT
    assert one(posts.gated_prefix(F.lit("⚡ x"), F.lit(False), F.lit(False))) == ""
    assert one(posts.gated_prefix(F.lit("🇺🇸⚡"), F.lit(True), F.lit(False))) == posts.WARNING
    assert one(posts.gated_prefix(F.lit("🇺🇸⚡"), F.lit(False), F.lit(False))) == "🇺🇸"
    residual = lambda t: one(T.has_residual_artifact(F.lit(t)))
    assert residual("выручка [сумма не указана]") and residual("Представитель компании сообщил") and not residual("Представитель компании: «да»") and not residual("Visa buys")


def test_generated_texts_meet_their_items(spark):
    items = spark.createDataFrame([("u", "Visa buys"), ("v", "Gold")], "uid string, title string")
    generated = spark.createDataFrame([("u", "m", '{"prefix": "⚡", "text": "ok", "tickers": ""}'), ("w", "m", "ТЕКСТ: x")], "uid string, provider string, raw string")
    rows = posts.reference_check(generated, items).collect()
    assert [(r["uid"], r["text"], r["title"]) for r in rows] == [("u", "ok", "Visa buys")]
    checked = spark.createDataFrame([("a", None), ("b", "empty")], "post string, problem string")
    out, rejected = posts.emitted_and_rejected(checked)
    assert [r["post"] for r in out.collect()] == ["a"] and [r["problem"] for r in rejected.collect()] == ["empty"]
