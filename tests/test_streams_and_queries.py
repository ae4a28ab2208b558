import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from feedsieve import registry
from feedsieve.operators import dedup as D
from feedsieve.streaming import stream as S

SF = "/root/testdata/sf0.001"


def test_batch_equals_stream(spark, tmp_path):
    rows = [("a" if i % 3 else "b", 864000 + i * 3600, i) for i in range(40)]
    df = spark.createDataFrame(rows, "story_key string, cycle_s long, arrival long")
    for k in range(2):  # two files in order of time
        df.where(f"floor(arrival / 20) = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = S.stream_story_dedup(live).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r["arrival"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["arrival"]: r["accepted"] for r in D.story_dedup(df, order=("arrival",)).collect()}
    assert got == want


def windowed(spark, tmp_path, make, df, files):
    for k in range(files):
        df.where(f"part = {k}").drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = make(live).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(180)
    return {r["arrival"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}, run


@pytest.mark.parametrize("files", [1, 3])
def test_subject_cap_over_any_split_of_the_stream(spark, tmp_path, files):
    rows = [(f"k{i % 3}", 864000 + i * 1800, i, i * files // 60) for i in range(60)]
    df = spark.createDataFrame(rows, "subject_key string, cycle_s long, arrival long, part int")
    got, _ = windowed(spark, tmp_path, S.stream_subject_cap, df, files)
    assert got == {r["arrival"]: r["accepted"] for r in D.subject_cap(df, order=("arrival",)).collect()}


def test_state_of_a_window_expires(spark, tmp_path):
    day = 86400
    rows = [(f"k{i}", 10 * day + i, i, 0) for i in range(50)] + [("z", 20 * day, 90, 1), ("z", 21 * day, 91, 2), ("k0", 21 * day, 92, 2)]
    df = spark.createDataFrame(rows, "story_key string, cycle_s long, arrival long, part int")
    got, run = windowed(spark, tmp_path, S.stream_story_dedup, df, 3)
    assert all(got.values()) and len(got) == 53
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(kept) >= 50 > 10 > kept[-1]


def test_tick_stream_fires_once(spark, tmp_path):
    from feedsieve.operators import calendar as A
    from tests.test_events_and_text import raw

    events = A.load(raw(spark, {"tz": "UTC", "time": "2026-01-15 14:00"}))
    posts, at = [], 1768485600 - 3600
    for k in range(3):
        spark.createDataFrame([(at + 60 * k,)], "tick_s long").coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    live = spark.readStream.schema("tick_s long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks"))
    for _ in range(2):
        S.stream_alerts(live, events, str(tmp_path / "c"), str(tmp_path / "fired"), lambda df, _: posts.extend(df.collect()), available_now=True).awaitTermination(120)
    assert len(posts) == 1
    assert S.ticks(spark).isStreaming and S.ticks(spark).columns == ["tick_s"]


def test_calendar_files(spark, tmp_path):
    from feedsieve.operators import calendar as A
    from feedsieve.sources import feeds

    assert feeds.read_calendar(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "empty.json").write_text(" \n")
    assert feeds.read_calendar(spark, str(tmp_path / "empty.json")).count() == 0
    (tmp_path / "two.json").write_text('[{"type": "cpi", "title": "CPI", "time": "2026-01-15 08:30", "tz": "America/New_York", "importance": "critical"},\n {"type": "x"}]')
    rows = feeds.read_calendar(spark, str(tmp_path / "two.json"))
    assert [(r["entry_ix"], r["error"]) for r in A.validate(rows).orderBy("entry_ix").collect()] == [(0, None), (1, "missing title")]
    assert A.load(rows.where("entry_ix = 0")).first()["scheduled_utc"].hour == 13
    (tmp_path / "map.json").write_text('{"type": "cpi"}')
    with pytest.raises(Exception, match="must be a list"):
        feeds.read_calendar(spark, str(tmp_path / "map.json")).collect()
    with pytest.raises(A.CalendarError) as e:
        A.load(rows.sparkSession.range(150).selectExpr("CAST(id AS INT) AS entry_ix", *[f"CAST(NULL AS {t}) AS {c}" for c, t in (x.split() for x in feeds.CALENDAR.split(", "))]))
    assert str(e.value).count("missing type") == 150


def test_sources(spark, tmp_path):
    from feedsieve.operators import curate as C
    from feedsieve.sources import ledgers

    good = spark.createDataFrame([("a", 1)], "source_id string, n int")
    read = lambda: spark.read.parquet(str(tmp_path / "not there"))
    rows = C.union_sources([good, read, spark.createDataFrame([("b",)], "source_id string")])
    assert sorted((r["source_id"], r["n"]) for r in rows.collect()) == [("a", 1), ("b", None)]
    assert C.union_sources([read], "source_id string").count() == 0
    table = spark.createDataFrame([("a", "A", True), ("b", "B", False)], "source_id string, source_name string, enabled boolean")
    assert [r["source_name"] for r in C.with_source(rows, table).collect()] == ["A"]
    (tmp_path / "ledger").write_text("no table")
    with pytest.raises(Exception):  # noqa: B017  what cannot be read is not empty
        ledgers.read(spark, str(tmp_path / "ledger"), ledgers.SENT).collect()


def test_alert_batch_fires_once(spark, tmp_path):
    from feedsieve.operators import calendar as A
    from tests.test_events_and_text import raw

    events = A.load(raw(spark, {"tz": "UTC", "time": "2026-01-15 14:00"}))
    ticks = spark.createDataFrame([(1768485600 - 3600 + 60,)], "tick_s long")
    posts = []
    run = S.alert_batch(events, str(tmp_path / "fired"), lambda df, _: posts.extend(df.collect()))
    run(ticks, 0)
    run(ticks, 1)
    assert len(posts) == 1


def test_curate_batch_emits_once(spark, tmp_path):
    from tests.test_curation import ITEM, item

    rows = spark.createDataFrame([item(1, "Visa acquires rival, SEC approves", guid="g")], ITEM)
    out = []
    run = S.curate_batch(str(tmp_path / "sent"), str(tmp_path / "rejected"), lambda df, _: out.extend(df.collect()))
    run(rows, 0)
    run(rows, 1)
    assert len(out) == 1


def test_curate_batch_windows_reach_over_batches(spark, tmp_path):
    from tests.test_curation import ITEM, item

    title, hour, at = "Visa acquires rival, SEC approves", 3600, 1_000_800
    out = []
    run = S.curate_batch(str(tmp_path / "sent"), str(tmp_path / "rejected"), lambda df, _: out.extend(r["uid"] for r in df.collect()))
    for k, hours in enumerate((0, -1, 7)):  # one story under other uids, once late and once after its window
        run(spark.createDataFrame([item(k, title, guid=f"g{k}", observed=at + hours * hour)], ITEM), k)
        assert len(out) == (2 if k == 2 else 1)


def test_cycle_cap_counts_earlier_batches(spark, tmp_path):
    from tests.test_curation import ITEM, item

    names = ["Visa", "Oracle", "Netflix", "Walmart"]
    out = []
    run = S.curate_batch(str(tmp_path / "sent"), str(tmp_path / "rejected"), lambda df, _: out.extend(df.collect()), cycle_seconds=3600)
    for k in (0, 1):
        run(spark.createDataFrame([item(i, f"{names[i]} acquires rival for cash, SEC approves", observed=10_000_820 + i, guid=str(i)) for i in (2 * k, 2 * k + 1)], ITEM), k)
    assert len(out) == 3


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(df: pd.DataFrame) -> list:
    def one(v):
        return None if v is None or v is pd.NaT or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted([tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", ["item_keys", "predicates", "filter_items", "funnel", "story_dedup", "subject_cap", "daily_budget", "validate_calendar", "due_alerts", "clean_text", "validate_body", "labels_and_tags", "rss_items", "channel_items"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "orders", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF).toPandas()
    assert plain(got) == plain(con.sql(registry.oracle_sql()[name]).df())


def test_test_data_is_there():
    assert os.path.isdir(SF)
