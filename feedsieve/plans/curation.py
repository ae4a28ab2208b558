"""Registered curation queries over derived items, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsieve.functions import predicates as P
from feedsieve.operators import curate as C
from feedsieve.operators import dedup as D
from feedsieve.operators.kept import kept_once
from feedsieve.plans.items import AGAIN, DUCK_ITEMS, items, redelivered
from feedsieve.functions.keys import keys_sql

CYCLE = 3600


def _judged(spark, sf_dir):
    return C.judged(items(spark, sf_dir), cycle_seconds=CYCLE)


def _candidates(spark, sf_dir):
    return C.candidates(items(spark, sf_dir), cycle_seconds=CYCLE)


def item_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_keys(items(spark, sf_dir)).select("arrival", "uid", "story_key", "subject_key")


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("arrival", *P.GATES)


def filter_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("arrival", "age_reason", "noise_rule", "unpublished", "score", "reject_reason")


def score_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("arrival", "n_tier1", "n_tier2", "n_catalyst", "score")


def curate_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kept(items(spark, sf_dir), cycle_seconds=CYCLE).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("bigint").alias("total_score"), F.round(F.avg("score"), 6).alias("mean_score"))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.funnel(_judged(spark, sf_dir))


def full_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.full_funnel(items(spark, sf_dir), cycle_seconds=CYCLE)


def per_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.per_source_counts(items(spark, sf_dir).withColumn("cycle_s", C.cycle_start(F.col("observed_s"), CYCLE)))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("arrival", "cycle_s", "uid", "score", "rank")


def story_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.story_dedup(kept_once(_candidates(spark, sf_dir))).select("arrival", "story_key", "cycle_s", "accepted")


def subject_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.subject_cap(kept_once(_candidates(spark, sf_dir))).select("arrival", "subject_key", "cycle_s", "accepted")


def curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.curate(items(spark, sf_dir), cycle_seconds=CYCLE).select("arrival", "cycle_s", "uid", "source_id", "title", "score", "rank")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items delivered again one, two and thirty cycles later, as feeds list an entry for hours; what becomes of each delivery."""
    return C.decisions_of_deliveries(items(spark, sf_dir), redelivered, cycle_seconds=CYCLE).select("arrival", "cycle_s", "uid", "outcome")


def cycle_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cycle_cap(_candidates(spark, sf_dir)).select("arrival", "cycle_s", "rank")


def sample_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sample_links(items(spark, sf_dir).withColumn("cycle_s", C.cycle_start(F.col("observed_s"), CYCLE)))


def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).withColumn("day", F.floor(F.col("observed_s") / 86400).cast("bigint"))
    return C.queue(rows).select("arrival", "day", "arrived", "drain")


def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = e.select(F.floor(s / 86400).cast("bigint").alias("day"), F.col("event_id").alias("seq"), F.expr("CAST(floor(abs(value)) AS INT) % 101").alias("impact"), F.expr("event_id % 9 = 0").alias("official"), F.expr("1 + event_id % 2").alias("cost"))
    return C.daily_budget(rows, 200).select("day", "seq", "passed")


def top_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_item(C.kept(items(spark, sf_dir), cycle_seconds=CYCLE)).select("arrival", "title", "score")


def status_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _candidates(spark, sf_dir).withColumn("sent_s", F.col("cycle_s"))
    return C.status_metrics(sent, F.lit(1705276800))


def write_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted items of each day with generated texts made from their titles, some of them too short, some missing."""
    rows = items(spark, sf_dir)
    extra = rows.select("arrival", "source_name", "summary", "published_s", "year")
    queued = kept_once(C.curate(rows, cycle_seconds=CYCLE)).join(extra, "arrival").withColumn("day", F.floor(F.col("observed_s") / 86400).cast("bigint"))
    raw = F.when(F.col("arrival") % 7 == 0, F.lit("ТЕКСТ: мало")).otherwise(F.concat(F.lit("ТЕКСТ: "), F.col("title"), F.lit(". It was reported today")))
    generated = queued.where("arrival % 11 <> 0").select("uid", F.lit("m").alias("provider"), raw.alias("raw"))
    return C.write_up(queued, generated, limit=20).select("arrival", "day", "drain", "editor_used", "outcome")


BASE = f"WITH RECURSIVE {DUCK_ITEMS}, timed AS (SELECT *, observed_s - observed_s % {CYCLE} AS cycle_s, {P.AGE_REASON.format(hours=24)} AS age_reason FROM items), {P.gates_sql('timed')}"
KEPT = "kept AS (SELECT * FROM gated WHERE age_reason IS NULL AND (official OR NOT is_historical) AND reject_reason IS NULL)"
CANDIDATES = f"""{BASE}, {KEPT}, {keys_sql('gated')},
stale AS (SELECT uid, min(cycle_s) AS stale_s FROM keyed WHERE age_reason IS NOT NULL OR (NOT official AND is_historical) GROUP BY uid),
good AS (SELECT k.* FROM keyed k LEFT JOIN stale t USING (uid) WHERE k.age_reason IS NULL AND (k.official OR NOT k.is_historical) AND k.reject_reason IS NULL AND (t.stale_s IS NULL OR k.cycle_s < t.stale_s)),
once AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY cycle_s, uid ORDER BY arrival) = 1),
cand AS (SELECT *, row_number() OVER (PARTITION BY cycle_s ORDER BY score DESC, arrival) AS rank FROM once)"""
#: One candidate after the other; `marks` is all that was queued so far.
DECIDED = f"""{CANDIDATES}, line AS (SELECT row_number() OVER (ORDER BY cycle_s, rank) AS n, cycle_s, uid, story_key, subject_key FROM cand),
steps AS (SELECT 0::BIGINT AS n, '' AS outcome, []::STRUCT(c BIGINT, u VARCHAR, s VARCHAR, j VARCHAR)[] AS marks
 UNION ALL SELECT n, outcome, CASE WHEN outcome = 'queued' THEN list_append(marks, {{'c': cycle_s, 'u': uid, 's': story_key, 'j': subject_key}}) ELSE marks END FROM
  (SELECT o.*, f.marks, CASE WHEN len(list_filter(f.marks, lambda m: m.u = o.uid)) > 0 THEN 'seen' WHEN len(list_filter(f.marks, lambda m: m.c = o.cycle_s)) >= 3 THEN 'cycle_cap'
   WHEN len(list_filter(f.marks, lambda m: m.s = o.story_key AND o.cycle_s - m.c <= 6 * 3600)) > 0 THEN 'story' WHEN len(list_filter(f.marks, lambda m: m.j = o.subject_key AND o.cycle_s - m.c < 12 * 3600)) >= 2 THEN 'subject' ELSE 'queued' END AS outcome
  FROM steps f JOIN line o ON o.n = f.n + 1)),
decided AS (SELECT c.*, s.outcome FROM (SELECT *, row_number() OVER (ORDER BY cycle_s, rank) AS n FROM cand) c JOIN steps s USING (n))"""


def _fold(name: str, source: str, key: str, hours: int, most: int) -> str:
    """A recursive fold that keeps the last one or two accepted times of a key."""
    ok = f"(a IS NULL OR o.cycle_s - a > {hours * 3600})" if most == 1 else f"(b IS NULL OR o.cycle_s - b >= {hours * 3600})"
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY cycle_s, rank, arrival) AS n FROM {source}),
{name}_f AS (SELECT {key}, n, arrival, true AS accepted, cycle_s AS a, NULL::BIGINT AS b FROM {name}_o WHERE n = 1
 UNION ALL SELECT o.{key}, o.n, o.arrival, {ok}, CASE WHEN {ok} THEN o.cycle_s ELSE a END, CASE WHEN {ok} THEN a ELSE b END FROM {name}_f f JOIN {name}_o o ON o.{key} = f.{key} AND o.n = f.n + 1),
{name} AS (SELECT o.*, f.accepted FROM {name}_o o JOIN {name}_f f USING ({key}, n))"""


ORACLES = {
    "item_keys": f"WITH {DUCK_ITEMS}, {keys_sql('items')} SELECT arrival, uid, story_key, subject_key FROM keyed",
    "predicates": f"{BASE} SELECT arrival, {', '.join(P.GATES)} FROM gated",
    "filter_items": f"{BASE} SELECT arrival, age_reason, noise_rule, unpublished, score, reject_reason FROM gated",
    "score_inputs": f"{BASE} SELECT arrival, n_tier1::INT AS n_tier1, n_tier2::INT AS n_tier2, n_catalyst::INT AS n_catalyst, score FROM gated",
    "curate_by_source": f"{BASE}, {KEPT} SELECT source_id, count(*) AS n, sum(score)::BIGINT AS total_score, round(avg(score), 6) AS mean_score FROM kept GROUP BY source_id",
    "funnel": f"""{BASE} SELECT cycle_s, count(*) AS fetched, count(*) FILTER (WHERE age_reason IS NOT NULL) AS old, count(*) FILTER (WHERE age_reason IS NULL AND NOT official AND is_historical) AS historical,
 count(*) FILTER (WHERE age_reason IS NULL AND (official OR NOT is_historical) AND reject_reason IS NOT NULL AND unpublished IS NULL) AS low_impact,
 count(*) FILTER (WHERE age_reason IS NULL AND (official OR NOT is_historical) AND reject_reason IS NULL) AS kept FROM gated GROUP BY cycle_s""",
    "full_funnel": f"""{DECIDED}, f AS (SELECT cycle_s, count(*) AS fetched, count(*) FILTER (WHERE age_reason IS NOT NULL) AS old, count(*) FILTER (WHERE age_reason IS NULL AND NOT official AND is_historical) AS historical,
 count(*) FILTER (WHERE age_reason IS NULL AND (official OR NOT is_historical) AND reject_reason IS NOT NULL AND unpublished IS NULL) AS low_impact,
 count(*) FILTER (WHERE age_reason IS NULL AND (official OR NOT is_historical) AND reject_reason IS NULL) AS kept FROM gated GROUP BY cycle_s),
a AS (SELECT cycle_s, count(*) FILTER (WHERE outcome <> 'seen') AS new, count(*) FILTER (WHERE outcome = 'story') AS story_dup, count(*) FILTER (WHERE outcome = 'subject') AS subject_capped, count(*) FILTER (WHERE outcome = 'cycle_cap') AS over_cap,
 count(*) FILTER (WHERE outcome = 'queued') AS queued, count(*) FILTER (WHERE outcome <> 'seen' AND story_key = substr(sha256(''), 1, 24)) AS empty_keys FROM decided GROUP BY cycle_s)
SELECT f.*, coalesce(a.new, 0) AS new, coalesce(a.story_dup, 0) AS story_dup, coalesce(a.subject_capped, 0) AS subject_capped, coalesce(a.over_cap, 0) AS over_cap, coalesce(a.queued, 0) AS queued, coalesce(a.empty_keys, 0) AS empty_keys FROM f LEFT JOIN a USING (cycle_s)""",
    "per_source_counts": f"WITH {DUCK_ITEMS} SELECT observed_s - observed_s % {CYCLE} AS cycle_s, source_id, count(*) AS n FROM items GROUP BY ALL",
    "exact_dedup": f"{CANDIDATES} SELECT arrival, cycle_s, uid, score, rank::INT AS rank FROM cand",
    "story_dedup": f"{CANDIDATES}, {_fold('s', 'cand', 'story_key', 6, 1)} SELECT arrival, story_key, cycle_s, accepted FROM s",
    "subject_cap": f"{CANDIDATES}, {_fold('j', 'cand', 'subject_key', 12, 2)} SELECT arrival, subject_key, cycle_s, accepted FROM j",
    "curate": f"{DECIDED} SELECT arrival, cycle_s, uid, source_id, title, score, rank::INT AS rank FROM decided WHERE outcome = 'queued'",
    "decisions": f"{DECIDED.replace('FROM items), fielded', f'FROM ({AGAIN})), fielded')} SELECT arrival, cycle_s, uid, outcome FROM decided",
    "cycle_cap": f"{CANDIDATES} SELECT arrival, cycle_s, rank::INT AS rank FROM cand QUALIFY row_number() OVER (PARTITION BY cycle_s ORDER BY rank, arrival) <= 3",
    "sample_links": f"""WITH {DUCK_ITEMS}, r AS (SELECT *, observed_s - observed_s % {CYCLE} AS cycle_s, row_number() OVER (PARTITION BY observed_s - observed_s % {CYCLE}, source_id ORDER BY arrival) AS place FROM items)
SELECT cycle_s, source_id, string_agg(coalesce(nullif(link, ''), nullif(guid, ''), title[1:60]), ' ' ORDER BY place) AS links FROM r WHERE place <= 3 GROUP BY ALL""",
    "priority_queue": f"""{BASE}, q AS (SELECT arrival, score, observed_s // 86400 AS day, row_number() OVER (PARTITION BY observed_s // 86400 ORDER BY arrival) AS arrived FROM gated)
SELECT arrival, day, arrived::INT AS arrived, row_number() OVER (PARTITION BY day ORDER BY score DESC, arrival)::INT AS drain FROM q WHERE arrived <= 200""",
    "daily_budget": """WITH RECURSIVE e AS (SELECT floor(epoch(ts))::BIGINT // 86400 AS day, event_id AS seq, CAST(floor(abs(value)) AS INT) % 101 AS impact, event_id % 9 = 0 AS official, 1 + event_id % 2 AS cost FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY seq) AS n FROM e),
f AS (SELECT day, 0::BIGINT AS n, 0::BIGINT AS seq, 0::BIGINT AS used, true AS passed FROM (SELECT DISTINCT day FROM o)
 UNION ALL SELECT o.day, o.n, o.seq, used + CASE WHEN 200 - used > 40 OR (200 - used > 0 AND (impact >= 50 OR official)) OR (used >= 200 AND (official OR impact >= 80)) THEN cost ELSE 0 END,
  200 - used > 40 OR (200 - used > 0 AND (impact >= 50 OR official)) OR (used >= 200 AND (official OR impact >= 80)) FROM f JOIN o ON o.day = f.day AND o.n = f.n + 1)
SELECT day, seq, passed FROM f WHERE n > 0""",
    "top_item": f"{BASE}, {KEPT} SELECT arrival, title, score FROM kept ORDER BY score DESC, arrival LIMIT 1",
    "status_metrics": f"{CANDIDATES} SELECT count(*) FILTER (WHERE cycle_s // 86400 = 1705276800 // 86400 AND cycle_s <= 1705276800) AS budget_used, greatest(1000 - count(*) FILTER (WHERE cycle_s // 86400 = 1705276800 // 86400 AND cycle_s <= 1705276800), 0) AS budget_left, count(DISTINCT uid) AS seen, count(DISTINCT story_key) FILTER (WHERE 1705276800 - cycle_s <= 21600) AS open_stories, count(*) AS published FROM cand",
}
QUERIES = (item_keys, predicates, filter_items, score_inputs, curate_by_source, funnel, full_funnel, per_source_counts, exact_dedup, story_dedup, subject_cap, curate, decisions, cycle_cap, sample_links, priority_queue, daily_budget, top_item, status_metrics, write_up)
