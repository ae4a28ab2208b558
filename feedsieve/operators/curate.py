"""Curation of items: cycles, ranks, caps, the queue, the daily budget and counters."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedsieve.functions import keys, predicates
from feedsieve.functions import text as T
from feedsieve.functions import vocab as V
from feedsieve.functions.matchers import quoted
from feedsieve.operators import emission, posts
from feedsieve.operators.dedup import exact_dedup
from feedsieve.operators.kept import kept_once
from feedsieve.sources import ledgers


def with_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Attaches the enabled sources' facts; the source table is small and Spark broadcasts it by its size."""
    return items.join(sources.where("enabled"), "source_id")


def union_sources(sources: list[DataFrame | Callable[[], DataFrame]], schema: str | None = None) -> DataFrame:
    """All source results together; a column that a source lacks is null.

    A source may be a function that reads it.  If it fails in reading, which includes a file that is
    not there or is no table, it contributes nothing and a warning is logged; `schema` is that of the
    result if every source fails.
    """
    frames = []
    for i, source in enumerate(sources):
        try:
            frames.append(source() if callable(source) else source)
        except PySparkException as e:
            logging.getLogger(__name__).warning("source %s contributes nothing: %s", i, e)
    if not frames:
        if schema is None:
            raise ValueError("no source could be read, and no schema is given")
        return SparkSession.active().createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def cycle_start(observed_s: Column, seconds: int = V.CYCLE_SECONDS) -> Column:
    """Start of the poll cycle of a time, both in epoch seconds."""
    return observed_s - observed_s % seconds


def with_uid(items: DataFrame) -> DataFrame:
    return items.withColumn("uid", keys.uid(F.col("guid"), F.col("link"), F.col("source_id"), F.col("title")))


def with_title_keys(items: DataFrame) -> DataFrame:
    return items.withColumns({"story_key": keys.story_key(F.col("title")), "subject_key": keys.subject_key(F.col("title"))})


def with_keys(items: DataFrame) -> DataFrame:
    return with_title_keys(with_uid(items))


def judged(items: DataFrame, cycle_seconds: int = V.CYCLE_SECONDS, least: int = V.MIN_IMPACT, require_anchor: bool = True, max_age: int = V.MAX_AGE_HOURS) -> DataFrame:
    """Every item with all predicates, its score and the reasons against it."""
    df = items.withColumn("cycle_s", cycle_start(F.col("observed_s"), cycle_seconds)).withColumn("age_reason", predicates.age_reason(max_age))
    return predicates.with_gates(df, least, require_anchor)


#: Whether an item is old, undated or a retrospective; such a one counts as seen from then on.
STALE = "age_reason IS NOT NULL OR (NOT official AND is_historical)"
KEPT = f"NOT ({STALE}) AND reject_reason IS NULL"


def _only(rows: DataFrame, keep: str, columns: list[str]) -> DataFrame:
    """Rows that a condition over gates keeps: a filter would be pushed below the gates and work all flags out a second time inside it."""
    return rows.select(F.explode(F.when(F.expr(keep), F.array(F.struct(*columns)))).alias("_row")).select("_row.*")


def kept(items: DataFrame, **how) -> DataFrame:
    """Items that pass the age, history and quality gates."""
    return _only(judged(items, **how), KEPT, [*items.columns, "cycle_s", "score", "is_upcoming_speech"])


def rank_by_impact(items: DataFrame) -> DataFrame:
    """Adds `rank` in the cycle: score descending, then arrival."""
    by = Window.partitionBy("cycle_s").orderBy(F.desc("score"), "arrival")
    return items.withColumn("rank", F.row_number().over(by))


def cycle_cap(items: DataFrame, most: int = V.CYCLE_MAX) -> DataFrame:
    """The first `most` items of each cycle by rank; no cap if `most` is not positive."""
    if most <= 0:
        return items
    place = F.row_number().over(Window.partitionBy("cycle_s").orderBy("rank", "arrival"))
    return items.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


SLIM = ("arrival", "observed_s", "cycle_s", "source_id", "title", "link", "guid", "official", "is_upcoming_speech", "score", "uid")


#: What the gates and the title keys read of an entry besides its link, and what they say.
CONTENT = ("title", "summary", "source_id", "source_name", "official", "impact", "year")
TITLE_KEYS = ("story_key", "subject_key")
SAID = ("score", "is_upcoming_speech", "is_historical", "reject_reason", "unpublished")
#: So many judged contents go to every executor; more are joined by a shuffle.
FEW_CONTENTS = 100_000


def judged_once(entries: DataFrame, least: int = V.MIN_IMPACT, require_anchor: bool = True) -> DataFrame:
    """Entries with their uids, title keys and what the gates say, each content judged once: feeds repeat theirs, and the gates do not read the time.

    Of a link the gates see only whether a noisy section is in it, so the content holds that section.  `entries` is read twice.
    """
    section = F.regexp_extract(F.lower(F.coalesce("link", F.lit(""))), "|".join(map(quoted, V.URL_SECTIONS)), 0)
    rows = entries.withColumn("_content", F.struct(*CONTENT, section.alias("link")))
    # few contents would be put into few tasks, though they are the costly part
    tasks = max(entries.sparkSession.sparkContext.defaultParallelism, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    contents = rows.select("_content").distinct().repartition(tasks)
    judged = kept_once(with_title_keys(predicates.with_gates(contents.select("_content", "_content.*"), least, require_anchor)).select("_content", *SAID, *TITLE_KEYS))
    few = judged.limit(FEW_CONTENTS + 1).count() <= FEW_CONTENTS
    return with_uid(rows.join(F.broadcast(judged) if few else judged, "_content").drop("_content"))


def delivered_flags(rows: DataFrame, cycle_seconds: int = V.CYCLE_SECONDS, max_age: int = V.MAX_AGE_HOURS) -> DataFrame:
    """Deliveries of judged entries with their cycles, and whether they are stale or kept; only what decisions need."""
    rows = rows.withColumn("cycle_s", cycle_start(F.col("observed_s"), cycle_seconds)).withColumn("age_reason", predicates.age_reason(max_age))
    rows = rows.withColumns({"stale": F.expr(f"coalesce({STALE}, false)"), "kept": F.expr(f"coalesce({KEPT}, false)")})
    return rows.select("arrival", "cycle_s", "uid", "score", *TITLE_KEYS, "stale", "kept")


def flagged(items: DataFrame, **how) -> DataFrame:
    """Judged items with their uids, whether they are stale or kept, and only the columns that later steps need."""
    rows = with_uid(judged(items, **how)).withColumns({"stale": F.expr(f"coalesce({STALE}, false)"), "kept": F.expr(f"coalesce({KEPT}, false)")})
    return rows.select(*SLIM, "age_reason", "is_historical", "reject_reason", "unpublished", "stale", "kept")


def candidates_of(rows: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Kept items of `flagged` or `delivered_flags` rows, one a uid and cycle, with ranks; not those in the ledger, or found stale before or in the same cycle."""
    columns = [c for c in (*SLIM, *TITLE_KEYS) if c in rows.columns]
    # of what is stale only the cycle is needed, so one shuffle by uid serves both
    both = _only(rows, "kept OR stale", ["uid", "cycle_s", "kept", *(F.when(F.col("kept"), F.col(c)).alias(c) for c in columns if c not in ("uid", "cycle_s"))])
    stale_s = F.min(F.when(~F.col("kept"), F.col("cycle_s"))).over(Window.partitionBy("uid"))
    left = both.withColumn("_stale_s", stale_s).where("kept AND (_stale_s IS NULL OR cycle_s < _stale_s)").select(*columns)
    found = rank_by_impact(exact_dedup(left, ledger))
    return found if "story_key" in columns else with_title_keys(found)


def candidates(items: DataFrame, ledger: DataFrame | None = None, **how) -> DataFrame:
    """Candidates of each cycle; see `candidates_of`."""
    return candidates_of(kept_once(flagged(items, **how)), ledger)


def decisions(items: DataFrame, ledger: DataFrame | None = None, most: int = V.CYCLE_MAX, **how) -> DataFrame:
    """Every candidate with what becomes of it: `queued`, or why not; a uid is queued once."""
    return emission.decided(candidates(items, ledger, **how), emission.Limits(most))


def decisions_of_deliveries(entries: DataFrame, deliver: Callable[[DataFrame], DataFrame], ledger: DataFrame | None = None, most: int = V.CYCLE_MAX, cycle_seconds: int = V.CYCLE_SECONDS, max_age: int = V.MAX_AGE_HOURS, **how) -> DataFrame:
    """`decisions` on the deliveries of entries (arrival, cycle_s, rank, uid, keys, outcome): an entry is judged before it is delivered.

    deliver: gives the deliveries of a table of entries, which differ in arrival and observed_s only.
    """
    rows = delivered_flags(deliver(judged_once(entries, **how)), cycle_seconds, max_age)
    return emission.decided(candidates_of(rows, ledger).drop("score"), emission.Limits(most))


def curate(items: DataFrame, ledger: DataFrame | None = None, most: int = V.CYCLE_MAX, **how) -> DataFrame:
    """Items for the queue, each uid once: gates, exact, story and subject deduplication and the cycle's cap, as one loop over the cycles would do it.

    An item that is passed over may be queued in a later cycle that delivers it again.
    """
    return decisions(items, ledger, most, **how).where(F.col("outcome") == emission.QUEUED).drop("outcome")


def curate_after(items: DataFrame, sent: DataFrame, most: int = V.CYCLE_MAX, **how) -> DataFrame:
    """`curate` after earlier runs, whose rows are in `sent` (uid, story_key, subject_key, cycle_s).

    Earlier rows are not queued again, hold their windows and count for their cycle's cap.  A new
    row older than the last sent one counts at that one's cycle.
    """
    last = sent.agg(F.max("cycle_s")).first()[0]
    if last is None:
        return curate(items, None, most, **how)
    new = candidates(items, sent, **how).withColumn("cycle_s", F.greatest("cycle_s", F.lit(last)))
    new = rank_by_impact(exact_dedup(new))
    # no window reaches further back than the longest one
    recent = sent.where(F.col("cycle_s") >= last - 3600 * max(V.STORY_HOURS, V.SUBJECT_HOURS)).select("cycle_s", "uid", "story_key", "subject_key")
    return emission.decided(new, emission.Limits(most), recent).where(F.col("outcome") == emission.QUEUED).drop("outcome")


def sample_links(items: DataFrame, most: int = 3) -> DataFrame:
    """The first links (guid or title where there is none) of each source and cycle."""
    place = F.row_number().over(Window.partitionBy("cycle_s", "source_id").orderBy("arrival"))
    link = F.coalesce(F.nullif("link", F.lit("")), F.nullif("guid", F.lit("")), F.substring("title", 1, 60))
    rows = items.withColumn("_place", place).where(F.col("_place") <= most).withColumn("_link", link)
    got = rows.groupBy("cycle_s", "source_id").agg(F.sort_array(F.collect_list(F.struct("_place", "_link"))).alias("x"))
    return got.select("cycle_s", "source_id", F.array_join(F.transform("x", lambda x: x["_link"]), " ").alias("links"))


def queue(items: DataFrame, most: int = V.QUEUE_MAX, queue_key: str = "day") -> DataFrame:
    """Drain order of each queue by score; later arrivals than the queue holds are refused."""
    arrived = F.row_number().over(Window.partitionBy(queue_key).orderBy("arrival"))
    held = items.withColumn("arrived", arrived).where(F.col("arrived") <= most)
    return held.withColumn("drain", F.row_number().over(Window.partitionBy(queue_key).orderBy(F.desc("score"), "arrival")))


def daily_budget(rows: DataFrame, limit: int = V.DAILY_LIMIT) -> DataFrame:
    """Adds `passed`; rows are day, seq, impact, official, cost, in the order of seq.

    Only passed rows cost.  The gate has three phases, each decided by a running sum over
    the rows that the phases before let pass, so no row is looked at in a loop.
    """
    limit = max(1, limit)
    near = limit - max(1, limit // 5)
    before = Window.partitionBy("day").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("day")
    spent = F.coalesce(F.sum("cost").over(before), F.lit(0))
    rows = rows.withColumn("_free", spent < near).withColumn("_good", F.col("official") | (F.col("impact") >= 50))
    used = F.coalesce(F.sum(F.when(F.col("_free"), F.col("cost"))).over(day), F.lit(0))
    later = F.coalesce(F.sum(F.when(~F.col("_free") & F.col("_good"), F.col("cost"))).over(before), F.lit(0))
    open_ = used + later < limit
    passed = F.col("_free") | F.when(open_, F.col("_good")).otherwise(F.col("official") | (F.col("impact") >= 80))
    return rows.withColumn("passed", passed).drop("_free", "_good")


def per_source_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("cycle_s", "source_id").agg(F.count(F.lit(1)).alias("n"))


def gate_counts() -> dict[str, Column]:
    fresh = F.col("age_reason").isNull()
    historical = ~F.col("official") & F.col("is_historical")
    return {
        "fetched": F.count(F.lit(1)),
        "old": F.count_if(~fresh),
        "historical": F.count_if(fresh & historical),
        "low_impact": F.count_if(fresh & ~historical & F.col("reject_reason").isNotNull() & F.col("unpublished").isNull()),
        "kept": F.count_if(fresh & ~historical & F.col("reject_reason").isNull()),
    }


def funnel(rows: DataFrame) -> DataFrame:
    """Counters of each cycle from judged items."""
    return rows.groupBy("cycle_s").agg(*[c.alias(k) for k, c in gate_counts().items()])


AFTER_GATES = ("new", "story_dup", "subject_capped", "over_cap", "queued", "empty_keys")


def after_gates(decided: DataFrame) -> DataFrame:
    """Counters of each cycle from decisions: new items, retellings, items over their subject's or the cycle's cap, and what is queued.

    Once a cycle is full, nothing more is looked at.  `empty_keys` counts new items without any token in their titles, which are all one story.
    """
    is_ = lambda outcome: F.col("outcome") == outcome
    new = ~is_(emission.SEEN)
    counts = (F.count_if(new), F.count_if(is_(emission.STORY)), F.count_if(is_(emission.SUBJECT)), F.count_if(is_(emission.FULL)), F.count_if(is_(emission.QUEUED)), F.count_if(new & (F.col("story_key") == keys.EMPTY)))
    return decided.groupBy("cycle_s").agg(*[c.alias(k) for k, c in zip(AFTER_GATES, counts, strict=True)])


def full_funnel(items: DataFrame, ledger: DataFrame | None = None, most: int = V.CYCLE_MAX, **how) -> DataFrame:
    """All counters of each cycle, from the fetched items to the queue; items are judged once."""
    rows = kept_once(flagged(items, **how))
    after = after_gates(emission.decided(candidates_of(rows, ledger), emission.Limits(most)))
    found = funnel(rows).join(after, "cycle_s", "left")
    return found.select(*[c for c in found.columns if c not in AFTER_GATES], *[F.coalesce(c, F.lit(0)).alias(c) for c in AFTER_GATES])


def write_up(queued: DataFrame, generated: DataFrame, limit: int = V.DAILY_LIMIT, most: int = V.QUEUE_MAX, ledger: DataFrame | None = None) -> DataFrame:
    """Queued items with their generated texts, judged for publication: the posts of a day's queue.

    queued: items as `curate` gives them, each uid once, with day and whatever rendering reads;
    generated: uid, provider, raw.  `outcome` is the first that holds: `seen` (in the ledger by the
    time it is drained), `budget` (the day's budget is spent), `no_text` (nothing was generated),
    the gate's problem, `sent`.  What is sent costs one call, or two if it needs an editor; all
    else costs nothing, so it takes no other post's place.
    """
    drained = queue(queued, most)
    if ledger is not None:
        drained = drained.join(ledger.select("uid", F.lit(True).alias("_sent")).distinct(), "uid", "left")
    read = generated.select("uid", "provider", T.parse_model_output(F.col("raw")).alias("_f")).select("uid", "provider", "_f.prefix", "_f.text", "_f.tickers")
    rows = drained.join(read, "uid", "left")
    editor = posts.needs_editor(posts.credibility_label(rows), F.col("score"), F.col("text"))
    rows = posts.quality_gate(posts.render(rows.withColumn("editor_used", F.coalesce(editor, F.lit(False)))))
    seen = F.coalesce("_sent", F.lit(False)) if ledger is not None else F.lit(False)
    sound = ~seen & F.col("provider").isNotNull() & F.col("problem").isNull()
    cost = F.when(~sound, 0).when(F.col("editor_used"), 2).otherwise(1)
    rows = daily_budget(rows.withColumns({"seq": F.col("drain"), "impact": F.col("score"), "cost": cost}), limit)
    outcome = F.when(seen, "seen").when(~F.col("passed"), "budget").when(F.col("provider").isNull(), "no_text").otherwise(F.coalesce("problem", F.lit("sent")))
    return rows.withColumn("outcome", outcome).drop("_sent")


def record(written: DataFrame, ledger: str, archive: str, rejected: str) -> None:
    """Sends what `write_up` let pass to the ledger and the archive, and keeps the rest in a table of its own, with its outcome.

    Recorded twice it is as recorded once: each table takes a uid (the last one a uid, outcome and
    day) once.  The ledger comes last, so what it lacks after a failure is recorded again.
    """
    written = kept_once(written)
    sent = written.where("outcome = 'sent'").withColumn("sent_at", F.timestamp_seconds("observed_s"))
    ledgers.append_archive(sent.withColumns({"created_at": F.col("sent_at"), "provider_used": F.col("provider")}), archive)
    ledgers.append_rejected(written.where("outcome <> 'sent'"), rejected)
    ledgers.append_sent(sent, ledger)


def top_item(items: DataFrame) -> DataFrame:
    """The one item with the highest score; the first arrival of equals."""
    return items.orderBy(F.desc("score"), "arrival").limit(1)


def status_metrics(sent: DataFrame, as_of_s: Column, hours: int = V.STORY_HOURS, limit: int = V.DAILY_LIMIT, cost: Column | None = None) -> DataFrame:
    """Distinct ids, stories still in their window, all published rows of a ledger, and the day's budget: used and left.

    A row costs one call, or what `cost` says; the day is that of `as_of_s`.
    """
    today = F.floor(F.col("sent_s") / 86400) == F.floor(as_of_s / 86400)
    used = F.coalesce(F.sum(F.when(today & (F.col("sent_s") <= as_of_s), F.lit(1) if cost is None else cost)), F.lit(0)).cast("bigint")
    return sent.agg(used.alias("budget_used"), F.greatest(F.lit(limit) - used, F.lit(0)).cast("bigint").alias("budget_left"), F.count_distinct("uid").alias("seen"), F.count_distinct(F.when(as_of_s - F.col("sent_s") <= hours * 3600, F.col("story_key"))).alias("open_stories"), F.count(F.lit(1)).alias("published"))
