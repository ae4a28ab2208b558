"""What is emitted, when the cycle's steps depend on one another.

In a cycle, candidates are visited by rank until the cycle is full.  A candidate is passed over if
its uid was emitted before, if its story was emitted within the story window, or if its subject
was emitted as often as its cap allows.  Only what is emitted marks its uid, story and subject,
so what was passed over may come back in a later cycle as long as its source delivers it.

Every decision depends on those before it, so time goes forward in one fold.  To run it on many
machines, time is cut into slices that are folded side by side, each from the state that
the slice before is thought to leave: none at first.  Slices whose guess was wrong are folded again from
what that slice did leave, until no guess is wrong.  Stories and subjects are forgotten after
hours, so most slices are often right after a second pass.  Where they are not (a story that never ends
may keep its beat for ever), runs of slices are folded in one go, each four times as long as before, so
that few passes do in any case; the result is exact.  A state holds what was emitted within the longest
window, and uids that are delivered once more.

The fold does not see every row.  In a cycle, of the candidates with the same story and subject at most
one is emitted: the first whose uid was not emitted before.  A uid that is delivered for the first
time is such a one, so what stands behind it in its cycle, story and subject is not emitted (`contenders`).
Nor can a uid have been emitted that was no contender before, which leaves fewer contenders (`narrowed`).
The fold says what is emitted; what becomes of all rows follows from that by joins.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.functions import vocab as V
from feedsieve.operators.kept import kept_once

SLICE_HOURS = 240
#: So few rows are folded without asking whether they can be made fewer.
ENOUGH = 100_000
#: What becomes of a candidate.
QUEUED, SEEN, STORY, SUBJECT, FULL = "queued", "seen", "story", "subject", "cycle_cap"
MARK = "array<struct<cycle_s:bigint,uid:string,until_s:bigint,story_key:string,subject_key:string>>"


@dataclass(frozen=True)
class Limits:
    """A cycle's cap (none if not positive), and the windows in seconds."""

    most: int = V.CYCLE_MAX
    story: int = V.STORY_HOURS * 3600
    subject: int = V.SUBJECT_HOURS * 3600
    subject_most: int = V.SUBJECT_MAX


@dataclass
class State:
    """What was emitted, as far as it still matters."""

    limits: Limits
    marks: list[tuple] = field(default_factory=list)
    stories: dict[str, int] = field(default_factory=dict)
    subjects: dict[str, list[int]] = field(default_factory=dict)
    uids: set[str] = field(default_factory=set)
    filled: dict[int, int] = field(default_factory=dict)
    cycle: int | None = None
    room: int = 1000

    def add(self, mark: tuple) -> None:
        cycle, uid, _, story, subject = mark
        self.marks.append(mark)
        self.uids.add(uid)
        self.stories[story] = max(cycle, self.stories.get(story, cycle))
        self.subjects.setdefault(subject, []).append(cycle)
        self.filled[cycle] = self.filled.get(cycle, 0) + 1

    def at(self, cycle: int) -> list[tuple]:
        """The marks that matter from a cycle on."""
        window = max(self.limits.story, self.limits.subject)
        return sorted(m for m in self.marks if cycle - m[0] <= window or m[2] >= cycle)

    def forget(self) -> None:
        """Drops what is over; the room that is left grows with what is not, so that this costs little a row."""
        left = self.at(self.cycle)
        self.marks, self.stories, self.subjects, self.uids, self.filled = [], {}, {}, set(), {}
        for m in left:
            self.add(m)
        self.room = 1000 + 2 * len(left)

    def visit(self, cycle: int, uid: str, until: int, story: str, subject: str) -> str:
        if cycle != self.cycle:
            self.cycle = cycle
            if len(self.marks) > self.room:
                self.forget()
        if uid in self.uids:
            return SEEN
        if 0 < self.limits.most <= self.filled.get(cycle, 0):
            return FULL
        if story in self.stories and cycle - self.stories[story] <= self.limits.story:
            return STORY
        recent = [x for x in self.subjects.get(subject, ()) if cycle - x < self.limits.subject]
        if len(recent) >= self.limits.subject_most:
            return SUBJECT
        self.subjects[subject] = recent
        self.add((cycle, uid, until, story, subject))
        return QUEUED


MARK_FIELDS = ("cycle_s", "uid", "until_s", "story_key", "subject_key")
#: Before all ranks, and before all cycles.
BEFORE = -(1 << 62)


def _fold(batches: Iterator[pd.DataFrame], limits: Limits) -> Iterator[pd.DataFrame]:
    """Rows of each slice in order, after a row that brings its state, or none to go on from the slice before; gives the rows that are emitted, and a row with the state that is left."""
    state, at, after, last = State(limits), None, 0, []
    fields = ["slice", "rank", "arrival", "cycle_s", "uid", "story_key", "subject_key"]

    def emitted(part: pd.DataFrame, which: list[int]) -> pd.DataFrame:
        return part.iloc[which][fields].assign(marks=None)

    def left() -> pd.DataFrame:
        marks = [dict(zip(MARK_FIELDS, m, strict=True)) for m in last]
        none = pd.Series([None], dtype=object)
        return pd.DataFrame({"slice": [at], "rank": [0], "arrival": [0], "cycle_s": [0], "uid": none, "story_key": none, "subject_key": none, "marks": [marks]})

    for b in batches:
        which: list[int] = []
        for k, row in enumerate(zip(*(b[c] for c in ("slice", "brings", *MARK_FIELDS)), strict=True)):
            if row[0] != at:
                yield emitted(b, which)
                if at is not None:
                    last = state.at(after)
                    yield left()
                state, at, which = State(limits), row[0], []
            if row[1]:
                after = int(b["after_s"].iloc[k])
                # as text, since Arrow's arrays of structs cost more a row than the fold, also where they are null
                brought = b["brought"].iloc[k]
                for m in [tuple(m[f] for f in MARK_FIELDS) for m in json.loads(brought)] if isinstance(brought, str) else last:
                    state.add(m)
            elif state.visit(*row[2:]) == QUEUED:
                which.append(k)
        yield emitted(b, which)
    if at is not None:
        last = state.at(after)
        yield left()


def delivered(candidates: DataFrame) -> DataFrame:
    """Adds `first_s` and `until_s`, the first and the last cycle that deliver the uid."""
    uid = Window.partitionBy("uid")
    return candidates.withColumns({"first_s": F.min("cycle_s").over(uid), "until_s": F.max("cycle_s").over(uid)})


def contenders(rows: DataFrame) -> DataFrame:
    """The rows (with first_s) that may be emitted: in a cycle, story and subject up to the first one whose uid is new."""
    ahead = Window.partitionBy("cycle_s", "story_key", "subject_key").orderBy("rank", "arrival").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_new", F.max(F.col("cycle_s") == F.col("first_s")).over(ahead)).where("_new IS NULL OR NOT _new").drop("_new")


def narrowed(rows: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """The contenders among contenders, as long as they are many and get fewer; any of these tables leads to the same decisions."""
    left = kept_once(contenders(rows))
    was, n = math.inf, left.count()
    while enough < n < 0.8 * was:
        left = kept_once(contenders(left.withColumn("first_s", F.min("cycle_s").over(Window.partitionBy("uid")))))
        was, n = n, left.count()
    return left


def decided(candidates: DataFrame, limits: Limits = Limits(), sent: DataFrame | None = None, slice_hours: int = SLICE_HOURS) -> DataFrame:  # noqa: B008
    """Adds `outcome` to candidates (cycle_s, rank, arrival, uid, story_key, subject_key), one a uid and cycle.

    sent: what was emitted before the first cycle, or in it (cycle_s, uid, story_key, subject_key), as far back as the windows reach.
    """
    # what was observed at no time is in no cycle
    rows = kept_once(delivered(candidates.where("cycle_s IS NOT NULL")))
    fresh = rows if sent is None else rows.join(sent.select("uid").distinct(), "uid", "left_anti")
    # without a window of stories, a cycle may emit several of a story
    narrow = (narrowed(fresh) if limits.story >= 0 else fresh).withColumn("slice", F.floor(F.col("cycle_s") / (slice_hours * 3600)))
    no = F.lit(0).cast("bigint")
    narrow = narrow.select("slice", F.lit(False).alias("brings"), no.alias("after_s"), F.lit(None).cast("string").alias("brought"), "cycle_s", F.col("rank").cast("bigint").alias("rank"), "arrival", "uid", "until_s", "story_key", "subject_key")
    marks = _emitted(narrow, limits, sent)
    if sent is not None:
        marks = marks.unionByName(sent.select("cycle_s", F.lit(BEFORE).alias("rank"), F.lit(BEFORE).alias("arrival"), "uid", "story_key", "subject_key", F.lit(BEFORE).alias("seen_s")))
    marks = kept_once(marks)
    found = rows.join(marks.groupBy("uid").agg(F.min("seen_s").alias("_seen_s")), "uid", "left")
    full, place = F.lit(False), F.struct("rank", "arrival")
    if limits.most > 0:
        nth = F.row_number().over(Window.partitionBy("cycle_s").orderBy("rank", "arrival"))
        filled = marks.withColumn("_nth", nth).where(F.col("_nth") == limits.most).select("cycle_s", place.alias("_full"))
        found, full = found.join(filled, "cycle_s", "left"), _behind("_full")
    story = told(narrow, marks, limits.story).withColumnRenamed("cycle_s", "_cycle_s")
    found = found.join(story, (F.col("cycle_s") == F.col("_cycle_s")) & F.col("story_key").eqNullSafe(F.col("_story_key")), "left")
    outcome = F.when(F.col("_seen_s") == F.col("cycle_s"), QUEUED).when(F.col("_seen_s") < F.col("cycle_s"), SEEN).when(full, FULL).when(_behind("_told"), STORY).otherwise(SUBJECT)
    return found.withColumn("outcome", outcome).select(*candidates.columns, "outcome")


def _behind(place: str):
    """Whether a row stands behind a place in its cycle; null if there is none."""
    return (F.col("rank") > F.col(f"{place}.rank")) | ((F.col("rank") == F.col(f"{place}.rank")) & (F.col("arrival") > F.col(f"{place}.arrival")))


def told(rows: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """The place (rank, arrival) in a cycle behind which a story is told, for cycles and stories of rows that have one (cycle_s, _story_key, _told)."""
    here = F.min(F.when(F.col("_emitted"), F.struct("rank", "arrival")))
    both = rows.select("cycle_s", "story_key", F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("bigint").alias("arrival"), F.lit(False).alias("_emitted")).distinct()
    both = both.unionByName(marks.select("cycle_s", "story_key", F.col("rank").cast("bigint").alias("rank"), F.col("arrival").cast("bigint").alias("arrival"), F.lit(True).alias("_emitted")))
    times = both.groupBy("cycle_s", "story_key").agg(here.alias("_here"))
    earlier = Window.partitionBy("story_key").orderBy("cycle_s").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("_here").isNotNull(), F.col("cycle_s"))).over(earlier)
    start = F.struct(F.lit(BEFORE).alias("rank"), F.lit(BEFORE).alias("arrival"))
    place = F.when(F.col("cycle_s") - last <= window, start).when(F.lit(window >= 0), F.col("_here"))
    return times.withColumn("_told", place).where("_told IS NOT NULL").select("cycle_s", F.col("story_key").alias("_story_key"), "_told")


def _emitted(rows: DataFrame, limits: Limits, sent: DataFrame | None) -> DataFrame:
    """What is emitted of rows in slices (cycle_s, rank, arrival, uid, story_key, subject_key, seen_s)."""
    order = Window.orderBy("slice")
    firsts = rows.groupBy("slice").agg(F.min("cycle_s").alias("first_s"))
    slices = kept_once(firsts.select("slice", F.coalesce(F.lead("first_s").over(order), F.lit(1 << 62)).alias("after_s"), F.lag("slice").over(order).alias("before"), F.row_number().over(order).alias("ix")))
    used = slices.select("slice", F.array().cast(MARK).alias("marks"))
    if sent is not None:
        mark = F.struct("cycle_s", "uid", F.col("cycle_s").alias("until_s"), "story_key", "subject_key")
        given = sent.agg(F.sort_array(F.collect_list(mark)).cast(MARK).alias("given"))
        first = slices.where("before IS NULL").select("slice", F.lit(True).alias("first"))
        used = used.join(first.join(F.broadcast(given)), "slice", "left").select("slice", F.coalesce("given", "marks").alias("marks"))
    used = kept_once(used)
    schema = f"slice bigint, rank bigint, arrival bigint, cycle_s bigint, uid string, story_key string, subject_key string, marks {MARK}"
    no = F.lit(0).cast("bigint")
    # the number of the fold that a slice's rows are taken from
    turn = slices.select("slice", F.lit(0).alias("turn"))
    folds: list[DataFrame] = []
    todo, ends = used, slices.select("slice", F.array().cast(MARK).alias("marks"))
    as_text = F.to_json("marks", {"ignoreNullFields": "false"})
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while (wrong := todo.count()) > 0:
        length = 4 ** max(0, len(folds) - 1)
        runs = slices.withColumn("run", F.floor(F.col("ix") / length))
        starts = todo.join(runs, "slice").groupBy("run").agg(F.min("ix").alias("start"))
        again = kept_once(runs.join(F.broadcast(starts), "run").where("ix >= start").join(todo, "slice", "left").select("slice", "run", "after_s", (F.col("ix") > F.col("start")).alias("goes_on"), F.when(F.col("ix") == F.col("start"), as_text).alias("brought")))
        brought = again.select("run", "slice", F.lit(True).alias("brings"), "after_s", "brought", no.alias("cycle_s"), no.alias("rank"), no.alias("arrival"), F.lit("").alias("uid"), no.alias("until_s"), F.lit("").alias("story_key"), F.lit("").alias("subject_key"))
        taken = rows.join(F.broadcast(again.select("slice", "run")), "slice").unionByName(brought)
        ordered = taken.repartition(min(4 * wrong, tasks), "run").sortWithinPartitions("run", "slice", F.desc("brings"), "cycle_s", "rank", "arrival")
        folded = kept_once(ordered.drop("run").mapInPandas(lambda batches: _fold(batches, limits), schema))
        folds.append(folded.where("marks IS NULL").drop("marks").withColumn("turn", F.lit(len(folds))))
        turn = kept_once(_put(turn, again.select("slice", F.lit(len(folds) - 1).alias("turn"))))
        ends = kept_once(_put(ends, folded.where("marks IS NOT NULL").select("slice", "marks")))
        came = slices.where("before IS NOT NULL").select("slice", "before").join(ends.select(F.col("slice").alias("before"), "marks"), "before").select("slice", "marks")
        used = kept_once(_put(used, came.join(F.broadcast(again.where("goes_on").select("slice")), "slice", "left_semi")))
        todo = kept_once(came.join(used.select("slice", F.col("marks").alias("was")), "slice").where(F.col("marks") != F.col("was")).drop("was"))
        used = kept_once(_put(used, todo))
    none = rows.sparkSession.createDataFrame([], schema).drop("marks").withColumn("turn", F.lit(0))
    found = reduce(lambda a, b: a.union(b), folds, none).join(F.broadcast(turn), ["slice", "turn"])
    return found.select("cycle_s", "rank", "arrival", "uid", "story_key", "subject_key", F.col("cycle_s").alias("seen_s"))


def _put(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A table of slices with some of its rows replaced."""
    return table.join(F.broadcast(rows.select("slice")), "slice", "left_anti").union(rows)
