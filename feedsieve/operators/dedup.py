"""Exact, story and subject deduplication.

The windows forget what they suppressed: a story is accepted again once the window has
passed since its last *accepted* copy, which no fixed window function says.  Per key, times
go through a fold in sorted order.

Keys may be hot (a title without a usable token has the empty key), so rows do not go through
the fold.  At one time a key can accept at most `most` rows, and these are the first ones in
order.  So the fold sees each key and time once, with a count that partial aggregation made,
and gives back how many rows are accepted then; rows are ranked within key and time, which
are small groups.

A key may have very many times, so a fold does not go by keys either: where a key is silent for
longer than the window, nothing is remembered, and what follows is folded on its own.  Times are
dealt by ranges of key and time, so a hot key lies in many parts; a table with one row a part says
where a part goes on with the key of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.functions import vocab as V
from feedsieve.operators.kept import kept_once


def exact_dedup(items: DataFrame, ledger: DataFrame | None = None, cycle: str = "cycle_s", arrival: str = "arrival") -> DataFrame:
    """Drops items in the ledger; within a cycle the first arrival of a uid stays."""
    if ledger is not None:
        items = items.join(ledger.select("uid").distinct(), "uid", "left_anti")
    first = Window.partitionBy(cycle, "uid").orderBy(arrival)
    return items.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def accept_window(items: DataFrame, key: str, time: str, window: int, most: int = 1, strict: bool = False, order: tuple[str, ...] = ("arrival",), skip_empty: bool = False) -> DataFrame:
    """Adds `accepted`: whether fewer than `most` accepted rows of the key lie within the window before.

    Rows of a key go by time, then `order`.  With `strict`, a row exactly a window earlier is outside.
    With `skip_empty`, rows with an empty key are all accepted.  `items` is read twice.
    """
    kinds = dict(items.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, times = object(), []
        for b in batches:
            got = []
            for s, t, n in zip(b["_segment"], b["_time"], b["_n"], strict=True):
                if s != last:
                    last, times = s, []
                times = [x for x in times if (t - x < window if strict else t - x <= window)]
                got.append(min(n, max(0, most - len(times))))
                times += [t] * got[-1]
            yield b[["_key", "_time"]].assign(_ok=got)

    counted = items.groupBy(F.col(key).alias("_key"), F.col(time).alias("_time")).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("_n"))
    folded = segments(counted, window, strict).repartition("_segment").sortWithinPartitions("_segment", "_time").mapInPandas(fold, f"_key {kinds[key]}, _time {kinds[time]}, _ok long")
    place = F.row_number().over(Window.partitionBy(key, time).orderBy(*order))
    rows = items.withColumn("_place", place).join(folded, F.col(key).eqNullSafe(F.col("_key")) & F.col(time).eqNullSafe(F.col("_time")))
    free = (F.col(key) == "") if skip_empty else F.lit(False)
    return rows.withColumn("accepted", F.coalesce(free, F.lit(False)) | (F.col("_place") <= F.col("_ok"))).drop("_place", "_key", "_time", "_ok")


def segments(times: DataFrame, window: int, strict: bool = False) -> DataFrame:
    """Adds `_segment` to distinct (_key, _time): the stretches of a key's times between silences longer than the window.

    A segment is named by its key, the part in which it begins, and a number in that.
    """
    parted = kept_once(times.repartitionByRange("_key", "_time").withColumn("_part", F.spark_partition_id()))
    mark = F.struct("_key", "_time")
    ends = parted.groupBy("_part").agg(F.min(mark).alias("first"), F.max(mark).alias("last"))
    in_turn = Window.orderBy("_part")
    goes_on = ends.withColumn("before", F.lag("last").over(in_turn)).where(F.col("before._key").eqNullSafe(F.col("first._key")))
    carried = goes_on.select("_part", F.col("first._key").alias("_same"), F.col("before._time").alias("_carried"))
    own = Window.partitionBy("_part", "_key").orderBy("_time")
    rows = parted.join(F.broadcast(carried), "_part", "left")
    before = F.coalesce(F.lag("_time").over(own), F.when(F.col("_same").eqNullSafe(F.col("_key")), F.col("_carried")))
    silent = F.col("_time") - before
    cut = before.isNull() | (silent >= window if strict else silent > window)
    rows = rows.withColumn("_cut", cut.cast("long")).withColumn("_number", F.sum("_cut").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # a part whose last key was never cut in it holds that key alone, so the segment that is open at its end began before
    open_ = rows.groupBy("_part").agg(F.max(F.struct("_key", "_time", "_number")).alias("last"))
    began = F.last(F.when(F.col("last._number") > 0, F.struct(F.col("_part").alias("part"), F.col("last._number").alias("number"))), ignorenulls=True)
    inherited = open_.select("_part", began.over(in_turn.rowsBetween(Window.unboundedPreceding, -1)).alias("_began"))
    rows = rows.join(F.broadcast(inherited), "_part", "left")
    segment = F.when(F.col("_number") > 0, F.struct("_key", F.col("_part").alias("part"), F.col("_number").alias("number"))).otherwise(F.struct("_key", F.col("_began.part").alias("part"), F.col("_began.number").alias("number")))
    return rows.select("_key", "_time", "_n", F.to_json(segment).alias("_segment"))


def story_dedup(items: DataFrame, hours: int = V.STORY_HOURS, time: str = "cycle_s", order: tuple[str, ...] = ("rank", "arrival"), skip_empty: bool = False) -> DataFrame:
    """Adds `accepted`: one copy of a story in each window since its last accepted copy."""
    return accept_window(items, "story_key", time, hours * 3600, 1, False, order, skip_empty)


def subject_cap(items: DataFrame, hours: int = V.SUBJECT_HOURS, most: int = V.SUBJECT_MAX, time: str = "cycle_s", order: tuple[str, ...] = ("rank", "arrival"), skip_empty: bool = False) -> DataFrame:
    """Adds `accepted`: at most `most` accepted items of a subject in any window."""
    return accept_window(items, "subject_key", time, hours * 3600, most, True, order, skip_empty)
