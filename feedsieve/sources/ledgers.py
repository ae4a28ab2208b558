"""Ledgers: tables of what was sent, archived, rejected and fired, one row a key.

Rows lie in partitions by day, so a reader that looks back for some hours opens some days
however long the ledger has grown.  Writing is insert-if-absent by key: a batch that is run again
after a failure at any point, between its tables or within one, adds nothing.  The days
that a writer compares with are those of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENT = "uid string, story_key string, source_id string, title string, link string, sent_at timestamp, subject_key string"
FIRED = "event_id string, offset_label string, status string, fired_at timestamp"
ARCHIVE = ("uid", "source_id", "source_name", "title", "link", "body", "official", "impact", "provider_used", "editor_used", "created_at")
REJECTED = ("uid", "story_key", "source_id", "title", "link", "outcome", "day")
MAX_TITLE, MAX_LINK = 500, 1000
DAY = "dt"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, path: str, schema: str, since: Column | None = None) -> DataFrame:
    """A ledger, or its days from `since` (a date) on; empty where none was written.

    One that is there and cannot be read is an error, or all would be sent again.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{schema}, {DAY} date")
    rows = spark.read.schema(f"{schema}, {DAY} date").parquet(path)
    return rows if since is None else rows.where(F.col(DAY) >= since)


def load_seen(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    return read(spark, path, SENT, since).select("uid", "story_key")


def absent(rows: DataFrame, ledger: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key that the ledger does not hold."""
    new = rows.join(ledger.select(*key).distinct(), key, "left_anti")
    rest = [c for c in rows.columns if c not in key]
    return new.groupBy(*key).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("x")).select(*key, "x.*").select(*rows.columns)


def _insert(rows: DataFrame, path: str, key: list[str], time: str, back_days: int | None) -> int:
    """Adds the rows whose key the ledger does not hold in their days, or so many days before them (None: in any); says how many."""
    rows = rows.withColumn(DAY, F.to_date(time)).persist()
    first = rows.agg(F.min(DAY)).first()[0]
    if first is None:
        rows.unpersist()
        return 0
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != DAY)
    held = read(rows.sparkSession, path, schema, None if back_days is None else F.date_sub(F.lit(first), back_days))
    new = absent(rows, held, key, time).persist()
    count = new.count()
    if count:
        new.repartition(DAY).write.mode("append").partitionBy(DAY).parquet(path)
    new.unpersist()
    rows.unpersist()
    return count


def append_sent(rows: DataFrame, path: str, back_days: int | None = None) -> int:
    """Adds sent items once each; titles and links are cut to their columns' lengths."""
    subject = F.col("subject_key") if "subject_key" in rows.columns else F.lit(None).cast("string").alias("subject_key")
    rows = rows.select("uid", "story_key", "source_id", F.substring("title", 1, MAX_TITLE).alias("title"), F.substring("link", 1, MAX_LINK).alias("link"), F.col("sent_at").cast("timestamp").alias("sent_at"), subject)
    return _insert(rows, path, ["uid"], "sent_at", back_days)


def append_archive(posts: DataFrame, path: str) -> int:
    """Adds rendered posts once each."""
    return _insert(posts.select(*ARCHIVE), path, ["uid"], "created_at", 0)


def append_rejected(rows: DataFrame, path: str) -> int:
    """Adds posts that were not sent, once for each outcome and day."""
    timed = rows.select(*REJECTED, F.timestamp_seconds(F.col("day") * 86400).alias("rejected_at"))
    return _insert(timed, path, ["uid", "outcome", "day"], "rejected_at", 0)


def mark_alerts_fired(rows: DataFrame, path: str) -> int:
    """Adds alerts once each, and says how many were new."""
    rows = rows.select("event_id", "offset_label", F.lit("fired").alias("status"), F.col("fired_at").cast("timestamp").alias("fired_at"))
    return _insert(rows, path, ["event_id", "offset_label"], "fired_at", 1)


def compact(spark: SparkSession, path: str, before: str) -> int:
    """Makes one file of each day before a date that has several; says how many days that were.

    A day's new file is written beside it and takes its place, so a reader sees the old files or
    the new one; a compaction that is cut short leaves the old ones.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    days = [d for s in fs.listStatus(root) if (d := s.getPath().getName()).startswith(f"{DAY}=") and d < f"{DAY}={before}"]
    many = [d for d in days if sum(x.getPath().getName().startswith("part-") for x in fs.listStatus(fs_path(root, d))) > 1]
    for d in many:
        beside, old = fs_path(root, f"_new-{d}"), fs_path(root, f"_old-{d}")
        spark.read.parquet(fs_path(root, d).toString()).coalesce(1).write.mode("overwrite").parquet(beside.toString())
        fs.delete(old, True)
        fs.rename(fs_path(root, d), old)
        fs.rename(beside, fs_path(root, d))
        fs.delete(old, True)
    return len(many)
