"""What the operators share: table reading, keys, checkpoints and safe columns."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every contract here, for Java regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names.  Where none is named, as in tests, a temporary one in local mode; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or f"file://{tempfile.mkdtemp(prefix='spark-')}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder, which outlive any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made within lose their shuffle files when they have run, not only when the driver next collects its garbage.

    For steps that end in a checkpoint or in files; a frame that is run again would have to shuffle again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Rows of a few numbers that make a partition worth a task.
ROWS_A_TASK = 25_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """A table of about so many rows in no more partitions than they are worth, however many a shuffle makes."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run's files, under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{os.urandom(8).hex()}"


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes that go to a Python worker at once, as texts may be long; the same for all operators here."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def crc32_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo `mod`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once a row."""
    return F.transform(F.array(value), use)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed_share(df: DataFrame, hashed: Column, most: int) -> DataFrame:
    """About `most` rows of a table, or all if it has no more: those whose hash falls under a share of its range.

    Nothing is ranked or gathered; the rows kept depend on their hashes and the table's size alone.
    """
    n = df.count()
    return df if n <= most else df.where(F.pmod(hashed, F.lit(1 << 40)) < int((1 << 40) * most / n))


#: Key tables of up to this many rows are broadcast after counting them; beyond it Spark chooses the join.
BROADCAST_KEYS = 1_000_000


def sized(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A table of keys, to be broadcast if it is counted to be small enough."""
    return F.broadcast(keys) if keys.count() <= most else keys


def free_name(wanted: str, columns: list[str]) -> str:
    """A column name that begins as wanted and that no column has; Spark does not tell cases apart."""
    used = {c.lower() for c in columns}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of a table by name, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as Parquet in the shared folder, which is denser than a checkpoint and can be dropped."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(rid, doc_id, text), numbered and written once: later scans may cut the input elsewhere, so a place in it is no key."""
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), name)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by `written`, once nothing reads them any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_order(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows with `place`, their number from 0 in ascending order of the keys (nulls first), written once.

    Rows are dealt by ranges of all keys and numbered within their ranges; only the ranges' sizes,
    one row each, meet in one task.  Rows equal in all keys are numbered in any order.
    """
    ordered = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = F.broadcast(sizes.select("_range", before.cast("long").alias("_before")))
    return ordered.withColumn("_range", part).join(firsts, "_range").withColumn("place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_range", "_before", "_at")
