"""Substring deduplication by line hashing.

A unit is a piece of a line up to a full stop, exclamation or question mark (all of the
line, if it has none), with a word at least.  Units are normalised (ASCII lower case, single
blanks) and hashed; digests are grouped globally; the occurrence with the smallest (doc_id,
offset) stays.  The others are candidates, and a run of neighbouring candidates is removed
if it has `min_words` words together.  So the minimum is one of the passage: lines and
sentences may be short, while a short sentence that many texts share stays alone where it
is alone.  Offsets are code points of the original text.

Units are made once and written; only repeated ones are looked at again.  Digests that
repeat very often are few, and are joined back by broadcast if their table is counted to
be small; the others go by their digest.  Grouping is pre-aggregated.

Out of reach: the first and last piece of a passage that was pasted into the middle of a
sentence, and a passage without a mark inside a longer line.

Defined cases: a null or empty text has no units; a null doc_id ranks last; repeated
rows are told apart by row number, so copies of a row lose their passages to the first; an
empty table gives no rows; other columns, whatever their names, are kept by `remove`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.llm.common import checkpoint, columns_of, dropped, free_name, sized, small_batches, written

#: Least words of a run of repeated units.
MIN_WORDS = 20
UNIT = re.compile("[^.!?\n]+[.!?]*|[.!?]+")
#: A digest that occurs more often than this is not dealt to one task.
OFTEN = 100_000
UNITS = "rid long, doc_id long, unit long, start long, end long, n_words long, digest binary"


def text_units(text: str) -> list[tuple[int, int, int, int, bytes]]:
    """(number, start, end, words, digest) of the units of a text."""
    out = []
    for m in UNIT.finditer(text):
        words = m[0].encode("utf-8", "surrogatepass").lower().split()
        if words:
            out.append((len(out), m.start(), m.end(), len(words), hashlib.blake2b(b" ".join(words), digest_size=16).digest()))
    return out


def units(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, d, *u) for r, d, t in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "text")), strict=True) for u in text_units(t or "")]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(cols)], [x.split()[0] for x in UNITS.split(", ")])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, UNITS)


def _slim(docs: DataFrame, rid) -> DataFrame:
    return docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each removed passage: where it lay, and where the first occurrence of its first unit is kept."""
    return _repeated(_slim(docs, F.monotonically_increasing_id()), min_words)


def _repeated(docs: DataFrame, min_words: int) -> DataFrame:
    """The removed passages of numbered documents, which are read once."""
    found = written(units(docs), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("rid"), F.col("start"))
    groups = checkpoint(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    often = groups.where(F.col("copies") > OFTEN)
    again = found.join(groups.where(F.col("copies") <= OFTEN), "digest").unionByName(found.join(sized(often), "digest"))
    again = again.where((F.col("rid") != F.col("first.rid")) | (F.col("start") != F.col("first.start"))).drop("digest")
    run = F.col("unit") - F.row_number().over(Window.partitionBy("rid").orderBy("unit"))
    first = F.min(F.struct(F.col("unit"), F.col("first"), F.col("copies"))).alias("x")
    runs = again.withColumn("run", run).groupBy("rid", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.sum("n_words").alias("n_words"), first).where(F.col("n_words") >= min_words)
    out = checkpoint(runs.select("doc_id", "start", "end", "n_units", "n_words", F.col("x.first.doc_id").alias("kept_doc_id"), F.col("x.first.start").alias("kept_start"), F.col("x.copies").alias("copies"), "rid"))
    dropped(found)
    return out


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All documents with repeated passages cut out of `text`, and a column `removed` (with `_` added, if that is taken): the cut spans in original offsets."""
    row, cut, removed = (free_name(c, docs.columns) for c in ("row", "cut", "removed"))
    whole = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    spans = _repeated(_slim(whole, F.col(row)), min_words).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut)).withColumnRenamed("rid", row)
    rows = whole.join(spans, row, "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, n: F.call_function("substring", F.col("text"), (a["at"] + 1).cast("int"), n)
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], piece(a, (s["start"] - a["at"]).cast("int"))).alias("out"))
    end = lambda a: F.concat(a["out"], piece(a, F.length("text")))
    clean = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.aggregate(cut, start, step, end))
    return rows.withColumn("text", clean).withColumnRenamed(cut, removed).select(*columns_of(docs), removed)


def op6(docs: DataFrame) -> DataFrame:
    return repeated(docs).drop("rid")


SQL = """
WITH l AS (SELECT doc_id, t, line - 1 AS line, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)),
s AS (SELECT doc_id, t, start + coalesce(sum(length(t)) OVER (PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT doc_id, line, start, unnest(regexp_extract_all(t, '[^.!?]+[.!?]*|[.!?]+')) AS t, generate_subscripts(regexp_extract_all(t, '[^.!?]+[.!?]*|[.!?]+'), 1) AS i FROM l)),
w AS (SELECT *, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM s),
k AS (SELECT doc_id, start, start + length(t) AS "end", len(w) AS n_words, array_to_string(w, ' ') AS key, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS unit FROM w WHERE len(w) > 0),
g AS (SELECT *, count(*) OVER (PARTITION BY key) AS copies, first_value(doc_id) OVER o AS kept_doc_id, first_value(start) OVER o AS kept_start FROM k WINDOW o AS (PARTITION BY key ORDER BY doc_id, start)),
r AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM g WHERE copies > 1 AND (doc_id <> kept_doc_id OR start <> kept_start))
SELECT doc_id, min(start)::BIGINT AS start, max("end")::BIGINT AS "end", count(*) AS n_units, sum(n_words)::BIGINT AS n_words,
  arg_min(kept_doc_id, unit) AS kept_doc_id, arg_min(kept_start, unit)::BIGINT AS kept_start, arg_min(copies, unit) AS copies
FROM r GROUP BY doc_id, run HAVING sum(n_words) >= 20
"""
