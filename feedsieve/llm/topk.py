"""Exact search for the largest inner products, by buckets of length.

Vectors are grouped by length into buckets whose lengths differ by 5 % at most.  A query has
a lower bound from the start: its k-th best product with a bounded number of vectors, half of
them the longest and half drawn by a hash.  That bound over the query's length says how long a vector must be at least, so buckets
below it are never met.  Queries with like needs make groups, and a group meets a slice of a
bucket in one task.

There, vectors come by falling length.  The bound, divided by both lengths, is a cosine that
a vector must reach: the local threshold.  Where it is low, a query takes all vectors that are long
enough (length pruning).  Where it is high, its largest coordinates confine those of a vector to
ranges, which sorted lists give, and their intersection remains (coordinate pruning).  What
remains is multiplied out, which raises the bound for what follows.

A product is exact: components are whole numbers, and products go through integers where a double
could not hold them.  Bounds leave room for rounding and drop nothing that equals the k-th.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; a shorter vector counts as filled up with zeros, so an empty one scores 0;
components are held to 2**26 either way after scaling, with up to 2,048 of them; rows that repeat an
id are queries and candidates of their own; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.llm.common import hashed_share, in_order, sized, small_batches, written

RATIO = 1.05
SEEDS = 1024
GROUP, SLICE = 4096, 2048
#: From this cosine on, ranges of coordinates are worth looking up; below it they hold nearly all vectors.
COORDINATES_FROM = 0.6
FOCUS = 4
MOST = 1 << 26
SLACK = 1e-9
FOUND = "asked long, query_id long, row long, vec_id long, score long, verified long"


def whole_numbers(vectors: DataFrame, key: str, value: str, scale: float) -> DataFrame:
    """(row, vec_id, vec, norm) of vectors that take part, written once."""
    x = F.transform(F.col(value), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    vec = F.transform(x, lambda v: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(v * scale))).cast("int"))
    rows = vectors.where(F.col(key).isNotNull() & F.col(value).isNotNull() & fine).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("vec_id"), vec.alias("vec"), F.col("_query"))
    squares = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    return written(rows.withColumn("norm", F.sqrt(squares)), "topk")


def bucket(length: Column) -> Column:
    """The bucket of a length; lengths under 1 are those of zero vectors."""
    return F.when(length < 1, F.lit(-1)).otherwise(F.floor(F.log(length) / float(np.log(RATIO)))).cast("int")


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors as rows, filled up with zeros to the longest."""
    ends = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten(), np.float64)
    if len(ends) and (ends == ends[0]).all():
        return flat.reshape(len(ends), -1)
    out = np.zeros((len(ends), ends.max(initial=0)))
    out[np.arange(out.shape[1]) < ends[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact products of rows; `bound` is the largest product of two lengths."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if bound < 1 << 52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Cell:
    """A group of queries against vectors that come by falling length."""

    def __init__(self, ids: np.ndarray, query_ids: np.ndarray, vecs: np.ndarray, norms: np.ndarray, bounds: np.ndarray, k: int):
        self.ids, self.query_ids, self.vecs, self.norms, self.k = ids, query_ids, vecs, norms, k
        self.bounds = bounds.copy()
        self.units = vecs / np.maximum(norms, 1)[:, None]
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in ids]
        self.verified = np.zeros(len(ids), np.int64)

    def _take(self, q: int, scores: np.ndarray, vec_ids: np.ndarray, rows: np.ndarray) -> None:
        self.verified[q] += len(scores)
        good = np.flatnonzero((scores >= self.bounds[q]) & (rows != self.ids[q]))
        if len(good) > self.k:
            least = np.partition(scores[good], len(good) - self.k)[len(good) - self.k]
            good = good[scores[good] >= least]
            good = good[np.lexsort((rows[good], vec_ids[good], -scores[good]))[: self.k]]
        if len(good):
            new = zip((-scores[good]).tolist(), vec_ids[good].tolist(), rows[good].tolist(), strict=True)
            self.best[q] = sorted([*self.best[q], *new])[: self.k]
            if len(self.best[q]) == self.k:
                self.bounds[q] = max(self.bounds[q], -self.best[q][-1][0])

    def meet(self, vec_ids: np.ndarray, rows: np.ndarray, vecs: np.ndarray, norms: np.ndarray) -> None:
        most = norms[0]
        # the shortest a vector may be for each query; a bound of 0 or less admits all
        with np.errstate(divide="ignore", invalid="ignore"):
            needs = np.where((self.bounds > 0) & (self.norms > 0), self.bounds * (1 - SLACK) / self.norms, -np.inf)
            local = np.where(most > 0, needs / most, 0.0)
        active = needs <= most
        coordinate = active & (local >= COORDINATES_FROM)
        lengthwise = np.flatnonzero(active & ~coordinate)
        if len(lengthwise):
            long_enough = len(norms) - np.searchsorted(norms[::-1], needs[lengthwise], "left")
            scores = products(self.vecs[lengthwise], vecs[: long_enough.max()], self.norms[lengthwise].max() * most)
            for i, q in enumerate(lengthwise.tolist()):
                self._take(q, scores[i, : long_enough[i]], vec_ids[: long_enough[i]], rows[: long_enough[i]])
        if coordinate.any():
            self._by_coordinates(np.flatnonzero(coordinate), local, vec_ids, rows, vecs, norms)

    def _by_coordinates(self, queries: np.ndarray, local: np.ndarray, vec_ids: np.ndarray, rows: np.ndarray, vecs: np.ndarray, norms: np.ndarray) -> None:
        units = vecs / np.maximum(norms, 1)[:, None]
        d = min(units.shape[1], self.units.shape[1])
        order = np.argsort(units[:, :d], axis=0, kind="stable")
        for q in queries.tolist():
            focus = np.argsort(-np.abs(self.units[q, :d]))[:FOCUS]
            # an angle of at most `turn` from the query keeps a coordinate within the cosines of its angle plus and minus that
            turn = np.arccos(min(1.0, local[q]))
            angle = np.arccos(np.clip(self.units[q, focus], -1, 1))
            low, high = np.cos(np.minimum(np.pi, angle + turn)) - SLACK, np.cos(np.maximum(0, angle - turn)) + SLACK
            spans = [(np.searchsorted(units[:, f], lo, "left", sorter=order[:, f]), np.searchsorted(units[:, f], hi, "right", sorter=order[:, f])) for f, lo, hi in zip(focus, low, high, strict=True)]
            least = int(np.argmin([b - a for a, b in spans])) if len(focus) else 0
            left = order[spans[least][0] : spans[least][1], focus[least]] if len(focus) else np.arange(len(rows))
            for i, f in enumerate(focus):
                if i != least:
                    left = left[(units[left, f] >= low[i]) & (units[left, f] <= high[i])]
            if len(left):
                self._take(q, products(self.vecs[q : q + 1], vecs[left], self.norms[q] * norms[0])[0], vec_ids[left], rows[left])

    def found(self) -> pa.RecordBatch:
        """For each query a row with the number of products, and its best."""
        out = [(int(self.ids[q]), int(self.query_ids[q]), None, None, None, int(n)) for q, n in enumerate(self.verified)]
        out += [(int(self.ids[q]), int(self.query_ids[q]), row, vec_id, -score, 0) for q, best in enumerate(self.best) for score, vec_id, row in best]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in FOUND.split(", ")])


def with_bounds(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Adds `bound`, the k-th best product with at most SEEDS vectors; minus infinity where there are fewer than k."""
    half = SEEDS // 2
    longest = vectors.orderBy(F.desc("norm"), "row").limit(half)
    drawn = hashed_share(vectors, F.xxhash64("row"), half).limit(half)
    seeds = longest.union(drawn).dropDuplicates(["row"]).select("row", "vec", "norm").toArrow().combine_chunks()
    lists, seed_rows = seeds["vec"].combine_chunks(), seeds["row"].to_numpy()
    vecs = matrix(lists) if len(seed_rows) else np.zeros((0, 0))
    most = max(seeds["norm"].to_pylist(), default=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                scores = products(matrix(b.column("vec")), vecs, most * max(b.column("norm").to_pylist())).astype(np.float64)
                scores[b.column("row").to_numpy()[:, None] == seed_rows] = -np.inf
                kth = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(b.num_rows, -np.inf)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kth)], [*b.schema.names, "bound"])

    return queries.select("row", "vec_id", "vec", "norm").mapInArrow(run, "row long, vec_id long, vec array<int>, norm double, bound double")


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a group and slice follow one another, queries first."""
    key, cell, asked = None, None, []
    for b in batches:
        keys = np.stack([b.column(c).to_numpy() for c in ("group", "bucket", "slice")], 1)
        is_vector = np.asarray(b.column("is_vector").to_numpy(zero_copy_only=False))
        new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1) | (is_vector[1:] != is_vector[:-1])) if len(keys) else np.zeros(0, bool))
        for a, z in zip(new, [*new[1:], len(keys)], strict=True):
            part = b.slice(a, z - a)
            if tuple(keys[a]) != key:
                if cell:
                    yield cell.found()
                key, cell, asked = tuple(keys[a]), None, []
            if not is_vector[a]:
                asked.append(part)
                continue
            if cell is None:
                if not asked:
                    continue
                q = pa.Table.from_batches(asked).combine_chunks()
                cell = Cell(q["row"].to_numpy(), q["vec_id"].to_numpy(), matrix(q["vec"].combine_chunks()), q["norm"].to_numpy(), q["bound"].to_numpy(), k)
            cell.meet(part.column("vec_id").to_numpy(), part.column("row").to_numpy(), matrix(part.column("vec")), part.column("norm").to_numpy())
    if cell:
        yield cell.found()


def largest_products(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", value: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k largest products of each query with all rows but its own: query_id, rank, vec_id, score, and n_verified, how many products were taken for the query."""
    small_batches(vectors.sparkSession)
    rows = whole_numbers(vectors.withColumn("_query", F.coalesce(is_query, F.lit(False))), key, value, scale)
    rows = rows.withColumn("bucket", bucket(F.col("norm")))
    queries = with_bounds(rows.where("_query"), rows, k)
    need = F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") * (1 - SLACK) / F.col("norm")).otherwise(0.0)
    queries = in_order(queries.withColumn("need", need), ["need", "row"], "topk").withColumn("group", F.floor(F.col("place") / GROUP))
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    rows = rows.join(F.broadcast(sizes), "bucket").withColumn("slice", F.pmod(F.xxhash64("row"), "slices").cast("int"))

    # which group meets which bucket: there are some hundred buckets at most, as lengths are bounded
    needs = queries.groupBy("group").agg(F.min("need").alias("least"))
    top = sizes.agg(F.coalesce(F.max("bucket"), F.lit(-1)).alias("top"))
    first = F.greatest(F.lit(-1), bucket(F.col("least")) - 1)
    meets = written(needs.join(F.broadcast(top)).where(first <= F.col("top")).select("group", "least", F.explode(F.sequence(first, F.col("top"))).alias("bucket")).join(F.broadcast(sizes), "bucket"), "topk")
    asked = queries.join(sized(meets.select("group", "bucket", "slices")), "group").select("group", "bucket", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(False).alias("is_vector"), "row", "vec_id", "norm", "bound", "vec")
    offered = rows.join(sized(meets.select("group", "bucket", "least")), "bucket").where("norm >= least").select("group", "bucket", "slice", F.lit(True).alias("is_vector"), "row", "vec_id", "norm", F.lit(0.0).alias("bound"), "vec")
    cells = asked.unionByName(offered).repartition("group", "bucket", "slice").sortWithinPartitions("group", "bucket", "slice", "is_vector", F.desc("norm"), "row")
    found = cells.mapInArrow(lambda batches: _cells(batches, k), FOUND)
    by = Window.partitionBy("asked")
    found = found.withColumn("n_verified", F.sum("verified").over(by)).where("row IS NOT NULL")
    rank = F.row_number().over(by.orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_verified")


def op12(embeddings: DataFrame) -> DataFrame:
    return largest_products(embeddings, F.col("vec_id") % 50 == 0).drop("n_verified")


SQL = """WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score, row_number() OVER (PARTITION BY q.row ORDER BY list_inner_product(q.vec, c.vec) DESC, c.vec_id, c.row)::INT AS rank FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM s WHERE rank <= 5"""
