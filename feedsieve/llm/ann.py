"""Approximate nearest neighbours: NN-descent in Spark joins, and greedy search of its graph.

Equal vectors are one node.  The first graph comes from orders of all nodes: a bounded
sample of pivots is drawn, nodes are sorted by nearest pivot and nearness to it, and the
nodes of one stretch of that order are compared.  Then each round joins every node with its
neighbours in both directions and compares these with one another, so neighbours of
neighbours meet; each node keeps its best.  Rounds end when the graph hardly gains.

The search keeps a list of the best nodes for each query, starts it with the query's own
neighbours, and in each round opens the best nodes not opened before, joins their
neighbours, and scores them.  It ends when every list's nodes are opened, as then no
neighbour of the best is unknown.  It walks a thinner graph: the best edges of a node in
each direction, so a node that many point at is no dearer than others.

The index holds every vector; graph degree, stretches and list lengths are parameters that
trade recall for time.  A query scores some thousand nodes at most, however large the
table.  Recall is measured against brute force in the tests.

Vectors that are null, zero, or hold null or non-finite components take no part.  Shorter
vectors count as filled up with zeros to the longest.  Ties go to the smaller vec_id; rows
that repeat a vec_id are candidates and queries of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.llm.common import checkpoint, small_batches

DEGREE = 40
#: Neighbours in either direction that meet in a round; more of a node's followers than this wait for a later round.
MEETING = 40
#: New neighbours that a node takes from one meeting at most.
TAKEN = 8
PIVOTS, STRETCH, ORDERS = 256, 128, 3
#: Rounds go on while the sum of similarities gains this share, and at most so many.
GAIN, ROUNDS = 0.004, 8
#: Edges of a node in each direction that the search follows.
WALKED = 24
#: A search's list, the nodes that it opens in a round, and a bound on rounds that lists of this length do not reach.
LIST, OPENED, SEARCH_ROUNDS = 160, 32, 12
#: Ids of so many queries are broadcast.
BROADCAST_QUERIES = 1_000_000
EDGE = "node long, other long, sim float"


def usable(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """(vec_id, vec) of vectors that take part."""
    v = F.transform(F.col(value), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine)
    sizes = rows.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if sizes["least"] == sizes["most"]:
        return rows
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(sizes["most"]) - F.size("vec"))))


def _unit(vec: list) -> np.ndarray:
    m = np.array(vec, np.float64).reshape(len(vec), -1)
    big = np.abs(m).max(1, keepdims=True)
    m = m / big
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def units(nodes: DataFrame) -> DataFrame:
    """(node, unit): vectors of length one as half-precision bytes, which the graph is built from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = _unit(b.column("vec").to_pylist()).astype("<f2")
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([x.tobytes() for x in u], pa.binary())], ["node", "unit"])

    return nodes.select("node", "vec").mapInArrow(run, "node long, unit binary")


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f2").reshape(len(raw), -1).astype(np.float32)


def _top_edges(ids: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each member's `keep` most similar others within a block of members."""
    np.fill_diagonal(sims, -9)
    k = min(keep, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel()


def _edges(parts: list) -> pa.RecordBatch:
    a, b, s = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(s.astype(np.float32))], ["node", "other", "sim"])


def first_graph(u: DataFrame, n: int, seed: int, parts: int) -> DataFrame:
    """Edges within stretches of an order by nearest pivot."""
    drawn = u.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 40)) <= int((1 << 40) * min(1.0, PIVOTS / max(1, n)))).limit(4 * PIVOTS).collect()
    pivots = _matrix(pa.array([r["unit"] for r in sorted(drawn, key=lambda r: r["node"])], pa.binary())) if drawn else np.zeros((1, 1), np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sims = _matrix(b.column("unit")) @ pivots.T if len(drawn) else np.zeros((b.num_rows, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sims.argmax(1) + 0.5 * np.clip(1 - sims.max(1), 0, 1.9))], ["node", "unit", "place"])

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block(last: bool):
            ids, m = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            out, at = [], 0
            while len(ids) - at >= 2 * STRETCH or (last and at < len(ids)):
                end = len(ids) if len(ids) - at < 2 * STRETCH else at + STRETCH
                if end - at > 1:
                    out.append(_top_edges(ids[at:end], m[at:end] @ m[at:end].T, DEGREE))
                at = end
            held[:] = [(ids[at:], m[at:])]
            return _edges(out)

        for b in batches:
            if b.num_rows:
                held.append((b.column("node").to_numpy(), _matrix(b.column("unit"))))
                yield block(False)
        if held:
            yield block(True)

    placed = u.mapInArrow(place, "node long, unit binary, place double")
    return placed.repartitionByRange(max(1, min(parts, n // (4 * STRETCH))), "place", "node").sortWithinPartitions("place", "node").select("node", "unit").mapInArrow(stretch, EDGE)


def best(edges: DataFrame, most: int, by: str = "node", of: str = "other") -> DataFrame:
    """The `most` best edges of each node; an edge counts once."""
    once = edges.groupBy(by, of).agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("sim"), of))
    return once.withColumn("r", rank).where(F.col("r") <= most).drop("r").select("node", "other", "sim")


def _both(graph: DataFrame, most: int) -> DataFrame:
    """(hub, member): neighbours in either direction; of those that point at a hub, the `most` best."""
    back = Window.partitionBy("other").orderBy(F.desc("sim"), "node")
    forth = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    a = graph.withColumn("r", F.row_number().over(forth)).where(F.col("r") <= most).select(F.col("node").alias("hub"), F.col("other").alias("member"))
    b = graph.withColumn("r", F.row_number().over(back)).where(F.col("r") <= most).select(F.col("other").alias("hub"), F.col("node").alias("member"))
    return a.union(b).distinct()


def descend(graph: DataFrame, u: DataFrame) -> DataFrame:
    """One round: members of a hub meet, and each takes over those better than its worst neighbour."""
    worst = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) < DEGREE, F.lit(-2.0)).otherwise(F.min("sim")).cast("float").alias("worst"))
    facts = u.join(worst, "node").select(F.col("node").alias("member"), "unit", "worst")
    rows = _both(graph, MEETING).join(facts, "member").repartition("hub").sortWithinPartitions("hub", "member").select("hub", "member", "unit", "worst")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list = []

        def groups(hub, ids, m, w, last):
            cuts = np.append(np.flatnonzero(np.diff(hub, prepend=hub[0] - 1 if len(hub) else 0)), len(hub))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == len(hub) and not last:
                    break
                if b - a > 1:
                    sims = m[a:b] @ m[a:b].T
                    np.fill_diagonal(sims, -9)
                    k = min(TAKEN, b - a - 1)
                    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    i, c = np.nonzero(np.take_along_axis(sims, top, 1) > w[a:b, None])
                    j = top[i, c]
                    out.append((ids[a + i], ids[a + j], sims[i, j]))
            return _edges(out), (cuts[-2] if len(cuts) > 1 and not last else len(hub))

        for b in batches:
            if b.num_rows:
                now = (b.column("hub").to_numpy(), b.column("member").to_numpy(), _matrix(b.column("unit")), b.column("worst").to_numpy())
                if left:
                    now = tuple(np.concatenate((x, y)) for x, y in zip(left, now, strict=True))
                found, at = groups(*now, False)
                left = [x[at:] for x in now]
                yield found
        if left:
            yield groups(*left, True)[0]

    return best(graph.union(rows.mapInArrow(meet, EDGE)), DEGREE)


def build(u: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph over all nodes."""
    n = u.count()
    parts = int(u.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    graph = first_graph(u, n, 0, parts)
    for k in range(1, ORDERS):
        graph = graph.union(first_graph(u, n, k, parts))
    graph = checkpoint(best(graph, DEGREE))
    total = 0.0
    for _ in range(rounds if n > STRETCH else 0):
        graph = checkpoint(descend(graph, u))
        before, total = total, graph.agg(F.sum(F.col("sim") + 1)).first()[0] or 0.0
        if total - before < GAIN * total:
            break
    return graph


def _scored(pairs: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, node, score) with cosines in double precision on the original vectors."""
    joined = pairs.join(queries.select(F.col("node").alias("query"), F.col("vec").alias("q")), "query").join(nodes.select("node", "vec"), "node").select("query", "node", "q", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, v = (np.asarray(b.column(c).flatten(), np.float64).reshape(b.num_rows, -1) for c in ("q", "vec"))
                # scaled first, so that squares neither overflow nor vanish
                q, v = (x / np.abs(x).max(1, keepdims=True) for x in (q, v))
                s = (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), pa.array(s)], ["query", "node", "score"])

    return joined.mapInArrow(run, "query long, node long, score double")


def _near(pairs: DataFrame, queries: DataFrame, u: DataFrame) -> DataFrame:
    """(query, node, score) by half-precision units, which the walk is guided by."""
    joined = pairs.join(queries.select(F.col("node").alias("query"), F.col("unit").alias("q")), "query").join(u, "node").select("query", "node", "q", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.einsum("ij,ij->i", _matrix(b.column("q")), _matrix(b.column("unit")))
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), pa.array(s, pa.float32())], ["query", "node", "score"])

    return joined.mapInArrow(run, "query long, node long, score float")


def search(graph: DataFrame, queries: DataFrame, u: DataFrame, most: int = LIST, opened: int = OPENED, rounds: int = SEARCH_ROUNDS) -> DataFrame:
    """Greedy search: (query, node, score) of all nodes that were scored for each query node.

    graph: edges; queries and u: node and unit of the queries and of all nodes.
    """
    near = checkpoint(_both(graph, WALKED).select(F.col("hub").alias("from"), F.col("member").alias("node")))
    start = queries.select(F.col("node").alias("query")).join(near, F.col("query") == F.col("from")).select("query", "node")
    known = checkpoint(_near(start, queries, u).withColumn("open", F.lit(False)))
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    for _ in range(rounds):
        listed = known.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most)
        todo = checkpoint(listed.where(~F.col("open")).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= opened).select("query", F.col("node").alias("from")))
        if todo.isEmpty():
            break
        met = todo.join(near, "from").select("query", "node").where("query <> node").distinct().join(known.select("query", "node"), ["query", "node"], "left_anti")
        marked = known.join(todo.withColumnRenamed("from", "node").withColumn("now", F.lit(True)), ["query", "node"], "left").select("query", "node", "score", (F.col("open") | F.coalesce("now", F.lit(False))).alias("open"))
        known = checkpoint(marked.union(_near(met, queries, u).withColumn("open", F.lit(False))))
    return known.select("query", "node", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """The k nearest vectors of each query: query_id, rank, vec_id, score, and how many nodes were scored for it."""
    small_batches(vectors.sparkSession)
    rows = checkpoint(usable(vectors, key, value).withColumn("row", F.monotonically_increasing_id()))
    # equal vectors are one node; its k + 1 smallest ids are enough to answer with
    copy = Window.partitionBy("vec").orderBy("vec_id", "row")
    first = checkpoint(rows.groupBy("vec").agg(F.min("row").alias("node")))
    nodes = first.select("node", "vec")
    members = checkpoint(rows.withColumn("r", F.row_number().over(copy)).where(F.col("r") <= k + 1).join(first, "vec").select("node", "vec_id", "row"))
    asked = checkpoint(rows.where(is_query).join(first, "vec").select(F.col("vec_id").alias("query_id"), F.col("row").alias("asked"), "node"))
    u = checkpoint(units(nodes))
    queries = checkpoint(nodes.join(asked.select("node").distinct(), "node"))
    found = search(build(u), u.join(F.broadcast(queries.select("node")) if queries.count() <= BROADCAST_QUERIES else queries.select("node"), "node", "left_semi"), u)
    top = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    scored = found.groupBy("query").agg(F.count(F.lit(1)).alias("n_scored"))
    # the best by the walk's own scores are scored anew on the original vectors
    best_found = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= 4 * k).select("query", "node")
    found = _scored(best_found, queries, nodes)
    own = _scored(queries.select(F.col("node").alias("query"), "node"), queries, nodes)
    near = found.union(own).join(scored, "query", "left").select(F.col("query").alias("node"), F.col("node").alias("near"), "score", F.coalesce("n_scored", F.lit(0)).alias("n_scored"))
    answers = asked.join(near, "node").select("query_id", "asked", F.col("near").alias("node"), "score", "n_scored")
    answers = answers.join(members, "node").where("row <> asked")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row"))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "n_scored")


def op3(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 50 == 0)
