"""N-gram Jaccard join: prefix filters under several global token orders.

Documents with the same set of shingles are one node, so copies cost nothing more.
A pair whose Jaccard similarity reaches the threshold must share a token among the
first `n - ceil(threshold * n) + 1` tokens of each side under *any* order of all
tokens.  Three orders are used:

1. tokens with a small hash first, the frequent ones among them last.  Frequencies
   are counted over all nodes.  This order's prefixes are joined to get candidates.
2. and 3. two other hash orders, whose prefixes are kept as short fingerprints; a
   candidate whose fingerprints share nothing is dropped, as is one whose small-hash
   tokens differ by more than the threshold allows.

What is left is verified on whole sets.  Only links between components are needed, so
a token shared by many nodes does not make all pairs: its nodes are compared with the
most central one, which has the largest share of frequent tokens, and components are
formed.  Nodes of such a token that still lie in different components go on:

* their whole sets are looked at; a token that no other of these nodes has cannot be
  shared, and nodes that have too few others drop out.  The rest get prefixes again, by
  exact frequency.  Rare tokens make pairs; a frequent one names its central node.
* each node of a central node `c` is written as its difference from it, the tokens that
  only one of both has.  Two differences differ in the same tokens as the two sets, so
  the join goes on among differences, which are short and whose tokens are rare.  A
  difference that is small enough is itself a link.  Of two nodes in different
  components at least one is no neighbour of `c`, so their differences share a token
  (`least_shared`), and prefixes of the differences find all pairs that are left.
* before that, nodes are looked at by profile (sizes of set and difference, and how much
  of it no other node of `c` has).  Profiles that cannot reach each other make no pair,
  so a group of near copies just under the threshold costs its profiles, not its pairs.

No pair that could link two components is skipped.

Defined cases: null or empty texts have no set and are alone; repeated rows are rows
of one node; a null doc_id gets a row and does not name a component (null if no other
id is reachable); an empty table gives no rows; other columns, whatever their names, do
not matter and are kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.llm.common import checkpoint, columns_of, dropped, free_name, numbered, shuffles_removed, sized, small_batches, written
from feedsieve.llm.components import components
from feedsieve.llm.shingles import digest, mix64, shingle_sets

#: Tokens whose hash lies in a share of all hashes come first in order 1; the share is so many times that of a prefix.
LOW_PREFIXES = 2
#: A token in more nodes than this counts as frequent, and its nodes are not all paired at once.
LIGHT = 8
#: Frequent tokens known by count; the most frequent ones, if there are more.  This changes the order, not the result.
KNOWN_FREQUENT = 1_000_000
#: Times that nodes without a possible partner are looked for; more rounds find more of them.
WEEDING = 3
SIGNED = "rid long, doc_id long, n long, sig binary, low binary, f2 binary, f3 binary"


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _fingerprints(values: np.ndarray, salt: int, count: int) -> bytes:
    with np.errstate(over="ignore"):
        order = mix64(values ^ np.uint64(salt))
        first = np.partition(order, count - 1)[:count] if count < len(order) else order
    return np.unique((first & np.uint64(0xFFFF)).astype("<u2")).tobytes()


def sign(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """For each document: its set's size and digest, its small-hash tokens, and two prefix fingerprints."""
    small_batches(docs.sparkSession)
    limit = np.uint64(min(int(LOW_PREFIXES * (100 - percent) / 100 * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").fill_null("").to_pylist(), size)
            cols: list[list] = [[], [], [], [], []]
            for s in sets:
                p = prefix_length(len(s), percent)
                low = s[: max(p, int(np.searchsorted(s, limit)))]
                for c, v in zip(cols, (len(s), digest(s) if len(s) else None, low.tobytes(), _fingerprints(s, 0x5BD1E995, p) if len(s) else b"", _fingerprints(s, 0xA24BAED4963EE407, p) if len(s) else b""), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], [x.split()[0] for x in SIGNED.split(", ")])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, SIGNED)


def _exploded(nodes: DataFrame) -> DataFrame:
    """(token) of every small-hash token of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, "<i8"))], ["token"])

    return nodes.select("low").mapInArrow(run, "token long")


def _prefixes(nodes: DataFrame, tokens: np.ndarray, counts: np.ndarray, percent: int) -> DataFrame:
    """(token, node, n, share, often) of each node's prefix under order 1; share: of its tokens, the frequent ones.  tokens: these, sorted."""
    known = nodes.sparkSession.sparkContext.broadcast((tokens, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, how = known.value
        for batch in batches:
            out, ids, ns, shares, flags = [], [], [], [], []
            for node, n, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = np.frombuffer(low, "<u8")
                p = prefix_length(n, percent)
                rank = np.zeros(len(mine))
                if len(often):
                    at = np.minimum(np.searchsorted(often, mine), len(often) - 1)
                    rank = np.where(often[at] == mine, how[at], 0)
                shares.append(np.full(p, (rank > 0).mean(), np.float32))
                if len(mine) > p:
                    # only tokens under the limit are ranked by count: those beyond it come after them
                    order = np.lexsort((mine, rank))
                    mine, rank = mine[order], rank[order]
                out.append(mine[:p])
                flags.append(rank[:p] > 0)
                ids.append(np.full(p, node))
                ns.append(np.full(p, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(shares)), pa.array(np.concatenate(flags))], ["token", "node", "n", "share", "often"])

    return nodes.select("node", "n", "low").mapInArrow(run, "token long, node long, n long, share float, often boolean")


def _may_link(a: tuple, b: tuple, percent: int) -> bool:
    """a, b: (n, low, f2, f3).  False only if the pair cannot reach the threshold."""
    n, m = a[0], b[0]
    if 100 * min(n, m) < percent * max(n, m):
        return False
    for k in (2, 3):
        if not np.intersect1d(np.frombuffer(a[k], "<u2"), np.frombuffer(b[k], "<u2"), assume_unique=True).size:
            return False
    x, y = np.frombuffer(a[1], "<u8"), np.frombuffer(b[1], "<u8")
    top = min(x[-1], y[-1])  # up to here both sides' tokens are all known
    x, y = x[: np.searchsorted(x, top, "right")], y[: np.searchsorted(y, top, "right")]
    common = len(np.intersect1d(x, y, assume_unique=True))
    most = min(n - (len(x) - common), m - (len(y) - common))
    return 100 * most >= percent * (n + m - most)


def _ends(pairs: DataFrame) -> DataFrame:
    return checkpoint(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())


def _filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    pairs = checkpoint(pairs)
    own = checkpoint(nodes.select("node", "n", "low", "f2", "f3").join(sized(_ends(pairs)), "node"))
    facts = lambda s: own.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "low", "f2", "f3")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            keep = [(r[0], r[1]) for r in rows if _may_link(r[2:6], r[6:10], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.int64()) for i in (0, 1)], ["a", "b"])

    joined = pairs.join(facts("a"), "a").join(facts("b"), "b")
    return joined.select("a", "b", *[f"{s}_{c}" for s in "ab" for c in ("n", "low", "f2", "f3")]).mapInArrow(run, "a long, b long")


def _sets(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, set) of some nodes, worked out again from their texts; a node's number is that of the row that stands for it."""
    rows = docs.select(F.col("rid").alias("node"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(batch.column("text").fill_null("").to_pylist(), size)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "set"])

    return written(rows.join(sized(wanted), "node").select("node", "text").mapInArrow(run, "node long, set binary"), "texts")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.int64()) for i in (0, 1)], ["a", "b"])

    found = _sets(_ends(pairs), docs, size)
    left = found.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = found.select(F.col("node").alias("b"), F.col("set").alias("y"))
    out = checkpoint(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))
    dropped(found)
    return out


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _first_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """All pairs at a light token; at a frequent one, each node with the most central one."""
    fits = F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    light = prefix.where("NOT often")
    pairs = light.alias("x").join(light.alias("y"), F.expr("x.token = y.token AND x.node < y.node") & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    heavy = prefix.where("often")
    drawn = heavy.groupBy("token").agg(F.max(F.struct(F.col("share"), F.xxhash64("node").alias("h"), F.col("node"), F.col("n"))).alias("c"))
    star = heavy.alias("x").join(drawn.alias("y"), "token").where("x.node <> y.c.node").where(f"100 * least(x.n, y.c.n) >= {percent} * greatest(x.n, y.c.n)")
    return pairs.union(star.select(*_ordered("x.node", "y.c.node"))).distinct()


def _shared_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """(node, token, df, n, k) of tokens that lie in several of these nodes, for nodes that may reach the threshold with them; k: these tokens of the node."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, "<i8") for x in batch.column("set").to_pylist()]
            n = np.array([len(x) for x in found])
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), n)), pa.array(np.concatenate(found)), pa.array(np.repeat(n, n))], ["node", "token", "n"])

    rows = sets.mapInArrow(explode, "node long, token long, n long")
    for _ in range(WEEDING):
        # joined back, not a window: the join of a token that many nodes have can be split
        df = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        rows = checkpoint(rows.select("node", "token", "n").join(df, "token"))
        k = rows.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("m")).where(f"100 * k >= {percent} * m")
        rows = rows.join(k.select("node", "k"), "node")
    return checkpoint(rows.select("node", "token", "n", "df", "k"))


def farthest(n: Column, m: Column, percent: int) -> Column:
    """The most tokens that two linked sets of n and m tokens may differ in."""
    return F.floor((100 - percent) * (n + m) / (100 + percent)).cast("long")


def least_shared(s: Column, z: Column, far: Column) -> Column:
    """Tokens that two differences of s and z tokens share at least, if their sets differ in no more than `far`."""
    return F.ceil((s + z - far) / 2).cast("long")


def differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(c, node, n, s, diff, near) for (c, node): the tokens that only one of the node's and c's sets has, and whether both link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s, diff, near = [], [], [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                d = np.setxor1d(x, y, assume_unique=True)
                n.append(len(x))
                s.append(len(d))
                diff.append(d.tobytes())
                near.append((100 + percent) * len(d) <= (100 - percent) * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("node"), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(diff, pa.binary()), pa.array(near, pa.bool_())], ["c", "node", "n", "s", "diff", "near"])

    of = sets.select("node", F.col("set").alias("x"))
    to = sets.select(F.col("node").alias("c"), F.col("set").alias("y"))
    return members.join(of, "node").join(to, "c").select("c", "node", "x", "y").mapInArrow(run, "c long, node long, n long, s long, diff binary, near boolean")


def _difference_tokens(found: DataFrame) -> DataFrame:
    """(c, node, key) of every token of every difference; key: a hash of c and the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, "<u8") for x in batch.column("diff").to_pylist()]
            n = np.array([len(x) for x in rows])
            if n.sum():
                c, node = (np.repeat(batch.column(k).to_numpy(), n) for k in ("c", "node"))
                with np.errstate(over="ignore"):
                    key = mix64(mix64(c.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.concatenate(rows)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(node), pa.array(key)], ["c", "node", "key"])

    return found.select("c", "node", "diff").mapInArrow(run, "c long, node long, key long")


def _pairs_of_differences(found: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one central node in different components whose differences share enough tokens to link."""
    tokens = _difference_tokens(found)
    df = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = checkpoint(tokens.join(df, "key"))
    k = shared.groupBy("c", "node").agg(F.count(F.lit(1)).alias("k"))
    rows = found.select("c", "node", "n", "s").join(k, ["c", "node"]).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = checkpoint(rows)
    profile = rows.groupBy("c", "n", "s", "k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    both = lambda x, y: farthest(F.col(f"{x}.n"), F.col(f"{y}.n"), percent)
    least = lambda x, y: least_shared(F.col(f"{x}.s"), F.col(f"{y}.s"), both(x, y))
    can = lambda x, y: F.least(f"{x}.k", f"{y}.k") >= least(x, y)
    met = profile.alias("x").join(profile.alias("y"), (F.col("x.c") == F.col("y.c")) & can("x", "y") & ((F.col("x.lo") != F.col("y.hi")) | (F.col("x.hi") != F.col("y.lo"))))
    alive = met.select("x.c", "x.n", "x.s", "x.k", least("x", "y").alias("least")).groupBy("c", "n", "s", "k").agg(F.min("least").alias("least"))
    rows = rows.join(alive, ["c", "n", "s", "k"])
    place = F.row_number().over(Window.partitionBy("c", "node").orderBy("df", "key"))
    heads = shared.join(rows, ["c", "node"]).withColumn("place", place).where(F.col("place") <= F.col("k") - F.col("least") + 1)
    heads = checkpoint(heads.select("key", "node", "n", "s", "k", "root", "place"))
    fits = lambda x, y: F.col(f"{x}.place") <= F.col(f"{x}.k") - least(x, y) + 1
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    return heads.alias("x").join(heads.alias("y"), apart & can("x", "y") & fits("x", "y") & fits("y", "x")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _later_links(prefix: DataFrame, links: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links of nodes that met at frequent tokens and lie in different components; None if there is no such node."""
    named = checkpoint(prefix.where("often").select("token", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    open_tokens = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    wanted = checkpoint(named.join(open_tokens, "token").select("node").distinct())
    if wanted.isEmpty():
        return None
    sets = _sets(wanted, docs, size)
    rows = _shared_tokens(sets, percent)
    # tokens that no other node has come first in the order and are left out, so they use up the prefix
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - (F.col("n") - F.col("k"))
    rows = rows.withColumn("place", place).where(F.col("place") <= length).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = checkpoint(rows.select("node", "token", "n", "k", "df", "root", F.floor(F.log("n") / F.lit(float(np.log(100 / percent)))).cast("int").alias("class")))
    light = rows.where(f"df <= {LIGHT}")
    bound = "least(x.k, y.k)"
    near = F.expr(f"x.token = y.token AND x.node < y.node AND x.root <> y.root AND 100 * {bound} >= {percent} * (x.n + y.n - {bound})")
    few = light.alias("x").join(light.alias("y"), near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    # linked sets lie in one class of sizes or in neighbouring ones, and so meet in one of these
    wide = rows.where(f"df > {LIGHT}").withColumn("class", F.explode(F.array(F.col("class"), F.col("class") + 1)))
    share = (F.col("k") / F.col("n")).alias("share")
    central = wide.groupBy("token", "class").agg(F.max(F.struct(share, F.xxhash64("node").alias("h"), F.col("node").alias("c"))).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    members = checkpoint(wide.join(central.select("token", "class", "m.c"), ["token", "class"]).select("c", "node").distinct())
    found = written(differences(members, sets, percent), "differences")
    star = found.where("near AND c <> node").select(*_ordered("c", "node"))
    links = checkpoint(links.union(star))
    roots = components(links)
    pairs = few.union(_pairs_of_differences(found, roots, percent)).distinct()
    out = checkpoint(links.union(_verified(checkpoint(_filtered(pairs, nodes, percent)), docs, size, percent)))
    dropped(found)
    dropped(sets)
    return out


def _least_known(counted: DataFrame) -> int:
    """The least count that leaves at most KNOWN_FREQUENT tokens; counts are told apart by eighths of powers of two."""
    step = F.floor(F.log2("count") * 8)
    total, least = 0, 1 << 62
    for r in counted.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).orderBy(F.desc("k")).collect():
        total += r["n"]
        if total > KNOWN_FREQUENT:
            break
        least = r["least"]
    return least


def link(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed documents, sets, roots) of numbered documents: each one's set, each set's node, and the component root of linked nodes."""
    full = written(sign(docs, size, percent), "sets")
    signed = checkpoint(full.select("rid", "doc_id", "n", "sig"))
    first = checkpoint(signed.where("n > 0").groupBy("sig").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least_id")))
    copies = checkpoint(signed.where("n > 0").join(first, "sig").where("rid <> node").select("rid"))
    nodes = written(full.where("n > 0").join(sized(copies), "rid", "left_anti").select(F.col("rid").alias("node"), "n", "low", "f2", "f3"), "nodes")
    dropped(full)
    counted = checkpoint(_exploded(nodes).groupBy("token").count().where(f"count > {LIGHT}"))
    frequent = counted.where(F.col("count") >= _least_known(counted)).toPandas()
    tokens = frequent["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    whole = written(_prefixes(nodes, tokens[order], frequent["count"].to_numpy(np.int64)[order], percent), "prefixes")
    # a token that is not known to be frequent lies in few nodes, so its window is small
    rest = whole.where("NOT often").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1").withColumn("often", F.col("df") > LIGHT).drop("df")
    prefix = written(whole.where("often").unionByName(rest), "prefixes")
    dropped(whole)
    links = checkpoint(_verified(checkpoint(_filtered(_first_pairs(prefix, percent), nodes, percent)), docs, size, percent))
    roots = checkpoint(components(links))
    more = _later_links(prefix, links, roots, nodes, docs, size, percent)
    if more is not None:
        roots = components(more)
    dropped(nodes)
    dropped(prefix)
    return signed, first, roots


def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and row number of each document."""
    rows = numbered(docs, "rows")
    out = _joined(rows, size, percent)
    dropped(rows)
    return out


def _joined(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The join of numbered documents, which nothing reads afterwards."""
    with shuffles_removed(docs.sparkSession):
        signed, nodes, roots = link(docs, size, percent)
        roots = checkpoint(roots)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("node").alias("first_rid"))
    of_sig = named.select("sig", "root").join(least, "root").select("sig", "component_id", "first_rid")
    rows = signed.select("rid", "doc_id", "n", "sig").join(of_sig, "sig", "left")
    alone = F.col("sig").isNull()
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "rid", F.when(alone, F.col("rid")).otherwise(F.col("first_rid")).alias("first_rid"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component, the row with the smallest doc_id stays."""
    row = free_name("row", docs.columns)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    joined = checkpoint(_joined(rows.select(F.col(row).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), size, percent))
    kept = joined.groupBy("first_rid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("rid"))).alias("k")).select(F.col("k.rid").alias(row))
    return rows.join(kept, row, "left_semi").select(*columns_of(docs))


def op2(docs: DataFrame) -> DataFrame:
    return join(docs, 3, 90).select("doc_id", "n_shingles", "component_id")


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d WHERE len(w) >= 3),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w || ' ' || lead(w, 1) OVER (PARTITION BY doc_id ORDER BY i) || ' ' || lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM x) WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)
"""
