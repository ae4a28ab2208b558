"""Merkle manifest of a dataset, with a witness for every row.

A row's leaf is a digest of its columns.  The leaves of a group (a language here) make a tree
whose nodes have `ARITY` children, and the groups' roots make another tree, whose root stands
for the dataset.  A row's witness is what a reader needs beside the row to work out that root:
for each level the digests left and right of its node.

Trees grow by appending.  `Frontier` keeps the open run of each level; a run that is full, or
closed at the end, becomes one node of the next level, and at that moment its members' witnesses
are extended by their siblings.  Leaves are appended in aligned blocks of `ARITY ** height`, each
block in one task, which gives the blocks' roots.  These are appended in turn, so there are as
many tiers as the largest group needs.  A second pass over the leaves appends them again with
witnesses, which are then extended by their block's, so that witnesses are never shuffled.

Defined cases: a null value counts as `-`; null ids and groups come first; rows with equal ids go
by their digests, and rows equal throughout are leaves each; a group of one row is its own root;
an empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.llm.common import ascii_lower, crc32_mod, in_order, sized, small_batches, written

ARITY = 8
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, place long, size long, digest binary"
PATH = "lefts array<binary>, rights array<binary>"


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def node_of(digests: list[bytes]) -> bytes:
    """The digest of a run of nodes: of their digests as text."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def height_of(size: int, most: int) -> int:
    """Levels above the leaves of a tree, at most those of a block."""
    levels = 0
    while size > 1 and levels < most:
        size, levels = -(-size // ARITY), levels + 1
    return levels


class Frontier:
    """A growing tree of at most one block: open runs of each level, and the witnesses of its leaves, as far as they are known."""

    def __init__(self, height: int, with_paths: bool):
        self.height, self.with_paths = height, with_paths
        #: For each level the nodes of its open run: digest, first leaf and leaf after the last.
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(height + 1)]
        self.paths: list[tuple[list[bytes], list[bytes]]] = []

    def append(self, digest: bytes) -> None:
        at = len(self.paths)
        self.paths.append(([], []))
        self._put(0, (digest, at, at + 1))

    def _put(self, level: int, node: tuple[bytes, int, int]) -> None:
        self.open[level].append(node)
        if level < self.height and len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        if self.with_paths:
            for k, (_, first, end) in enumerate(run):
                left, right = b"".join(digests[:k]), b"".join(digests[k + 1 :])
                for lefts, rights in self.paths[first:end]:
                    lefts.append(left)
                    rights.append(right)
        self._put(level + 1, (node_of(digests), run[0][1], run[-1][2]))

    def close(self) -> bytes:
        """Completes the runs that are still open, shorter ones too, and gives the root."""
        for level in range(self.height):
            if self.open[level]:
                self._complete(level)
        return self.open[self.height][0][0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each tree and block, which follow one another."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _block(height: int) -> Column:
    return F.floor(F.col("place") / ARITY**height).alias("block")


def block_roots(nodes: DataFrame, height: int) -> DataFrame:
    """The roots of aligned blocks, as nodes of the next tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            tree = Frontier(height_of(rows[0]["size"], height), False)
            for row in rows:
                tree.append(row["digest"])
            made = (rows[0]["tree"], rows[0]["block"], -(-rows[0]["size"] // ARITY**height), tree.close())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["tree", "place", "size", "digest"])

    ordered = nodes.select("tree", "place", "size", "digest", _block(height)).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    return ordered.mapInArrow(run, NODE)


def witnessed(nodes: DataFrame, above: DataFrame, kept: str, height: int) -> DataFrame:
    """Nodes with witnesses (lefts, rights), which go on with those of their block in `above` (tree, place, lefts, rights, root, subroot).

    A block's row goes before its nodes in the same task.  `kept` names further columns of the nodes, with types.
    """
    names = [c.split()[0] for c in kept.split(", ")] if kept else []
    facts = above.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), "lefts", "rights", "subroot", "root")
    rows = nodes.select("tree", "place", "size", "digest", *names, _block(height)).unionByName(facts, allowMissingColumns=True)
    schema = f"tree long, place long, digest binary, {kept + ', ' if kept else ''}{PATH}, subroot binary, root binary"
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    fields = {name: kinds[kind] for name, kind in (c.split() for c in schema.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fact, *rows in _blocks(batches):
            tree = Frontier(height_of(rows[0]["size"], height), True)
            for row in rows:
                tree.append(row["digest"])
            tree.close()
            for row, (lefts, rights) in zip(rows, tree.paths, strict=True):
                row |= {"lefts": lefts + fact["lefts"], "rights": rights + fact["rights"], "subroot": fact["subroot"], "root": fact["root"]}
            for at in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows[at : at + 500]], kind) for f, kind in fields.items()], list(fields))

    ordered = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    return ordered.mapInArrow(run, schema)


def _tiers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of these one's blocks, until each tree has one node."""
    tiers, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        tiers.append(written(block_roots(tiers[-1], height), "merkle"))
        most = -(-most // ARITY**height)
    return tiers


def _down(tiers: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """Witnesses of the lowest tier but one, from the witness of each tree's root (tree, place 0)."""
    for tier in reversed(tiers[1:-1]):
        above = written(witnessed(tier, above, "", height), "merkle")
    return above


def with_witnesses(rows: DataFrame, tree: str, kept: str, height: int = HEIGHT) -> DataFrame:
    """Rows (`tree` column, doc_id, digest and `kept`) with tree root, dataset root and witness.

    Rows of a tree go by doc_id, then by digest; trees by their column's value in bytes.
    """
    # the number of a row parts rows that are equal throughout, which else would all meet in one range
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle")
    placed = in_order(rows, [tree, "doc_id", "digest", "_row"], "merkle")
    trees = placed.groupBy(F.col(tree).alias("_value")).agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("size"))
    trees = in_order(trees, ["_first"], "merkle").withColumnRenamed("place", "_tree")
    names = [c.split()[0] for c in kept.split(", ")]
    leaves = placed.join(sized(trees), F.col(tree).eqNullSafe(F.col("_value"))).select(F.col("_tree").alias("tree"), (F.col("place") - F.col("_first")).alias("place"), "size", "digest", *names)
    tiers = _tiers(leaves, height)
    tops = tiers[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees.count()).cast("long").alias("size"), "digest")
    upper = _tiers(tops, height)
    root = upper[-1].select("tree", "place", *_nothing(), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    whole = witnessed(tops, _down(upper, root, height), "", height)
    facts = whole.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
    return witnessed(leaves, _down(tiers, written(facts, "merkle"), height), kept, height)


def _nothing() -> list[Column]:
    return [F.array().cast("array<binary>").alias(c) for c in ("lefts", "rights")]


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded(digest: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its witness give, as hexadecimal text."""
    levels = F.arrays_zip(lefts.alias("lefts"), rights.alias("rights"))
    return F.aggregate(levels, _hex(digest), lambda d, x: F.sha2(F.concat(_hex(x["lefts"]), d, _hex(x["rights"])), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """One digest over all siblings, level by level from the leaf up, left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(_hex(a), _hex(b))), ""), 256)


def manifest(docs: DataFrame, tree: str = "lang", other: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(doc_id, digest, lefts, rights, subroot, root, changed) of every row: the manifest of documents by `tree`.

    `changed` is the digest of the row with the text `other` in place of its own, and null where `other` is null.
    """
    small_batches(docs.sparkSession)
    values = [F.col("doc_id").cast("long"), *map(F.col, FIELDS[1:])]
    changed = leaf([*values[:-1], other]) if other is not None else F.lit(None).cast("binary")
    if other is not None:
        changed = F.when(other.isNotNull(), changed)
    rows = docs.select(F.col(tree).cast("string").alias("_tree_value"), values[0].alias("doc_id"), leaf(values).alias("digest"), changed.alias("changed"))
    return with_witnesses(rows, "_tree_value", "doc_id long, changed binary", height)


def op11(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A third of the rows are looked up with their text in lower case, the others as they are; see `manifest`."""
    tampered = F.when(crc32_mod(F.col("doc_id"), 3) == 0, ascii_lower(F.col("text").cast("string")))
    rows = manifest(docs, other=tampered, height=height).withColumn("folded_root", folded(F.coalesce("changed", "digest"), F.col("lefts"), F.col("rights")))
    root = _hex(F.col("root"))
    return rows.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"), proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


#: The checksum of an id's decimal text, bit by bit; the polynomial is that of zlib.
CRC32 = "xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT), lambda c, b: list_reduce(range(0, 8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295)"
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || {})"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UP = f"""SELECT u.tree, u.level + 1 AS level, u.place // {ARITY} AS place, sha256(string_agg(u.digest, '' ORDER BY u.place)) AS digest, (any_value(u.size) + {ARITY - 1}) // {ARITY} AS size
 FROM {{0}} u WHERE u.size > 1 GROUP BY u.tree, u.level, u.place // {ARITY}"""
_WALK = f"""SELECT w.row, w.tree, w.level + 1 AS level, w.place // {ARITY} AS place, w.seen || coalesce(s.before, '') || coalesce(s.after, '') AS seen, sha256(coalesce(s.before, '') || w.fold || coalesce(s.after, '')) AS fold
 FROM {{0}} w JOIN (SELECT n.tree, n.level, n.place, string_agg(m.digest, '' ORDER BY m.place) FILTER (WHERE m.place < n.place) AS before, string_agg(m.digest, '' ORDER BY m.place) FILTER (WHERE m.place > n.place) AS after
  FROM {{1}} n JOIN {{1}} m ON m.tree = n.tree AND m.level = n.level AND m.place // {ARITY} = n.place // {ARITY} WHERE n.size > 1 GROUP BY n.tree, n.level, n.place) s ON s.tree = w.tree AND s.level = w.level AND s.place = w.place"""
SQL = f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS row, coalesce(doc_id::VARCHAR, '') AS id, {_LEAF.format(_FIELD.format("text"))} AS leaf FROM documents),
t AS (SELECT *, CASE WHEN ({CRC32.format("id")}) % 3 = 0 THEN {_LEAF.format(_FIELD.format(_LOW))} ELSE leaf END AS used FROM d),
l AS (SELECT *, coalesce('1' || lang, '0') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM t),
nodes AS (SELECT tree, 0 AS level, place, leaf AS digest, size FROM l UNION ALL {_UP.format("nodes")}),
tops AS (SELECT '' AS tree, 0 AS level, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, digest, count(*) OVER () AS size, tree AS of FROM nodes WHERE size = 1),
upper_nodes AS (SELECT tree, level, place, digest, size FROM tops UNION ALL {_UP.format("upper_nodes")}),
walk AS (SELECT row, tree, 0 AS level, place, '' AS seen, used AS fold FROM l UNION ALL {_WALK.format("walk", "nodes")}),
turned AS (SELECT w.row, '' AS tree, 0 AS level, p.place, w.seen, w.fold FROM walk w JOIN nodes n ON n.tree = w.tree AND n.level = w.level AND n.size = 1 JOIN tops p ON p.of = w.tree),
climb AS (SELECT * FROM turned UNION ALL {_WALK.format("climb", "upper_nodes")})
SELECT l.doc_id, l.leaf, p.digest AS subroot, r.digest AS root, sha256(c.seen) AS proof_sha256, c.fold AS folded_root, c.fold = r.digest AS verified
FROM l JOIN tops p ON p.of = l.tree JOIN upper_nodes r ON r.size = 1 JOIN climb c ON c.row = l.row AND c.level = r.level"""
