"""Mixing sources to target weights: temperature mixing in DataFrame expressions alone.

Each source's share of all tokens is raised to an exponent and normalised.  The
exponent is found by bisection so that the weights meet a target entropy, which is part of the
way from the entropy that the sources have to that of equal weights unless one is given: below
one it levels sources that are too uneven.  Above one it would sharpen sources that are more
even than a target that is given; it goes so far only if `exponents` says so.  A limit on
repetition then keeps the exponent near enough to one.  The mixture says what its target
was, what entropy it has, and what stood in between (`limited_by`).  Each pass over the
small table of sources weighs fifteen inner points at once, which is four bisection
steps.  A source then gets its weight of the token budget: whole passes over its
documents and a part of one more.

Each pass is a permutation of blocks: documents are dealt into blocks by a hash of
pass and id, blocks are ordered by a hash, and whole blocks are taken while the
budget lasts; only the block in which it ends is cut, at a document.  A block has
about `block_tokens` tokens however large its source, and blocks are summed up in
stretches of their order first, so no task gathers a source or all of its blocks.
`mix_at`, a place between 0 and 1 in the order of the mixture, spreads the blocks of
every source evenly.

Defined cases: a null source is a source of its own; a null or empty text counts
one token, its end; repeated rows are dealt apart as they come; sources that are all
alike have exponent 1, as no exponent changes their weights; an empty table gives an
empty mixture; input columns of any name are kept by `mix_documents`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.llm.common import SPACES, checkpoint, columns_of, free_name

POINTS = 15
PASSES = 12
#: The exponents that bisection may choose from: sources are levelled, never sharpened.
EXPONENTS = (0.0, 1.0)
#: How far the target lies from the sources' own entropy to that of equal weights.
LEVEL = 0.5
#: Blocks in one stretch of a pass's order, about; sums go over stretches, then inside each.
STRETCH_BLOCKS = 4096
#: Sources are broadcast up to this many rows; beyond it Spark chooses the join.
BROADCAST_SOURCES = 10_000


def n_tokens(text: Column) -> Column:
    """Words of a text and its end."""
    return (F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")) + 1).cast("long")


def source_tokens(measured: DataFrame) -> DataFrame:
    return measured.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def _facts(sources: DataFrame, exponents: list[float], total: float) -> list[tuple[float, float, float]]:
    """(entropy, largest repetition at a budget of all tokens, and at the budget that covers every source once) for each exponent, in one pass over the sources."""
    p = F.col("tokens") / F.lit(total)
    row = sources.agg(
        *[F.sum(F.pow(p, F.lit(a))) for a in exponents],
        *[F.sum(F.pow(p, F.lit(a)) * F.log(p)) for a in exponents],
        *[F.max(F.pow(p, F.lit(a - 1))) for a in exponents],
        *[F.max(F.pow(p, F.lit(1 - a))) for a in exponents],
    ).first()
    n = len(exponents)
    return [(math.log(row[i]) - a * row[n + i] / row[i], row[2 * n + i] / row[i], row[2 * n + i] * row[3 * n + i]) for i, a in enumerate(exponents)]


def find_exponent(sources: DataFrame, total: float, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, cover: bool = False, exponents: tuple[float, float] = EXPONENTS) -> float:
    """The exponent by bisection.

    `entropy`: a share of the entropy of equal weights; the exponent whose weights have it, or the
    nearest one in `exponents`.  More even weights have a smaller exponent.
    `max_repeats`: passes over any source.  Repetition grows on both sides of one, so the exponent is
    moved towards one until it keeps to the limit.
    `cover`: the limit holds at the budget that gives every source one whole pass, where that is larger.
    """
    row = sources.agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if row["n"] < 2 or row["least"] == row["most"]:
        return 1.0

    def bisect(low: float, high: float, goes_on) -> float:
        """goes_on(entropy, repeats, repeats when covering): whether the wanted exponent is at or above this one."""
        for _ in range(PASSES):
            step = (high - low) / (POINTS + 1)
            inner = [low + step * (i + 1) for i in range(POINTS)]
            passed = sum(goes_on(*f) for f in _facts(sources, inner, total))
            low, high = low + step * passed, low + step * (passed + 1)
        return (low + high) / 2

    found = 1.0
    if entropy is not None:
        found = bisect(*exponents, lambda h, r, c: h >= entropy * math.log(row["n"]))
    if max_repeats is not None:
        scale = (budget or total) / total
        # covering adds a little against rounding, for which the limit leaves room
        repeats = lambda r, c: max(r * scale, c * (1 + 1e-6) if cover else 0.0)
        if found < 1:
            found = max(found, bisect(exponents[0], 1.0, lambda h, r, c: repeats(r, c) > max_repeats))
        elif found > 1:
            found = min(found, bisect(1.0, exponents[1], lambda h, r, c: repeats(r, c) <= max_repeats))
    return found


def target_entropy(sources: DataFrame, total: float, level: float = LEVEL) -> float:
    """The entropy, as a share of that of equal weights, a part of the way from the sources' own to equal weights; 1 for fewer than two sources."""
    n = sources.count()
    return 1.0 if n < 2 else (1 - level) * _facts(sources, [1.0], total)[0][0] / math.log(n) + level


def limited_by(exponent: float, reached: float, target: float | None, exponents: tuple[float, float]) -> str:
    """What decided the exponent: the target, the end of the exponents, or the limit on repeats."""
    if target is None or abs(reached - target) < 1e-6:
        return "target"
    return "exponents" if min(abs(exponent - e) for e in (*exponents, 1.0)) < 1e-6 else "repeats"


def _covering(sources: DataFrame, exponent: float, total: float) -> float:
    """The tokens at which the source that is thinned most gets one pass; a little is added against rounding."""
    power = F.pow(F.col("tokens") / F.lit(total), F.lit(exponent))
    row = sources.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    return (row[0] or 0.0) * (row[1] or 0.0) * (1 + 1e-9) + 1


def quotas(sources: DataFrame, exponent: float, total: float, budget: float, block_tokens: int) -> DataFrame:
    """Weight, whole passes, tokens of the last pass and blocks of each source."""
    power = F.pow(F.col("tokens") / F.lit(total), F.lit(exponent))
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    quota = F.round(F.col("weight") * F.lit(budget)).cast("long")
    return (
        sources.withColumn("weight", power / F.lit(norm))
        .withColumn("quota", F.greatest(quota, F.lit(0)))
        .withColumn("passes", F.floor(F.col("quota") / F.col("tokens")).cast("int"))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
        .withColumn("blocks", F.ceil(F.col("tokens") / block_tokens).cast("long"))
    )


def _hash(*cols) -> Column:
    return F.xxhash64(*cols)


def mix(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = 4.0, budget: int | None = None, block_tokens: int = 1 << 16, seed: int = 17, keys: tuple[str, ...] = ("doc_id",), cover: bool = False, exponents: tuple[float, float] = EXPONENTS) -> DataFrame:
    """The mixture: a row for each time that a document is used, without its text.

    `entropy` is a share of that of equal weights; see `target_entropy` if none is given.
    `budget` is in tokens; all tokens of the input if none is given.  With `cover` it is raised
    to the least budget that gives every source one whole pass, so no document is left out.
    """
    measured = checkpoint(docs.select(*[F.col(k) for k in keys], F.col("source"), n_tokens(F.col("text")).alias("n_tokens")))
    sources = checkpoint(source_tokens(measured))
    total = float(sources.agg(F.sum("tokens")).first()[0] or 1)
    budget = float(budget or total)
    entropy = target_entropy(sources, total) if entropy is None else entropy
    exponent = find_exponent(sources, total, entropy, max_repeats, budget, cover, exponents)
    n = max(2, sources.count())
    reached = (_facts(sources, [exponent], total)[0][0] if sources.count() > 1 else math.log(n)) / math.log(n)
    if cover:
        budget = max(budget, _covering(sources, exponent, total))
    plan = checkpoint(quotas(sources, exponent, total, budget, block_tokens))
    of = plan.select(F.col("source").alias("of"), "weight", "quota", "passes", "rest", "blocks")
    if plan.count() <= BROADCAST_SOURCES:
        of = F.broadcast(of)
    used = measured.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    dealt = used.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1))))
    dealt = dealt.where(F.col("pass") >= 0).withColumn("draw", _hash(*[F.col(k) for k in keys], F.col("pass"), F.lit(seed)))
    dealt = dealt.withColumn("block", F.pmod(F.col("draw"), F.col("blocks")))
    blocks = dealt.groupBy("source", "pass", "block").agg(F.sum("n_tokens").alias("block_sum"), F.first("rest").alias("rest"), F.first("passes").alias("passes"), F.first("quota").alias("quota"))
    # the order of a pass is cut into stretches, so that sums run over stretches and then inside each
    blocks = blocks.join(of.select(F.col("of").alias("s"), "blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    blocks = blocks.withColumn("at", F.pmod(_hash(F.col("block"), F.col("pass"), F.lit(seed + 1)), F.lit(1 << 40)))
    blocks = checkpoint(blocks.withColumn("stretch", F.floor(F.col("at") * F.ceil(F.col("blocks") / STRETCH_BLOCKS) / F.lit(1 << 40)).cast("long")).drop("blocks"))
    whole = Window.partitionBy("source", "pass")
    upto = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("source", "pass", "stretch").agg(F.sum("block_sum").alias("n"))
    sums = sums.select(F.col("source").alias("s"), F.col("pass").alias("p"), F.col("stretch").alias("t"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("earlier"), F.sum("n").over(whole).alias("pass_tokens"))
    inner = Window.partitionBy("source", "pass", "stretch").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (F.col("stretch") == F.col("t"))).drop("s", "p", "t")
    blocks = blocks.withColumn("before", F.col("earlier") + F.coalesce(F.sum("block_sum").over(inner), F.lit(0)))
    room = F.when(F.col("pass") < F.col("passes"), F.col("block_sum")).otherwise(F.col("rest") - F.col("before"))
    blocks = blocks.withColumn("room", room).where("room > 0")
    first = F.col("pass") * F.col("pass_tokens") + F.col("before")
    blocks = blocks.select(F.col("source").alias("s"), F.col("pass").alias("p"), F.col("block").alias("b"), "block_sum", "room", ((first + F.pmod(_hash(F.col("block"), F.col("source"), F.lit(seed + 2)), F.lit(1 << 20)) / F.lit(1 << 20)) / F.greatest(F.col("quota"), F.lit(1))).alias("mix_at"))
    taken = dealt.drop("quota", "passes", "rest", "blocks").join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (F.col("block") == F.col("b")))
    inside = Window.partitionBy("source", "pass", "block").orderBy("draw", *keys)
    taken = taken.withColumn("place", F.row_number().over(inside)).withColumn("upto", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    taken = taken.where((F.col("room") >= F.col("block_sum")) | (F.col("upto") <= F.col("room")))
    return taken.select(*keys, "source", "n_tokens", "pass", "block", "place", "mix_at", "weight", F.lit(exponent).alias("exponent"), F.lit(entropy).alias("target_entropy"), F.lit(reached).alias("entropy"), F.lit(limited_by(exponent, reached, entropy, exponents)).alias("limited_by"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixture as documents: a row for each use, with the columns of the input.

    Rows get a number first, as ids may repeat or be null; the numbered table is
    written once, so that both sides of the join see the same numbers.
    """
    row = free_name("row", docs.columns)
    numbered = checkpoint(docs.withColumn(row, F.monotonically_increasing_id()))
    slim = numbered.select(F.col(row).alias("doc_id"), "source", "text")
    used = mix(slim, **how).select(F.col("doc_id").alias(row))
    return used.join(numbered, row).select(*columns_of(docs))


def shares(mixture: DataFrame) -> DataFrame:
    """For each source: its weight, and the share of the mixture's tokens that it has got."""
    got = mixture.groupBy("source").agg(F.first("weight").alias("weight"), F.first("exponent").alias("exponent"), F.sum("n_tokens").alias("tokens"))
    return got.withColumn("share", F.col("tokens") / F.lit(got.agg(F.sum("tokens")).first()[0] or 1))


def op1(docs: DataFrame) -> DataFrame:
    return mix(docs)
