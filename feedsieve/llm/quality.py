"""Quality rules: a rule bitmask ledger in DataFrame expressions alone.

Every rule is evaluated once for each document.  The ledger keeps its
measurements and a bit for each rule that fails; a policy is a named set of
bits, so a new policy or an ablation reads the ledger and never a text.

Defined cases: a null text has no words and fails `few_words`; repeated rows,
also of one doc_id, are measured row by row; other columns of the input, whatever
their names, do not matter; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.llm.common import SPACES, let

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bullet_lines")

#: Rule name -> SQL condition under which it fails; a rule's place is its bit.  Integers only, so results are exact.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 14 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines AND n_lines >= 4",
    "shouting": "2 * n_upper > word_chars",
    "bullets": "10 * n_bullet_lines > 9 * n_lines AND n_lines >= 4",
    "many_words": "n_words > 100000",
}
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "v1": ("few_words", "repeated_windows", "symbols", "word_length"),
    "v2": ("few_words", "repeated_windows", "symbols", "word_length", "repeated_lines", "shouting", "bullets"),
    "strict": tuple(RULES),
}


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def _window_key(words: Column, i: Column, bits: Column) -> Column:
    """The hash of the three words from place i, with i in the low bits."""
    h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("bigint"))


def repeated_words(words: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more.

    Windows are sorted by a part of their hash, which leaves the few that may be
    equal; only these are compared as texts.  The work is n log n for any text.
    """
    n = F.size(words)
    bits = F.when(n < 1 << 24, 24).otherwise(31)

    def alike(keys: Column, b: Column) -> Column:
        def near(x: Column, i: Column) -> Column:
            return F.call_function("shiftrightunsigned", x.bitwiseXOR(F.get(keys, i)), b) == 0

        return F.filter(keys, lambda x, i: F.coalesce(near(x, i - 1), F.lit(False)) | F.coalesce(near(x, i + 1), F.lit(False)))

    def places(keys: Column, b: Column) -> Column:
        at = F.transform(alike(keys, b), lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b) - 1).cast("int"))
        text = lambda p: F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))
        pairs = F.sort_array(F.transform(at, lambda p: F.struct(text(p).alias("g"), p.alias("p"))))
        same = lambda s: F.filter(s, lambda x, i: F.coalesce((F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"]), F.get(s, i + 1)["g"] == x["g"], F.get(s, i - 1)["g"] == x["g"], F.lit(False)))
        return let(pairs, lambda s: F.sort_array(F.transform(same(s), lambda x: x["p"])))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(p, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))["n"]

    keys = let(F.struct(words.alias("w"), bits.alias("b")), lambda s: F.sort_array(F.transform(F.sequence(F.lit(0), F.size(s["w"]) - 3), lambda i: _window_key(s["w"], i, s["b"]))))
    return F.when(n < 3, 0).otherwise(let(keys, lambda k: covered(places(k, bits)))).cast("bigint")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `fail_bits` with a bit for each rule that fails."""
    t = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    t = t.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    t = t.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\u000b\f\r", "")) > 0))
    words = F.col("words")
    m = t.select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("bigint").alias("n_upper"),
        F.size(F.filter("lines", lambda x: F.substring(x, 1, 1).isin("-", "*", "•"))).cast("bigint").alias("n_bullet_lines"),
    )
    bits = sum((F.when(F.expr(f), 1 << i).otherwise(0) for i, f in enumerate(RULES.values())), F.lit(0))
    return m.withColumn("fail_bits", bits.cast("bigint"))


def apply_policy(measured: DataFrame, version: str = "v2") -> DataFrame:
    """Adds base_failed and kept, by the bits of one policy."""
    hit = lambda rules: F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("bigint")) != 0
    return measured.withColumns({"base_failed": hit(BASE), "kept": ~hit(BASE) & ~hit(POLICIES[version])})


def ablation(measured: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it."""
    rules = POLICIES[version]
    all_bits = F.lit(mask(rules)).cast("bigint")
    got = F.col("fail_bits").bitwiseAND(all_bits)
    one = {r: F.lit(mask([r])).cast("bigint") for r in rules}
    sums = measured.agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(got == 0).alias("kept"),
        *[F.count_if(got.bitwiseAND(b) != 0).alias(f"fail_{r}") for r, b in one.items()],
        *[F.count_if(got == b).alias(f"only_{r}") for r, b in one.items()],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"fail_{r}").alias("failed"), F.col(f"only_{r}").alias("failed_alone"), (F.col("kept") + F.col(f"only_{r}")).alias("kept_without")) for r in rules]))
    return sums.select("docs", "kept", rows.alias("x")).select("x.rule", "docs", "kept", "x.failed", "x.failed_alone", "x.kept_without")


def keep_good(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The documents that a policy keeps, with the columns they came with.

    Ids may repeat or be null, so each row is judged by its own text: the rules are evaluated beside the row.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(row.alias("doc_id"), F.col("text"))
    judged = apply_policy(ledger(held), version)
    # a filter would be pushed below the ledger and work the rules out again inside it
    kept = judged.select(F.explode(F.when(F.col("kept"), F.array("doc_id"))).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9(docs: DataFrame) -> DataFrame:
    return apply_policy(ledger(docs)).select("doc_id", *MEASURES[:5], "base_failed", "kept", "fail_bits")


_UP = "length(regexp_replace(t, '[^A-Z]', '', 'g'))"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
g AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER (PARTITION BY rid ORDER BY i) || ' ' || lead(w, 2) OVER (PARTITION BY rid ORDER BY i) AS g FROM w),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
p AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS q FROM r) GROUP BY rid),
c AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (WHERE l[1] IN ('-', '*', '•')) AS n_bullet_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, {_UP}::BIGINT AS n_upper, coalesce(n_bullet_lines, 0)::BIGINT AS n_bullet_lines
  FROM d LEFT JOIN c USING (rid) LEFT JOIN l USING (rid) LEFT JOIN p USING (rid)),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(RULES.values()))})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
  (fail_bits & {mask(BASE)}) <> 0 AS base_failed, (fail_bits & {mask((*BASE, *POLICIES["v2"]))}) = 0 AS kept FROM f
"""
