"""Derived keys: item id, story key, subject key (numbers, assets and words of a title)."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsieve.functions import vocab as V
from feedsieve.functions.matchers import mapped, text_sql, words_in

WORDS = r"[a-zA-Zа-яёА-ЯЁ]{3,}"
TICKER = r"(?<![A-Za-z0-9_])[A-Z]{2,5}(?![A-Za-z0-9_])"
PROPER = r"(?<![A-Za-z0-9_а-яёА-ЯЁ])[A-ZА-ЯЁ][a-zA-Zа-яёА-ЯЁ]{3,}(?![A-Za-z0-9_а-яёА-ЯЁ])"


def _renamed(words: Column, table: dict) -> Column:
    """Words as the table names them; looked up by hash first, as most words are not in the table."""
    pairs = ", ".join(f"{text_sql(k)}, {text_sql(v)}" for k, v in table.items())
    known = ", ".join(map(text_sql, table))
    return F.call_function("transform", words, F.expr(f"w -> CASE WHEN w IN ({known}) THEN coalesce(try_element_at(map({pairs}), w), w) ELSE w END"))


def uid(guid: Column, link: Column, source_id: Column, title: Column) -> Column:
    """First of guid, link and source:title that is not empty, as 32 hex digits of its SHA-256."""
    basis = F.coalesce(F.nullif(guid, F.lit("")), F.nullif(link, F.lit("")), F.concat(F.coalesce(source_id, F.lit("")), F.lit(":"), F.coalesce(title, F.lit(""))))
    return F.substring(F.sha2(basis, 256), 1, 32)


def normalise_number(token: Column) -> Column:
    """A number as written in text, in one form: separators, suffix multipliers and per cent signs; null if it is none."""
    bare = F.replace(F.lower(F.trim(F.regexp_replace(token, "%+$", ""))), F.lit("$"), F.lit(""))
    form = r"^([0-9.,]+)\s*([a-zа-я]+)?$"
    digits, suffix = F.regexp_extract(bare, form, 1), F.regexp_extract(bare, form, 2)
    decimal = F.contains(digits, F.lit(",")) & ~F.contains(digits, F.lit(".")) & digits.rlike(",[0-9]{1,2}$")
    plain = F.when(decimal, F.replace(digits, F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    value = plain.try_cast("double") * F.coalesce(F.try_element_at(mapped(V.MULTIPLIERS), suffix).cast("double"), F.lit(1.0))
    # all digits are written out, also where a double would show an exponent
    whole, part = value.try_cast("decimal(38,0)").cast("string"), F.regexp_replace(value.try_cast("decimal(38,18)").cast("string"), "0+$", "")
    written = F.coalesce(F.when(value % 1 == 0, whole).otherwise(part), value.cast("string"))
    return F.concat(written, F.when(F.endswith(token, F.lit("%")), F.lit("%")).otherwise(F.lit("")))


def _numbers(title: Column) -> Column:
    found = F.transform(F.regexp_extract_all(title, F.lit("(?iu)" + V.NUMBER), F.lit(0)), normalise_number)
    return F.filter(found, lambda x: x.isNotNull())


def _without(words: Column, values) -> Column:
    return F.call_function("filter", words, F.expr(f"w -> w NOT IN ({', '.join(map(text_sql, values))})"))


def _alias(words: Column) -> Column:
    return _renamed(words_in(words, V.ALIASES), V.ALIASES)


def _canonical(words: Column) -> Column:
    return _renamed(words, V.SYNONYMS)


def story_tokens(title: Column) -> Column:
    """Numbers and assets; without a number also the significant words.  Sorted, each once."""
    title = F.trim(F.coalesce(title, F.lit("")))
    low = F.regexp_extract_all(F.lower(title), F.lit(WORDS), F.lit(0))
    tickers = F.transform(F.regexp_extract_all(title, F.lit(TICKER), F.lit(0)), F.lower)
    assets = F.concat(_alias(low), _renamed(tickers, V.ALIASES))
    words = _canonical(_without(F.filter(low, lambda w: F.length(w) >= 4), V.STOPWORDS))
    numbers = _numbers(title)
    return F.sort_array(F.array_distinct(F.when(F.size(numbers) > 0, F.concat(numbers, assets)).otherwise(F.concat(assets, words))))


def subject_tokens(title: Column) -> Column:
    """Known assets and the longest capitalised word; the first of equally long ones."""
    title = F.trim(F.coalesce(title, F.lit("")))
    low = F.regexp_extract_all(F.lower(title), F.lit(WORDS), F.lit(0))
    tickers = F.transform(F.regexp_extract_all(title, F.lit(TICKER), F.lit(0)), F.lower)
    proper = F.transform(F.regexp_extract_all(title, F.lit(PROPER), F.lit(0)), F.lower)
    names = _canonical(_without(proper, (*V.STOPWORDS, *V.ALIASES)))
    longest = F.aggregate(names, F.lit("").cast("string"), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.sort_array(F.array_distinct(F.concat(_alias(low), _alias(tickers), F.when(longest != "", F.array(longest)).otherwise(F.array().cast("array<string>")))))


#: The key of a title without any token.
EMPTY = sha256(b"").hexdigest()[:24]


def _key(tokens: Column) -> Column:
    return F.substring(F.sha2(F.array_join(tokens, " "), 256), 1, 24)


def story_key(title: Column) -> Column:
    return _key(story_tokens(title))


def subject_key(title: Column) -> Column:
    return _key(subject_tokens(title))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_map(table: dict) -> str:
    return "MAP {" + ", ".join(f"{_lit(k)}: {_lit(v) if isinstance(v, str) else v}" for k, v in table.items()) + "}"


def keys_sql(items: str) -> str:
    """Common table expressions that end in `keyed`: uid, story_key, subject_key of a table of items."""
    aliases, synonyms, factors = _sql_map(V.ALIASES), _sql_map(V.SYNONYMS), _sql_map(V.MULTIPLIERS)
    stop, skipped = ("[" + ", ".join(map(_lit, w)) + "]" for w in (V.STOPWORDS, (*V.STOPWORDS, *V.ALIASES)))
    twice = "regexp_replace(ttl, '([^A-Za-z0-9_а-яёА-ЯЁ])', '\\1\\1', 'g')"
    bounded = lambda p: f"regexp_extract_all({twice}, '(?:^|[^A-Za-z0-9_])({p})(?:$|[^A-Za-z0-9_])', 1)"
    alias = lambda w: f"list_filter(list_transform({w}, lambda w: {aliases}[w]), lambda w: w IS NOT NULL)"
    form = r"^([0-9.,]+)\s*([a-zа-я]+)?$"
    return f"""titled AS (SELECT *, trim(coalesce(title, '')) AS ttl FROM {items}),
worded AS (SELECT *, regexp_extract_all(lower(ttl), '{WORDS}') AS lows, list_transform({bounded('[A-Z]{2,5}')}, lambda w: lower(w)) AS tick,
 list_transform({bounded('[A-ZА-ЯЁ][a-zA-Zа-яёА-ЯЁ]{3,}')}, lambda w: lower(w)) AS proper, regexp_extract_all(ttl, '(?i){V.NUMBER.replace("'", "''")}') AS toks FROM titled),
bare AS (SELECT *, list_transform(toks, lambda k: replace(lower(trim(regexp_replace(k, '%+$', ''))), '$', '')) AS bares FROM worded),
parts AS (SELECT *, list_transform(bares, lambda b: regexp_extract(b, '{form}', 1)) AS digs, list_transform(bares, lambda b: regexp_extract(b, '{form}', 2)) AS sufs FROM bare),
vals AS (SELECT *, list_transform(range(1, len(toks) + 1), lambda i: TRY_CAST(CASE WHEN contains(digs[i], ',') AND NOT contains(digs[i], '.') AND regexp_matches(digs[i], ',[0-9]{{1,2}}$') THEN replace(digs[i], ',', '.') ELSE replace(digs[i], ',', '') END AS DOUBLE)
 * coalesce({factors}[sufs[i]], 1)) AS nums FROM parts),
numbered AS (SELECT *, list_filter(list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN nums[i] = floor(nums[i]) THEN nums[i]::BIGINT::VARCHAR ELSE nums[i]::VARCHAR END || CASE WHEN toks[i][-1] = '%' THEN '%' ELSE '' END), lambda x: x IS NOT NULL) AS numbers,
 list_concat({alias('lows')}, list_transform(tick, lambda w: coalesce({aliases}[w], w))) AS assets,
 list_transform(list_filter(lows, lambda w: length(w) >= 4 AND NOT list_contains({stop}, w)), lambda w: coalesce({synonyms}[w], w)) AS significant,
 list_transform(list_filter(proper, lambda w: NOT list_contains({skipped}, w)), lambda w: coalesce({synonyms}[w], w)) AS names FROM vals),
longest AS (SELECT *, list_filter(names, lambda w: length(w) = list_max(list_transform(names, lambda v: length(v))))[1:1] AS top FROM numbered),
keyed AS (SELECT *, substr(sha256(coalesce(nullif(guid, ''), nullif(link, ''), source_id || ':' || title)), 1, 32) AS uid,
 substr(sha256(array_to_string(list_sort(list_distinct(CASE WHEN len(numbers) > 0 THEN list_concat(numbers, assets) ELSE list_concat(assets, significant) END)), ' ')), 1, 24) AS story_key,
 substr(sha256(array_to_string(list_sort(list_distinct(list_concat(list_concat({alias('lows')}, {alias('tick')}), top))), ' ')), 1, 24) AS subject_key FROM longest)"""
