"""Posts: labels, markers, tags, rendering, and the quality gates around it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.functions import text as T
from feedsieve.functions import vocab as V
from feedsieve.functions.matchers import contains_any, has_word, let, mapped, quoted
from feedsieve.operators import ground

# Labels and markers.
OFFICIAL, RUMOR = "◉ Официально", "◎ Слух"
BOLT, WARNING = "⚡️", "⚠️"
REGULATION, DATA, LARGE_MOVE = "🏛", "📊", "💥"
FLAG = "[\U0001f1e6-\U0001f1ff]{2}"


def _source(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)))


def keyword_match(text: Column, words: tuple[str, ...], substring: str = " -", found: Column | None = None) -> Column:
    """Any of the words, between word boundaries; those with a character of `substring` anywhere.

    A plain word is looked up among those of the text, which `found` holds if they are at hand.
    """
    part = tuple(w for w in words if any(c in w for c in substring))
    plain = [w for w in words if re.fullmatch(r"\w+", w) and w not in part]
    other = [w for w in words if w not in part and w not in plain]
    ways = [has_word(_words(text) if found is None else found, plain)] if plain else []
    ways += [text.rlike(r"(?U)\b(?:" + "|".join(map(quoted, other)) + r")\b")] if other else []
    ways += [contains_any(text, part)] if part else []
    return reduce(lambda a, b: a | b, ways)


def is_established_source(official: Column, source_name: Column, link: Column) -> Column:
    host = T.domain(link)
    named = contains_any(F.concat_ws(" ", F.lower(F.coalesce(source_name, F.lit(""))), host), V.OUTLETS)
    return official | named | host.endswith(".gov") | F.contains(host, F.lit(".gov."))


def credibility_label(df: DataFrame) -> Column:
    """Needs title, summary, official, source_name and link."""
    text = _source("title", "summary")
    rumor = contains_any(F.lower(text), V.RUMOR_PHRASES) | text.rlike(V.RUMOR_WORD)
    sure = contains_any(F.lower(text), V.OFFICIAL_PHRASES) | is_established_source(F.col("official"), F.col("source_name"), F.col("link"))
    return F.when(rumor, RUMOR).when(sure, OFFICIAL).otherwise(RUMOR)


def is_large_move(body: Column, tickers: Column) -> Column:
    shares = F.regexp_extract_all(F.coalesce(tickers, F.lit("")), F.lit(r"[↑↓]\s*([0-9]+(?:[.,][0-9]+)?)\s*%"), F.lit(1))
    big = F.exists(shares, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double") >= 10)
    return big | keyword_match(F.lower(F.coalesce(body, F.lit(""))), V.STRONG_MOVE)


def type_marker(text: Column, body: Column, tickers: Column) -> Column:
    """First of regulation, data and large move; empty if none.  text: title, summary and body."""
    low = F.lower(text)
    return F.when(keyword_match(low, V.REGULATION), REGULATION).when(keyword_match(low, V.DATA), DATA).when(is_large_move(body, tickers), LARGE_MOVE).otherwise("")


def clean_prefix(raw: Column) -> Column:
    flag = F.regexp_extract(F.coalesce(raw, F.lit("")), FLAG, 0)
    return F.when(flag != "", flag).when(F.contains(raw, F.lit("⚠")), WARNING).when(F.contains(raw, F.lit("⚡")), BOLT).otherwise("")


def is_recent(published_s: Column, as_of_s: Column, hours: int = V.BREAKING_HOURS) -> Column:
    return F.coalesce(as_of_s - published_s <= hours * 3600, F.lit(False))


def gated_prefix(raw: Column, speech: Column, recent: Column) -> Column:
    prefix = clean_prefix(raw)
    return F.when(speech, WARNING).when((prefix == BOLT) & ~recent, "").otherwise(prefix)


def hashtags(text: Column, prefix: Column, most: int = V.MAX_TAGS) -> Column:
    """At most four tags: assets by alphabet of their names, then themes, then places."""
    low = F.lower(text)
    assets = {}
    for name, tag in sorted(V.ALIASES.items()):
        assets.setdefault(f"#{tag.upper()}", []).append(name)
    flag = F.try_element_at(mapped(V.FLAG_TAGS), F.regexp_extract(F.coalesce(prefix, F.lit("")), FLAG, 0))

    def tags(found: Column) -> Column:
        rules = lambda table: [F.when(keyword_match(low, tuple(words), " .-", found), tag) for tag, words in table.items()]
        return F.slice(F.array_distinct(F.array_compact(F.array(*rules(assets), *rules(V.THEME_TAGS), flag, *rules(V.GEO_TAGS)))), 1, most)

    return let(_words(low), tags)


def needs_editor(label: Column, score: Column, text: Column) -> Column:
    return ((label == OFFICIAL) | (score >= 70)) & (F.coalesce(text, F.lit("")) != "")


def render(posts: DataFrame) -> DataFrame:
    """Adds label, marker, clean (the cleaned text), body, tags and `post`.

    posts: an item (title, summary, link, source_name, official, published_s, observed_s, year,
    is_upcoming_speech) joined with its generated fields prefix, text and tickers.
    """
    df = posts.withColumn("label", credibility_label(posts)).withColumn("_tick", T.sanitize(T.strip_urls(F.coalesce("tickers", F.lit("")))))
    df = df.withColumn("clean", T.clean_body(F.coalesce(F.nullif("text", F.lit("")), F.nullif("summary", F.lit("")), F.col("title"))))
    df = df.withColumn("marker", type_marker(_source("title", "summary", "clean"), F.col("clean"), F.col("_tick")))
    df = df.withColumn("_prefix", F.concat("marker", gated_prefix(F.col("prefix"), F.col("is_upcoming_speech"), is_recent(F.col("published_s"), F.col("observed_s")))))
    df = df.withColumn("_source", _source("title", "summary"))
    df = df.withColumn("body", ground.grounded(T.clean_artifacts(F.col("clean")), F.col("_source")))
    df = df.withColumn("body", T.strip_invalid_years(F.col("body"), F.col("_source"), F.col("year")))
    df = df.withColumn("tags", hashtags(_source("title", "summary", "body", "_tick"), F.col("_prefix")))
    name = T.html_escape(F.coalesce(F.nullif("source_name", F.lit("")), F.lit("Источник")))
    link = F.when(F.coalesce("link", F.lit("")) != "", F.concat(F.lit('<a href="'), T.html_escape(F.col("link")), F.lit('">'), name, F.lit("</a>"))).otherwise(name)
    first = F.when(F.col("_prefix") != "", F.trim(F.concat_ws(" ", "_prefix", T.html_escape(F.col("body"))))).otherwise(T.html_escape(F.col("body")))
    lines = [first, F.when(F.col("_tick") != "", F.concat(F.lit("\n<code>"), T.html_escape(F.col("_tick")), F.lit("</code>"))), F.concat(F.lit("\n"), F.concat_ws(" · ", "label", link)), F.when(F.size("tags") > 0, F.concat(F.lit("\n"), F.array_join("tags", " ")))]
    return df.withColumn("post", F.concat_ws("\n", *lines)).drop("_tick", "_prefix", "_source")


def quality_gate(rendered: DataFrame) -> DataFrame:
    """Adds `problem`: why a post is not published; null if it is."""
    return rendered.withColumn("problem", F.coalesce(T.body_problem(F.col("clean")), F.when(T.has_residual_artifact(F.col("post")), "artifact")))


def emitted_and_rejected(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts that pass the gate, and the rest with their problems."""
    return checked.where(F.col("problem").isNull()).drop("problem"), checked.where(F.col("problem").isNotNull())


def reference_check(generated: DataFrame, items: DataFrame) -> DataFrame:
    """Generated text beside the item it was written from, by uid."""
    fields = T.parse_model_output(F.col("raw"))
    return generated.withColumn("f", fields).select("uid", "provider", "f.prefix", "f.text", "f.tickers").join(items, "uid")
