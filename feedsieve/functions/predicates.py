"""All row filters of the curation: flags computed once, and gates over the flags.

A gate is a SQL condition over flag columns and earlier gates.  Every rule reads the flags,
so each vocabulary is matched once a row however many rules need it.  Columns needed:
title, summary, link, source_id, source_name, official, impact (base), year (of the time
of observation).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsieve.functions import vocab as V
from feedsieve.functions.matchers import Flag, known_words

#: The fields that flags look at, as SQL that both engines read.
FIELDS = {
    "text": "concat(coalesce(title, ''), ' ', coalesce(summary, ''))",
    "low": "lower(concat(coalesce(title, ''), ' ', coalesce(summary, '')))",
    "head": "coalesce(title, '')",
    "low_head": "lower(coalesce(title, ''))",
    "low_link": "lower(coalesce(link, ''))",
    "low_source": "lower(concat(coalesce(source_id, ''), ' ', coalesce(source_name, '')))",
}

FLAGS = {
    "n_tier1": Flag("count", "low", V.TIER1),
    "n_tier2": Flag("count", "low", V.TIER2),
    "n_catalyst": Flag("count", "low", V.CATALYST),
    "f_relevant": Flag("terms", "low", V.RELEVANT),
    "f_geo": Flag("terms", "low", V.GEOPOLITICAL),
    "f_anchor": Flag("terms", "low", V.MARKET_ANCHOR),
    "f_regional": Flag("terms", "low", V.REGIONAL),
    "f_commentary": Flag("terms", "low", V.COMMENTARY),
    "f_figure": Flag("terms", "low", V.SPEECH_FIGURES),
    "f_influential": Flag("parts", "low", V.INFLUENTIAL),
    "f_ad": Flag("regex", "text", V.AD),
    "f_horoscope": Flag("regex", "text", V.HOROSCOPE),
    "f_opinion": Flag("regex", "text", V.OPINION),
    "f_routine": Flag("regex", "text", V.ROUTINE),
    "f_bare_move": Flag("regex", "text", V.BARE_MOVE),
    "f_intent": Flag("regex", "text", V.SPEECH_INTENT),
    "f_historical": Flag("regex", "text", V.HISTORICAL),
    "f_reference": Flag("regex", "text", V.YEAR_REFERENCE),
    "f_retro": Flag("regex", "text", V.RETRO_TOPIC),
    "f_current": Flag("regex", "text", V.CURRENT),
    "f_explains": Flag("regex", "text", V.RETRO_EXPLAIN),
    "f_crypto": Flag("regex", "text", V.CRYPTO_SUBJECT),
    "h_past": Flag("regex", "head", V.SPEECH_PAST),
    "h_future": Flag("regex", "head", V.SPEECH_FUTURE),
    "h_current": Flag("regex", "head", V.CURRENT),
    "h_number": Flag("regex", "head", V.NEWS_NUMBER),
    "h_question": Flag("regex", "head", V.QUESTION),
    "h_forecast_move": Flag("regex", "head", V.FORECAST_MOVE),
    "h_forecast_analyst": Flag("regex", "head", V.FORECAST_ANALYST),
    "h_price_target": Flag("regex", "head", V.PRICE_TARGET),
    "h_forecast_topic": Flag("regex", "head", V.FORECAST_TOPIC),
    "h_forecast_fact": Flag("regex", "head", V.FORECAST_FACT),
    "h_technical": Flag("regex", "head", V.TECHNICAL),
    "h_level": Flag("regex", "head", V.LEVEL),
    "h_geo": Flag("terms", "low_head", V.GEOPOLITICAL),
    "h_event": Flag("terms", "low_head", V.EVENT),
    "h_move": Flag("terms", "low_head", V.MOVE),
    "h_tier1": Flag("terms", "low_head", V.TIER1),
    "h_catalyst": Flag("terms", "low_head", V.CATALYST),
    "h_meme": Flag("terms", "low_head", V.MEMECOIN),
    "h_phrase": Flag("parts", "low_head", V.COMMENTARY_PHRASES),
    "l_section": Flag("parts", "low_link", V.URL_SECTIONS),
    "s_strict": Flag("parts", "low_source", ("zerohedge",)),
    "f_rumor": Flag("parts", "low", V.RUMOR_PHRASES),
    "f_rumor_word": Flag("exact", "text", V.RUMOR_WORD),
    "f_official": Flag("parts", "low", V.OFFICIAL_PHRASES),
}

YEARS = r"\b(20[0-9]{2})\b"

#: In order; a gate may use flags, years and gates above it.
GATES = {
    "matches_keywords": "official OR f_relevant",
    "is_ad": "NOT official AND f_ad",
    "is_price_horoscope": "f_horoscope",
    "is_opinion": "f_opinion",
    "has_influential_author": "f_influential",
    "is_upcoming_speech": "f_intent AND NOT (h_past AND NOT h_future) AND f_figure",
    "has_tier1": "n_tier1 > 0",
    "is_geopolitical": "f_geo",
    "has_market_anchor": "f_anchor",
    "is_regional_noise": "f_regional AND n_tier1 = 0",
    "is_commentary": "f_commentary",
    "is_routine_move": "f_routine OR f_bare_move",
    "is_year_reference": "f_reference",
    "is_retrospective_topic": "f_retro OR (NOT f_reference AND f_historical)",
    "title_is_historical": "title_old",
    "is_historical": "f_retro OR (NOT f_reference AND (title_old OR (f_historical AND NOT recent_year)))",
    "has_real_event": "official OR is_upcoming_speech OR f_influential OR h_geo OR h_event OR (h_move AND h_tier1)",
    "is_forecast": "h_forecast_move OR h_forecast_analyst OR h_price_target OR (h_forecast_topic AND NOT h_forecast_fact)",
    "is_technical_analysis": "h_technical OR h_level",
    "is_non_news": "is_forecast OR is_technical_analysis",
    "is_memecoin_pump": "h_meme AND NOT h_event",
    "has_hard_news_signal": "h_current OR h_number OR h_catalyst",
    "has_news_signal": "has_hard_news_signal OR h_tier1",
    "is_noise_url": "l_section",
    "has_rumor_language": "f_rumor OR f_rumor_word",
    "has_official_language": "f_official",
    "has_current": "f_current OR this_year OR f_reference",
}

NOISE_RULE = """CASE
 WHEN NOT official AND is_noise_url THEN 'U'
 WHEN is_upcoming_speech THEN NULL
 WHEN NOT official AND NOT is_year_reference AND is_retrospective_topic THEN 'R'
 WHEN NOT official AND past_year AND NOT has_current THEN 'A'
 WHEN NOT official AND h_phrase THEN 'B'
 WHEN f_explains AND (past_year OR f_crypto) THEN 'C'
 WHEN NOT official AND h_question AND NOT has_hard_news_signal THEN 'D'
 WHEN s_strict AND (past_year OR NOT has_current OR f_historical) THEN 'E'
 END"""

#: First failing gate of publication, null for what may be published.
UNPUBLISHED = """CASE
 WHEN noise_rule IS NOT NULL THEN 'noise'
 WHEN is_ad THEN 'ad'
 WHEN is_price_horoscope THEN 'horoscope'
 WHEN NOT official AND is_historical THEN 'historical'
 WHEN is_upcoming_speech THEN NULL
 WHEN NOT official AND NOT has_influential_author AND is_non_news THEN 'non_news'
 WHEN NOT official AND is_memecoin_pump THEN 'memecoin'
 WHEN NOT matches_keywords THEN 'off_topic'
 WHEN {anchor} AND NOT official AND is_geopolitical AND NOT has_market_anchor THEN 'no_anchor'
 WHEN is_opinion AND NOT official AND NOT has_influential_author THEN 'opinion'
 WHEN NOT official AND NOT has_real_event THEN 'no_event'
 END"""

SCORE = """CAST(greatest(0, least(100, impact
 + CASE WHEN official THEN 25 ELSE 0 END + CASE WHEN is_upcoming_speech THEN 25 ELSE 0 END
 + 18 * least(n_tier1, 2) + 8 * least(n_tier2, 2) + 10 * least(n_catalyst, 2)
 - CASE WHEN n_tier1 = 0 AND f_regional THEN 30 ELSE 0 END
 - CASE WHEN n_tier1 = 0 AND f_commentary AND NOT official THEN 15 ELSE 0 END
 - CASE WHEN n_tier1 = 0 AND n_catalyst = 0 AND is_routine_move THEN 25 ELSE 0 END
 - CASE WHEN is_opinion AND NOT official AND NOT has_influential_author THEN 20 ELSE 0 END)) AS INT)"""

REJECTED = """CASE
 WHEN unpublished IS NOT NULL THEN unpublished
 WHEN NOT official AND NOT is_upcoming_speech AND n_tier1 = 0 AND n_catalyst = 0 AND NOT has_real_event THEN 'filler'
 WHEN NOT official AND NOT is_upcoming_speech AND f_routine AND n_catalyst = 0 THEN 'routine'
 WHEN score < {least} AND NOT official AND NOT is_upcoming_speech THEN 'low_impact'
 END"""

#: Age in seconds; a time without a zone is not trusted.
AGE_REASON = """CASE
 WHEN published_s IS NULL THEN 'no_date'
 WHEN NOT published_has_tz THEN 'naive_date'
 WHEN published_s > observed_s THEN 'future'
 WHEN observed_s - published_s > {hours} * 3600 THEN 'old'
 END"""


def layers() -> list[list[str]]:
    """The gates in as few steps as their dependence allows; each step is one projection."""
    depth: dict[str, int] = {}
    for name, rule in GATES.items():
        depth[name] = 1 + max((depth[w] for w in re.findall(r"\w+", rule) if w in depth), default=-1)
    return [[n for n, d in depth.items() if d == k] for k in range(max(depth.values()) + 1)]


def with_flags(items: DataFrame) -> DataFrame:
    """Adds the fields' flags and the year facts, each worked out once."""
    df = items.withColumns({k: F.expr(v) for k, v in FIELDS.items()})
    years, head_years = F.regexp_extract_all("text", F.lit(YEARS), F.lit(1)), F.regexp_extract_all("head", F.lit(YEARS), F.lit(1))
    vocabularies: dict[str, list] = {}
    for f in FLAGS.values():
        if f.kind in ("terms", "count"):
            vocabularies.setdefault(f.field, []).append(f.what)
    df = df.withColumns({f"_{field}_words": known_words(F.col(field), *v) for field, v in vocabularies.items()})
    flags = {k: f.column(F.col(f"_{f.field}_words") if f.field in vocabularies else None) for k, f in FLAGS.items()}
    df = df.withColumns(flags | {"_years": years, "_head_years": head_years})
    y = F.col("year")
    return df.withColumns({
        "title_old": (F.size("_head_years") > 0) & F.forall("_head_years", lambda x: x.cast("int") < y),
        "past_year": F.exists("_years", lambda x: (x.cast("int") >= 2010) & (x.cast("int") < y)),
        "recent_year": F.exists("_years", lambda x: x.cast("int").isin(y, y - 1)),
        "this_year": F.contains("text", y.cast("string")),
    }).drop("_years", "_head_years", *[f"_{field}_words" for field in vocabularies])


def with_gates(items: DataFrame, least: int = V.MIN_IMPACT, require_anchor: bool = True) -> DataFrame:
    """Adds every predicate, `noise_rule`, `unpublished`, `score` and `reject_reason`."""
    df = with_flags(items)
    for layer in layers():
        df = df.withColumns({name: F.expr(GATES[name]) for name in layer})
    df = df.withColumn("noise_rule", F.expr(NOISE_RULE))
    df = df.withColumn("unpublished", F.expr(UNPUBLISHED.format(anchor=str(require_anchor).lower())))
    df = df.withColumn("score", F.expr(SCORE))
    return df.withColumn("reject_reason", F.expr(REJECTED.format(least=least)))


def age_reason(hours: int = V.MAX_AGE_HOURS):
    return F.expr(AGE_REASON.format(hours=hours))


def gates_sql(items: str, least: int = V.MIN_IMPACT, require_anchor: bool = True) -> str:
    """Common table expressions that end in `gated`, from a table expression named by `items`."""
    fields = ", ".join(f"{v} AS {k}" for k, v in FIELDS.items())
    flags = ", ".join(f"{f.sql()} AS {k}" for k, f in FLAGS.items())
    all_years, head_years = f"regexp_extract_all(text, '{YEARS}', 1)", f"regexp_extract_all(head, '{YEARS}', 1)"
    gates = "".join(f", {rule} AS {name}" for name, rule in GATES.items())
    return f"""fielded AS (SELECT *, {fields} FROM {items}),
flagged AS (SELECT *, {flags},
 len({head_years}) > 0 AND len(list_filter({head_years}, lambda x: x::INT >= year)) = 0 AS title_old,
 len(list_filter({all_years}, lambda x: x::INT >= 2010 AND x::INT < year)) > 0 AS past_year,
 len(list_filter({all_years}, lambda x: x::INT = year OR x::INT = year - 1)) > 0 AS recent_year,
 contains(text, year::VARCHAR) AS this_year FROM fielded),
ruled AS (SELECT *{gates} FROM flagged),
noised AS (SELECT *, {NOISE_RULE} AS noise_rule FROM ruled),
judged AS (SELECT *, {UNPUBLISHED.format(anchor=str(require_anchor).lower())} AS unpublished, {SCORE} AS score FROM noised),
gated AS (SELECT *, {REJECTED.format(least=least)} AS reject_reason FROM judged)"""
