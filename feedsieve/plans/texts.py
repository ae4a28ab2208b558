"""Registered text, post and source queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsieve.functions import text as T
from feedsieve.functions import vocab as V
from feedsieve.functions.matchers import quoted
from feedsieve.operators import curate as C
from feedsieve.operators import ground
from feedsieve.operators import posts as O
from feedsieve.plans.curation import BASE, CYCLE, DECIDED
from feedsieve.plans.items import DUCK_ITEMS, items, spread
from feedsieve.sources import feeds


def _documents(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.strip_urls(t)).alias("no_urls"), F.md5(T.sanitize(t)).alias("sanitized"), F.md5(T.strip_forbidden(t)).alias("allowed"), F.md5(T.keep_concrete_sentences(t)).alias("concrete"), F.md5(T.clean_body(t)).alias("clean"))


def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.truncate_at_sentence(F.col("text"))).alias("cut"), F.md5(T.html_escape(F.col("text"))).alias("escaped"))


def validate_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.body_problem(F.col("text")).alias("problem"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their links, one in five of them in a section that brings no news."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.concat("url", F.when(F.col("page_id") % 5 == 0, "/learn/more").otherwise(""))
    return pages.select("page_id", T.domain(url).alias("domain"), F.lower(url).rlike("|".join(map(quoted, V.URL_SECTIONS))).alias("is_noise_url"))


def labels_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    text = O._source("title", "summary")
    label = O.credibility_label(rows)
    return rows.select("arrival", label.alias("label"), O.type_marker(text, F.col("title"), F.lit("↑ 12%")).alias("marker"), F.array_join(O.hashtags(text, F.lit("")), " ").alias("tags"))


def needs_editor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.judged(items(spark, sf_dir), cycle_seconds=CYCLE)
    return rows.select("arrival", O.needs_editor(O.credibility_label(rows), F.col("score"), F.col("title")).alias("needs_editor"))


#: What is added to every text by turns: a quote, numbers and a speaker that it lacks, some that it has, a line of tickers.
ADDED = (" «Мы рады новым возможностям»", " Sales grew to 777123 units and 4.5%.", " Quentin Marlowe: it will be so.", "", "\nТИКЕРЫ: BTC 5\nend")


def _pairs(spark, sf_dir):
    """Documents as sources, and as bodies their texts with other figures and an addition."""
    added = F.element_at(F.array(*[F.lit(x) for x in ADDED]), (F.pmod("doc_id", F.lit(len(ADDED))) + 1).cast("int"))
    return _documents(spark, sf_dir).withColumnRenamed("text", "source").withColumn("body", F.concat(F.translate("source", "37", "82"), added))


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the grounded texts, and how much of each went."""
    b, s = F.col("body"), F.col("source")
    rows = _pairs(spark, sf_dir).select("doc_id", "body", ground.filter_quotes(b, s).alias("q"), ground.validate_numbers(b, s).alias("n"), ground.clean_made_up_names(b, s).alias("w"))
    return rows.select("doc_id", *[F.md5(c).alias(k) for k, c in (("quoted", "q"), ("numbers", "n"), ("names", "w"))], *[(F.col(c) != F.col("body")).alias(f"{k}_changed") for k, c in (("quoted", "q"), ("numbers", "n"), ("names", "w"))])


def ungrounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", F.size(T.plain_numbers(F.col("body"))).alias("numbers"), F.size(T.ungrounded_numbers(F.col("body"), F.col("source"))).alias("ungrounded"))


def strip_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("arrival", T.strip_invalid_years(O._source("title", "summary"), F.col("summary"), F.col("year")).alias("body"))


def parse_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    raw = F.when(F.col("arrival") % 2 == 0, F.to_json(F.struct(F.lit("⚡️").alias("prefix"), F.col("title").alias("text")))).otherwise(F.concat(F.lit("ПРЕФИКС: ⚡️\nтекст — "), F.col("title")))
    got = rows.select("arrival", T.parse_model_output(raw).alias("f"))
    return got.select("arrival", "f.prefix", "f.text", "f.tickers")


#: Generated texts by turns: sound ones, one with invented figures, a placeholder, too short a one, a token over and over.
GENERATED = ("The deal was confirmed today.", "It cost 77 million in 2019. Volume was 123456.", "Lorem ipsum.", "", "go go go go", "Ivan Petrov: it is done.")


def render_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.kept(items(spark, sf_dir), cycle_seconds=CYCLE)
    said = F.element_at(F.array(*[F.lit(x) for x in GENERATED]), (F.col("arrival") % len(GENERATED) + 1).cast("int"))
    text = F.when(said == "", F.lit("ok")).otherwise(F.concat_ws(" ", "title", said))
    fields = rows.withColumns({"prefix": F.lit("⚡️"), "text": text, "tickers": F.when(F.col("arrival") % 2 == 0, "BTC: $1 (↑ 12%)").otherwise("")})
    return O.quality_gate(O.render(fields)).select("arrival", "post", "problem")


def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    safe = T.html_escape(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    item = F.concat(F.lit("<item><title>Turn "), F.col("turn"), F.lit(" of "), F.col("conv_id"), F.lit("</title><link>https://news.example/"), F.col("conv_id"), F.lit("/"), F.col("turn"), F.lit("</link><description>"), safe, F.lit("</description><pubDate>Mon, 01 Jan 2024 10:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00 +0300</pubDate></item>"))
    docs = c.groupBy(F.col("conv_id").cast("string").alias("source_id")).agg(F.concat(F.lit('<?xml version="1.0"?><rss><channel>'), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    return feeds.read_rss(docs).select("source_id", "title", "link", F.trim("summary").alias("summary"), "guid", F.unix_seconds("published").alias("published_s"))


def channel_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = T.strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    block = F.concat(F.lit('<div class="tgme_widget_message" data-post="c/'), F.col("conv_id"), F.lit("/"), F.col("turn"), F.lit('"><br><div class="tgme_widget_message_text js">'), T.html_escape(text), F.lit('</div><a class="tgme_widget_message_date" href="https://t.example/'), F.col("conv_id"), F.lit('">x</a></div>'))
    pages = c.select(F.col("conv_id").cast("string").alias("source_id"), F.concat(F.lit("<html><body>"), block, F.lit("</body></html>")).alias("html"))
    return feeds.parse_channel_html(pages).select("source_id", "title", "link", F.md5("summary").alias("summary"), "guid")


_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_URL = lambda x: f"regexp_replace({x}, '(?i){V.URLS}', '', 'g')"
_CHARS = T.ALLOWED.replace("'", "''")
_SANE = lambda x: _STRIP(f"regexp_replace(regexp_replace({x}, '[^{_CHARS}]', '', 'g'), '[ \\t]{{2,}}', ' ', 'g')")
_FORB = lambda x: _STRIP(f"regexp_replace(regexp_replace({x}, '(?i)(?:{'|'.join(map(quoted, V.FORBIDDEN))})', '', 'g'), '\\s{{2,}}', ' ', 'g')")
_SENT = lambda x: f"list_filter(string_split(regexp_replace({_STRIP(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP('s')} <> '')"
_CONC = lambda x: _STRIP(f"array_to_string(list_filter({_SENT(x)}, lambda s, i: i = 1 OR regexp_matches(s, '{T.CONCRETE}')), ' ')")
_DOCS = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_ESC = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _any(text: str, words, substring: str) -> str:
    whole = "|".join(quoted(w) for w in words if not any(c in w for c in substring))
    part = [w for w in words if any(c in w for c in substring)]
    return "(" + " OR ".join([f"regexp_matches({text}, '\\b(?:{whole})\\b')", *(f"contains({text}, '{w}')" for w in part)]) + ")"


def _parts(text: str, words) -> str:
    joined = "|".join(map(quoted, words)).replace("'", "''")
    return f"regexp_matches({text}, '{joined}')"


_ASSETS: dict[str, list[str]] = {}
for _name, _tag in sorted(V.ALIASES.items()):
    _ASSETS.setdefault(f"#{_tag.upper()}", []).append(_name)
_TAGS = ", ".join(f"CASE WHEN {_any('low', w, ' .-')} THEN '{t}' END" for t, w in [*_ASSETS.items(), *V.THEME_TAGS.items(), *V.GEO_TAGS.items()])
_LABEL = f"""CASE WHEN {_parts('low', V.RUMOR_PHRASES)} OR regexp_matches(tx, '{V.RUMOR_WORD}') THEN '{O.RUMOR}'
 WHEN {_parts('low', V.OFFICIAL_PHRASES)} OR official OR {_parts("lower(source_name) || ' news.example'", V.OUTLETS)} THEN '{O.OFFICIAL}' ELSE '{O.RUMOR}' END"""
_ITEMS = f"WITH {DUCK_ITEMS}, x AS (SELECT *, title || ' ' || summary AS tx, lower(title || ' ' || summary) AS low FROM items)"


def _plain(text: str) -> str:
    """Numbers as doubles.  Without look-around, a replacement is made again where matches may overlap."""
    for pattern, put, times in (("([0-9])[\\s\u00a0]+([0-9])", "\\1\\2", 2), ("([0-9]),([0-9]{3})([^0-9]|$)", "\\1\\2\\3", 3), ("([0-9]+),([0-9]{1,2})([^0-9]|$)", "\\1.\\2\\3", 2)):
        for _ in range(times):
            text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return f"list_transform(regexp_extract_all({text}, '[0-9]+(?:\\.[0-9]+)?'), lambda v: v::DOUBLE)"


#: The write-up's queue of each day, what a sound post costs, and its budget of 20 calls, one item after the other.
_WRITTEN = f"""{DECIDED}, q AS (SELECT *, observed_s // 86400 AS day, title || ' ' || summary AS tx FROM decided WHERE outcome = 'queued'),
a AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY arrival) AS arrived FROM q),
r AS (SELECT arrival, day, row_number() OVER (PARTITION BY day ORDER BY score DESC, arrival) AS drain, score, official, arrival % 11 <> 0 AS made, arrival % 7 <> 0 AS sound, arrival % 11 <> 0 AND (({_LABEL}) = '{O.OFFICIAL}' OR score >= 70) AS editor_used FROM a WHERE arrived <= 200),
w AS (SELECT day, 0::BIGINT AS drain, 0::BIGINT AS used, true AS passed FROM (SELECT DISTINCT day FROM r)
 UNION ALL SELECT day, drain, used + CASE WHEN ok AND made AND sound THEN CASE WHEN editor_used THEN 2 ELSE 1 END ELSE 0 END, ok FROM
  (SELECT r.*, w.used, 20 - w.used > 4 OR (20 - w.used > 0 AND (r.score >= 50 OR r.official)) OR (w.used >= 20 AND (r.official OR r.score >= 80)) AS ok FROM w JOIN r ON r.day = w.day AND r.drain = w.drain + 1))"""

ORACLES = {
    "write_up": f"{_WRITTEN} SELECT r.arrival, r.day, r.drain::INT AS drain, r.editor_used, CASE WHEN NOT w.passed THEN 'budget' WHEN NOT r.made THEN 'no_text' WHEN NOT r.sound THEN 'too_few_words' ELSE 'sent' END AS outcome FROM r JOIN w USING (day, drain)",
    "needs_editor": f"{BASE} SELECT arrival, (({_LABEL}) = '{O.OFFICIAL}' OR score >= 70) AND title <> '' AS needs_editor FROM (SELECT *, title || ' ' || summary AS tx FROM gated)",
    "ungrounded_numbers": f"""WITH p AS (SELECT doc_id, coalesce(text, '') AS source FROM documents),
q AS (SELECT doc_id, source, translate(source, '37', '82') || [{", ".join("'" + x + "'" for x in ADDED)}][1 + (doc_id % {len(ADDED)} + {len(ADDED)}) % {len(ADDED)}] AS body FROM p),
n AS (SELECT doc_id, {_plain('body')} AS b, {_plain('source')} AS s FROM q)
SELECT doc_id, len(b)::INT AS numbers, len(list_filter(b, lambda x: len(list_filter(s, lambda k: abs(x - k) / (k + 1e-9) <= 0.05)) = 0))::INT AS ungrounded FROM n""",
    "clean_text": f"{_DOCS} SELECT doc_id, md5({_URL('t')}) AS no_urls, md5({_SANE('t')}) AS sanitized, md5({_FORB('t')}) AS allowed, md5({_CONC('t')}) AS concrete, md5({_CONC(_FORB(_SANE(_URL('t'))))}) AS clean FROM d",
    "truncate_text": f"""{_DOCS}, h AS (SELECT *, t[1:{V.MAX_POST}] AS head FROM d), c AS (SELECT *, regexp_extract(head, '(?s)^(.*[.!?])', 1) AS cut FROM h)
SELECT doc_id, md5(CASE WHEN length(t) <= {V.MAX_POST} THEN t WHEN cut <> '' THEN regexp_replace(cut, '\\s+$', '') ELSE regexp_replace(head, '\\s+$', '') || '...' END) AS cut, md5({_ESC('t')}) AS escaped FROM c""",
    "validate_body": f"""{_DOCS}, w AS (SELECT *, {_STRIP('t')} AS s, list_transform(regexp_extract_all(t, '{T.WORD}'), lambda x: lower(x)) AS w FROM d)
SELECT doc_id, CASE WHEN s = '' THEN 'empty' WHEN {_parts('lower(s)', V.PLACEHOLDERS)} THEN 'placeholder' WHEN len(w) < 3 THEN 'too_few_words'
 WHEN len(list_filter(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2])) > 0 THEN 'repeated_token' END AS problem FROM w""",
    "page_links": f"SELECT page_id, lower(regexp_extract(link, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS domain, {_parts('lower(link)', V.URL_SECTIONS)} AS is_noise_url FROM (SELECT *, url || CASE WHEN page_id % 5 = 0 THEN '/learn/more' ELSE '' END AS link FROM pages)",
    "labels_and_tags": f"""{_ITEMS} SELECT arrival, {_LABEL} AS label, CASE WHEN {_any('low', V.REGULATION, ' -')} THEN '{O.REGULATION}' WHEN {_any('low', V.DATA, ' -')} THEN '{O.DATA}' ELSE '{O.LARGE_MOVE}' END AS marker,
 array_to_string(list_filter([{_TAGS}], lambda v: v IS NOT NULL)[1:{V.MAX_TAGS}], ' ') AS tags FROM x""",
    "parse_output": f"WITH {DUCK_ITEMS} SELECT arrival, '⚡️' AS prefix, title AS text, NULL::VARCHAR AS tickers FROM items",
    "rss_items": f"""SELECT conv_id::VARCHAR AS source_id, 'Turn ' || turn || ' of ' || conv_id AS title, 'https://news.example/' || conv_id || '/' || turn AS link, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS summary,
 'https://news.example/' || conv_id || '/' || turn AS guid, 1704092400 + 60 * (turn % 60) AS published_s FROM conversations""",
    "channel_items": f"""WITH c AS (SELECT *, {_STRIP("regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')")} AS t FROM conversations)
SELECT conv_id::VARCHAR AS source_id, t[1:160] AS title, 'https://t.example/' || conv_id AS link, md5(t) AS summary, 'c/' || conv_id || '/' || turn AS guid FROM c WHERE t <> ''""",
    "strip_years": f"""{_ITEMS}, p AS (SELECT arrival, summary, {_SENT('tx')} AS ss FROM x)
SELECT arrival, {_STRIP("array_to_string(list_filter(ss, lambda s: len(list_filter(regexp_extract_all(s, '\\b(19[0-9]{2}|20[0-9]{2})\\b', 1), lambda y: y::INT < 2024 AND NOT contains(summary, y))) = 0), ' ')")} AS body FROM p""",
}
QUERIES = (clean_text, truncate_text, validate_body, page_links, labels_and_tags, needs_editor, grounding, ungrounded_numbers, strip_years, parse_output, render_posts, rss_items, channel_items)
del _name, _tag
