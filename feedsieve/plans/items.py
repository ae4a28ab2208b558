"""Items derived from the `events` table, the same in Spark SQL and in DuckDB SQL.

The test tables hold no news feed, so headlines are templates filled by arithmetic on the
events.  Only integers and text functions are used, so both engines give equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: id, name, kind, category, official, base impact, enabled.  All are invented; one name holds that of the source with stricter rules.
SOURCES = (
    ("ledger_daily", "Ledger Daily", "rss", "crypto", False, 45, True),
    ("pine_street", "Pine Street Journal", "rss", "markets", False, 40, True),
    ("chain_letter", "Chain Letter", "rss", "crypto", False, 35, True),
    ("rates_office", "Office of Rates", "rss", "regulator", True, 60, True),
    ("harbour_news", "Harbour News", "rss", "markets", False, 40, True),
    ("zerohedge_mirror", "Zerohedge Mirror", "rss", "markets", False, 30, True),
    ("token_times", "Token Times", "rss", "crypto", False, 40, True),
    ("attic_notes", "Attic Notes", "rss", "crypto", False, 20, False),
    ("bonds_bulletin", "Bonds Bulletin", "rss", "markets", False, 45, True),
    ("listing_board", "Listing Board", "rss", "regulator", True, 55, True),
    ("miner_mail", "Miner Mail", "rss", "crypto", False, 30, True),
    ("quay_channel", "Quay Channel", "telegram", "markets", False, 30, True),
    ("north_wire", "North Wire", "rss", "markets", False, 40, True),
    ("clip_desk", "Clip Desk", "youtube", "markets", False, 25, False),
    ("vault_post", "Vault Post", "rss", "crypto", False, 35, True),
    ("square_forum", "Square Forum", "reddit", "crypto", False, 20, False),
    ("treasury_desk", "Treasury Desk", "rss", "regulator", True, 60, True),
    ("open_order", "Open Order", "rss", "markets", False, 35, True),
    ("layer_two", "Layer Two Review", "rss", "crypto", False, 40, True),
    ("dusk_edition", "Dusk Edition", "rss", "markets", False, 25, False),
)

#: {n} is a number from the event's value.
TITLES = (
    "Bitcoin drops to ${n}K after ETF outflows", "BTC falls to ${n},000 as ETF outflows grow", "Meta unveils new payments network {n}",
    "Meta announces new payments network", "Gold steady ahead of data", "Nikkei and Topix slip {n}% in quiet session",
    "Analyst outlook for Hang Seng could improve", "Wall Street recap: stocks end mixed", "Ethereum could reach ${n}00 by June",
    "Broker raises price target on Tesla to ${n}", "Solana forms golden cross near ${n}", "Pepe soars {n}% overnight",
    "Dogecoin listed on Kraken after upgrade", "Ceasefire talks resume near the border", "OPEC cuts output as tariffs hit oil",
    "Powell to testify before Senate on Thursday", "Powell spoke about rates yesterday", "Trader says market will crash",
    "Musk says Tesla launches new plant", "Why is Nvidia so popular", "Lessons from the 2021 bull market",
    "Inflation rises to {n}%, highest since 2022", "Sponsored: best wallet to buy", "Курс меняется без причины",
    "Exchange ledger of 2019 resurfaces in Cyprus", "Experts say money will change", "Bitcoin slump explained by miners", "Analyst believes SEC approves staking rules", "Market wrap: Oracle posts results", "?!",
)
SUMMARIES = ("", "SEC approves the filing today.", "The report was released this morning.", "Sources say talks continue.", "Shares were up 2.5% at the close.")
COLUMNS = ("arrival", "observed_s", "source_id", "source_name", "source_kind", "title", "link", "summary", "published_s", "published_has_tz", "official", "impact", "guid", "year")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _title(template: str) -> str:
    head, mark, tail = template.partition("{n}")
    return f"concat({_text(head)}, CAST(n AS STRING), {_text(tail)})" if mark else _text(template)


def item_sql(events: str, seconds: str) -> str:
    """The items of a table of events; `seconds` is the engine's expression for epoch seconds of ts."""
    case = lambda on, texts: f"CASE {on} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"
    values = ", ".join(f"({i}, {_text(s[0])}, {_text(s[1])}, {_text(s[2])}, {str(s[4]).lower()}, {s[5]}, {str(s[6]).lower()})" for i, s in enumerate(SOURCES))
    return f"""SELECT e.event_id AS arrival, e.s AS observed_s, c.id AS source_id, c.name AS source_name, c.kind AS source_kind,
 {case(f"e.event_id % {len(TITLES)}", [_title(t) for t in TITLES])} AS title,
 concat('https://news.example/', CASE WHEN e.event_id % 17 = 0 THEN 'learn/' ELSE 'story/' END, CAST(e.event_id AS STRING)) AS link,
 {case("e.event_id % 5", [_text(s) for s in SUMMARIES])} AS summary,
 CASE WHEN e.event_id % 41 = 0 THEN NULL WHEN e.event_id % 53 = 0 THEN e.s + 3600 ELSE e.s - (e.event_id * 37 % 30) * 3600 END AS published_s,
 e.event_id % 59 <> 0 AS published_has_tz, c.official AS official, c.impact AS impact,
 concat('g', CAST(CASE WHEN e.event_id % 10 = 3 THEN e.event_id - 1 ELSE e.event_id END AS STRING)) AS guid, 2024 AS year
FROM (SELECT *, {seconds} AS s, CAST(floor(abs(value)) AS INT) AS n FROM {events}) e
JOIN (SELECT * FROM (VALUES {values}) AS v(ix, id, name, kind, official, impact, enabled) WHERE enabled) c ON e.user_id % 20 = c.ix"""


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small file gives fewer tasks; what follows is bound by pattern matching.  Large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of a folder's events; the sources are a small constant table, joined by broadcast."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    return spark.sql(item_sql("{events}", "unix_seconds(ts)"), events=spread(events))


#: Later cycles, in hours, that deliver an item again.
DELIVERIES = ((0, 0), (1, 1), (2, 2), (3, 30))
AGAIN = "SELECT * REPLACE (arrival * 4 + i AS arrival, observed_s + 3600 * h AS observed_s) FROM items, (VALUES " + ", ".join(map(str, DELIVERIES)) + ") AS d(i, h)"


def redelivered(rows: DataFrame) -> DataFrame:
    """Each item as a feed gives it that lists it for some polls and once more later."""
    times = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("h")) for i, h in DELIVERIES]))
    return rows.withColumn("_d", times).withColumns({"arrival": F.col("arrival") * 4 + F.col("_d.i"), "observed_s": F.col("observed_s") + 3600 * F.col("_d.h")}).drop("_d")


DUCK_ITEMS = "items AS (" + item_sql("events", "floor(epoch(ts))::BIGINT") + ")"
