"""Registered calendar and alert queries: entries from `orders`, ticks from `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsieve.functions import vocab as V
from feedsieve.operators import calendar as A

KINDS = (*A.TEMPLATES, "custom & co", "")
ZONES = ("UTC", "Asia/Tokyo", "UTC", "Mars/Base", "")
AS_OF = 1705276800


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _pick(on: str, values) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def raw_sql(orders: str, array: str) -> str:
    """Calendar entries of a table of orders; `array` is the engine's list function."""
    kinds, zones = [f"'{k}'" for k in KINDS], [f"'{z}'" for z in ZONES]
    offsets = ["NULL", f"{array}('1h')", f"{array}('1h', '24h', '1h')", f"{array}('24h')", "NULL", f"{array}('2h')", "NULL"]
    pad = lambda x: f"lpad(CAST(CAST(floor({x}) AS INT) AS STRING), 2, '0')"
    return f"""SELECT o_orderkey AS entry_ix, {_pick(f"o_orderkey % {len(KINDS)}", kinds)} AS type,
 CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE concat('Event <', CAST(o_orderkey AS STRING), '>') END AS title,
 CASE WHEN o_orderkey % 37 = 0 THEN 'soon' WHEN o_orderkey % 41 = 0 THEN NULL ELSE concat('2024-01-', {pad("m / 1440 + 1")}, ' ', {pad("m % 1440 / 60")}, ':', {pad("m % 60")}) END AS time,
 {_pick(f"o_orderkey % {len(ZONES)}", zones)} AS tz, {_pick("o_orderkey % 9", ["'critical'", "'standard'", "'special'"] * 2 + ["'Critical'", "'standard'", "'huge'"])} AS importance,
 {_pick("o_orderkey % 7", offsets)} AS offsets, '' AS source_url, CASE WHEN o_orderkey % 4 = 0 THEN '3.1% & up' END AS consensus,
 CASE WHEN o_orderkey % 13 = 0 THEN 'cancelled' WHEN o_orderkey % 43 = 0 THEN 'lost' END AS status
FROM (SELECT o_orderkey, o_orderkey * 7919 % 43200 AS m FROM {orders})"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return spark.sql(raw_sql("{orders}", "array"), orders=orders)


def _events(spark, sf_dir):
    return A.validate(_raw(spark, sf_dir)).where("error IS NULL").drop("error", "entry_ix")


def _ticks(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("tick_s")).distinct()


def validate_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.validate(_raw(spark, sf_dir))
    return rows.select("entry_ix", "error", "event_id", F.unix_seconds("scheduled_utc").alias("scheduled_s"), F.array_join("offsets", ",").alias("offsets"), "status")


def due_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.due_alerts(_events(spark, sf_dir), _ticks(spark, sf_dir)).select("event_id", "offset_label", "target_s", "tick_s")


def unfired_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = A.due_alerts(_events(spark, sf_dir), _ticks(spark, sf_dir)).select("event_id", "offset_label", "target_s", "tick_s")
    fired = due.where("offset_label = '24h' AND event_id LIKE 'cpi:%'").select("event_id", "offset_label")
    return A.unfired(due, fired)


def render_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = A.unfired(A.due_alerts(_events(spark, sf_dir), _ticks(spark, sf_dir)))
    return A.render_alert(due).select("event_id", "offset_label", "tick_s", "post")


def upcoming_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.upcoming(_events(spark, sf_dir), AS_OF, 10).select("event_id", F.unix_seconds("scheduled_utc").alias("scheduled_s"), "title")


def alert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = A.unfired(A.due_alerts(_events(spark, sf_dir), _ticks(spark, sf_dir))).select("event_id", "offset_label", F.lit("fired").alias("status"))
    return A.alert_status(_events(spark, sf_dir), due)


_OK = "^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$"
BASE = f"""WITH raw AS ({raw_sql("orders", "list_value").replace("AS STRING", "AS VARCHAR")}),
t AS (SELECT *, trim(coalesce(type, '')) AS ty, trim(coalesce(title, '')) AS ti, lower(trim(coalesce(importance, ''))) AS im, lower(trim(coalesce(status, 'scheduled'))) AS st,
 CASE WHEN tz IN ('UTC', 'Asia/Tokyo') THEN epoch(try_strptime(time, '%Y-%m-%d %H:%M'))::BIGINT - CASE WHEN tz = 'Asia/Tokyo' THEN 32400 ELSE 0 END END AS s FROM raw),
e AS (SELECT *, CASE WHEN ty = '' THEN 'missing type' WHEN ti = '' THEN 'missing title' WHEN im NOT IN ('critical', 'standard', 'special') THEN 'invalid importance' WHEN coalesce(time, '') = '' THEN 'missing time'
 WHEN tz = '' THEN 'missing tz' WHEN NOT regexp_matches(time, '{_OK}') THEN 'invalid time' WHEN tz NOT IN ('UTC', 'Asia/Tokyo') THEN 'unknown timezone' WHEN len(offsets) = 0 THEN 'empty offsets'
 WHEN len(list_filter(offsets, lambda o: o NOT IN ('24h', '1h'))) > 0 THEN 'unknown offsets' WHEN st NOT IN ('scheduled', 'cancelled') THEN 'invalid status' END AS er FROM t),
i AS (SELECT *, CASE WHEN er IS NULL THEN ty || ':' || strftime(make_timestamp(s * 1000000), '%Y%m%dT%H%MZ') END AS event_id FROM e),
v AS (SELECT *, coalesce(er, CASE WHEN event_id IS NOT NULL AND row_number() OVER (PARTITION BY event_id ORDER BY entry_ix) > 1 THEN 'duplicate event' END) AS error,
 CASE WHEN offsets IS NULL THEN CASE WHEN im = 'critical' THEN ['24h', '1h'] WHEN im IN ('standard', 'special') THEN ['1h'] END ELSE list_filter(['24h', '1h'], lambda o: list_contains(offsets, o)) END AS labels FROM i),
ev AS (SELECT * FROM v WHERE error IS NULL), tk AS (SELECT DISTINCT floor(epoch(ts))::BIGINT AS tick_s FROM events),
al AS (SELECT *, s - CASE offset_label WHEN '24h' THEN 86400 ELSE 3600 END AS target_s FROM (SELECT *, unnest(labels) AS offset_label FROM ev WHERE st = 'scheduled')),
due AS (SELECT al.*, tick_s FROM al JOIN tk ON target_s <= tick_s AND tick_s <= target_s + {V.GRACE_MINUTES * 60} AND tick_s < s),
fst AS (SELECT event_id, offset_label, min(tick_s) AS tick_s FROM due GROUP BY ALL)"""


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_TEMPLATES = ", ".join(f"({_quoted((k, *v))})" for k, v in A.TEMPLATES.items())
ORACLES = {
    "validate_calendar": f"{BASE} SELECT entry_ix, error, event_id, s AS scheduled_s, array_to_string(labels, ',') AS offsets, st AS status FROM v",
    "due_alerts": f"{BASE} SELECT event_id, offset_label, target_s, tick_s FROM due",
    "unfired_alerts": f"{BASE} SELECT event_id, offset_label, min(tick_s) AS tick_s, min(target_s) AS target_s FROM due WHERE NOT (offset_label = '24h' AND event_id LIKE 'cpi:%') GROUP BY ALL",
    "render_alerts": f"""{BASE}, tm(ty, b, d, tail, src) AS (VALUES {_TEMPLATES}), one AS (SELECT DISTINCT f.*, a.ty, a.ti, a.im, a.consensus FROM fst f JOIN al a USING (event_id, offset_label))
SELECT event_id, offset_label, tick_s, CASE im WHEN 'critical' THEN '🚨' WHEN 'special' THEN '⚠️' ELSE '📅' END || ' ' ||
 coalesce(CASE WHEN offset_label = '24h' THEN nullif(b, '') END, nullif(d, ''), CASE WHEN offset_label = '24h' THEN 'Завтра' ELSE 'Сегодня' END || ' — ' || {_escaped("ti")} || '.') ||
 CASE WHEN im = 'critical' AND coalesce(consensus, '') <> '' THEN ' Консенсус: ' || {_escaped("consensus")} || '.' ELSE '' END || CASE WHEN coalesce(tail, '') <> '' THEN ' ' || tail ELSE '' END ||
 chr(10) || chr(10) || '◉ Calendar' || CASE WHEN coalesce(src, '') <> '' THEN ' · ' || src ELSE '' END AS post FROM one LEFT JOIN tm USING (ty)""",
    "upcoming_events": f"{BASE} SELECT event_id, s AS scheduled_s, ti AS title FROM ev WHERE st = 'scheduled' AND s > {AS_OF} ORDER BY s, event_id LIMIT 10",
    "alert_status": f"{BASE} SELECT (SELECT count(*) FROM ev WHERE st = 'scheduled') AS active, (SELECT count(*) FROM fst) AS fired",
}
QUERIES = (validate_calendar, due_alerts, unfired_alerts, render_alerts, upcoming_events, alert_status)
