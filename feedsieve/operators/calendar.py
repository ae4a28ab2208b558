"""Scheduled events: validation, due alerts, once-only emission and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.functions import vocab as V
from feedsieve.functions.text import html_escape

# Markers and sentences of alerts.
MARKERS = {"critical": "🚨", "standard": "📅", "special": "⚠️"}
FOOTER = "◉ Calendar"
#: type -> (sentence the day before, sentence on the day, closing sentence, source)
TEMPLATES = {
    "fomc": ("Завтра ФРС объявит решение по процентной ставке.", "ФРС сегодня объявит решение по процентной ставке.", "Внимание к комментариям Пауэлла и сигналам по дальнейшей траектории ставок.", "Federal Reserve"),
    "cpi": ("Завтра в США выйдет отчёт по инфляции (CPI).", "Сегодня в США выходит отчёт по инфляции (CPI).", "Данные определят ожидания по политике ФРС; реакция в долларе, доходностях трежерис и крипте — самая быстрая.", "BLS"),
    "nfp": ("Завтра в США выйдет отчёт по занятости (NFP) и уровню безработицы.", "Сегодня в США выходит отчёт по занятости (NFP) и уровню безработицы.", "Цифры по созданию рабочих мест и пересмотры предыдущих месяцев задают тон ожиданиям по ставке ФРС.", "BLS"),
    "ecb": ("Завтра ЕЦБ объявит решение по процентной ставке.", "Сегодня ЕЦБ объявит решение по процентной ставке.", "Внимание к комментариям Лагард и сигналам по траектории ставок в еврозоне.", "ECB"),
    "boj": ("Завтра Банк Японии объявит решение по процентной ставке.", "Сегодня Банк Японии объявит решение по процентной ставке.", "Внимание к сигналам по нормализации денежно-кредитной политики и реакции в иене.", "BOJ"),
    "trump_speech": ("", "Сегодня выступает Дональд Трамп.", "Рынки ждут заявлений по тарифам, торговой политике и отношениям с Китаем; возможен рост волатильности в крипте и акциях.", "White House"),
    "powell_testimony": ("", "Сегодня Пауэлл выступит с показаниями в Конгрессе.", "Внимание к сигналам по траектории ставок и оценке состояния экономики.", "Federal Reserve"),
    "jackson_hole": ("", "Сегодня в Джексон-Хоуле выступает председатель ФРС.", "Рынки ждут программных тезисов по дальнейшей политике; историческая площадка для разворотов.", "Federal Reserve"),
}


class CalendarError(ValueError):
    """Entries that cannot be loaded, all in one message."""


def known_zones() -> tuple[str, ...]:
    from zoneinfo import available_timezones

    return tuple(sorted(available_timezones()))


def local_to_utc(time: Column, tz: Column) -> Column:
    """A local time in a known zone as UTC; null for text that is no time.  Daylight saving is minded."""
    text = F.trim(time)
    local = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")))
    return F.to_utc_timestamp(local, tz)


def canonical_offsets(offsets: Column) -> Column:
    """Each label once, the longest lead first."""
    return F.filter(F.array(*[F.lit(o) for o in V.OFFSETS]), lambda o: F.array_contains(offsets, o))


def event_id(kind: Column, scheduled: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.date_format(scheduled, "yyyyMMdd'T'HHmm'Z'"))


def validate(raw: DataFrame) -> DataFrame:
    """Adds `error`, the first thing wrong with an entry (null if none), and the event's columns.

    raw: entry_ix, type, title, time, tz, importance, offsets, source_url, consensus, status.
    A later valid entry with an id seen before is an error too.
    """
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    df = raw.withColumns({
        "_type": t("type"), "_title": t("title"), "_importance": F.lower(t("importance")), "_tz": t("tz"),
        "_status": F.lower(F.trim(F.coalesce("status", F.lit("scheduled")))), "source_url": t("source_url"), "consensus": t("consensus"),
    })
    zone = F.col("_tz").isin(*known_zones())
    df = df.withColumn("_utc", F.when(zone, local_to_utc(F.col("time"), F.when(zone, F.col("_tz")).otherwise("UTC"))))
    readable = F.col("time").isNotNull() & local_to_utc(F.col("time"), F.lit("UTC")).isNotNull()
    labels = F.array(*[F.lit(o) for o in V.OFFSETS])
    error = (
        F.when(F.col("_type") == "", "missing type")
        .when(F.col("_title") == "", "missing title")
        .when(~F.col("_importance").isin(*V.DEFAULT_OFFSETS), "invalid importance")
        .when(F.coalesce("time", F.lit("")) == "", "missing time")
        .when(F.col("_tz") == "", "missing tz")
        .when(~readable, "invalid time")
        .when(~zone, "unknown timezone")
        .when(F.col("offsets").isNotNull() & (F.size("offsets") == 0), "empty offsets")
        .when(F.col("offsets").isNotNull() & (F.size(F.array_except("offsets", labels)) > 0), "unknown offsets")
        .when(~F.col("_status").isin(*V.STATUSES), "invalid status")
    )
    usual = F.create_map(*[x for k, v in V.DEFAULT_OFFSETS.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in v]))])
    df = df.withColumn("error", error).withColumn("event_id", F.when(F.col("error").isNull(), event_id(F.col("_type"), F.col("_utc"))))
    # entries without an id are ranked alone
    seen = F.row_number().over(Window.partitionBy(F.coalesce("event_id", F.concat(F.lit("#"), F.col("entry_ix")))).orderBy("entry_ix"))
    df = df.withColumn("error", F.coalesce("error", F.when(F.col("event_id").isNotNull() & (seen > 1), "duplicate event")))
    return df.select(
        "entry_ix", "event_id", F.col("_type").alias("type"), F.col("_title").alias("title"), F.col("_utc").alias("scheduled_utc"), F.col("_importance").alias("importance"),
        F.when(F.col("offsets").isNull(), F.try_element_at(usual, F.col("_importance"))).otherwise(canonical_offsets(F.col("offsets"))).alias("offsets"),
        F.col("_tz").alias("tz_name"), "source_url", "consensus", F.col("_status").alias("status"), "error",
    )


def load(raw: DataFrame) -> DataFrame:
    """Valid events; raises with all errors of a load that has any.  A calendar is a file that people write, so they are few."""
    rows = validate(raw)
    bad = rows.where(F.col("error").isNotNull()).orderBy("entry_ix").select("entry_ix", "error").collect()
    if bad:
        raise CalendarError("; ".join(f"entry {r['entry_ix']}: {r['error']}" for r in bad))
    return rows.drop("error", "entry_ix")


def alerts(events: DataFrame) -> DataFrame:
    """A row for each active event and offset, with its target time in epoch seconds."""
    lead = F.create_map(*[F.lit(x) for kv in V.OFFSETS.items() for x in kv])
    rows = events.where("status = 'scheduled'").withColumn("offset_label", F.explode("offsets"))
    s = F.unix_seconds(F.col("scheduled_utc"))
    return rows.withColumn("scheduled_s", s).withColumn("target_s", F.col("scheduled_s") - F.element_at(lead, F.col("offset_label")))


def due_alerts(events: DataFrame, ticks: DataFrame, grace_minutes: int = V.GRACE_MINUTES) -> DataFrame:
    """Alerts whose target lies at most the grace before a tick, and whose event has not begun.

    ticks has tick_s.  Both sides carry the number of a stretch as long as the grace, so the
    interval join is an equi-join and neither side need be small.
    """
    width = max(1, grace_minutes * 60)
    left = alerts(events).withColumn("_slot", F.explode(F.array(F.floor(F.col("target_s") / width), F.floor(F.col("target_s") / width) + 1)))
    right = ticks.withColumn("_slot", F.floor(F.col("tick_s") / width))
    inside = (F.col("target_s") <= F.col("tick_s")) & (F.col("tick_s") <= F.col("target_s") + grace_minutes * 60) & (F.col("tick_s") < F.col("scheduled_s"))
    return left.join(right, "_slot").where(inside).drop("_slot")


def unfired(due: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The first tick of each alert that the ledger does not hold."""
    key = ["event_id", "offset_label"]
    if ledger is not None:
        due = due.join(ledger.select(*key).distinct(), key, "left_anti")
    rest = [c for c in due.columns if c not in key]
    first = due.groupBy(*key).agg(F.min(F.struct("tick_s", *[c for c in rest if c != "tick_s"])).alias("x"))
    return first.select(*key, "x.*")


def upcoming(events: DataFrame, as_of_s: int, limit: int = 10) -> DataFrame:
    """The next active events, soonest first."""
    return events.where("status = 'scheduled'").where(F.unix_seconds("scheduled_utc") > as_of_s).orderBy("scheduled_utc", "event_id").limit(limit)


def render_alert(due: DataFrame) -> DataFrame:
    """Adds `post`: marker, leading sentence, consensus of critical events, closing sentence and footer."""
    spark = due.sparkSession
    rows = [(k, *v) for k, v in TEMPLATES.items()]
    table = spark.createDataFrame(rows, "type string, _before string, _day string, _tail string, _source string")
    df = due.join(F.broadcast(table), "type", "left")
    tomorrow = F.col("offset_label") == "24h"
    generic = F.concat(F.when(tomorrow, "Завтра").otherwise("Сегодня"), F.lit(" — "), html_escape(F.col("title")), F.lit("."))
    lead = F.coalesce(F.when(tomorrow, F.nullif("_before", F.lit(""))), F.nullif("_day", F.lit("")), generic)
    consensus = F.when((F.col("importance") == "critical") & (F.coalesce("consensus", F.lit("")) != ""), F.concat(F.lit(" Консенсус: "), html_escape(F.col("consensus")), F.lit("."))).otherwise("")
    tail = F.when(F.coalesce("_tail", F.lit("")) != "", F.concat(F.lit(" "), F.col("_tail"))).otherwise("")
    marker = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv]), F.col("importance")), F.lit(MARKERS["standard"]))
    footer = F.concat(F.lit(FOOTER), F.when(F.coalesce("_source", F.lit("")) != "", F.concat(F.lit(" · "), html_escape(F.col("_source")))).otherwise(""))
    return df.withColumn("post", F.concat(marker, F.lit(" "), lead, consensus, tail, F.lit("\n\n"), footer)).drop("_before", "_day", "_tail", "_source")


def alert_status(events: DataFrame, fired: DataFrame) -> DataFrame:
    """Active events and alerts fired."""
    active = events.agg(F.count_if(F.col("status") == "scheduled").alias("active"))
    return active.join(fired.agg(F.count_if(F.col("status") == "fired").alias("fired")), how="cross")
