import pytest
from pyspark.sql import functions as F

from feedsieve.functions import text as T
from feedsieve.operators import calendar as A
from feedsieve.operators import ground
from feedsieve.operators import posts as O
from feedsieve.sources import feeds, ledgers

RAW = "entry_ix int, type string, title string, time string, tz string, importance string, offsets array<string>, source_url string, consensus string, status string"


def raw(spark, *rows):
    usual = {"type": "fomc", "title": "Fed", "time": "2026-01-15 14:00", "tz": "America/New_York", "importance": "critical", "offsets": None, "source_url": None, "consensus": None, "status": None}
    return spark.createDataFrame([(i, *(usual | r).values()) for i, r in enumerate(rows)], RAW)


def test_daylight_saving(spark):
    got = A.load(raw(spark, {"time": "2026-01-15 08:30"}, {"time": "2026-07-15 08:30:00"})).select(F.date_format("scheduled_utc", "HH:mm")).collect()
    assert sorted(r[0] for r in got) == ["12:30", "13:30"]


def test_all_errors_are_reported(spark):
    bad = [{"type": ""}, {"title": " "}, {"importance": "huge"}, {"time": None}, {"tz": ""}, {"time": "soon"}, {"tz": "Mars/Base"}, {"offsets": []}, {"offsets": ["2h"]}, {"status": "lost"}, {}, {}]
    want = ["missing type", "missing title", "invalid importance", "missing time", "missing tz", "invalid time", "unknown timezone", "empty offsets", "unknown offsets", "invalid status", None, "duplicate event"]
    rows = A.validate(raw(spark, *bad)).orderBy("entry_ix").collect()
    assert [r["error"] for r in rows] == want
    with pytest.raises(A.CalendarError, match="entry 0: missing type; entry 1: missing title"):
        A.load(raw(spark, *bad))


def test_due_bounds_and_once(spark):
    events = A.load(raw(spark, {"tz": "UTC", "time": "2026-01-15 14:00"}, {"tz": "UTC", "time": "2026-01-16 14:00", "status": "cancelled"}))
    start = 1768485600  # 2026-01-15 14:00
    ticks = [start - 3601, start - 3600, start - 3600 + 1200, start - 3600 + 1201, start - 86400 + 60, start]
    due = A.due_alerts(events, spark.createDataFrame([(t,) for t in ticks], "tick_s long"))
    assert sorted((r["offset_label"], r["tick_s"]) for r in due.collect()) == [("1h", start - 3600), ("1h", start - 2400), ("24h", start - 86340)]
    assert sorted((r["offset_label"], r["tick_s"]) for r in A.unfired(due).collect()) == [("1h", start - 3600), ("24h", start - 86340)]
    post = A.render_alert(A.unfired(due)).where("offset_label = '24h'").first()["post"]
    assert post.startswith("🚨 Завтра ФРС") and post.endswith("◉ Calendar · Federal Reserve")


@pytest.mark.parametrize(("text", "problem"), [(None, "empty"), ("  \n", "empty"), ("as an AI I will not", "placeholder"), ("one two", "too_few_words"), ("go Go GO now", "repeated_token"), ("Рынок вырос на 3%", None)])
def test_body_problem(spark, text, problem):
    assert spark.createDataFrame([(text,)], "t string").select(T.body_problem(F.col("t"))).first()[0] == problem


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "see https://a.b/c now", T.strip_urls) == "see  now"
    assert one(spark, "a漢 b  c", T.sanitize) == "a b c"
    assert one(spark, "Раз. Два. Три 5.", T.keep_concrete_sentences) == "Раз. Три 5."
    assert one(spark, "Ab. " + "c" * 20, lambda c: T.truncate_at_sentence(c, 10)) == "Ab."
    assert one(spark, "c" * 20, lambda c: T.truncate_at_sentence(c, 10)) == "c" * 10 + "..."
    assert one(spark, None, T.truncate_at_sentence) == ""
    assert one(spark, "<a & 'b'>", T.html_escape) == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, "https://WWW.Sec.gov/x", T.domain) == "www.sec.gov"
    assert one(spark, "G00GL \\cdot \\text up", T.clean_artifacts) == "GOOGL · up"


def test_model_output(spark):
    rows = ['```json\n{"prefix": "⚡️", "text": " Hi ", "tickers": null}\n```', "ПРЕФИКС: ⚠️\nтекст — two\nТЕКСТ: three", "[1]", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(T.parse_model_output(F.col("t"))).collect()]
    assert tuple(got[0]) == ("⚡️", "Hi", None) and tuple(got[1]) == ("⚠️", "three", None) and tuple(got[2]) == tuple(got[3]) == (None, None, None)


def rewritten(spark, use, *pairs):
    df = spark.createDataFrame(list(pairs), "body string, source string")
    return [r[0] for r in df.select(use(F.col("body"), F.col("source"))).collect()]


def test_grounding_of_numbers(spark):
    got = rewritten(
        spark, ground.validate_numbers,
        ("It rose 71,000 and 9 more", "at 70,000"), ("5 units", "none"), ("Нефть стоит $95", "Crude rose to $95.0"), ("Цена $100 за баррель", "Oil is up"),
        ("Up 3%\nТИКЕРЫ: BTC 5\nand 12 млн\nТИКЕРЫ: ETH 6", "3 and 12"), ("no number", ""), ("", "1"), ("1 000 000 and 2,5", "1000000 and 2.5"),
    )
    assert got[0] == "It rose 71,000 and [сумма не указана] more"
    assert got[1].strip() == "[сумма не указана] units" and got[2] == "Нефть стоит $95" and got[3] == "Цена [сумма не указана] за баррель"
    assert got[4] == "Up 3%\nand 12 млн\nТИКЕРЫ: ETH 6"
    assert got[5:] == ["no number", "", "1 000 000 and 2,5"]


def test_grounding_of_quotes(spark):
    echo = "Visa Labs открыла новый центр разработки. Visa Labs: «новый центр разработки открыла»"
    distinct = "Рынок вырос сегодня. Аналитик: «Регулятор готовит большие изменения для фондов»"
    got = rewritten(
        spark, ground.filter_quotes,
        ("He said «мы очень рады всем вам»", "nothing here"), ("Note «exchange listed forty tokens» ended", "The exchange listed forty tokens"), ("CEO: «так будет»", "так будет"),
        ("Аналитик: «Биткоин скоро будет стоить намного меньше»", "Visa wins a court case"), (echo, "Visa Labs новый центр разработки открыла"), (distinct, "Регулятор готовит большие изменения для фондов"),
        ("Глава: «Биткоин достиг отметки $70 000»", "bitcoin достиг отметки $70 000"), ("no quote, at all,", "x"), ('A "first empty", "second empty"', "zzzz"),
    )
    assert got[:3] == ["He said", "Note «exchange listed forty tokens» ended", "CEO"]
    assert got[3] == "Аналитик" and got[4] == "Visa Labs открыла новый центр разработки. Visa Labs" and got[5] == distinct
    assert "Биткоин достиг" in got[6] and got[7] == "no quote, at all," and got[8] == "A"


def test_grounding_of_names(spark):
    got = rewritten(spark, ground.clean_made_up_names, ("John Smith: no. Mary: yes", "Mary said"), ("Иван Петров (глава банка): рост", "банк"), ("Elon Musk: hello", "Elon Musk said"), ("nobody here", ""))
    assert got == ["представитель компании  no. Mary: yes", "представитель компании  рост", "Elon Musk: hello", "nobody here"]
    whole = rewritten(spark, ground.grounded, ("John Smith: «мы очень рады всем вам» on 5 May", "nothing"), (None, "x"))
    assert whole == ["представитель компании on [сумма не указана] May", ""]


def test_labels_and_tags(spark):
    df = spark.createDataFrame([("SEC sues exchange", "", False, "Blog", "https://x.example/a"), ("Token may rise", "", True, "SEC", ""), ("In May it rose", "", False, "Reuters", "")], "title string, summary string, official boolean, source_name string, link string")
    assert [r[0] for r in df.select(O.credibility_label(df)).collect()] == [O.RUMOR, O.RUMOR, O.OFFICIAL]
    tags = spark.createDataFrame([("Bitcoin ETF: SEC sues, Fed cuts rates in China",)], "t string").select(O.hashtags(F.col("t"), F.lit("🇨🇳"))).first()[0]
    assert tags == ["#BTC", "#регулирование", "#ETF", "#макро"]
    assert spark.range(1).select(O.clean_prefix(F.lit("x🇺🇸⚡️"))).first()[0] == "🇺🇸"


RSS = """<rss><channel><item><title>One</title><link>https://a/1</link><description>d</description><guid>g1</guid><pubDate>Tue, 06 Jan 2026 10:00:00 GMT</pubDate></item>
<item><title>Two</title><link>https://a/2</link></item><item><title>No link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://b/1"/><id>i</id><updated>2026-01-01T00:00:00Z</updated></entry></feed>"""


def test_feeds(spark):
    docs = spark.createDataFrame([("r", RSS), ("a", ATOM), ("bad", "<rss"), ("n", None)], "source_id string, xml string")
    got = {r["link"]: r for r in feeds.read_rss(docs).collect()}
    assert sorted(got) == ["https://a/1", "https://a/2", "https://b/1"]
    assert got["https://a/1"]["published"] is not None and got["https://a/2"]["guid"] == "https://a/2"
    assert got["https://b/1"]["published"] is None and got["https://b/1"]["guid"] == "i"


def test_channel_page():
    html = '<div class="tgme_widget_message" data-post="c/1"><div class="tgme_widget_message_text">Hi <b>you</b><br>x</div><a class="tgme_widget_message_date" href="u"></a></div><div class="tgme_widget_message"><i>no text</i></div>'
    assert feeds.channel_messages(html) == [{"title": "Hi you x", "link": "u", "summary": "Hi you x", "guid": "c/1"}]


def test_ledgers_insert_once(spark, tmp_path):
    path = str(tmp_path / "sent")
    rows = spark.createDataFrame([("u", "k", "s", "t" * 600, "l", 1), ("u", "k", "s", "later", "l", 2)], "uid string, story_key string, source_id string, title string, link string, x int").withColumn("sent_at", F.timestamp_seconds("x"))
    ledgers.append_sent(rows, path)
    ledgers.append_sent(rows, path)
    got = ledgers.read(spark, path, ledgers.SENT).collect()
    assert len(got) == 1 and len(got[0]["title"]) == 500
    fired = spark.createDataFrame([("e", "1h", 1), ("e", "1h", 2)], "event_id string, offset_label string, x int").withColumn("fired_at", F.timestamp_seconds("x"))
    assert [ledgers.mark_alerts_fired(fired, str(tmp_path / "fired")) for _ in range(2)] == [1, 0]
