"""Feeds that are partly broken, files that are, and grounding by golden rows."""

import pytest
from pyspark.sql import functions as F

from feedsieve.functions.keys import normalise_number
from feedsieve.operators import ground
from feedsieve.sources import feeds

HEAD = '<?xml version="1.0"?><rss version="2.0"><channel><title>x</title>'
ENTRY = "<item><title>{0}</title><link>https://a.example/{0}</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>"


def items(spark, *docs):
    return feeds.read_rss(spark.createDataFrame([("s", d) for d in docs], "source_id string, xml string"))


@pytest.mark.parametrize(
    ("broken", "title"),
    [
        ("<item><title>AT&T & friends</title><link>https://a.example/q?a=1&b=2</link></item>", "AT&T & friends"),
        ("<item><title>A&nbsp;B &mdash; C &amp; D &bogus;</title><link>l</link></item>", "A B — C & D &bogus;"),
        ("<item><title><![CDATA[R&D <b>x</b>]]></title><link>l?a&b</link></item>", "R&D <b>x</b>"),
        ("<item><title>never <b>closed</title><link>l</link></item>", None),
        ("<item><title>cut off", None),
        ("<item><title></title><link>l</link></item>", None),
    ],
)
def test_a_bad_entry_costs_itself(spark, broken, title):
    doc = HEAD + ENTRY.format("one") + broken + ENTRY.format("two") + "</channel></rss>"
    got = [r["title"] for r in items(spark, doc).collect()]
    assert sorted(got) == sorted(["one", "two", *([title] if title else [])])
    lost = feeds.unread_entries(spark.createDataFrame([("s", doc)], "source_id string, xml string"))
    # what is not closed is no entry; what is closed and gives nothing is told
    assert lost.count() == (title is None and broken.endswith("</item>"))


def test_documents_without_end_and_atom(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A & B</title><link href="https://a.example/1?x=1&y=2"/><id>i</id><published>2024-01-01T10:00:00Z</published></entry><entry><title>no link</title></entry>'
    got = items(spark, HEAD + ENTRY.format("one"), atom, "no xml at all", "", None).collect()
    assert sorted((r["title"], r["link"], r["guid"]) for r in got) == [("A & B", "https://a.example/1?x=1&y=2", "i"), ("one", "https://a.example/one", "https://a.example/one")]
    assert {r["published"].year for r in got} == {2024}


def test_long_entries_are_cut_without_deep_recursion(spark):
    doc = HEAD + f"<item><title>long</title><link>l</link><description>{'word & ' * 50_000}</description></item>" + ENTRY.format("two")
    got = {r["title"]: len(r["summary"]) for r in items(spark, doc).collect()}
    assert got["long"] > 300_000 and set(got) == {"long", "two"}


def test_a_truncated_file_loses_itself(spark, tmp_path):
    schema = "source_id string, n long"
    for k in range(3):
        spark.createDataFrame([("a", k)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"))
    files[1].write_bytes(files[1].read_bytes()[:40])
    (tmp_path / "in" / f".{files[1].name}.crc").unlink(missing_ok=True)
    rows, lost = feeds.read_files(spark, str(tmp_path / "in"), schema)
    assert rows.count() == 2 and [r["path"].rsplit("/", 1)[1] for r in lost.collect()] == [files[1].name]
    assert rows.unionByName(spark.createDataFrame([("b", 9)], schema)).agg(F.sum("n")).first()[0] is not None


@pytest.mark.parametrize(("text", "number"), [("$99999999999999999999", "100000000000000000000"), ("5.50%", "5.5%"), ("2bn", "2000000000"), ("1,5", "1.5"), ("0", "0"), ("0.25", "0.25")])
def test_numbers_in_one_form(spark, text, number):
    assert spark.range(1).select(normalise_number(F.lit(text))).first()[0] == number


SOURCE = "Visa said revenue rose 12% to $5.2 billion in 2024. \"We plan to open ten offices in Berlin\", Anna Schmidt told reporters."


@pytest.mark.parametrize(
    ("rule", "body", "wanted"),
    [
        (ground.filter_quotes, "Visa растёт «Мы рады новым возможностям для клиентов» сегодня", "Visa растёт  сегодня"),
        (ground.filter_quotes, "Visa said \"We plan to open ten offices in Berlin\" today", "Visa said \"We plan to open ten offices in Berlin\" today"),
        (ground.filter_quotes, "Visa said «short» - ", "Visa said"),
        (ground.filter_quotes, "  no quote at all ", "no quote at all"),
        (ground.validate_numbers, "Revenue rose 12% to $5.2 billion", "Revenue rose 12% to $5.2 billion"),
        (ground.validate_numbers, "Revenue rose 40% now", "Revenue rose [сумма не указана] now"),
        (ground.validate_numbers, "ТИКЕРЫ: V 1\nno figures", "no figures\nТИКЕРЫ: V 1"),
        (ground.validate_numbers, "plain words", "plain words"),
        (ground.clean_made_up_names, "Anna Schmidt: we grow", "Anna Schmidt: we grow"),
        (ground.clean_made_up_names, "Quentin Marlowe: we grow", "представитель компании  we grow"),
        (ground.clean_made_up_names, "no speaker", "no speaker"),
    ],
)
def test_grounding_by_golden_rows(spark, rule, body, wanted):
    assert spark.createDataFrame([(body, SOURCE)], "b string, s string").select(rule(F.col("b"), F.col("s"))).first()[0] == wanted
