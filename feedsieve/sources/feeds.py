"""Feed documents and channel pages to items, and tables of items as streams."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RSS = "title string, link string, description string, summary string, guid string, pubDate string"
ATOM = "title string, link array<struct<_href string, _rel string>>, summary string, content string, id string, published string, updated string"
#: Entities that pages use and feeds do not declare.
ENTITIES = {"nbsp": " ", "mdash": "—", "ndash": "–", "laquo": "«", "raquo": "»", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’", "hellip": "…", "euro": "€", "pound": "£", "copy": "©", "reg": "®", "trade": "™", "bull": "•", "middot": "·"}
MESSAGES = "array<struct<title string, link string, summary string, guid string>>"
ITEM = "source_id string, source_name string, source_kind string, title string, link string, summary string, published timestamp, published_has_tz boolean, official boolean, impact int, guid string, observed_at timestamp, arrival long"
TITLE_CHARS = 160


def feed_time(text: Column) -> Column:
    """A feed's date as a timestamp; null for one without a zone or that cannot be read.  Weekdays are not looked at."""
    bare = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3,9},\s*", ""))
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss zzz", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")])


def _filled(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _items(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"title": _filled("title"), "link": _filled("link"), "summary": _filled("summary")}).where("title <> '' AND link <> ''")
    guid = F.coalesce(F.nullif(_filled("guid"), F.lit("")), F.col("link"))
    return rows.select("source_id", "title", "link", "summary", guid.alias("guid"), feed_time(F.col("published")).alias("published"))


def _entries(xml: Column, tag: str) -> Column:
    """The texts of a document's elements of one name, each from its start to its end; one that is not closed is left out."""
    end = f"</{tag}>"
    begun = F.filter(F.split(xml, rf"(?=<{tag}[\s>])", -1), lambda x: x.rlike(rf"^<{tag}[\s>]") & F.contains(x, F.lit(end)))
    return F.transform(begun, lambda x: F.concat(F.substring_index(x, end, 1), F.lit(end)))


def _repaired(entry: Column) -> Column:
    """An entry with bare ampersands and undeclared entities made readable; character data that is marked as such stays."""

    def piece(x: Column) -> Column:
        for name, sign in ENTITIES.items():
            x = F.replace(x, F.lit(f"&{name};"), F.lit(sign))
        return F.regexp_replace(x, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")

    pieces = F.split(entry, r"(?=<!\[CDATA\[)|(?<=\]\]>)", -1)
    mended = F.array_join(F.transform(pieces, lambda x: F.when(F.startswith(x, F.lit("<![CDATA[")), x).otherwise(piece(x))), "")
    return F.when(F.contains(entry, F.lit("&")), mended).otherwise(entry)


def _parsed(raw: DataFrame) -> DataFrame:
    """A row for each entry of RSS and Atom documents, with its text and what could be read of it."""
    docs = raw.select("source_id", _entries(F.col("xml"), "item").alias("items"), _entries(F.col("xml"), "entry").alias("entries"))
    rss = docs.select("source_id", F.explode("items").alias("entry")).withColumn("x", F.from_xml(_repaired(F.col("entry")), RSS, {"mode": "PERMISSIVE"}))
    rss = rss.select("source_id", "entry", "x.title", "x.link", F.coalesce("x.summary", "x.description").alias("summary"), "x.guid", F.col("x.pubDate").alias("published"))
    atom = docs.where(F.size("items") == 0).select("source_id", F.explode("entries").alias("entry")).withColumn("x", F.from_xml(_repaired(F.col("entry")), ATOM, {"mode": "PERMISSIVE"}))
    best = F.coalesce(F.filter("x.link", lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")[0]["_href"], F.col("x.link")[0]["_href"])
    atom = atom.select("source_id", "entry", "x.title", best.alias("link"), F.coalesce("x.summary", "x.content").alias("summary"), F.col("x.id").alias("guid"), "x.published")
    return rss.unionByName(atom)


def read_rss(raw: DataFrame) -> DataFrame:
    """Items of RSS and Atom documents (source_id, xml).

    Documents are cut into entries first and each is read alone, so one that cannot be read costs
    itself and nothing else.  Bare ampersands and the usual undeclared entities are mended.  Entries
    without title or link are left out; only the publication date counts, never that of a change.
    """
    return _items(_parsed(raw))


def unread_entries(raw: DataFrame) -> DataFrame:
    """Entries of documents that give no item, as source_id and entry."""
    return _parsed(raw).where((_filled("title") == "") | (_filled("link") == "")).select("source_id", "entry")


def read_files(spark: SparkSession, folder: str, schema: str, source: str = "parquet", **options: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a folder's files, and the files that gave none (path, length), as corrupt ones do.

    A file that cannot be read, or breaks off while it is, loses what was not read of it and no other file.
    """
    rows = spark.read.schema(schema).format(source).options(ignoreCorruptFiles="true", ignoreMissingFiles="true", **options).load(folder)
    files = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_path").alias("path"), "length")
    return rows, files.join(rows.select(F.col("_metadata.file_path").alias("path")).distinct(), "path", "left_anti")


class _Channel(HTMLParser):
    """Collects the message blocks of one page."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.depth, self.block, self.text = 0, -1, -1
        self.now: dict = {}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag not in self.VOID:
            self.depth += 1
        if "tgme_widget_message" in classes:
            self._close()
            self.block, self.now = self.depth, {"post": a.get("data-post") or "", "link": "", "parts": [], "seen": False}
        elif self.block >= 0 and "tgme_widget_message_text" in classes and not self.now["seen"]:
            self.text, self.now["seen"] = self.depth, True
        elif self.block >= 0 and tag == "a" and "tgme_widget_message_date" in classes and not self.now["link"]:
            self.now["link"] = a.get("href") or ""

    def handle_endtag(self, tag):
        if tag in self.VOID:
            return
        if self.depth == self.text:
            self.text = -1
        if self.depth == self.block:
            self._close()
        self.depth -= 1

    def handle_data(self, data):
        if self.text >= 0 and data.strip():
            self.now["parts"].append(data.strip())

    def _close(self):
        if self.block >= 0 and self.now["parts"]:
            text = " ".join(self.now["parts"])
            title = text.split("\n")[0][:TITLE_CHARS]
            self.found.append({"title": title, "link": self.now["link"], "summary": text, "guid": self.now["post"] or self.now["link"] or title})
        self.block = self.text = -1


def channel_messages(html: str) -> list[dict]:
    page = _Channel()
    page.feed(html)
    page.close()
    page._close()
    return page.found


def parse_channel_html(pages: DataFrame) -> DataFrame:
    """Items of message-preview pages (source_id, html); the page goes no further than its messages."""

    @F.pandas_udf(MESSAGES)
    def messages(html: pd.Series) -> pd.Series:
        return pd.Series([channel_messages(h or "") for h in html])

    found = pages.select("source_id", F.explode(messages("html")).alias("x"))
    return found.select("source_id", "x.*", F.lit(None).cast("timestamp").alias("published"))


def stream_items(spark: SparkSession, path: str, schema: str = ITEM, source: str = "parquet") -> DataFrame:
    """Items as an unbounded table: files that land in a folder."""
    return spark.readStream.schema(schema).format(source).load(path)


CALENDAR = "type string, title string, time string, tz string, importance string, offsets array<string>, source_url string, consensus string, status string"
CALENDAR_FIELDS = ", ".join(f.replace(" ", ": ", 1) for f in CALENDAR.split(", "))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar entries of a JSON file, numbered in order; see `calendar.validate`.

    The file holds a list of entries.  A missing or empty file is an empty calendar; anything but
    a list is an error.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"entry_ix int, {CALENDAR}")
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value")).where("value <> ''")
    read = F.try_parse_json("value")
    checked = whole.select(F.when(read.isNotNull() & F.startswith("value", F.lit("[")), F.col("value")).otherwise(F.raise_error(F.lit("the top level of a calendar must be a list of entries"))).alias("value"))
    entries = checked.select(F.posexplode(F.from_json("value", F.lit(f"array<struct<{CALENDAR_FIELDS}>>"))).alias("entry_ix", "x"))
    return entries.select("entry_ix", "x.*")
