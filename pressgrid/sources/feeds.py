"""Feeds, HTML pages, files, tables and metric text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import EVENTS, SCHEMAS, Corpus

ENTITY_FEED = "entities array<struct<type string, value string, mentions bigint, image string>>, returned bigint, total bigint"
ARTICLE = "URL string, title string, published string, images array<struct<url string, alt string, title string>>, entities struct<PERSON array<string>>"
#: Bytes of an image that are read at most.
MAX_BLOB = 5 * 1024 * 1024


def read_entity_feed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Persons of an entity feed: ``name, mentions, image``.

    Names are trimmed and empty ones dropped, null mentions are 0, and an image that isn't an object is null.  A feed of
    ``lines`` has a document a line, so one file may be many tasks; otherwise a file is one document and one task.
    """
    rows = spark.read.schema(ENTITY_FEED).option("multiLine", not lines).json(path).select(F.explode("entities").alias("e"))
    image = F.from_json("e.image", "url string, width int, height int")
    return rows.filter("e.type = 'PERSON'").select(
        F.trim("e.value").alias("name"), F.coalesce("e.mentions", F.lit(0)).alias("mentions"),
        F.when(F.trim("e.image").startswith("{"), image).alias("image")).filter("name <> ''")


def read_article_feed(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Articles of a feed, a bare list or an object with ``articles``; and what is rejected, with the reason.

    A feed of ``lines`` has on each line a list, such an object, or one article: its files are split over tasks.  Otherwise a
    file is one document and one task.
    """
    raw = spark.read.text(path, wholetext=not lines)
    bare = F.from_json("value", f"array<struct<{_struct(ARTICLE)}>>")
    inside = F.from_json("value", f"struct<articles:array<struct<{_struct(ARTICLE)}>>>")["articles"]
    if lines:
        inside = F.coalesce(inside, F.array(F.from_json("value", f"struct<{_struct(ARTICLE)}>")))
    parsed = raw.select(F.when(F.ltrim("value").startswith("["), bare).when(F.trim("value") != "", inside).alias("a"))
    rows = parsed.select(F.explode("a").alias("a")).select("a.*")
    persons = F.filter(F.transform(F.coalesce("entities.PERSON", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select(F.col("URL").alias("url"), "title", "published", F.coalesce("images", F.array()).alias("images"), persons.alias("persons"))
    reason = F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "no_url").when(F.size("persons") == 0, "no_person")
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def _struct(fields: str) -> str:
    """``a string, b struct<..>`` as the inside of a struct type."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(fields + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = fields[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)


class _Media(HTMLParser):
    """Links of one kind of tag, with alt text and the caption of the figure around."""

    def __init__(self, tag: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.names = tag, ("src", "data-src") if tag == "img" else ("href",)
        self.found: list[list] = []
        self.figures: list[list[int]] = []
        self.text: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == self.tag:
            link = next((own[n] for n in self.names if own.get(n)), None)
            if link:
                for figure in self.figures[-1:]:
                    figure.append(len(self.found))
                self.found.append([link, own.get("alt"), None])
        elif tag == "figure":
            self.figures.append([])
        elif tag == "figcaption" and self.figures and self.text is None:
            self.text = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data.strip())

    def handle_endtag(self, tag):
        if tag == "figcaption" and self.text is not None:
            self.caption, self.text = "".join(self.text), None
        elif tag == "figure" and self.figures:
            for i in self.figures.pop():
                self.found[i][2] = getattr(self, "caption", None)
            self.caption = None


def _scan(tag: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, url, html in zip(frame["page_id"], frame["url"], frame["html"]):
                parser, seen = _Media(tag), set()
                parser.feed(html or "")
                for link, alt, caption in parser.found:
                    try:
                        target = urljoin(url or "", link)
                    except ValueError:
                        continue
                    if target.startswith(("http://", "https://")) and target not in seen:
                        rows.append((page_id, len(seen), target, alt, caption))
                        seen.add(target)
            yield pd.DataFrame(rows, columns=["page_id", "position", "src", "alt", "caption"])

    return run


def extract_media(pages: DataFrame, tag: str = "img") -> DataFrame:
    """Media candidates of ``pages(page_id, url, html)``, each URL once for a page in order."""
    return pages.select("page_id", "url", "html").mapInPandas(_scan(tag), "page_id bigint, position int, src string, alt string, caption string")


def read_blobs(spark: SparkSession, path: str, max_bytes: int = MAX_BLOB) -> DataFrame:
    """Image files within the cap that begin as an image does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= max_bytes)
    head = F.hex(F.substring("content", 1, 12))
    kind = F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("47494638"), "gif").when(head.rlike("^52494646.{8}57454250"), "webp")
    return files.select("path", "length", "content", kind.alias("kind")).filter("kind is not null")


def write_corpus(c: Corpus, path: str) -> None:
    """A new snapshot directory: articles by month, tables with an entity clustered by it."""
    for name, df in c.items():
        if name == "articles" and "published_at" in df.columns:
            df.withColumn("month", F.date_format("published_at", "yyyy-MM")).write.partitionBy("month").parquet(f"{path}/{name}")
        elif "entity_id" in df.columns:
            df.repartitionByRange("entity_id").sortWithinPartitions("entity_id").write.parquet(f"{path}/{name}")
        else:
            df.write.parquet(f"{path}/{name}")


def read_corpus(spark: SparkSession, path: str) -> Corpus:
    return Corpus(**{name: spark.read.parquet(f"{path}/{name}").drop("month") for name in SCHEMAS})


def read_events(spark: SparkSession, path: str, streaming: bool = False, schema: str = EVENTS, fmt: str = "parquet") -> DataFrame:
    """The operational event log, as a table or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).format(fmt).load(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def metrics_text(rows: DataFrame) -> DataFrame:
    """Exposition lines of ``metric, labels map<string,string>, value``, labels in order of their names."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    whole = F.col("value") == F.floor("value")
    value = F.when(whole, F.col("value").cast("bigint").cast("string")).otherwise(F.format_string("%.6f", "value"))
    return rows.select(F.concat("metric", labels, F.lit(" "), value).alias("value"))


def write_metrics(rows: DataFrame, path: str) -> None:
    metrics_text(rows).write.mode("overwrite").text(path)
