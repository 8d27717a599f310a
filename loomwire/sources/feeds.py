"""Landed feeds as article rows: RSS and Atom, news sitemaps, JSON APIs and index pages.

Fetching is left to whatever lands the files; a DataSource (`LandedFeeds`) lists feeds by name, one partition each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomwire.functions.dates import feed_date, stamp_in_url
from loomwire.functions.text import clean_url, has_cjk, hash_id, strip

ARTICLE = "id string, title string, url string, ts timestamp, source string, category string, content string, thumbnail string"


def _article(df: DataFrame, source: Column, category: Column) -> DataFrame:
    return df.select(hash_id(F.col("url")).alias("id"), strip(F.col("title")).alias("title"), "url", "ts", source.alias("source"), category.alias("category"), "content", "thumbnail")


def _plain(raw: Column) -> Column:
    out = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


TEXT = "array<struct<_VALUE:string>>"
ENTRY = (
    f"struct<title:{TEXT}, link:array<struct<_VALUE:string,_href:string,_rel:string>>, pubDate:string, published:string, updated:string, date:string,"
    f" `dc:date`:string, `content:encoded`:string, content:{TEXT}, description:{TEXT}, summary:{TEXT}, `media:thumbnail`:array<struct<_url:string>>,"
    " `media:content`:array<struct<_url:string,_type:string>>, enclosure:array<struct<_url:string,_type:string>>>"
)
FEED = f"struct<channel:struct<item:array<{ENTRY}>>, item:array<{ENTRY}>, entry:array<{ENTRY}>, _corrupt_record:string>"
NEWS = "publication_date:string, title:string"
SITEMAP = f"struct<url:array<struct<loc:string, {NEWS}, news:struct<{NEWS}>, image:array<struct<loc:string>>>>, _corrupt_record:string>"
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
MAX_ITEMS = 30
NO_TITLE = "(no title)"


def _filled(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def _first(values: Column, field: str) -> Column:
    """The first filled field of a list of elements."""
    return F.get(F.filter(F.transform(values, lambda x: _filled(x[field])), lambda x: x.isNotNull()), F.lit(0))


def without_prefixes(body: Column) -> Column:
    """XML whose element names have lost their prefixes; comments and CDATA stay as they are."""
    return F.regexp_replace(body, r"(?s)(<!\[CDATA\[.*?\]\]>|<!--.*?-->)|(</?)[\w.-]+:", "$1$2")


def _xml(kind: str) -> Column:
    if kind == "sitemap":
        return F.from_xml(without_prefixes(F.col("body")), SITEMAP, PERMISSIVE)
    return F.from_xml("body", FEED, PERMISSIVE)


def malformed(files: DataFrame, kind: str = "rss") -> DataFrame:
    """source and error of the bodies that are no XML; kind is rss or sitemap."""
    bad = F.col("body").isNull() | _xml(kind)["_corrupt_record"].isNotNull()
    return files.filter(bad).select("source", F.when(F.col("body").isNull(), "no body").otherwise("parse: not well-formed").alias("error"))


def thumbnail(item: Column) -> Column:
    """A media thumbnail, else media content or an enclosure that is an image."""
    picture = lambda x: F.coalesce(x["_url"].rlike(r"(?i)\.(jpe?g|png|webp|gif)"), F.lit(False))
    image = lambda x: F.coalesce(x["_type"].startswith("image"), F.lit(False))
    return F.coalesce(_first(item["media:thumbnail"], "_url"), _first(F.filter(item["media:content"], picture), "_url"), _first(F.filter(item["enclosure"], image), "_url"))


def rss(files: DataFrame, cutoff: Column, max_items: int = MAX_ITEMS, category: Column | None = None) -> DataFrame:
    """files (source, body): RSS or Atom; the first `max_items` entries of each body, then those not older than the cutoff."""
    x = _xml("rss")
    entries = F.coalesce(x["channel"]["item"], x["item"], x["entry"])
    items = files.select("source", F.explode(F.slice(entries, 1, max_items)).alias("i"))
    i = F.col("i")
    own = F.filter(i["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    date = F.coalesce(*(_filled(i[c]) for c in ("pubDate", "published", "updated", "date", "dc:date")))
    content = F.coalesce(_filled(i["content:encoded"]), *(_first(i[c], "_VALUE") for c in ("content", "description", "summary")))
    rows = items.select(
        "source",
        F.coalesce(_first(i["title"], "_VALUE"), F.lit(NO_TITLE)).alias("title"),
        clean_url(F.coalesce(_first(i["link"], "_VALUE"), _first(own, "_href"))).alias("url"),
        feed_date(date).alias("ts"),
        F.coalesce(content, F.lit("")).alias("content"),
        thumbnail(i).alias("thumbnail"),
    )
    rows = rows.filter((F.col("ts") >= cutoff) & (F.col("url") != ""))
    return _article(rows, F.col("source"), category if category is not None else F.lit(None).cast("string"))


def _once(items: Column) -> Column:
    """Structs (pos, url, ...) of one body without later ones of a URL."""
    by_url = F.array_sort(F.transform(items, lambda x: F.struct(x["url"].alias("url"), x["pos"].alias("pos"), x.alias("item"))))
    return F.transform(F.filter(by_url, lambda x, k: (k == 0) | ~F.get(by_url, k - 1)["url"].eqNullSafe(x["url"])), lambda x: x["item"])


def sitemap(files: DataFrame, cutoff: Column, max_items: int = MAX_ITEMS, part: str | None = None, cjk: bool = False) -> DataFrame:
    """files (source, body): news sitemaps; each URL of a body once, its newest `max_items`, optionally only some paths and titles in Chinese.

    A body is worked off inside its row; nothing is shuffled.
    """
    parsed = files.select("source", _xml("sitemap")["url"].alias("urls"))

    def item(x: Column, k: Column) -> Column:
        date = feed_date(F.coalesce(_filled(x["news"]["publication_date"]), _filled(x["publication_date"])))
        title = F.coalesce(_filled(x["news"]["title"]), _filled(x["title"]))
        image = F.nullif(clean_url(_first(x["image"], "loc")), F.lit(""))
        return F.struct(k.alias("pos"), clean_url(strip(x["loc"])).alias("url"), date.alias("ts"), title.alias("title"), image.alias("thumbnail"))

    def good(x: Column) -> Column:
        out = (x["ts"] >= cutoff) & x["title"].isNotNull() & (x["url"] != "")
        if part:
            out = out & x["url"].contains(part)
        return F.coalesce(out & has_cjk(x["title"]) if cjk else out, F.lit(False))

    found = parsed.withColumn("items", F.filter(F.transform("urls", item), good)).withColumn("items", _once(F.col("items")))
    newest = F.array_sort(F.transform("items", lambda x: F.struct((-F.unix_micros(x["ts"])).alias("age"), x["pos"].alias("pos"), x.alias("item"))))
    top = found.select("source", F.explode(F.slice(newest, 1, max_items)).alias("x")).select("source", "x.item.*").withColumn("content", F.lit(None).cast("string"))
    segment = F.regexp_extract(F.coalesce(F.try_url_decode("url"), F.col("url")), r"^https?://[^/]+/([^/]+)/", 1)
    return _article(top, F.col("source"), segment)


PAGED = (
    "struct<items:array<struct<type:int,data:struct<title:string,publishUrl:string,publishTime:bigint,description:string,"
    "mainImage:struct<cdnUrl:string>,originalImage:struct<cdnUrl:string>>>>>"
)
FLAT = "array<struct<newsId:string,title:string,category:string,publishDate:bigint,imageList:array<struct<imageUrl:string,image2Url:string>>>>"


def paged_json(files: DataFrame, cutoff: Column, max_items: int = MAX_ITEMS) -> DataFrame:
    """files (source, body): {"items": [{"type": 1, "data": {...}}]}, times in epoch seconds; of the first `max_items` those of type 1."""
    items = F.slice(F.from_json("body", PAGED)["items"], 1, max_items)
    d = F.col("i.data")
    rows = files.select("source", F.explode(items).alias("i")).filter((F.col("i.type") == 1) & (F.coalesce(d["publishTime"], F.lit(0)) != 0))
    image = F.coalesce(F.nullif(d["mainImage"]["cdnUrl"], F.lit("")), F.nullif(d["originalImage"]["cdnUrl"], F.lit("")))
    rows = rows.select(
        "source",
        F.coalesce(d["title"], F.lit(NO_TITLE)).alias("title"),
        clean_url(d["publishUrl"]).alias("url"),
        F.timestamp_seconds(d["publishTime"]).alias("ts"),
        _filled(d["description"]).alias("content"),
        image.alias("thumbnail"),
    )
    return _article(rows.filter((F.col("ts") >= cutoff) & (F.col("url") != "")), F.col("source"), F.lit(None).cast("string"))


def flat_json(files: DataFrame, cutoff: Column, base: str, categories: dict[str, str], max_items: int = MAX_ITEMS, other: str = "local") -> DataFrame:
    """files (source, body): a list, times in epoch milliseconds; of a body the first `max_items` that pass.

    Items without id, title or date are skipped. The URL is made from category and id; the first image is the thumbnail.
    """
    named = F.create_map(*(F.lit(x) for kv in categories.items() for x in kv)) if categories else None

    def item(x: Column) -> Column:
        slug = F.lit(other) if named is None else F.coalesce(F.try_element_at(named, x["category"]), F.lit(other))
        image = F.get(x["imageList"], F.lit(0))
        return F.struct(
            strip(x["newsId"]).alias("id"),
            strip(x["title"]).alias("title"),
            F.timestamp_millis(x["publishDate"]).alias("ts"),
            F.nullif(F.coalesce(_filled(image["imageUrl"]), _filled(image["image2Url"])), F.lit("")).alias("thumbnail"),
            slug.alias("slug"),
        )

    good = lambda x: F.coalesce((x["id"] != "") & (x["title"] != "") & (x["ts"] >= cutoff), F.lit(False))
    items = F.slice(F.filter(F.transform(F.from_json("body", FLAT), item), good), 1, max_items)
    rows = files.select("source", F.inline(items)).withColumn("content", F.lit(None).cast("string"))
    url = F.concat(F.lit(base.rstrip("/") + "/"), "slug", F.lit("/player?newsId="), "id")
    return _article(rows.withColumn("url", url), F.col("source"), F.col("slug"))


def index_page(files: DataFrame, cutoff: Column, base: str, pattern: str, section: str | None = None, max_items: int = MAX_ITEMS) -> DataFrame:
    """files (source, body): anchors of an HTML page whose address fits, dated by the time stamp in it; of a body the first `max_items`."""
    root = base.rstrip("/") + "/"
    whole = lambda c: F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit(root), F.regexp_replace(c, "^/+", "")))

    def item(a: Column, k: Column) -> Column:
        url = clean_url(whole(F.regexp_extract(a, r"""(?is)^<a\b[^>]*\bhref=["']([^"']+)""", 1)))
        image = F.nullif(F.regexp_extract(a, r"""(?is)<img\b[^>]*\bsrc=["']([^"']+)""", 1), F.lit(""))
        title = strip(_plain(F.regexp_replace(a, r"<[^>]+>", "")))
        return F.struct(k.alias("pos"), url.alias("url"), stamp_in_url(url).alias("ts"), title.alias("title"), whole(image).alias("thumbnail"))

    def good(x: Column) -> Column:
        out = x["url"].rlike(pattern) & (x["ts"] >= cutoff) & (x["title"] != "")
        return F.coalesce(out & x["url"].contains(section) if section else out, F.lit(False))

    anchors = F.regexp_extract_all("body", F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    found = files.select("source", F.filter(F.transform(anchors, item), good).alias("items")).withColumn("items", _once(F.col("items")))
    rows = found.select("source", F.inline(F.slice(F.array_sort("items"), 1, max_items))).withColumn("content", F.lit(None).cast("string"))
    return _article(rows, F.col("source"), F.lit(section))


def longest_urls(rows: DataFrame, pattern: str, order: str = "ord") -> DataFrame:
    """Of all URLs with one article number (group 1 of the pattern) the longest, at the place of the first; URLs without a number go."""
    number = F.nullif(F.regexp_extract("url", pattern, 1), F.lit(""))
    best = F.max_by("url", F.struct(F.length("url"), -F.col(order)))
    return rows.withColumn("number", number).filter("number IS NOT NULL").groupBy("number").agg(best.alias("url"), F.min(order).alias(order))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All feeds, each article once (the first feed wins), newest first."""
    whole = None
    for k, p in enumerate(parts):
        p = p.withColumn("feed", F.lit(k))
        whole = p if whole is None else whole.unionByName(p)
    first = Window.partitionBy("id").orderBy("feed", F.desc("ts"))
    return whole.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "feed").orderBy(F.desc("ts"), "id")


class LandedFeeds(DataSource):
    """Rows (source, body, status, error) of feeds, one partition each; option `feeds` is name=path lines.

    A file that is missing or can't be read is a row with its error, not a failed job. Files are read where the task runs, so paths must be visible there.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_feeds"

    def schema(self) -> str:
        return "source string, body string, items int, error string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(dict(line.split("=", 1) for line in self.options["feeds"].splitlines() if line.strip()))


class _Feed(InputPartition):
    def __init__(self, source: str, path: str):
        super().__init__(source)
        self.source, self.path = source, path


class _FeedReader(DataSourceReader):
    def __init__(self, feeds: dict[str, str]):
        self.feeds = feeds

    def partitions(self) -> list[InputPartition]:
        return [_Feed(*x) for x in self.feeds.items()]

    def read(self, partition: _Feed) -> Iterator[tuple]:
        try:
            with open(partition.path, encoding="utf-8") as f:
                body = f.read()
            n = sum(1 for x in ElementTree.fromstring(body).iter() if x.tag.rsplit("}", 1)[-1] in ("item", "entry", "url"))
            yield partition.source, body, n, None
        except (OSError, ElementTree.ParseError) as e:
            yield partition.source, None, 0, f"{type(e).__name__}: {e}"


def _field(c: Column, name: str) -> Column:
    """The value of a hidden form field or meta element of a page."""
    by_id = F.regexp_extract(c, rf"""(?is)<input\b(?=[^>]*\b(?:id|name)=["']{name}["'])[^>]*\bvalue=["']([^"']*)""", 1)
    meta = F.regexp_extract(c, rf"""(?is)<meta\b(?=[^>]*\b(?:property|name)=["']{name}["'])[^>]*\bcontent=["']([^"']*)""", 1)
    return _plain(F.coalesce(F.nullif(by_id, F.lit("")), F.nullif(meta, F.lit(""))))


def pages(files: DataFrame, cutoff: Column, section: str, fields: dict[str, str] | None = None) -> DataFrame:
    """files (source, url, body): articles from pages that carry title, section, date and image in hidden fields; other sections are dropped."""
    f = {"title": "title", "section": "section", "date": "date", "image": "image"} | (fields or {})
    rows = files.select("source", clean_url(F.col("url")).alias("url"), _field(F.col("body"), f["title"]).alias("title"), _field(F.col("body"), f["section"]).alias("section"), feed_date(_field(F.col("body"), f["date"])).alias("ts"), F.lit(None).cast("string").alias("content"), _field(F.col("body"), f["image"]).alias("thumbnail"))
    return _article(rows.filter((F.col("section") == section) & (F.col("ts") >= cutoff)), F.col("source"), F.col("section"))


INDEX = "struct<sitemap:array<struct<loc:string>>, url:array<struct<loc:string>>, _corrupt_record:string>"


def walk_sitemaps(roots: DataFrame, bodies: DataFrame, levels: int = 4, most: int = 120) -> DataFrame:
    """source, pos, url: the pages below sitemap indexes. roots has source and url, bodies the landed XML by url.

    At each level the last child of an index is followed, by one join of all sources with the bodies; of a leaf the first
    `most` pages count. What is missing or no XML ends a walk without pages, as do indexes deeper than `levels`.
    """
    x = F.from_xml(without_prefixes(F.col("body")), INDEX, PERMISSIVE)
    known = bodies.select(F.col("url").alias("_url"), x.alias("x")).select("_url", *(F.transform(F.col(f"x.{c}"), lambda i: strip(i["loc"])).alias(c) for c in ("sitemap", "url")))
    at, found = roots.select("source", F.col("url").alias("_url")), None
    for _ in range(levels):
        met = at.join(known, "_url").select("source", "sitemap", "url")
        leaf = met.filter(F.coalesce(F.size("sitemap"), F.lit(0)) <= 0)
        pages_ = leaf.select("source", F.posexplode(F.slice("url", 1, most)).alias("pos", "url")).filter("url <> ''")
        found = pages_ if found is None else found.unionByName(pages_)
        at = met.filter(F.size("sitemap") > 0).select("source", F.element_at("sitemap", -1).alias("_url"))
    return found


def page_batches(pages_: DataFrame, size: int = 10) -> DataFrame:
    """Pages of walk_sitemaps with the number of the batch they are fetched in."""
    return pages_.withColumn("batch", F.floor(F.col("pos") / size).cast("int"))


#: Readers by the name that a feed's configuration gives.
READERS = {"rss": rss, "sitemap": sitemap, "paged_json": paged_json, "flat_json": flat_json, "index_page": index_page, "pages": pages}


def read(files: DataFrame, kind: str, cutoff: Column, **options) -> DataFrame:
    return READERS[kind](files, cutoff, **options)


def snapshot(spark, path: str, schema: str) -> DataFrame:
    """A table of an earlier run, empty if there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def converted(c: Column, table: dict[str, str]) -> Column:
    """Phrases replaced as from one script variant to another: at each place the longest that begins there, then on after it.

    The table is the caller's; empty phrases aren't allowed. Single characters for single characters are translated by SQL,
    phrases by looking up, where one may begin, the lengths that its first character has, longest first.
    """
    if not table:
        return c
    if all(len(k) == len(v) == 1 for k, v in table.items()):
        return F.translate(c, "".join(table), "".join(table.values()))
    sizes: dict[str, list[int]] = {}
    for phrase in sorted(table, key=len, reverse=True):
        of = sizes.setdefault(phrase[0], [])
        of += [len(phrase)] if len(phrase) not in of else []
    begin = f"[{re.escape(''.join(sizes))}]"

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        first = re.compile(begin)

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            out, done, m = [], 0, first.search(text)
            while m:
                at = m.start()
                size = next((n for n in sizes[text[at]] if text[at : at + n] in table), 0)
                if size:
                    out += [text[done:at], table[text[at : at + size]]]
                    done = at + size
                m = first.search(text, at + max(size, 1))
            return "".join([*out, text[done:]])

        return texts.map(one)

    return convert(c)
