"""Feed items from landed files: RSS and Atom XML, and JSON lines of labelled cases.

Edge cases: a malformed item or one without title or link is an error row, the others go on; items
without a date are not recent; a folder without items gives no rows; unknown elements are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.functions.text import host_of, strip_html, unwrapped_link
from newsgraph.operators.rows import first_wins

PLAIN = "pubDate string, published string, updated string, description string, summary string"
# A link is text, or an element whose address is an attribute; there may be several, of which the first counts.
ITEM = f"title string, link array<struct<_VALUE:string,_href:string>>, {PLAIN}, source struct<_VALUE:string,_url:string>, _malformed string"
# Row elements of the two kinds of feed.
RSS, ATOM = "item", "entry"
MAX_AGE_DAYS = 45
MAX_SUMMARY = 300
UNKNOWN_SOURCE = "unknown"


def read_rss(spark: SparkSession, path: str, kind: str = RSS) -> DataFrame:
    """Items of all feeds of one kind under a path, with the file they came from; a malformed item has its text in ``_malformed`` and nulls elsewhere."""
    reader = spark.read.format("xml").option("rowTag", kind).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed")
    items = reader.schema(ITEM).load(path).withColumn("feed", F.input_file_name())
    # An empty address is none: the first link decides, whether or not it has one.
    first = F.get("link", F.lit(0))
    return items.withColumn("link", F.nullif(F.trim(F.coalesce(F.nullif(F.trim(first["_VALUE"]), F.lit("")), first["_href"])), F.lit("")))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS and Atom feeds under a path."""
    return read_rss(spark, path, RSS).unionByName(read_rss(spark, path, ATOM))


def errors(items: DataFrame) -> DataFrame:
    """``feed, reason, items``: what was left out of each feed."""
    reason = F.when(F.col("_malformed").isNotNull(), "malformed").when(F.coalesce(F.trim("title"), F.lit("")) == "", "no title").when(F.col("link").isNull(), "no link")
    return items.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("feed", "reason").agg(F.count("*").alias("items"))


def usable(items: DataFrame) -> DataFrame:
    """Items with a title and a link."""
    return items.filter(F.col("_malformed").isNull() & (F.coalesce(F.trim("title"), F.lit("")) != "") & F.col("link").isNotNull()).drop("_malformed")


def search_queries(queries: DataFrame, seasonal: bool = False, engines: tuple[str, ...] = ("bing",)) -> DataFrame:
    """Of a table (engine, query, seasonal) the queries of the engines that are switched on; those of the season only in it. A null season is all year."""
    wanted = F.lit(True) if seasonal else ~F.coalesce("seasonal", F.lit(False))
    return queries.filter(F.col("engine").isin(*engines) & wanted).select("engine", "query").distinct()


def read_gold(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Labelled cases; a missing split is the test split."""
    cases = spark.read.json(path)
    named = F.coalesce(F.col("split"), F.lit("test")) if "split" in cases.columns else F.lit("test")
    cases = cases.withColumn("split", named)
    return cases.filter(F.col("split") == split) if split else cases


def parse_date(*texts: Column) -> Column:
    """First text that is a date: RFC 822 or ISO 8601; null if none is."""
    tries = []
    for text in texts:
        bare = F.trim(F.regexp_replace(text, r"^[A-Za-z]{3}, *", ""))
        tries += [F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(text)]
    return F.coalesce(*tries)


def title_without_source(title: Column, source: Column) -> Column:
    """Drops a last " - part" that equals the source."""
    parts = F.split(title, " - ")
    short = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " - ")
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == source), short).otherwise(title)


def recent(items: DataFrame, now: Column, days: int = MAX_AGE_DAYS) -> DataFrame:
    """Items with a date that are no older than so many days."""
    return items.filter(F.col("published").isNotNull() & (F.unix_micros(now) - F.unix_micros("published") <= days * 86_400_000_000))


def search_items(raw: DataFrame, source: Column, suffixed: bool) -> DataFrame:
    """Items of one search source in one form: title, link, published, source, summary."""
    named = F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit(UNKNOWN_SOURCE))
    title = title_without_source(F.trim("title"), named) if suffixed else F.trim("title")
    summary = F.lit("") if suffixed else strip_html(F.coalesce("description", "summary", F.lit("")), MAX_SUMMARY)
    return raw.select(title.alias("title"), unwrapped_link(F.col("link")).alias("link"), parse_date(F.col("pubDate"), F.col("published"), F.col("updated")).alias("published"), named.alias("source"), summary.alias("summary"))


def direct_items(raw: DataFrame) -> DataFrame:
    """Items of a publisher's own feed; the source is the link's host."""
    return search_items(raw, host_of(F.col("link")), suffixed=False)


def united(*sources: DataFrame) -> DataFrame:
    """All sources, first wins per link by order of sources, then date and title."""
    out = None
    for priority, items in enumerate(sources):
        items = items.withColumn("priority", F.lit(priority))
        out = items if out is None else out.unionByName(items)
    return first_wins(out.filter("link IS NOT NULL"), ["link"], F.col("priority"), F.col("published").desc_nulls_last(), F.col("title"))
