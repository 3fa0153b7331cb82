"""A batch of matched reports into the tables of stories and articles, as one set of joins.

The result equals taking the reports one after the other in order of ``place``: a report goes to the
story it matched, else to the oldest one with its normalised title, else it founds one; an address or
a title that its story holds already is not stored again; stories are summed up from all their articles.

Edge cases: reports without an address or a title key are left out; of repeated addresses, then of
repeated title keys, in the batch the first counts; an empty batch changes nothing; null counts are
unknown; a null normalised title equals no other. Columns beyond those named are dropped.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.operators import rollup, rows
from newsgraph.tables import materialize

REPORT = (
    "place long, story_id long, joins long, norm_title string, title_key string, url string, title string, source_key string, aggregator boolean, confidence string, "
    "published timestamp, deaths long, injuries long, deaths_confidence float, injuries_confidence float, scope string, content_type string, extract_confidence string"
)
ARTICLE = "id long, " + REPORT.removeprefix("place long, ").replace("joins long, norm_title string, ", "")
STORY = (
    "story_id long, display_title string, norm_title string, first_published timestamp, last_published timestamp, source_count long, max_confidence string, "
    "deaths long, injuries long, deaths_manual long, injuries_manual long, casualties_locked boolean"
)


class Ingested(NamedTuple):
    """``outcomes``: place, url, story_id, inserted, matched. ``articles``: rows to append. ``stories``: new and changed rows."""

    outcomes: DataFrame
    articles: DataFrame
    stories: DataFrame


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def distinct_reports(batch: DataFrame) -> DataFrame:
    """The first report of each address, and of those the first of each title key."""
    keyed = batch.filter("url IS NOT NULL AND title_key IS NOT NULL")
    return rows.first_wins(rows.first_wins(keyed, ["url"], F.col("place")), ["title_key"], F.col("place"))


def ingest(batch: DataFrame, stories: DataFrame, articles: DataFrame) -> Ingested:
    """``batch`` (REPORT; ``place`` is unique, ``story_id`` a stored story or null, ``joins`` the place of an earlier report whose story it shares) into ``stories`` (STORY) and ``articles`` (ARTICLE).

    Story and article ids go on from the largest ones stored, plus place, so a batch that is run again gives the same rows.
    A report that joins one that is left out or itself joins another stands for itself. Tables are met on keys only; of the stored articles those of touched stories are read for the sums.
    """
    held = articles.select("id", "story_id", "url", "title_key")
    new = rows.new_rows(distinct_reports(batch.select(*names(REPORT))), held, "url")
    there = new.filter("joins IS NULL").select(F.col("place").alias("joins"), F.lit(True).alias("_there"))
    new = new.join(there, "joins", "left").withColumn("joins", F.when(F.col("_there") & F.col("story_id").isNull(), F.col("joins")))
    followers = new.filter("joins IS NOT NULL").withColumn("_matched", F.lit(True))
    by_title = stories.filter("norm_title IS NOT NULL").groupBy("norm_title").agg(F.min("story_id").alias("_known"))
    new = new.filter("joins IS NULL").join(by_title, "norm_title", "left").withColumn("_told", F.coalesce("story_id", "_known")).withColumn("_matched", F.col("story_id").isNotNull())
    # Of reports that no story takes, the first with a normalised title founds for all of them; one without founds for itself.
    alike = F.when(F.col("_told").isNull(), F.coalesce(F.concat(F.lit("t"), "norm_title"), F.concat(F.lit("p"), F.col("place").cast("string"))))
    new = new.withColumn("_alike", alike)
    founders = new.filter("_told IS NULL").groupBy("_alike").agg(F.min("place").alias("_founder"))
    last = stories.agg(F.coalesce(F.max("story_id"), F.lit(0)).alias("_last_story")).crossJoin(articles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last_article")))
    new = new.join(founders, "_alike", "left").crossJoin(F.broadcast(last))  # one row
    new = new.withColumn("_story", F.coalesce("_told", F.col("_last_story") + 1 + F.col("_founder")))
    led = new.select(F.col("place").alias("joins"), "_story", "_last_article")
    new = new.unionByName(followers.join(led, "joins"), allowMissingColumns=True)
    taken = held.select(F.col("story_id").alias("_story"), "title_key", F.lit(True).alias("_taken")).distinct()
    settled = materialize(new.join(taken, ["_story", "title_key"], "left").withColumn("inserted", F.col("_taken").isNull()), "ingest-settled")

    stored = settled.filter("inserted").withColumn("id", F.col("_last_article") + 1 + F.col("place")).withColumn("story_id", F.col("_story"))
    added = stored.select(*names(ARTICLE))
    refused = rows.owners(settled.filter("NOT inserted").select("place", "url", "title_key"), held).withColumnRenamed("owner", "story_id")
    outcomes = stored.select("place", "url", "story_id", "inserted", F.col("_matched").alias("matched"))
    outcomes = outcomes.unionByName(refused.select("place", "url", "story_id", F.lit(False).alias("inserted"), F.lit(False).alias("matched")))
    own = stored.filter(F.col("place") == F.col("_founder")).select("story_id", F.col("title").alias("display_title"), "norm_title", "deaths", "injuries")
    return Ingested(outcomes, added, summed_up(stories, own, articles, added))


def summed_up(stories: DataFrame, founded: DataFrame, articles: DataFrame, added: DataFrame) -> DataFrame:
    """Rows of all stories that ``added`` touches, with windows, outlets and counts over all their articles.

    Locked counts stay; a manual count goes first; a count that no article tells stays as it was (a founder's own count at first).
    """
    touched = added.select("story_id").distinct()
    members = articles.select(*names(ARTICLE), F.lit(False).alias("_new")).join(touched, "story_id", "left_semi").unionByName(added.withColumn("_new", F.lit(True)))
    told = rollup.eligible(members)
    # Where the first primary outlet comes in this batch and has no count, the one that aggregators told before it stays.
    first = told.filter(~F.coalesce("aggregator", F.lit(False))).groupBy("story_id").agg(F.min("id").alias("_first"), F.bool_and("_new").alias("_late"))
    before = told.join(first, "story_id").filter(F.col("_late") & (F.col("id") < F.col("_first"))).drop("_first", "_late")
    out = stories.select(*names(STORY)).join(touched, "story_id", "left_semi").unionByName(founded, allowMissingColumns=True)
    out = out.join(rollup.published_window(added).withColumnsRenamed({"first_published": "_first", "last_published": "_last", "max_confidence": "_surest"}), "story_id")
    out = out.join(rollup.source_counts(members).withColumnRenamed("source_count", "_outlets"), "story_id")
    for count in ("deaths", "injuries"):
        for rows_, name in ((told, "_best"), (before, "_before")):
            out = out.join(rollup.best_value(rows_, count, f"{count}_confidence").select("story_id", F.col(count).alias(name)), "story_id", "left")
        derived = F.coalesce("_best", "_before")
        out = out.withColumn(count, rollup.precedence(F.col("casualties_locked"), F.col(f"{count}_manual"), derived, F.col(count))).drop("_best", "_before")
    sure = F.when((F.coalesce("max_confidence", F.lit("")) == "high") | (F.col("_surest") == "high"), "high").otherwise("medium")
    out = out.withColumn("first_published", F.least("first_published", "_first")).withColumn("last_published", F.greatest("last_published", "_last"))
    out = out.withColumn("source_count", F.col("_outlets")).withColumn("max_confidence", sure).withColumn("casualties_locked", F.coalesce("casualties_locked", F.lit(False)))
    return out.select(*names(STORY))


def with_changes(stories: DataFrame, changed: DataFrame) -> DataFrame:
    """The stories after a batch: changed rows stand in for the stored ones."""
    return stories.select(*names(STORY)).join(changed.select("story_id"), "story_id", "left_anti").unionByName(changed)


def tally(outcomes: DataFrame) -> DataFrame:
    """One row: new_stories, merged, skipped. A report that went to a story by its title alone counts as new."""
    count = lambda c, n: F.count_if(F.expr(c)).alias(n)
    return outcomes.agg(count("inserted AND NOT matched", "new_stories"), count("inserted AND matched", "merged"), count("NOT inserted", "skipped"))
