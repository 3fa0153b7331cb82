"""What a reader of the news asks: the latest stories, one story with its articles, how fresh it all is.

Edge cases: stories without a time come last, equal times go by the later id; an id that isn't digits, or isn't
there, gives no row; without a successful run there is no row, and the freshness is never; of runs that finished together
the one with the larger number counts; one without an end counts by its start, after those with one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.operators import enrich, views

# Fixed value: stories of the feed.
LATEST = 100
STORY = ("story_id", "display_title", "deaths", "injuries", "source_count", "max_confidence", "first_published", "last_published")


@dataclass(frozen=True)
class Reader:
    """Over stories (story_id, last_published, …), articles (id, story_id, published) and runs (batch, status, started_at, finished_at, fetched, new_stories)."""

    stories: DataFrame
    articles: DataFrame
    runs: DataFrame

    def latest(self, size: int = LATEST) -> DataFrame:
        """The stories with the latest reports: a report may be weeks old when it is found, so the last one decides."""
        kept = [c for c in STORY if c in self.stories.columns]
        return self.stories.select(*kept).orderBy(F.desc_nulls_last("last_published"), F.desc("story_id")).limit(size)

    def story(self, story_id: str) -> DataFrame:
        """One story with the ids of its articles in order of publication."""
        return enrich.story_with_articles(self.stories, self.articles, story_id)

    def last_run(self) -> DataFrame:
        """``batch, at, fetched, new_stories`` of the last run that went well."""
        done = self.runs.filter("status = 'ok'").orderBy(F.desc_nulls_last("finished_at"), F.desc("batch")).limit(1)
        return done.select("batch", F.coalesce("finished_at", "started_at").alias("at"), "fetched", "new_stories")

    def freshness(self, now: Column) -> DataFrame:
        """One row: when the last run went well, and whether that is fresh, late, stale or never."""
        last = self.last_run().agg(F.max("at").alias("at"))
        return last.select("at", views.freshness(F.col("at"), now).alias("state"))
