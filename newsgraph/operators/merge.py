"""Stories that tell of one event folded into the oldest of them, after the fact.

Matches within the follow-up window (``within``) make clusters in order of first publication (``cluster``);
the oldest story of a cluster is the parent. Articles of the others move to it, but for those whose title
it holds already, which are dropped, and the others themselves go. The parent's window, outlets,
confidence and counts are summed up again from all its articles.

Edge cases: clusters of one change nothing; of several moving articles with one title the one with the
least id moves; articles without a title key always move; a parent without articles keeps its window;
locked counts stay; no stories give empty tables. Columns beyond those of ``ingest_batch`` are dropped.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.operators import cluster, ingest_batch, match, rollup, rows, within
from newsgraph.operators import entities as E
from newsgraph.tables import materialize


class Merged(NamedTuple):
    """``groups``: parent, id, size, shared (why a story is there). ``stories``, ``articles``: whole tables afterwards. ``dropped``: ids of articles that went."""

    groups: DataFrame
    stories: DataFrame
    articles: DataFrame
    dropped: DataFrame


def as_reports(stories: DataFrame, words: E.Entities = E.THAI) -> DataFrame:
    """Stories as reports (id, first_published, published, features); the last report's time counts for the window."""
    regions = F.col("provinces") if "provinces" in stories.columns else E.regions(F.col("display_title"), words)
    own = match.features(F.col("display_title"), regions, F.col("deaths"), F.col("injuries"), F.col("last_published"), words)
    return stories.select(F.col("story_id").alias("id"), "first_published", F.col("last_published").alias("published"), own.alias("features"))


def merged(stories: DataFrame, articles: DataFrame, words: E.Entities = E.THAI, days: int = match.FOLLOW_UP_DAYS) -> Merged:
    """Fold ``stories`` (STORY) with ``articles`` (ARTICLE)."""
    reports = materialize(as_reports(stories, words), "merge-reports")
    pairs = materialize(within.matches_within(reports, days).withColumnsRenamed({"a_id": "a", "b_id": "b"}), "merge-pairs")
    dated = reports.select("id", F.col("first_published").alias("published"), "features")
    found = materialize(cluster.greedy_clusters(dated.select("id", "published"), pairs), "merge-clusters")
    groups = cluster.folded_groups(found, dated)
    moves = found.filter("id != cluster").select(F.col("id").alias("story_id"), F.col("cluster").alias("_parent"))

    stored, members = stories.select(*ingest_batch.names(ingest_batch.STORY)), articles.select(*ingest_batch.names(ingest_batch.ARTICLE))
    placed = members.select("id", "story_id", "title_key").join(moves, "story_id", "left").withColumnRenamed("_parent", "parent_id")
    placed = materialize(rows.reassigned(placed, placed.select("story_id", "title_key")).withColumnRenamed("story_id", "_story"), "merge-placed")
    gone = moves.select(F.col("story_id").alias("_story"))
    kept = placed.join(gone, "_story", "left_anti")
    dropped = placed.join(gone, "_story", "left_semi").select("id")
    after = members.join(kept, "id").withColumn("story_id", F.col("_story")).select(*members.columns)
    parents = moves.select(F.col("_parent").alias("story_id")).distinct()
    others = stored.join(moves.select("story_id"), "story_id", "left_anti")
    return Merged(groups, others.join(parents, "story_id", "left_anti").unionByName(rebuilt(others.join(parents, "story_id", "left_semi"), after)), after, dropped)


def rebuilt(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """The stories with what their articles say of them now; a count that none tells stays."""
    own = articles.join(stories.select("story_id"), "story_id", "left_semi")
    out = stories.join(rollup.published_window(own).withColumnsRenamed({"first_published": "_first", "last_published": "_last", "max_confidence": "_sure"}), "story_id", "left")
    out = out.join(rollup.source_counts(own).withColumnRenamed("source_count", "_outlets"), "story_id", "left")
    told = rollup.eligible(own)
    for count in ("deaths", "injuries"):
        out = out.join(rollup.best_value(told, count, f"{count}_confidence").select("story_id", F.col(count).alias("_best")), "story_id", "left")
        out = out.withColumn(count, rollup.precedence(F.col("casualties_locked"), F.col(f"{count}_manual"), F.col("_best"), F.col(count))).drop("_best")
    out = out.withColumn("first_published", F.coalesce("_first", "first_published")).withColumn("last_published", F.coalesce("_last", "last_published"))
    out = out.withColumn("source_count", F.coalesce("_outlets", F.lit(1))).withColumn("max_confidence", F.when(F.col("_sure") == "high", "high").otherwise("medium"))
    return out.select(*stories.columns)
