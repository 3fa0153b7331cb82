"""Article facts to stories, by strength of evidence. A count that is null is unknown, never zero.

Edge cases: an outlet of unknown kind is primary; null outlets, kinds and array members count for nothing;
null times are before all others; ties go to the larger count or the first name; repeated articles count
once as outlets and as often as they stand elsewhere; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_counts(articles: DataFrame) -> DataFrame:
    """Distinct outlets per story, aggregators aside, one at least."""
    outlets = F.count_distinct(F.when(~F.coalesce("aggregator", F.lit(False)), F.col("source_key")))
    return articles.groupBy("story_id").agg(F.greatest(outlets, F.lit(1)).cast("long").alias("source_count"))


def published_window(articles: DataFrame) -> DataFrame:
    """First and last publication per story and whether any article has high confidence."""
    return articles.groupBy("story_id").agg(
        F.min("published").alias("first_published"),
        F.max("published").alias("last_published"),
        F.when(F.bool_or(F.col("confidence") == "high"), "high").otherwise(F.max("confidence")).alias("max_confidence"),
    )


# Kinds of text that tell of no incident of their own.
NO_INCIDENT = ("campaign", "legal_explainer")


def eligible(articles: DataFrame) -> DataFrame:
    """Articles that may speak for a story: about one incident, neither campaign nor legal explainer, extraction not of low confidence."""
    return articles.filter(
        (F.coalesce("scope", F.lit("incident")) == "incident") & ~F.coalesce("content_type", F.lit("")).isin(*NO_INCIDENT) & (F.coalesce("extract_confidence", F.lit("")) != "low")
    )


def best_value(articles: DataFrame, value: str, confidence: str) -> DataFrame:
    """``story_id, <value>, <value>_confidence, <value>_outlets, <value>_source``: the value that the evidence favours.

    Only primary outlets speak if a story has any, with a value or without; aggregators otherwise; an outlet of unknown kind is primary.
    Among a story's values the highest confidence wins (null last), then the most distinct outlets, the latest report,
    the larger value. The source is llm if any article with that value has that ``extractor``, else regex. Stories without
    a value are absent. Two aggregations, the first on (story, value), so that a hot story is summed in parts.
    """
    told = articles.withColumn("aggregator", F.coalesce("aggregator", F.lit(False)))
    extracted = F.coalesce(F.bool_or(F.col("extractor") == "llm"), F.lit(False)) if "extractor" in articles.columns else F.bool_or(F.lit(False))
    each = told.groupBy("story_id", value, "aggregator").agg(F.max(confidence).alias("c"), F.collect_set("source_key").alias("keys"), F.max("published").alias("latest"), extracted.alias("llm"))
    primary = each.groupBy("story_id").agg(F.bool_or(~F.col("aggregator")).alias("has_primary"))
    kept = each.filter(F.col(value).isNotNull()).join(primary, "story_id").filter(~F.col("has_primary") | ~F.col("aggregator"))
    outlets = F.size(F.array_distinct(F.flatten(F.collect_list("keys"))))
    per_value = kept.groupBy("story_id", value).agg(F.max("c").alias("c"), outlets.alias("outlets"), F.max("latest").alias("latest"), F.bool_or("llm").alias("llm"))
    rank = F.struct(F.coalesce("c", F.lit(-1.0)), "outlets", "latest", value)
    best = per_value.groupBy("story_id").agg(F.max_by(F.struct(value, "c", "outlets", "llm"), rank).alias("b"))
    source = F.when(F.col("b.llm"), "llm").otherwise("regex")
    return best.select("story_id", f"b.{value}", F.col("b.c").alias(f"{value}_confidence"), F.col("b.outlets").cast("long").alias(f"{value}_outlets"), source.alias(f"{value}_source"))


def modal_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent non-null value per key, the first alphabetically on ties."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    least = counts.groupBy(key).agg(F.max("n").alias("n"))
    return counts.join(least, [key, "n"]).groupBy(key).agg(F.min(value).alias(value))


def sorted_union(rows: DataFrame, key: str, items: str) -> DataFrame:
    """Distinct members of all arrays per key, in binary order."""
    each = rows.select(key, F.explode(items).alias(items)).distinct()
    return each.groupBy(key).agg(F.array_sort(F.collect_set(items)).alias(items))


def precedence(locked: Column, manual: Column, derived: Column, existing: Column) -> Column:
    """A locked value stays; else the manual one, the derived one, what was there."""
    return F.when(F.coalesce(locked, F.lit(False)), existing).otherwise(F.coalesce(manual, derived, existing))


def provenance(locked: Column, manual: Column, derived: Column, existing: Column) -> Column:
    return F.when(F.coalesce(locked, F.lit(False)), existing).when(manual.isNotNull(), F.lit("manual")).when(derived.isNotNull(), F.lit("derived")).otherwise(existing)
