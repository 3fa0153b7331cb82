"""Reports over stories and articles: totals, regions, coverage, drift and accuracy.

Edge cases: a null count is unknown and adds nothing to a total; null and empty arrays name no region,
a region named twice counts once; shares of nothing are null; empty tables give zeros where a report is
one row, and no rows elsewhere; ties are settled by the name or key. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_if(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def casualty_state(deaths: Column, injuries: Column) -> Column:
    return F.when(deaths > 0, "fatal").when(injuries > 0, "injury").when(deaths.isNotNull() | injuries.isNotNull(), "none").otherwise("unknown")


def count_label(value: Column, unknown: str = "ไม่ระบุ") -> Column:
    return F.coalesce(value.cast("string"), F.lit(unknown))


def is_roundup(content_type: Column) -> Column:
    return content_type.eqNullSafe("statistics_roundup")


def story_confidence(confidence: Column, sources: Column, least: int = 2) -> Column:
    return F.when(confidence.eqNullSafe("high") & (F.coalesce(sources, F.lit(1)) >= least), "high").otherwise("medium")


def totals(stories: DataFrame, deaths: Column, injuries: Column, roundup: Column) -> DataFrame:
    """One row; round-ups are set apart first, then unknown stories, and nothing is imputed."""
    single = ~roundup
    unknown = deaths.isNull() & injuries.isNull()
    return stories.agg(
        F.coalesce(F.sum(F.when(single, deaths)), F.lit(0)).cast("long").alias("deaths"),
        F.coalesce(F.sum(F.when(single, injuries)), F.lit(0)).cast("long").alias("injuries"),
        count_if(single & ~unknown, "counted"),
        count_if(single & unknown, "unknown"),
        count_if(roundup, "aggregate"),
    )


def region_stats(stories: DataFrame, regions: str, deaths: Column, top: int = 10) -> DataFrame:
    """Stories, deaths over those that state them, and unknown ones per region; the busiest regions."""
    each = stories.select(F.explode(F.array_distinct(regions)).alias("region"), deaths.alias("_deaths"))
    stats = each.groupBy("region").agg(F.count("*").alias("stories"), F.coalesce(F.sum("_deaths"), F.lit(0)).cast("long").alias("deaths"), F.count(F.when(F.col("_deaths").isNull(), 1)).alias("unknown"))
    return stats.orderBy(F.desc("stories"), "region").limit(top)


def leading_first(stories: DataFrame, regions: str) -> DataFrame:
    """The most frequent first region and its share of all stories in per cent."""
    first = F.try_element_at(F.col(regions), F.lit(1))
    counts = stories.groupBy(first.alias("region")).agg(F.count("*").alias("stories"))
    all_ = counts.agg(F.sum("stories").alias("all"))
    return counts.filter("region IS NOT NULL").orderBy(F.desc("stories"), "region").limit(1).crossJoin(all_).select("region", "stories", F.round(100.0 * F.col("stories") / F.col("all")).cast("long").alias("share"))


def coverage(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows, and per column how many are known and what share, in one pass."""
    shares = [x for n, c in columns.items() for x in (F.count(c).alias(f"{n}_known"), F.round(100.0 * F.count(c) / F.nullif(F.count("*"), F.lit(0)), 1).alias(f"{n}_pct"))]
    return rows.agg(F.count("*").alias("total"), *shares)


def change(before: Column, after: Column) -> Column:
    """How a reading moved."""
    return F.when(before.eqNullSafe(after), "same").when(before.isNull(), "null->n").when(after.isNull(), "n->null").otherwise("n->n")


def rule_histogram(readings: DataFrame, *rules: Column) -> DataFrame:
    """How often each rule gave a count; readings without one add nothing."""
    return readings.select(F.explode(F.array_compact(F.array(*rules))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def body_sources(bodies: DataFrame, via: Column, improved: Column) -> DataFrame:
    """Where bodies came from: articles, those without a usable body under ``none``, and those of which the body added something."""
    usable = via.isNotNull()
    return bodies.groupBy(F.coalesce(via, F.lit("none")).alias("via")).agg(F.count("*").alias("n"), F.count_if(usable & F.coalesce(improved, F.lit(False))).alias("improved"))


def accuracy(pairs: DataFrame, expected: Column, actual: Column, *by: Column) -> DataFrame:
    """Per stratum of the expected value: rows, exact share, mean absolute error (no answer counts as 0)."""
    stratum = F.when(expected.isNull(), "unknown").when(expected == 0, "zero").otherwise("positive")
    return pairs.groupBy(*by, stratum.alias("stratum")).agg(
        F.count("*").alias("n"),
        F.round(F.avg(expected.eqNullSafe(actual).cast("int")), 6).alias("exact"),
        F.round(F.avg(F.abs(expected - F.coalesce(actual, F.lit(0)))), 6).alias("mae"),
        count_if(expected.isNull() & actual.isNotNull(), "false_numbers"),
    )


def freshness(finished: Column, now: Column) -> Column:
    minutes = (F.unix_micros(now) - F.unix_micros(finished)) / 60_000_000
    return F.when(finished.isNull(), "never").when(minutes <= 45, "fresh").when(minutes <= 180, "late").otherwise("stale")
