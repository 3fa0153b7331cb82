"""Facts of articles written back, and what they change in the sums of stories, kept up from the change alone.

``upserted`` takes facts by address, as JSON, into the articles and turns the rows before and after into
evidence that goes and evidence that comes. Evidence is a multiset: rows (story_id, kind, value, aggregator,
source_key, confidence, published, llm) with the number of times they stand. Adding what comes and taking
away what goes leaves the evidence of the stories touched, from which their best counts, kind of text and
places follow, a maximum that lost its only witness included, without reading their articles again.

Edge cases: of several updates of one address the one with the largest place counts; an address that no
article has, a null address, and text that is no JSON object change nothing; an empty string is no value;
a field that is missing is null or its default (scope incident, extractor regex, version 0, no places);
a count that isn't a whole number in range is null; locked stories keep everything; a value that nothing
tells any more stays as it was; empty tables give empty tables. Extra columns of articles stay.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.operators import rollup
from newsgraph.tables import by_rows, materialize

# The fields of the facts of an article.
FACTS = (
    "deaths long, injuries long, regex_deaths long, regex_injuries long, deaths_evidence string, injuries_evidence string, deaths_confidence float, injuries_confidence float, "
    "casualty_scope string, casualty_field string, casualty_snippet string, content_type string, alcohol_involved string, article_provinces array<string>, extractor string, "
    "extractor_model string, extract_confidence string, extractor_version int, payload string"
)
DEFAULTS = {"casualty_scope": "incident", "extractor": "regex", "extractor_version": 0}
EVIDENCE = ["story_id", "kind", "value", "aggregator", "source_key", "confidence", "published", "llm"]
COUNTS = ("deaths", "injuries")
# Articles of which one task makes evidence.
TASK_ROWS = 100_000


def fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.split(" ", 1)) for part in schema.split(", ")]


def typed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema, cast; absent ones are null."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields(schema)])


def unpacked(facts: Column) -> Column:
    """The record of facts in a JSON object; null where it is none."""
    plain = ", ".join(f"{n} {t if t.startswith('array') else 'string'}" for n, t in fields(FACTS))
    whole = F.regexp_like(F.trim(facts), F.lit(r"(?s)^\{.*\}$")) & F.try_parse_json(facts).isNotNull()
    record = F.transform(F.array(F.from_json(facts, plain)), lambda j: _record(j))[0]
    return F.when(whole, record)


def _record(j: Column) -> Column:
    out = []
    for name, kind in fields(FACTS):
        given = j[name]
        if kind.startswith("array"):
            value = F.coalesce(F.array_compact(given), F.array().cast(kind))
        elif kind == "string":
            value = given
        else:
            value = F.nullif(given, F.lit("")).try_cast(kind)
        out.append((F.coalesce(value, F.lit(DEFAULTS[name]).cast(kind)) if name in DEFAULTS else value).alias(name))
    return F.struct(*out)


class Upserted(NamedTuple):
    """``articles``: changed rows. ``stories``: changed rows. ``evidence``: that of all stories afterwards."""

    articles: DataFrame
    stories: DataFrame
    evidence: DataFrame


def evidence(articles: DataFrame) -> DataFrame:
    """``EVIDENCE`` and n: what articles (FACTS, story_id, source_key, aggregator, published) say of their stories."""
    own = articles.withColumn("aggregator", F.coalesce("aggregator", F.lit(False))).withColumn("llm", F.coalesce(F.col("extractor") == "llm", F.lit(False)))
    told = rollup.eligible(own.withColumn("scope", F.col("casualty_scope")))
    none = {"value": F.lit(None).cast("string"), "aggregator": F.lit(None).cast("boolean"), "source_key": F.lit(None).cast("string"), "confidence": F.lit(None).cast("float"), "published": F.lit(None).cast("timestamp"), "llm": F.lit(None).cast("boolean")}
    rows = lambda df, kind, **has: df.select("story_id", F.lit(kind).alias("kind"), *[has.get(n, c).alias(n) for n, c in none.items()])
    col = F.col
    parts = [rows(told, "speaks", aggregator=col("aggregator"))]
    for count in COUNTS:
        parts.append(rows(told.filter(col(count).isNotNull()), count, value=col(count).cast("string"), aggregator=col("aggregator"), source_key=col("source_key"), confidence=col(f"{count}_confidence"), published=col("published"), llm=col("llm")))
    parts.append(rows(own.filter("content_type IS NOT NULL"), "content_type", value=col("content_type")))
    parts.append(rows(own.withColumn("_p", F.explode("article_provinces")).filter("_p IS NOT NULL"), "province", value=col("_p")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*EVIDENCE).agg(F.count("*").alias("n"))


def moved(before: DataFrame, comes: DataFrame, goes: DataFrame) -> DataFrame:
    """The evidence with what comes and without what goes."""
    signed = before.unionByName(comes).unionByName(goes.withColumn("n", -F.col("n")))
    return signed.groupBy(*EVIDENCE).agg(F.sum("n").alias("n")).filter("n != 0")


def sums(evidence: DataFrame) -> DataFrame:
    """``story_id`` with the best counts, their confidence and source, the commonest content_type and the provinces, where evidence tells them."""
    out = evidence.select("story_id").distinct()
    primary = evidence.filter("kind = 'speaks'").groupBy("story_id").agg(F.bool_or(~F.col("aggregator")).alias("_primary"))
    for count in COUNTS:
        pool = evidence.filter(F.col("kind") == count).join(primary, "story_id").filter(~F.col("_primary") | ~F.col("aggregator"))
        # Outlets are put together per value first, so that a value that many tell is summed in parts.
        each = pool.groupBy("story_id", "value").agg(F.max("confidence").alias("c"), F.count_distinct("source_key").alias("outlets"), F.max("published").alias("latest"), F.bool_or("llm").alias("llm"))
        number = F.col("value").cast("long")
        best = each.groupBy("story_id").agg(F.max_by(F.struct(number.alias("v"), "c", "llm"), F.struct(F.coalesce("c", F.lit(-1.0)), "outlets", "latest", number)).alias("b"))
        out = out.join(best.select("story_id", F.col("b.v").alias(count), F.col("b.c").alias(f"{count}_confidence"), F.when(F.col("b.llm"), "llm").otherwise("regex").alias(f"{count}_source")), "story_id", "left")
    kinds = evidence.filter("kind = 'content_type'")
    kinds = kinds.join(kinds.groupBy("story_id").agg(F.max("n").alias("n")), ["story_id", "n"]).groupBy("story_id").agg(F.min("value").alias("content_type"))
    places = evidence.filter("kind = 'province'").groupBy("story_id").agg(F.array_sort(F.collect_set("value")).alias("provinces"))
    return out.join(kinds, "story_id", "left").join(places, "story_id", "left")


def with_sums(stories: DataFrame, found: DataFrame) -> DataFrame:
    """Stories (story_id, counts with _manual, _confidence and _source, content_type, provinces, casualties_locked) with their new sums; what none tells stays."""
    open_ = stories.filter(~F.coalesce("casualties_locked", F.lit(False)))
    told = [c for c in found.columns if c != "story_id"]
    both = open_.join(found.select("story_id", *[F.col(c).alias(f"_{c}") for c in told]), "story_id")
    for count in COUNTS:
        source = F.when(F.col(f"{count}_manual").isNotNull(), "manual").otherwise(F.coalesce(f"_{count}_source", f"{count}_source"))
        both = both.withColumn(count, F.coalesce(f"{count}_manual", f"_{count}", count)).withColumn(f"{count}_source", source).withColumn(f"{count}_confidence", F.coalesce(f"_{count}_confidence", f"{count}_confidence"))
    both = both.withColumn("content_type", F.coalesce("_content_type", "content_type")).withColumn("provinces", F.coalesce("_provinces", "provinces"))
    return both.select(*stories.columns)


def replaced(articles: DataFrame, read: DataFrame) -> DataFrame:
    """The articles whose address has facts in ``read``, with these; other columns as they are."""
    names = {n: n for n, _ in fields(FACTS)} | {"scope": "casualty_scope"}
    into = [c for c in articles.columns if c in names]
    fresh = read.select("url", *[F.col(names[c]).alias(f"_{c}") for c in into])
    kinds = dict(articles.dtypes)
    return articles.join(fresh, "url").select(*[F.col(f"_{c}").cast(kinds[c]).alias(c) if c in into else F.col(c) for c in articles.columns])


def upserted(articles: DataFrame, stories: DataFrame, before: DataFrame, updates: DataFrame) -> Upserted:
    """``updates`` (url, place, facts: JSON) into ``articles`` (url, FACTS, story_id, source_key, aggregator, published) and ``stories``; ``before`` is the evidence so far."""
    told = by_rows(updates.filter("url IS NOT NULL"), TASK_ROWS, "url").withColumn("f", unpacked(F.col("facts"))).filter("f IS NOT NULL")
    latest = materialize(told.groupBy("url").agg(F.max_by("f", "place").alias("f")).select("url", "f.*"), "facts-latest")
    old = materialize(articles.join(latest.select("url"), "url", "left_semi"), "facts-before")
    new = materialize(replaced(old, latest), "facts-after")
    after = materialize(moved(before, evidence(by_rows(new, TASK_ROWS)), evidence(by_rows(old, TASK_ROWS))), "evidence")
    touched = new.select("story_id").distinct()
    return Upserted(new, with_sums(stories.join(touched, "story_id", "left_semi"), sums(after.join(touched, "story_id", "left_semi"))), after)
