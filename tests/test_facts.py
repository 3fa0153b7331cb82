"""Facts written back: sums kept up from the change equal those taken from all articles."""

import json
import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsgraph.operators import facts

EPOCH = datetime(2026, 1, 1, tzinfo=UTC)
ARTICLE = f"id long, url string, story_id long, source_key string, aggregator boolean, published timestamp, extra string, {facts.FACTS}"
STORY = "story_id long, deaths long, injuries long, deaths_manual long, injuries_manual long, deaths_confidence float, injuries_confidence float, deaths_source string, injuries_source string, content_type string, provinces array<string>, casualties_locked boolean"
names = lambda schema: [n for n, _ in facts.fields(schema)]


def some_facts(draw):
    given = {
        "deaths": draw.choice(("", "1", "2", 3, None, "x")), "injuries": draw.choice((None, "4", 5)), "deaths_confidence": draw.choice(("0.5", 0.75, None, "")), "injuries_confidence": 0.5,
        "casualty_scope": draw.choice((None, "incident", "aggregate")), "content_type": draw.choice((None, "crash", "campaign", "law")), "extract_confidence": draw.choice((None, "low", "high")),
        "article_provinces": draw.choice((None, [], ["p1"], ["p2", "p1"])), "extractor": draw.choice((None, "llm")), "extractor_version": draw.choice(("", "7", None)), "payload": {"k": 1},
    }
    return {k: v for k, v in given.items() if draw.random() < 0.9}


def plain_record(given):
    number = lambda v, of: None if v in (None, "") or v == "x" else of(v)
    out = {n: given.get(n) for n in names(facts.FACTS)}
    for n in ("deaths", "injuries", "regex_deaths", "regex_injuries"):
        out[n] = number(out[n], int)
    for n in ("deaths_confidence", "injuries_confidence"):
        out[n] = number(out[n], float)
    out["article_provinces"] = out["article_provinces"] or []
    out["casualty_scope"], out["extractor"] = out["casualty_scope"] or "incident", out["extractor"] or "regex"
    out["extractor_version"] = number(out["extractor_version"], int) or 0
    out["payload"] = None if out["payload"] is None else '{"k":1}'
    return out


def plain_sums(story, members):
    if story["casualties_locked"]:
        return story
    story = dict(story)
    told = [m for m in members if m["casualty_scope"] == "incident" and m["content_type"] not in ("campaign", "legal_explainer") and m["extract_confidence"] != "low"]
    pool = [m for m in told if not m["aggregator"]] or told
    for count in ("deaths", "injuries"):
        by = {}
        for m in pool:
            if m[count] is not None:
                by.setdefault(m[count], []).append(m)
        sure = lambda v: max((m[f"{count}_confidence"] for m in by[v] if m[f"{count}_confidence"] is not None), default=None)
        rank = lambda v: (-1.0 if sure(v) is None else sure(v), len({m["source_key"] for m in by[v]}), max(m["published"] for m in by[v]), v)
        best = max(by, key=rank, default=None)
        source = None if best is None else "llm" if any(m["extractor"] == "llm" for m in by[best]) else "regex"
        first = lambda *values: next((v for v in values if v is not None), None)
        story[f"{count}_source"] = "manual" if story[f"{count}_manual"] is not None else first(source, story[f"{count}_source"])
        story[f"{count}_confidence"] = first(None if best is None else sure(best), story[f"{count}_confidence"])
        story[count] = first(story[f"{count}_manual"], best, story[count])
    kinds = Counter(m["content_type"] for m in members if m["content_type"])
    story["content_type"] = min(kinds, key=lambda k: (-kinds[k], k), default=story["content_type"])
    story["provinces"] = sorted({p for m in members for p in m["article_provinces"]}) or story["provinces"]
    return story


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r[n] for n in names(schema)) for r in rows], schema)


@pytest.mark.parametrize("seed", [1])
def test_sums_from_the_change_equal_a_full_count(spark, seed):
    draw = random.Random(seed)
    articles = {f"u{i}": {"id": i, "url": f"u{i}", "story_id": i % 6, "source_key": draw.choice("abc"), "aggregator": draw.choice((True, False, None)), "published": EPOCH + timedelta(hours=i), "extra": f"e{i}", **plain_record(some_facts(draw))} for i in range(40)}
    stories = {i: {**dict.fromkeys(names(STORY)), "story_id": i, "deaths": 9 if i == 1 else None, "deaths_manual": 8 if i == 2 else None, "casualties_locked": i == 3} for i in range(7)}
    stored, sums, held = frame(spark, articles.values(), ARTICLE), frame(spark, stories.values(), STORY), facts.evidence(frame(spark, articles.values(), ARTICLE))
    for _ in range(2):
        updates = [(f"u{draw.randint(0, 44)}", place, json.dumps(some_facts(draw))) for place in range(25)] + [(None, 90, "{}"), ("u1", 91, "{broken"), ("u1", 92, None), ("u1", 93, "[1]")]
        got = facts.upserted(stored, sums, held, spark.createDataFrame(updates, "url string, place long, facts string").withColumn("extra", F.lit("clash")))
        touched = set()
        for url, _, text in updates[:25]:
            if url in articles:
                articles[url] |= plain_record(json.loads(text))
                touched.add(articles[url]["story_id"])
        for i in touched:
            stories[i] = plain_sums(stories[i], [a for a in articles.values() if a["story_id"] == i])
        held = got.evidence
        stored = stored.join(got.articles.select("url"), "url", "left_anti").select(*names(ARTICLE)).unionByName(got.articles)
        sums = sums.join(got.stories.select("story_id"), "story_id", "left_anti").select(*names(STORY)).unionByName(got.stories)
        key = lambda df: sorted(map(str, df.collect()))
        assert key(stored) == key(frame(spark, articles.values(), ARTICLE)) and key(sums) == key(frame(spark, stories.values(), STORY))
        assert key(held.select(*facts.EVIDENCE, "n")) == key(facts.evidence(frame(spark, articles.values(), ARTICLE)).select(*facts.EVIDENCE, "n"))


def test_empty_tables(spark):
    none = [spark.createDataFrame([], s) for s in (ARTICLE, STORY)]
    got = facts.upserted(*none, facts.evidence(none[0]), spark.createDataFrame([], "url string, place long, facts string"))
    assert [df.count() for df in got] == [0, 0, 0]


def test_rows_that_repeat_are_dealt_by_number(spark):
    """10,000 equal rows are a tiny file, which Spark would give to one task."""
    from newsgraph import tables

    same = tables.materialize(spark.range(10_000).selectExpr("'u' AS url", "1 AS n").coalesce(1), "same")
    assert tables.by_rows(same, 1000).rdd.getNumPartitions() == 10 and tables.by_rows(same, 1000, "url").rdd.getNumPartitions() == 10
    assert tables.by_rows(same, 20_000).rdd.getNumPartitions() == 1 and tables.by_rows(same, 1000).count() == 10_000
