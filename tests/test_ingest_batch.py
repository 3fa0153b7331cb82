"""A batch into the tables equals the same reports taken one after the other."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsgraph.operators import ingest_batch as B
from newsgraph.operators import rollup

EPOCH = datetime(2026, 1, 1, tzinfo=UTC)


def _report(draw, place):
    return {
        "place": place, "story_id": draw.choice((None, None, 1, 2, 3)), "joins": None, "norm_title": draw.choice((None, *"abcdef")), "title_key": f"t{draw.randint(0, 25)}", "url": f"u{draw.randint(0, 30)}", "title": f"title {place}",
        "source_key": draw.choice("xyz"), "aggregator": draw.choice((True, False, None)), "confidence": draw.choice(("high", "medium")), "published": EPOCH + timedelta(hours=draw.randint(0, 500)),
        "deaths": draw.choice((None, 1, 2)), "injuries": draw.choice((None, 4)), "deaths_confidence": draw.choice((None, 0.5, 0.75)), "injuries_confidence": 0.5,
        "scope": draw.choice(("incident", "aggregate", None)), "content_type": draw.choice((None, "campaign", "legal_explainer", "crash")), "extract_confidence": draw.choice((None, "low")),
    }


def _best(members, count):
    told = [m for m in members if (m["scope"] or "incident") == "incident" and m["content_type"] not in ("campaign", "legal_explainer") and m["extract_confidence"] != "low"]
    primary = [m for m in told if not m["aggregator"]]
    by_value = {}
    for m in primary or told:
        if m[count] is not None:
            by_value.setdefault(m[count], []).append(m)
    sure = lambda m: -1.0 if m[f"{count}_confidence"] is None else m[f"{count}_confidence"]
    rank = lambda v: (max(map(sure, by_value[v])), len({m["source_key"] for m in by_value[v]}), max(m["published"] for m in by_value[v]), v)
    return max(by_value, key=rank, default=None)


def _one_by_one(batch, stories, articles):
    stories, articles, out = {s["story_id"]: dict(s) for s in stories}, [dict(a) for a in articles], {}
    urls, keys, last, last_article = {a["url"] for a in articles}, set(), max(stories, default=0), max((a["id"] for a in articles), default=0)
    first_urls = set()
    for r in sorted(batch, key=lambda r: r["place"]):
        if r["url"] in first_urls or r["url"] is None or r["title_key"] is None:
            continue
        first_urls.add(r["url"])
        if r["title_key"] in keys:
            continue
        keys.add(r["title_key"])
        if r["url"] in urls:
            continue
        story = r["story_id"]
        if story is None and r["norm_title"] is not None:
            story = min((i for i, s in stories.items() if s["norm_title"] == r["norm_title"]), default=None)
        if story is None:
            story = last + 1 + r["place"]
            stories[story] = {"story_id": story, "display_title": r["title"], "norm_title": r["norm_title"], "first_published": None, "last_published": None, "source_count": 0, "max_confidence": None, "deaths": r["deaths"], "injuries": r["injuries"], "deaths_manual": None, "injuries_manual": None, "casualties_locked": False}
        if any(a["story_id"] == story and a["title_key"] == r["title_key"] for a in articles):
            owner = min(a["id"] for a in articles if a["title_key"] == r["title_key"])
            out[r["place"]] = (next(a["story_id"] for a in articles if a["id"] == owner), False, False)
            continue
        articles.append({**r, "id": last_article + 1 + r["place"], "story_id": story})
        out[r["place"]] = (story, True, r["story_id"] is not None)
        s, members = stories[story], [a for a in articles if a["story_id"] == story]
        s["first_published"] = min(filter(None, (s["first_published"], r["published"])))
        s["last_published"] = max(filter(None, (s["last_published"], r["published"])))
        s["source_count"] = max(1, len({a["source_key"] for a in members if not a["aggregator"]}))
        s["max_confidence"] = "high" if "high" in (s["max_confidence"], r["confidence"]) else "medium"
        if not s["casualties_locked"]:
            for count in ("deaths", "injuries"):
                told = [s[f"{count}_manual"], _best(members, count), s[count]]
                s[count] = next((v for v in told if v is not None), None)
    return out, articles, stories


def _typed(spark, rows, schema):
    return spark.createDataFrame([tuple(r[n] for n in B.names(schema)) for r in rows], schema)


def _spark_rows(df):
    times = [F.unix_micros(c).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]
    return sorted((tuple(r) for r in df.select(*times).collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_batch_equals_one_by_one(spark, seed):
    draw = random.Random(seed)
    story = lambda i, n, **more: {"story_id": i, "display_title": f"s{i}", "norm_title": n, "first_published": EPOCH, "last_published": EPOCH, "source_count": 1, "max_confidence": "medium", "deaths": 7, "injuries": None, "deaths_manual": None, "injuries_manual": None, "casualties_locked": False, **more}
    stories = [story(1, "a"), story(2, "a", casualties_locked=True), story(3, "b", deaths_manual=9), story(4, None)]
    articles = [{**_report(draw, 0), "id": 100 + i, "story_id": 1 + i % 4, "url": f"u{60 + i if i % 8 else i}", "title_key": f"t{i % 13}", "aggregator": i % 4 > 0} for i in range(40)]
    batch = [_report(draw, p) for p in range(60)] + [{**_report(draw, 60), "url": None}, {**_report(draw, 61), "title_key": None}]
    out, kept, expected = _one_by_one(batch, stories, articles)
    before, stored = _typed(spark, stories, B.STORY), _typed(spark, articles, B.ARTICLE)
    got = B.ingest(_typed(spark, batch, B.REPORT).withColumn("extra", F.lit(1)), before, stored)
    assert {r["place"]: (r["story_id"], r["inserted"], r["matched"]) for r in got.outcomes.collect()} == out
    assert any(not inserted for _, inserted, _ in out.values()) and any(i for _, i, m in out.values() if not m)
    assert _spark_rows(stored.unionByName(got.articles)) == _spark_rows(_typed(spark, kept, B.ARTICLE))
    assert _spark_rows(B.with_changes(before, got.stories)) == _spark_rows(_typed(spark, expected.values(), B.STORY))
    count = B.tally(got.outcomes).first()
    assert (count["new_stories"], count["merged"], count["skipped"]) == tuple(sum(1 for _, i, m in out.values() if (i, m) == want) for want in ((True, False), (True, True), (False, False)))


def test_reports_that_join_another_one(spark):
    base = {**_report(random.Random(1), 0), "story_id": None}
    batch = [{**base, "place": p, "url": f"u{p}", "title_key": f"t{p}", "norm_title": f"n{p}", "joins": j} for p, j in enumerate((None, 0, 1, 0, 77))]
    got = B.ingest(_typed(spark, batch, B.REPORT), spark.createDataFrame([], B.STORY), spark.createDataFrame([], B.ARTICLE))
    assert {r["place"]: (r["story_id"], r["matched"]) for r in got.outcomes.collect()} == {0: (1, False), 1: (1, True), 2: (3, False), 3: (1, True), 4: (5, False)}
    assert got.stories.count() == 3


def test_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (B.REPORT, B.STORY, B.ARTICLE)]
    got = B.ingest(*empty)
    assert [d.count() for d in got] == [0, 0, 0] and B.tally(got.outcomes).first()["skipped"] == 0
    one = _typed(spark, [{**_report(random.Random(1), 5), "story_id": None, "norm_title": None}], B.REPORT)
    got = B.ingest(one, *empty[1:])
    assert [r["story_id"] for r in got.stories.collect()] == [6] and got.articles.first()["id"] == 6


def test_an_aggregators_count_stays_when_a_primary_outlet_without_one_follows(spark):
    base = {**_report(random.Random(1), 0), "story_id": None, "norm_title": "n", "scope": None, "content_type": None, "extract_confidence": None, "deaths_confidence": 0.5}
    batch = [{**base, "place": p, "url": f"u{p}", "title_key": f"t{p}", "aggregator": p < 2, "deaths": d} for p, d in enumerate((None, 2, None))]
    got = B.ingest(_typed(spark, batch, B.REPORT), spark.createDataFrame([], B.STORY), spark.createDataFrame([], B.ARTICLE))
    assert [r["deaths"] for r in got.stories.collect()] == [2] == [s["deaths"] for s in _one_by_one(batch, [], [])[2].values()]


def test_primary_outlets_without_a_value_silence_aggregators(spark):
    rows = [(1, None, 0.0, "a", False, "regex"), (1, 3, 0.9, "b", True, "regex"), (2, 3, 0.9, "b", True, "llm")]
    df = spark.createDataFrame(rows, "story_id long, deaths int, confidence double, source_key string, aggregator boolean, extractor string").withColumn("published", F.lit("2026-01-01").cast("timestamp"))
    assert [tuple(r) for r in rollup.best_value(df, "deaths", "confidence").collect()] == [(2, 3, 0.9, 1, "llm")]
