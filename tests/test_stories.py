"""Attaching reports, linked-data bodies, references, outlets and stored extractions on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from newsgraph.functions import text as X
from newsgraph.functions.json_ld import body_of
from newsgraph.operators import attach, enrich, rollup, rows
from newsgraph.sources import outlets


def one(spark, *values):
    return spark.range(1).select(*(v.alias(f"c{i}") for i, v in enumerate(values))).first()


@pytest.mark.parametrize("seed", range(3))
def test_attached_equals_a_plain_loop(spark, seed):
    draw = random.Random(seed)
    reports = [(i, (i * 7) % 31) for i in range(31)]
    place = dict(reports)
    matches = [(a, b, b >= 100, rank) for a in place for rank, b in enumerate(draw.sample([*place, 100, 101], draw.randint(0, 4)))]
    story, new = {}, {}
    for i in sorted(place, key=place.get):
        own = [b for a, b, stored, _ in sorted(matches, key=lambda m: m[3]) if a == i and (stored or (place[b] < place[i] and new[b]))]
        story[i], new[i] = (own[0], False) if own else (i, True)
    got = attach.attached(spark.createDataFrame(reports, "id long, place long"), spark.createDataFrame(matches, "left_id long, right_id long, stored boolean, rank int")).collect()
    assert {r["id"]: (r["story"], r["is_new"]) for r in got} == {i: (story[i], new[i]) for i in place}


def test_linked_data_bodies(spark):
    article = lambda **more: {"@type": "NewsArticle", **more}
    nested = article(articleBody="deep")
    for _ in range(3):
        nested = {"@graph": [nested]}
    assert body_of(json.dumps(nested)) == "deep" and body_of(json.dumps({"@graph": [nested]})) is None
    assert body_of(json.dumps([{"@type": "WebSite", "description": "no"}, article(articleBody=" ", description="short")])) == "short"
    assert body_of(json.dumps({"@type": ["Thing", "Article"], "articleBody": "own", "mainEntity": article(articleBody="other")})) == "own"
    assert body_of("{broken") is None and body_of("3") is None
    html = f"<script type='application/ld+json'>{{broken</script><script type='application/ld+json'>{json.dumps(article(articleBody='word ' * 40))}</script><p>x</p>"
    assert one(spark, X.article_body(F.lit(html)))["c0"]["via"] == "jsonld"
    assert one(spark, X.article_body(F.lit(None).cast("string")))["c0"] is None


def test_references(spark):
    cases = {"a&#3588;b&#65;": "aคbA", "&#38;lt;": "&lt;", "&amp;#65;": "&#65;", "&LT;&NBSP;x": "< x", "&#38;amp;": "&amp;", "&#9999999;&zzz;&#x41;": "&#9999999;&zzz;&#x41;", "&#128512;": "😀", "&#39;": "'"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.decode_entities(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == cases


def test_outlet_identities(spark):
    cases = {"ข่าวสด": ("khaosod", False), "www.khaosod.co.th": ("khaosod", False), "today.line.me": ("line", True), "bugaboo.tv": ("bugaboo", False), "TNN Thailand": ("tnn", False), "My  Paper-(x)": ("mypaperx", False), "MSN": ("msn", True), " ": ("unknown", False), "ch7.com": ("ch7", False), "co.th": ("co", False)}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", outlets.outlet_identity(F.col("t")).alias("o")).collect()
    assert {r["t"]: tuple(r["o"]) for r in got} == cases
    assert tuple(one(spark, outlets.outlet_identity(F.lit(None).cast("string")))["c0"]) == ("unknown", False)


def test_checked_extractions(spark):
    count = lambda value, basis, quote=None: {"value": value, "basis": basis, "quote": quote}
    none = count(None, "not_mentioned")
    cases = [(count(2, "stated", "ดับ 2"), True), (count(2, "stated", "ดับ 3"), False), (count(2, "stated"), False), (count(2, "implied"), True), (count(2.5, "implied"), False), (count(501, "implied"), False), (count(-1, "implied"), False), (count(0, "not_mentioned"), False), (none, True), (None, False)]
    rows_ = [(i, json.dumps({"deaths": c, "injuries": none, "provinces": ["ตาก", "นอก"], "confidence": "high"})) for i, (c, _) in enumerate(cases)] + [(90, "{broken"), (91, None), (92, json.dumps({"deaths": none, "injuries": none}))]
    df = spark.createDataFrame(rows_, "i long, p string").withColumn("x", enrich.checked_extraction(F.col("p"), F.lit("ชน ดับ 2 ราย")))
    got = {r["i"]: r["x"] for r in df.collect()}
    assert {i: x is not None for i, x in got.items()} == {**{i: ok for i, (_, ok) in enumerate(cases)}, 90: False, 91: False, 92: False}
    assert got[0]["provinces"] == ["ตาก"] and got[0]["vehicles"] == [] and got[0]["deaths"]["value"] == 2
    facts = enrich.article_facts(F.lit("เมาขับ ดับ 3 ราย"), F.lit("ตาก"))
    merged = one(spark, *(enrich.merged_facts(facts, enrich.checked_extraction(F.lit(rows_[0][1]), F.lit("ชน ดับ 2 ราย")), F.lit("{}"), live, "m") for live in (False, True)), facts)
    assert (merged["c0"]["deaths"], merged["c0"]["extractor"], merged["c0"]["extract_confidence"]) == (3, "regex", "high")
    assert (merged["c1"]["deaths"], merged["c1"]["extractor"], round(merged["c1"]["deaths_confidence"], 2)) == (2, "llm", 0.95)
    assert (merged["c2"]["article_provinces"], merged["c2"]["casualty_field"], merged["c2"]["extractor_version"]) == (["ตาก"], "title", 1)


def test_featured_row_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k long, v string")
    assert sorted((r["k"], r["featured"]) for r in rows.with_featured(df, F.col("k")).collect()) == [(1, False), (1, True), (2, False)]


def test_best_value_of_an_outlet_of_unknown_kind(spark):
    df = spark.createDataFrame([(1, 5, 0.9, "a", None)], "story_id long, deaths int, confidence double, source_key string, aggregator boolean").withColumn("published", F.lit("2026-01-01").cast("timestamp"))
    assert rollup.best_value(df, "deaths", "confidence").first()["deaths"] == 5


def test_story_with_articles(spark):
    stories = spark.createDataFrame([(1, "a"), (2, "b")], "story_id long, title string")
    articles = spark.createDataFrame([(10, 1, 5), (11, 1, 3)], "id long, story_id long, published long")
    of = lambda i: [tuple(r) for r in enrich.story_with_articles(stories, articles, i).collect()]
    assert of("1") == [(1, "a", [11, 10])] and of("2") == [(2, "b", [])] and of("9") == [] and of("1; x") == [] and of("") == []
