"""Operators on small fixtures: classifier cases, text functions, agreements, rollup ties, clustering, feeds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsgraph.functions import text as X
from newsgraph.lexicon import THAI
from newsgraph.operators import cluster, match, rollup, rows, similarity, views
from newsgraph.operators.classify import classify
from newsgraph.operators import components
from newsgraph.operators.components import connected_components
from newsgraph.sources import feeds
from newsgraph.streaming.ingest import ingest, stream_items, swept

UTC = dt.timezone.utc


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return df.select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("title", "source", "confidence"),
    [
        ("หนุ่มเมาแล้วขับ ซิ่งกระบะชนดับ 2 ราย", "", "high"),
        ("ตรวจวัดแอลกอฮอล์ 250 มก.% หลังชนคนข้ามถนน", "", "high"),
        ("ตั้งด่านตรวจแอลกอฮอล์ รวบเมาแล้วขับ 120 ราย", "", "high"),
        ("รณรงค์เมาไม่ขับ ช่วงเทศกาล ตำรวจตั้งจุดตรวจ", "", "medium"),
        ("ขึ้นภาษีสุราและเบียร์ มีผล 1 ม.ค.", "", "none"),
        ("เจลแอลกอฮอล์ล้างมือ ขาดตลาด", "", "none"),
        ("น้ำท่วมสุราษฎร์ธานี ถนนขาด 3 จุด", "", "none"),
        ("เมาแล้วขับ มีโทษอย่างไร เปิดอัตราโทษล่าสุด", "", "medium"),
        ("เมาแล้วขับชนดับ 2 ราย", "facebook.com", "medium"),
        ("เมาแล้วขับชนดับ 2 ราย", "vietnam.vn", "none"),
        (None, None, "none"),
    ],
)
def test_classifier(spark, title, source, confidence):
    row = classify(spark.createDataFrame([(title, "", source)], "title string, summary string, source string"), THAI).first()
    assert (row["passed"], row["confidence"]) == (confidence != "none", confidence)


def test_digits(spark):
    cases = {"๐๑๒๓๔๕๖๗๘๙": "0123456789", "1,234,567": "1234567", "2,5": "2,5", "ดับ 1,2 และ 3 ราย": "ดับ 1,2 และ 3 ราย", "๑,๒๓๔ ราย": "1234 ราย"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.ascii_digits(F.col("t")).alias("y")).collect()
    assert {r["t"]: r["y"] for r in got} == cases


def test_text_functions(spark):
    assert one(spark, X.ages(F.lit("ชาย ๓๕ ปี และ 14 ปี 200 ปี 14 ปี"))) == [35, 14]
    assert one(spark, X.is_cut_short(F.lit("word ... "))) and not one(spark, X.is_cut_short(F.lit("word")))
    assert one(spark, X.strip_html(F.lit("<script>x</script>a&nbsp;b&amp;c&#39;d &zzz;<b>e</b>"), 100)) == "a b&c'd &zzz; e"
    assert one(spark, X.unwrapped_link(F.lit("http://www.bing.com/news?url=https%3a%2f%2fa.example%2fx&y=1"))) == "https://a.example/x"
    assert round(one(spark, X.dice(F.lit("night"), F.lit("nacht night"))), 4) == round(2 * 4 / (4 + 10), 4)
    assert one(spark, X.dice(F.lit("a"), F.lit("abc"))) == 0


def test_article_bodies(spark):
    long = "word " * 60
    ld = '<script type="application/ld+json">{"@type":"NewsArticle","articleBody":"' + long + '"}</script><meta property="og:description" content="short">'
    paras = f"<article><p>{long}</p><figure><p>caption 99 caption 99 caption 99 caption 99 caption 99</p></figure><p>tiny</p></article>"
    og = f'<meta content="{long}" property="og:description">'
    got = spark.createDataFrame([(1, ld), (2, paras), (3, og), (4, "<p>x</p>"), (5, None)], "id int, h string").select("id", X.article_body(F.col("h"), 2500).alias("b")).collect()
    assert {r["id"]: r["b"] and r["b"]["via"] for r in got} == {1: "jsonld", 2: "paragraphs", 3: "og", 4: None, 5: None}
    assert "99" not in next(r["b"]["text"] for r in got if r["id"] == 2)


def test_agreements(spark):
    n = lambda v: F.lit(v).cast("int")
    assert [one(spark, match.count_agreement(n(a), n(b))) for a, b in [(1, 1), (1, 2), (None, 2), (0, None)]] == ["agree", "conflict", "unknown", "unknown"]
    empty = F.array().cast("array<string>")
    assert one(spark, match.region_agreement(empty, F.array(F.lit("a")))) == "unknown"


@pytest.mark.parametrize(
    ("similarity", "vehicles", "score", "rare", "regions", "deaths", "days", "expected"),
    [
        (1.0, True, 9.0, 3, "conflict", "agree", 0.0, False),
        (0.957, True, 0.0, 0, "agree", "conflict", 0.25, True),
        (0.957, True, 0.0, 0, "agree", "conflict", 3.0, False),
        (0.9, False, 0.0, 0, "agree", "conflict", 0.1, False),
        (0.349, False, 3.0, 1, "agree", "unknown", 0.0, False),
        (0.2, False, 4.0, 1, "agree", "unknown", 0.0, True),
        (0.725, False, 2.0, 1, "agree", "unknown", 0.0, True),
        (0.545, False, 5.0, 1, "agree", "unknown", 10.0, True),
        (0.578, True, 1.0, 0, "agree", "unknown", 10.0, False),
        (0.776, True, 0.0, 0, "unknown", "unknown", 0.0, False),
        (0.6, True, 0.0, 0, "agree", "unknown", 3.0, True),
    ],
)
def test_same_event(spark, similarity, vehicles, score, rare, regions, deaths, days, expected):
    overlap = F.struct(F.lit(score).alias("score"), F.lit(rare).alias("rare"))
    decision = match.same_event(F.lit(similarity), F.lit(vehicles), overlap, F.lit(regions), F.lit(deaths), F.lit("unknown"), F.lit(deaths == "agree"), F.lit(days))
    assert one(spark, decision) is expected


ARTICLE = "story_id long, deaths int, confidence float, source_key string, aggregator boolean, published timestamp, scope string, content_type string, extract_confidence string"


@pytest.mark.parametrize(
    ("articles", "expected"),
    [
        ([(2, 0.9, "a", False, 1), (3, 0.7, "b", False, 2), (3, 0.7, "c", False, 3)], 2),
        ([(2, 0.9, "a", False, 1), (3, 0.9, "b", False, 1), (3, 0.5, "c", False, 1)], 3),
        ([(2, 0.9, "a", False, 5), (3, 0.9, "b", False, 1)], 2),
        ([(2, None, "a", False, 9), (3, 0.1, "b", False, 1)], 3),
        ([(2, 0.9, "a", True, 1), (3, 0.1, "b", False, 1)], 3),
        ([(2, 0.9, "a", True, 1), (3, 0.1, "b", True, 1)], 2),
        ([(2, 0.9, "a", False, 1), (3, 0.9, "b", False, 1)], 3),
        ([(None, 0.9, "a", False, 1), (0, 0.1, "b", False, 1)], 0),
    ],
)
def test_best_value(spark, articles, expected):
    day = lambda d: dt.datetime(2026, 1, d, tzinfo=UTC)
    df = spark.createDataFrame([(1, v, c, k, agg, day(d), "incident", None, None) for v, c, k, agg, d in articles], ARTICLE)
    shut_out = spark.createDataFrame([(1, 99, 1.0, "z", False, day(9), "aggregate", None, None), (1, 98, 1.0, "z", False, day(9), "incident", "campaign", None), (1, 97, 1.0, "z", False, day(9), "incident", None, "low")], ARTICLE)
    assert rollup.best_value(rollup.eligible(df.unionByName(shut_out)), "deaths", "confidence").first()["deaths"] == expected


def test_precedence(spark):
    n = lambda v: F.lit(v).cast("int")
    cases = [(True, 5, 6, 1, 1), (False, 5, 6, 1, 5), (False, None, 6, 1, 6), (False, None, None, 1, 1), (None, None, 0, 1, 0)]
    assert [one(spark, rollup.precedence(F.lit(k).cast("boolean"), n(m), n(d), n(e))) for k, m, d, e, _ in cases] == [c[-1] for c in cases]


def test_totals(spark):
    def of(stories):
        df = spark.createDataFrame(stories, "deaths int, injuries int, content_type string")
        return tuple(views.totals(df, F.col("deaths"), F.col("injuries"), views.is_roundup(F.col("content_type"))).first())

    assert of([(2, 1, None), (None, None, None), (3, None, None)]) == (5, 1, 2, 1, 0)
    assert of([(2, 1, None), (264, 1200, "statistics_roundup")]) == (2, 1, 1, 0, 1)
    assert of([]) == (0, 0, 0, 0, 0)
    n = lambda v: F.lit(v).cast("int")
    states = {(None, None): "unknown", (0, 0): "none", (0, None): "none", (None, 0): "none", (2, 5): "fatal", (0, 5): "injury", (None, 3): "injury"}
    assert {k: one(spark, views.casualty_state(n(k[0]), n(k[1]))) for k in states} == states


def test_clusters_equal_one_greedy_pass(spark):
    draw = random.Random(2)
    for size, edges in ((1, 0), (3, 2), (40, 45), (60, 40)):
        nodes = [(i, dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(hours=draw.randint(0, 50))) for i in range(size)]
        links = [(draw.randrange(size), draw.randrange(size)) for _ in range(edges)] if size != 3 else [(0, 2), (1, 2)]
        by = {i: {b for a, b in links if a == i} | {a for a, b in links if b == i} for i in range(size)}
        plain = cluster.greedy([i for i, _ in sorted(nodes, key=lambda n: (n[1], n[0]))], by)
        got = cluster.greedy_clusters(spark.createDataFrame(nodes, "id long, published timestamp"), spark.createDataFrame(links, "a long, b long"))
        assert {r["id"]: r["cluster"] for r in got.collect()} == plain


def test_components(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 20)
    edges = [(7, i) for i in range(8, 300)] + [(300 + i, 301 + i) for i in range(30)] + [(500, 7), (1000, 1001)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 7 for i in [*range(7, 300), 500]}, **{i: 300 for i in range(300, 331)}, 1000: 1000, 1001: 1000}


def test_following_over_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        given = [("hot" if i % 3 else None if i % 2 else "b", (i * 37) % 401) for i in range(401)] + [("one", 1000)]
        got = {(r["k"], r["n"]): r["following"] for r in rows.following(spark.createDataFrame(given, "k string, n long"), "k", "n").collect()}
        by = {}
        for k, n in given:
            by.setdefault(k, []).append(n)
        assert got == {(k, n): m for k, ns in by.items() for n, m in zip(sorted(ns), [*sorted(ns)[1:], None], strict=True)}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_feeds(spark, tmp_path):
    item = "<item><title>{}</title><link>{}</link><pubDate>{}</pubDate><description>&lt;b&gt;text&lt;/b&gt; here</description><source url='u'>{}</source></item>"
    body = "".join(item.format(*x) for x in [("One - Daily", "http://a.example/1", "Wed, 12 Aug 2026 10:00:00 GMT", "Daily"), ("Two - Other", "http://a.example/2", "bad date", "Daily"), ("One again", "http://a.example/1", "Tue, 11 Aug 2026 10:00:00 +0700", "Daily")])
    (tmp_path / "feed.xml").write_text(f"<rss><channel>{body}</channel></rss>")
    raw = feeds.read_rss(spark, str(tmp_path))
    items = feeds.search_items(raw, F.col("source._VALUE"), suffixed=True)
    assert {r["title"] for r in items.collect()} == {"One", "Two - Other", "One again"}
    merged = feeds.united(items, feeds.direct_items(raw))
    assert merged.count() == 2 and merged.filter("link = 'http://a.example/1'").first()["published"].isoformat() == "2026-08-12T10:00:00"
    now = F.to_timestamp(F.lit("2026-08-20 00:00:00"))
    assert [r["title"] for r in feeds.recent(merged, now, 45).collect()] == ["One"]
    (tmp_path / "gold.jsonl").write_text('{"id": "a", "split": "dev"}\n{"id": "b"}\n')
    assert [r["id"] for r in feeds.read_gold(spark, str(tmp_path / "gold.jsonl"), "test").collect()] == ["b"]


def test_stream_is_idempotent(spark, tmp_path):
    rows_ = spark.createDataFrame([(i % 6, dt.datetime(2026, 1, 1 + i % 3)) for i in range(12)] + [(None, dt.datetime(2026, 1, 1))], "id long, ts timestamp_ntz")
    landed, target, checkpoint = (str(tmp_path / n) for n in ("landed", "target", "checkpoint"))
    for _ in range(3):
        rows_.write.mode("append").parquet(landed)
        ingest(stream_items(spark, landed, rows_.schema, "ts"), "id", "ts", "30 days", target, checkpoint).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list(range(6))


def test_sweep_and_samples(spark):
    now = dt.datetime(2026, 1, 1, 12, tzinfo=UTC)
    runs = spark.createDataFrame([(1, now - dt.timedelta(minutes=21), None, "running"), (2, now - dt.timedelta(minutes=20), None, "running"), (3, now - dt.timedelta(days=1), now, "ok")], "id int, started_at timestamp, finished_at timestamp, status string")
    assert {r["id"]: r["status"] for r in swept(runs, F.lit(now)).collect()} == {1: "timeout", 2: "running", 3: "ok"}
    n = spark.range(103)
    assert [r["id"] for r in rows.systematic_sample(n, 10, F.col("id")).orderBy("id").collect()] == list(range(0, 100, 10))
    assert rows.systematic_sample(n.limit(0), 10, F.col("id")).count() == 0
