"""Pairs within a window, clusters and attachment in rounds, and the merge of stories, against plain loops."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_ingest_batch import EPOCH, _best, _report, _spark_rows, _typed

from newsgraph.operators import attach, cluster, ingest_batch, match, merge, within
from newsgraph.operators.entities import SAMPLE

DAY = timedelta(days=1)


def test_pairs_share_a_key_within_the_window(spark, monkeypatch):
    monkeypatch.setattr(within, "CELL_ROWS", 5)
    draw = random.Random(3)
    given = [(i if i % 19 else None, EPOCH - 300 * DAY + DAY * draw.choice((draw.randint(0, 60), 14, 28)) if i % 23 else None, [draw.choice("hhhhhabcde") for _ in range(draw.randint(0, 3))] + [None] if i % 11 else None) for i in range(160)]
    got = within.pairs_within(spark.createDataFrame(given, "id long, published timestamp, keys array<string>"), 14)
    ok = [(i, at, {k for k in keys or [] if k}) for i, at, keys in given if i is not None and at is not None]
    expected = {(i, j) for i, a, k in ok for j, b, m in ok if (a, i) < (b, j) and b - a <= 14 * DAY and k & m}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected) > 300
    assert within.pairs_within(spark.createDataFrame([], "id long, published timestamp, keys array<string>"), 14).count() == 0


def test_a_long_component_settles_in_few_rounds(spark):
    draw = random.Random(1)
    n = 30_000
    order = draw.sample(range(n), n)
    nodes = [(i, EPOCH + timedelta(minutes=k)) for k, i in enumerate(order)]
    links = [(order[k], order[max(0, k - draw.randint(1, 30))]) for k in range(1, n)] + [(order[draw.randrange(n)], order[draw.randrange(n)]) for _ in range(200)]
    by = {i: set() for i in range(n)}
    for a, b in links:
        by[a].add(b), by[b].add(a)
    got = {r["id"]: r["cluster"] for r in cluster.greedy_clusters(spark.createDataFrame(nodes, "id long, published timestamp"), spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == cluster.greedy(order, by)


def test_clusters_of_odd_rows(spark):
    nodes = spark.createDataFrame([(1, EPOCH), (2, None), (3, EPOCH), (4, None)], "id long, published timestamp")
    edges = spark.createDataFrame([(2, 1), (1, 2), (2, 1), (3, 3), (4, 2), (9, 1), (None, 1)], "a long, b long")
    assert {r["id"]: r["cluster"] for r in cluster.greedy_clusters(nodes, edges).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert cluster.greedy_clusters(nodes.limit(0), edges).count() == 0


@pytest.mark.parametrize("extra", [0, 300])
def test_a_chain_of_waiting_reports(spark, extra):
    draw = random.Random(extra)
    n = 2000
    matches = [(i, i - 1, False, 1) for i in range(1, n)] + [(i, draw.randrange(i), False, 2) for i in draw.sample(range(3, n), extra)]
    matches = list({(a, b): (a, b, s, r) for a, b, s, r in reversed(matches)}.values())
    story, new = {}, {}
    near = {}
    for a, b, _, rank in sorted(matches, key=lambda m: m[3]):
        near.setdefault(a, []).append(b)
    for i in range(n):
        own = [b for b in near.get(i, []) if new[b]]
        story[i], new[i] = (own[0], False) if own else (i, True)
    got = attach.attached(spark.range(n).select("id", F.col("id").alias("place")), spark.createDataFrame(matches, "left_id long, right_id long, stored boolean, rank int")).collect()
    assert {r["id"]: (r["story"], r["is_new"]) for r in got} == {i: (story[i], new[i]) for i in range(n)}


def test_merge_equals_a_plain_loop(spark):
    draw = random.Random(11)
    titles = [f"{a} {b} car {c}" for a in ("red", "blue") for b in ("widget", "gizmo") for c in ("one", "two", "one two")]
    stories = [
        {"story_id": i, "display_title": draw.choice(titles), "norm_title": None, "first_published": EPOCH + DAY * draw.randint(0, 30), "last_published": EPOCH + DAY * draw.randint(30, 50), "source_count": 1, "max_confidence": "medium",
         "deaths": draw.choice((None, 1)), "injuries": None, "deaths_manual": 8 if i == 4 else None, "injuries_manual": None, "casualties_locked": i == 5} for i in range(40)
    ]
    articles = [{**_report(draw, 0), "id": 100 + i, "story_id": draw.randrange(45), "url": f"u{i}", "title_key": f"t{draw.randint(0, 12)}" if i % 9 else None} for i in range(150)]
    before, stored = _typed(spark, stories, ingest_batch.STORY), _typed(spark, articles, ingest_batch.ARTICLE)
    got = merge.merged(before, stored, SAMPLE)

    features = {r["id"]: r for r in merge.as_reports(before, SAMPLE).collect()}
    pairs = spark.createDataFrame([(a, b) for a in features for b in features if a < b], "left_id long, right_id long")
    same = {(r["left_id"], r["right_id"]) for r in match.matching(pairs, merge.as_reports(before, SAMPLE), merge.as_reports(before, SAMPLE)).collect()}
    near = lambda a, b: (min(a, b), max(a, b)) in same and abs(features[a]["published"] - features[b]["published"]) <= 14 * DAY
    clusters = []
    for i in sorted(features, key=lambda i: (features[i]["first_published"], i)):
        hit = next((c for c in clusters if any(near(m, i) for m in c)), None)
        hit.append(i) if hit else clusters.append([i])
    parent = {i: c[0] for c in clusters for i in c}
    assert {(r["parent"], r["id"], r["size"]) for r in got.groups.collect()} == {(c[0], i, len(c)) for c in clusters if len(c) > 1 for i in c} != set()

    held = {(a["story_id"], a["title_key"]) for a in articles}
    kept, dropped = [], set()
    for a in sorted(articles, key=lambda a: a["id"]):
        to = parent.get(a["story_id"], a["story_id"])
        if to != a["story_id"] and a["title_key"] is not None and (to, a["title_key"]) in held:
            dropped.add(a["id"])
            continue
        if to != a["story_id"]:
            held.add((to, a["title_key"]))
        kept.append({**a, "story_id": to})
    assert {r["id"] for r in got.dropped.collect()} == dropped != set()
    assert _spark_rows(got.articles) == _spark_rows(_typed(spark, kept, ingest_batch.ARTICLE))
    expected = []
    for s in stories:
        if parent[s["story_id"]] != s["story_id"]:
            continue
        if sum(p == s["story_id"] for p in parent.values()) > 1:
            own = [a for a in kept if a["story_id"] == s["story_id"]]
            times = [a["published"] for a in own]
            s = {**s, "first_published": min(times, default=s["first_published"]), "last_published": max(times, default=s["last_published"]), "source_count": max(1, len({a["source_key"] for a in own if not a["aggregator"]})), "max_confidence": "high" if any(a["confidence"] == "high" for a in own) else "medium"}
            if not s["casualties_locked"]:
                for count in ("deaths", "injuries"):
                    s[count] = next((v for v in (s[f"{count}_manual"], _best(own, count), s[count]) if v is not None), None)
        expected.append(s)
    assert _spark_rows(got.stories) == _spark_rows(_typed(spark, expected, ingest_batch.STORY))


def test_merge_of_nothing(spark):
    got = merge.merged(spark.createDataFrame([], ingest_batch.STORY), spark.createDataFrame([], ingest_batch.ARTICLE))
    assert [df.count() for df in got] == [0, 0, 0, 0]
