"""Runs over a folder of state: what a batch adds, what a repeated or broken one doesn't."""

import shutil
import threading
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsgraph.operators import enrich
from newsgraph.streaming import claims, runs

ITEM = "title string, link string, published timestamp, source string, summary string"
DAY = datetime(2026, 1, 5, tzinfo=UTC)


def _items(spark, *rows):
    return spark.createDataFrame([(title, link, DAY + timedelta(hours=hours), source, "") for title, link, hours, source in rows], ITEM)


def test_two_batches(spark, tmp_path):
    state = str(tmp_path / "state")
    first = _items(
        spark, ("หนุ่มเมาแล้วขับชนรถจักรยานยนต์ ดับ 2 ราย ที่เชียงใหม่", "a", 0, "khaosod.co.th"), ("หนุ่มเมาแล้วขับชนรถจักรยานยนต์ ดับ 2 ราย เชียงใหม่", "b", 1, "msn"),
        ("ประกาศผลสอบประจำปี", "c", 1, "x"), ("เมาแล้วขับ ตรวจจับ 1 ราย ที่ตรัง", "d", 2, "ไทยรัฐ"), ("เมาแล้วขับ ตรวจจับ 1 ราย ที่ตรัง", "e", 2, "msn"),
    )
    runs.run_batch(first, state, 0)
    runs.run_batch(first, state, 0)
    run = runs.read_runs(spark, state).first()
    assert (run["status"], run["fetched"], run["passed"], run["new_stories"], run["merged"], run["skipped"]) == ("ok", 5, 3, 2, 1, 0)
    stories = {r["display_title"]: r for r in runs.read_stories(spark, state).collect()}
    crash = next(r for t, r in stories.items() if "เชียงใหม่" in t)
    assert len(stories) == 2 and crash["deaths"] == 2 and crash["source_count"] == 1
    second = _items(spark, ("หนุ่มเมาแล้วขับชนรถจักรยานยนต์ ดับ 2 ราย ที่ เชียงใหม่ ล่าสุด", "f", 20, "มติชน"), ("หนุ่มเมาแล้วขับชนรถจักรยานยนต์ ดับ 2 ราย ที่เชียงใหม่", "a", 0, "khaosod.co.th"))
    runs.run_batch(second, state, 1)
    run = runs.read_runs(spark, state).filter("batch = 1").first()
    assert (run["new_stories"], run["merged"], run["skipped"]) == (0, 1, 1)
    crash = runs.read_stories(spark, state).filter(f"story_id = {crash['story_id']}").first()
    assert crash["source_count"] == 2 and runs.read_articles(spark, state).count() == 4
    # What an older reader read is read again, once; what was compacted reads the same.
    runs.reprocess(spark, state, 99, lambda title, summary: enrich.article_facts(title, summary).withField("deaths", F.when(F.contains(title, F.lit("เชียงใหม่")), 5).cast("long")))
    again = {r["story_id"]: r["deaths"] for r in runs.read_stories(spark, state).collect()}
    assert again[crash["story_id"]] == 5 and {r["extractor_version"] for r in runs.read_facts(spark, state).collect()} == {99}
    before = [sorted(map(str, read(spark, state).collect())) for read in (runs.read_stories, runs.read_articles, runs.read_facts)]
    runs.reprocess(spark, state, 99)
    assert runs.read_runs(spark, state).orderBy("batch", ascending=False).first()["fetched"] == 0
    runs.compact(spark, state)
    for table in ("stories", "articles", "facts"):
        for batch in (0, 1, 2, 3):
            shutil.rmtree(f"{state}/{table}/batch={batch}")
    assert before == [sorted(map(str, read(spark, state).collect())) for read in (runs.read_stories, runs.read_articles, runs.read_facts)]
    # Another run waits for one that is going.
    claims.begin(spark, f"{state}/runs", "x", runs.STALE_MINUTES)
    with pytest.raises(runs.RunInProgress):
        runs.run_batch(first, state, 3)


def test_one_of_two_runs_wins_and_one_that_was_given_up_commits_nothing(spark, tmp_path):
    folder = f"{tmp_path}/runs"
    won, lost = [], []

    def start(name):
        try:
            won.append(claims.begin(spark, folder, name, 20))
        except claims.RunInProgress:
            lost.append(name)

    together = [threading.Thread(target=start, args=(f"d{i}",)) for i in range(6)]
    for t in together:
        t.start()
    for t in together:
        t.join()
    assert won == [0] and len(lost) == 5
    # The first is given up, a second takes over; the first comes late.
    assert claims.begin(spark, folder, "second", 0) == 1
    with pytest.raises(claims.Fenced):
        claims.end(spark, folder, 0, "d", "ok")
    claims.end(spark, folder, 1, "second", "ok", passed=3)
    assert {(r["batch"], r["status"], r["passed"]) for r in claims.runs(spark, folder).collect()} == {(0, "timeout", None), (1, "ok", 3)}


def test_a_stream_goes_on_and_outlives_its_checkpoint(spark, tmp_path):
    state, landed = f"{tmp_path}/state", f"{tmp_path}/landed"

    def land(link, name):
        _items(spark, (f"เมาแล้วขับ ชนดับ 2 ราย {name}", link, 0, "x")).write.mode("append").parquet(landed)

    def stream(checkpoint):
        runs.run_stream(spark.readStream.schema(ITEM).parquet(landed), state, f"{tmp_path}/{checkpoint}").awaitTermination()
        return sorted(r["url"] for r in runs.read_articles(spark, state).collect())

    land("a", "ตรัง")
    assert stream("c1") == ["a"]
    land("b", "เลย")
    assert stream("c1") == ["a", "b"]
    land("c", "น่าน")
    assert stream("c2") == ["a", "b", "c"]  # a lost checkpoint: epochs begin at 0 again


def test_dry_run_writes_nothing(spark, tmp_path):
    shown = runs.dry_run(_items(spark, ("เมาแล้วขับ ชนดับ 2 ราย", "a", 0, "x"), ("ประกาศผลสอบ", "b", 1, "x"), ("เมาแล้วขับ ชนดับ 3 ราย", "c", 2, "x"))).collect()
    assert [(r["link"], r["deaths"]) for r in shown] == [("c", 3), ("a", 2)]
    assert runs.read_runs(spark, str(tmp_path / "none")).isEmpty() and runs.read_stories(spark, str(tmp_path / "none")).isEmpty()
