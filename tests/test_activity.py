"""Spans of activity of a stream: restarts, late reports and a lost checkpoint."""

from datetime import UTC, datetime, timedelta

from newsgraph.streaming import ingest

DAY = datetime(2026, 1, 1, tzinfo=UTC)
SCHEMA = "story_id long, published timestamp"


def test_spans_of_a_stream(spark, tmp_path):
    landed, target = f"{tmp_path}/landed", f"{tmp_path}/spans"

    def land(*rows):
        spark.createDataFrame([(s, None if d is None else DAY + timedelta(days=d)) for s, d in rows], SCHEMA).coalesce(1).write.mode("append").parquet(landed)

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).parquet(landed)
        ingest.record(ingest.activity(stream, "14 days", "1 day"), target, f"{tmp_path}/{checkpoint}").awaitTermination()
        return {(r["story_id"], (r["first_published"].replace(tzinfo=UTC) - DAY).days, (r["last_published"].replace(tzinfo=UTC) - DAY).days, r["reports"]) for r in ingest.recorded(spark, target).collect()}

    land((1, 0), (1, 10), (2, 3), (None, 1), (4, None))
    assert run("c1") == set()  # nothing has ended yet
    land((1, 20), (3, 30))  # after a restart: story 1 goes on, story 2 has ended
    assert run("c1") == {(2, 3, 3, 1)}
    land((2, 4), (2, 40), (5, 90))  # one report comes too late
    ended = {(1, 0, 20, 3), (2, 3, 3, 1), (3, 30, 30, 1), (2, 40, 40, 1)}
    assert run("c1") == ended
    got = run("c2")  # a lost checkpoint: all reports come at once, in time; what ended before is not there twice
    assert {s for s in got if s[0] != 2} == {s for s in ended if s[0] != 2} and len({s[:2] for s in got}) == len(got)
