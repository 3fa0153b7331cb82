"""The command line over landed feeds and a folder of state."""

from datetime import UTC, datetime, timedelta
from email.utils import format_datetime

from newsgraph.__main__ import main
from newsgraph.streaming import runs


def _feed(path, *entries):
    at = datetime.now(UTC) - timedelta(hours=5)
    body = "".join(f"<item><title>{title}</title><link>{link}</link><pubDate>{format_datetime(at + timedelta(minutes=i))}</pubDate></item>" for i, (title, link) in enumerate(entries))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"<rss><channel>{body}</channel></rss>", encoding="utf-8")


def test_commands(spark, tmp_path, capsys):
    landed, state = tmp_path / "feeds", f"{tmp_path}/state"
    crash = "หนุ่มเมาแล้วขับชนรถจักรยานยนต์ ดับ 2 ราย ที่เชียงใหม่"
    _feed(landed / "one.xml", (crash, "https://khaosod.co.th/1"), ("ประกาศผลสอบประจำปี", "https://x.com/2"))
    _feed(landed / "seasonal" / "two.xml", ("เมาแล้วขับ ตรวจจับ 1 ราย ที่ตรัง", "https://matichon.co.th/3"))
    assert main(["dry-run", str(landed), "--seasonal"], spark) == 0
    shown = capsys.readouterr().out
    assert "khaosod" in shown and "matichon" in shown and "x.com/2" not in shown
    assert runs.read_runs(spark, state).isEmpty()
    assert main(["run", str(landed), state], spark) == 0
    assert sorted(r["url"] for r in runs.read_articles(spark, state).collect()) == ["https://khaosod.co.th/1"]
    story = runs.open_reader(spark, state).latest().first()["story_id"]
    for command in (["status", state], ["latest", state], ["story", state, str(story)], ["merge", state]):
        assert main(command, spark) == 0
    said = capsys.readouterr().out
    assert "fresh" in said and "เชียงใหม่" in said
    runs.claims.begin(spark, f"{state}/runs", "other", runs.STALE_MINUTES)
    assert main(["run", str(landed), state], spark) == 1
