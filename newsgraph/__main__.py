"""Command line: ``python -m newsgraph COMMAND``.

Feeds are landed RSS and Atom files; those of the season lie in ``seasonal`` beneath them and are read
on request. Nothing is written by ``dry-run``, ``status``, ``latest``, ``story`` and ``merge`` without ``--commit``.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.sources import feeds
from newsgraph.streaming import runs
from newsgraph.tables import exists


def items(spark: SparkSession, path: str, seasonal: bool = False, days: int = feeds.MAX_AGE_DAYS) -> DataFrame:
    """Recent items of the landed feeds, the first of each link."""
    folders = [path] + [f"{path}/seasonal"] * (seasonal and exists(spark, f"{path}/seasonal"))
    found = [feeds.direct_items(feeds.usable(feeds.read_feeds(spark, f"{folder}/*.xml"))) for folder in folders]
    return feeds.recent(feeds.united(*found), F.current_timestamp(), days).drop("priority")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="newsgraph", description=__doc__.splitlines()[0])
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *arguments: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=about)
        for a in arguments:
            own.add_argument(a)
        return own

    for name, about, arguments in (("run", "feeds into the state, once", ("feeds", "state")), ("dry-run", "the newest relevant items of the feeds", ("feeds",))):
        own = command(name, about, *arguments)
        own.add_argument("--seasonal", action="store_true", help="also the feeds of the season")
        own.add_argument("--days", type=int, default=feeds.MAX_AGE_DAYS, help="oldest items that count")
    command("status", "runs, and how fresh the state is", "state")
    command("latest", "the latest stories", "state")
    command("story", "one story with its articles", "state", "id")
    command("reprocess", "read again what an older reader read", "state")
    command("compact", "write the tables whole", "state")
    command("merge", "stories that tell of one event", "state").add_argument("--commit", action="store_true", help="fold them")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 where all went well, 1 where another run holds the state."""
    asked = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("newsgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    state = getattr(asked, "state", None)
    try:
        if asked.command == "run":
            runs.run_batch(items(spark, asked.feeds, asked.seasonal, asked.days), state, f"run:{uuid.uuid4().hex}")
        elif asked.command == "dry-run":
            runs.dry_run(items(spark, asked.feeds, asked.seasonal, asked.days)).show(runs.SHOWN, truncate=False)
        elif asked.command == "status":
            read = runs.open_reader(spark, state)
            read.runs.orderBy("batch").show(50, truncate=False)
            read.freshness(F.current_timestamp()).show(truncate=False)
        elif asked.command == "latest":
            runs.open_reader(spark, state).latest().show(truncate=False)
        elif asked.command == "story":
            runs.open_reader(spark, state).story(asked.id).show(truncate=False)
        elif asked.command == "reprocess":
            runs.reprocess(spark, state)
        elif asked.command == "compact":
            runs.compact(spark, state)
        elif asked.command == "merge":
            runs.merge_duplicates(spark, state, asked.commit).orderBy("parent", "id").show(200, truncate=False)
    except (runs.RunInProgress, runs.Fenced) as error:
        print(f"another run holds the state: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
