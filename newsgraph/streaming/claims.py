"""One writer at a time over a folder, by files that are made once and never changed.

A run claims the next number by making ``start-<number>.json`` and is over with ``end-<number>.json``. Both
appear whole or not at all, and of several that make the same file one succeeds. So of two runs that start
together one holds the number; and a run that was given up for dead is ended by the one that takes over,
after which it can't commit any more, however late it comes. Readers trust numbers that ended ``ok``.

On a local or mounted file system a hard link makes the file, elsewhere a rename that doesn't overwrite,
which the file system has to keep atomic (HDFS does; object stores only with conditional writes).
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from newsgraph.tables import exists

RECORD = "batch long, delivery string, status string, at timestamp, fetched long, passed long, new_stories long, merged long, skipped long, whole boolean, detail string"


class RunInProgress(RuntimeError):
    """Another run holds the folder."""


class Fenced(RuntimeError):
    """The run was given up and another one has taken over; nothing of it counts."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file with this content; False where it is there already."""
    jvm, at, files = _hadoop(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".draft-{uuid.uuid4().hex}")
    files.mkdirs(at.getParent())
    if files.getScheme() == "file":
        name, own = at.toUri().getPath(), draft.toUri().getPath()
        with open(own, "x", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(own, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    out = files.create(draft, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not files.exists(at) and files.rename(draft, at):
        return True
    files.delete(draft, False)
    return False


def _record(batch: int, delivery: str, status: str, **more) -> str:
    return json.dumps({"batch": batch, "delivery": delivery, "status": status, "at": datetime.now(UTC).isoformat(), **more})


def _read(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    if not exists(spark, folder):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).option("pathGlobFilter", f"{kind}-*.json").json(folder)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """``batch, delivery, status, started_at, finished_at, …`` of all runs; one that has no end is running."""
    starts = _read(spark, folder, "start").selectExpr("batch", "delivery", "at AS started_at")
    ends = _read(spark, folder, "end").drop("delivery").withColumnRenamed("at", "finished_at")
    return starts.join(ends, "batch", "left").na.fill({"status": "running"})


def begin(spark: SparkSession, folder: str, delivery: str, stale_minutes: float) -> int:
    """Claim the next number; RunInProgress where another run holds the folder and isn't older than so many minutes."""
    last = runs(spark, folder).orderBy("batch", ascending=False).selectExpr("batch", "delivery", "status", "unix_micros(started_at) AS started").first()  # one row
    number = 0
    if last is not None:
        number = last["batch"] + 1
        if last["status"] == "running":
            if datetime.now(UTC).timestamp() - last["started"] / 1e6 <= stale_minutes * 60:
                raise RunInProgress(folder)
            end(spark, folder, last["batch"], last["delivery"], "timeout", fenced_ok=True)
    if not put_once(spark, f"{folder}/start-{number:09d}.json", _record(number, delivery, "running")):
        raise RunInProgress(folder)
    return number


def end(spark: SparkSession, folder: str, batch: int, delivery: str, status: str, fenced_ok: bool = False, **more) -> None:
    """End the run; Fenced where another one has ended it."""
    if not put_once(spark, f"{folder}/end-{batch:09d}.json", _record(batch, delivery, status, **more)) and not fenced_ok:
        raise Fenced(f"run {batch} of {folder}")
