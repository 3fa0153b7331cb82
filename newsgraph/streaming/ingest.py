"""Micro-batch ingestion: re-delivered items change nothing, late ones are dropped, state is a table.

Edge cases: items without a key are left out, those without a time never count as late; of one key in a
batch the earliest stands; an empty batch writes an empty file at most; a target that isn't there is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsgraph.operators.rows import first_wins
from newsgraph.streaming.claims import put_once
from newsgraph.tables import exists


def stream_items(spark: SparkSession, path: str, schema, time: str) -> DataFrame:
    """Landed parquet files as a stream; the time column becomes an instant in UTC."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def ingest(items: DataFrame, key: str, time: str, horizon: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends each key once to ``target`` and ends when the landed files are through.

    Duplicates within the horizon are dropped by state. A batch that is delivered again after a failure, or
    under a lost checkpoint, adds nothing: the keys that are stored for its times, give or take the
    horizon, are taken out; of the rest of the table the scan skips what the statistics of its files rule out.
    """
    spark = items.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        rows = first_wins(batch.filter(F.col(key).isNotNull()), [key], F.col(time), F.col(key))
        if exists(spark, target):
            ends = batch.agg((F.min(time) - F.expr(f"INTERVAL {horizon}")).alias("a"), (F.max(time) + F.expr(f"INTERVAL {horizon}")).alias("z")).first()
            stored = spark.read.parquet(target).filter(F.col(time).isNull() | F.col(time).between(F.lit(ends["a"]), F.lit(ends["z"]))).select(key)
            rows = rows.join(stored, key, "left_anti").select(*batch.columns)
        rows.write.mode("append").parquet(target)

    unique = items.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])
    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(reports: DataFrame, horizon: str, late: str) -> DataFrame:
    """Spans of activity of the stories of a stream of reports (story_id, published): ``story_id, first_published, last_published, reports``.

    A span goes on as long as each report follows another within the horizon, which lies in the state store
    and moves with every report; it comes out once, when time (the latest report less ``late``) has passed its
    end, and its state goes. Reports without a story or a time are left out, later ones than ``late`` dropped.
    """
    known = reports.filter("story_id IS NOT NULL AND published IS NOT NULL").withWatermark("published", late)
    spans = known.groupBy(F.session_window("published", horizon).alias("_span"), "story_id")
    return spans.agg(F.min("published").alias("first_published"), F.max("published").alias("last_published"), F.count("*").alias("reports")).drop("_span")


def record(spans: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The spans of a stream into ``target``, one folder an epoch, which a repeated epoch writes anew; ends when what has landed is through."""
    spark, name = spans.sparkSession, f"{checkpoint}/newsgraph-delivery/name.txt"
    put_once(spark, name, uuid.uuid4().hex)
    token = spark.read.text(name).first()["value"]
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{target}/delivery={token}/epoch={epoch}")
    return spans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def recorded(spark: SparkSession, target: str) -> DataFrame:
    """The spans recorded so far, each once, also where a lost checkpoint brought them again: of those that begin together the longest."""
    spans = spark.read.parquet(target).groupBy("story_id", "first_published")
    return spans.agg(F.max("last_published").alias("last_published"), F.max_by("reports", F.struct("last_published", "reports")).alias("reports"))


def swept(runs: DataFrame, now, minutes: int = 20) -> DataFrame:
    """Runs that have been going for longer than so many minutes are marked as timed out."""
    stale = (F.col("status") == "running") & (F.unix_micros(now) - F.unix_micros("started_at") > minutes * 60_000_000)
    return runs.withColumn("finished_at", F.when(stale, now).otherwise(F.col("finished_at"))).withColumn("status", F.when(stale, "timeout").otherwise(F.col("status")))
