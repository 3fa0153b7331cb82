"""Reports to stories one after the other, as rounds over tables.

A report joins the best of its matches that is a story: a stored one, or an earlier report that has
founded one; without any it founds its own. So a report with a stored match founds none, and of the
others one founds a story unless one of its earlier matches does. Whether it does is settled in rounds:
a match that is known falls out or decides. A report that waits for one match only says the opposite
of it, so whoever waits for such a report waits for that match instead, with the answer turned round.
That halves a chain of reports that wait for each other in every round. Where all is known, each report
takes its best match.

Edge cases: reports without matches found stories; matches with later reports, with themselves or with
reports that aren't there don't count; no reports give no rows. A round settles the earliest open
report at least, so the rounds end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.tables import drop_table, materialize


def _founders(spark, order: DataFrame, ways: DataFrame) -> DataFrame:
    """``id, founds`` of all reports."""
    stored = ways.filter("stored").select(F.col("left_id").alias("id")).distinct()
    waits = ways.join(stored.withColumnRenamed("id", "left_id"), "left_id", "left_anti").select(F.col("left_id").alias("id"), F.col("right_id").alias("on"), F.lit(False).alias("turned"))
    waits = materialize(waits, "attach-waits")
    at_once = stored.select("id", F.lit(False).alias("founds")).unionByName(order.select("id").join(stored, "id", "left_anti").join(waits.select("id"), "id", "left_anti").select("id", F.lit(True).alias("founds")))
    known = materialize(at_once, "attach-known")
    while not waits.isEmpty():
        # What is known of the matches waited for: a founder decides, one that is none falls out.
        told = waits.join(known.select(F.col("id").alias("on"), "founds"), "on", "left").withColumn("is", F.col("founds") != F.col("turned"))
        state = told.groupBy("id").agg(F.coalesce(F.bool_or("is"), F.lit(False)).alias("any"), F.count_if(F.col("is").isNull()).alias("open"))
        settled = materialize(state.filter("any OR open = 0").select("id", (~F.col("any")).alias("founds")), "attach-settled")
        open_ = told.filter("is IS NULL").join(settled.select("id"), "id", "left_anti").select("id", "on", "turned").distinct()
        open_ = materialize(open_, "attach-open")
        # Who waits for one match only is passed over.
        single = open_.groupBy("id").agg(F.count("*").alias("n"), F.first("on").alias("_far"), F.first("turned").alias("_turn")).filter("n = 1").select(F.col("id").alias("on"), "_far", "_turn")
        passed = open_.join(single, "on", "left").select("id", F.coalesce("_far", "on").alias("on"), F.when(F.col("_far").isNull(), F.col("turned")).otherwise(F.col("turned") == F.col("_turn")).alias("turned"))
        following, now = materialize(passed.distinct(), "attach-waits"), materialize(known.unionByName(settled), "attach-known")
        for gone in (waits, open_, known):
            drop_table(spark, gone)
        waits, known = following, now
    return known


def attached(reports: DataFrame, matches: DataFrame) -> DataFrame:
    """``id, story, is_new`` of reports (id, place: their order, unique).

    ``matches`` holds left_id (a report), right_id (a stored story or a report), stored (which of both)
    and rank (the smaller, the better; unique for a report).
    """
    order = reports.select("id", "place")
    earlier = matches.join(order.select(F.col("id").alias("left_id"), F.col("place").alias("_at")), "left_id")
    earlier = earlier.join(order.select(F.col("id").alias("right_id"), F.col("place").alias("_before")), "right_id", "left")
    ways = materialize(earlier.filter(F.col("stored") | (F.col("_before") < F.col("_at"))).select("left_id", "right_id", "stored", "rank"), "attach-ways")
    known = _founders(reports.sparkSession, order, ways)
    stories = known.filter("founds").select(F.col("id").alias("right_id"), F.lit(True).alias("_story"))
    chosen = ways.join(stories, "right_id", "left").filter(F.col("stored") | F.col("_story"))
    best = chosen.groupBy(F.col("left_id").alias("id")).agg(F.min_by("right_id", "rank").alias("story"))
    return known.join(best, "id", "left").select("id", F.when(F.col("founds"), F.col("id")).otherwise(F.col("story")).alias("story"), F.col("founds").alias("is_new"))
