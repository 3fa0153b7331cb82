"""Row-level steps of ingestion: first wins, new rows only, owners of rejected rows, samples and pages.

Edge cases: empty tables give no rows; repeated rows are rows of their own; ties are settled by the
keys named, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.tables import by_shuffle, materialize


def first_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order; a null key is a key."""
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_place = 1").drop("_place")


def new_rows(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key is not stored; rows without a key are never new."""
    return batch.filter(F.col(key).isNotNull()).join(stored.select(key), key, "left_anti")


def owners(rejected: DataFrame, stored: DataFrame) -> DataFrame:
    """Story of each rejected row: of the stored row with its url, else of the oldest one with its title key."""
    by_url = stored.groupBy("url").agg(F.min_by("story_id", "id").alias("_by_url"))
    by_title = stored.groupBy("title_key").agg(F.min_by("story_id", "id").alias("_by_title"))
    found = rejected.join(by_url, "url", "left").join(by_title, "title_key", "left")
    return found.withColumn("owner", F.coalesce("_by_url", "_by_title")).drop("_by_url", "_by_title")


def systematic_sample(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """Every n-th row of a total order, n chosen so that ``size`` rows come out.

    Places come from counts of ranges of the order, so no task sees more than its own range. The ranges
    are written once: dealt a second time, their bounds could differ from those that were counted.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).toLocalIterator())
    step = max(1, sum(n for _, n in counts) // size)
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long") if starts else df.sparkSession.createDataFrame([], "_part int, _start long")
    placed = ranged.join(offsets, "_part").withColumn("_place", F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return placed.filter((F.col("_place") % step == 0) & (F.col("_place") < step * size)).drop("_part", "_start", "_place")


def following(df: DataFrame, key: str, order: str, name: str = "following") -> DataFrame:
    """``key, order, name`` of each row: the next larger value of ``order`` (unique) within its key, null after the last one.

    Rows lie in ranges of (key, order), so a key with very many rows is spread over tasks; only the first row of each
    range and key is asked across their borders.
    """
    ranged = materialize(df.select(key, order).repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "following")
    inside = F.lead(order).over(Window.partitionBy("_part", key).orderBy(order))
    firsts = ranged.groupBy(key, "_part").agg(F.min(order).alias("_first"))
    ahead = firsts.select(F.col(key).alias("_key"), F.col("_part").alias("_own"), F.lead("_first").over(Window.partitionBy(key).orderBy("_part")).alias("_ahead"))
    found = ranged.withColumn(name, inside)
    last = found.join(by_shuffle(ahead), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_own")))
    return last.select(key, order, F.coalesce(name, "_ahead").alias(name))


def page_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next page by key."""
    return df.filter(F.col(key) > last).orderBy(key).limit(size)


def with_featured(df: DataFrame, *order: Column) -> DataFrame:
    """Marks the first row of the order; of several rows equal in all columns one is marked, nulls are as good as values.

    The first row is found as a place (part and number in it) of the written table, so no value has to be compared.
    """
    placed = df.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    placed = materialize(placed, "featured")
    first = placed.orderBy(*order, "_part", "_row").limit(1).select("_part", "_row", F.lit(True).alias("_first"))
    marked = placed.join(F.broadcast(first), ["_part", "_row"], "left")
    return marked.withColumn("featured", F.coalesce("_first", F.lit(False))).drop("_first", "_part", "_row")


def random_sample(df: DataFrame, size: int, seed: int, *key: Column) -> DataFrame:
    """``size`` rows in the order of a seeded hash of their key, so that reruns agree; fewer if there are fewer."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key))), *key).limit(size)


def newest(df: DataFrame, size: int, time: str, key: str) -> DataFrame:
    """The ``size`` newest rows, null times last, ties by key."""
    return df.orderBy(F.desc_nulls_last(time), key).limit(size)


def reassigned(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``id, story_id`` of children (id, story_id, parent_id, title_key), moved to their parent unless it holds their title already.

    Of several children of one parent with one title the one with the least id moves. A null title key never collides.
    """
    held = parents.select(F.col("story_id").alias("parent_id"), "title_key").distinct()
    place = F.row_number().over(Window.partitionBy("parent_id", "title_key").orderBy("id"))
    moving = children.filter(F.col("parent_id").isNotNull()).join(held, ["parent_id", "title_key"], "left_anti")
    moving = moving.withColumn("_place", F.when(F.col("title_key").isNull(), 1).otherwise(place)).filter("_place = 1")
    moved = moving.select("id", F.col("parent_id").alias("_to"))
    return children.join(moved, "id", "left").select("id", F.coalesce("_to", "story_id").alias("story_id"))
