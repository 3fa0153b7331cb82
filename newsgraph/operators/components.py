"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.tables import drop_table, materialize

MAX_ROUNDS = 60
# Keys with more rows than this are hot; the bound rises with the table, so that at most HOT_KEYS are.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def join_counted(rows: DataFrame, one: DataFrame, keys: list[str], hot: int, n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has one row a key and, in ``n``, the key's number of rows.

    Keys with more than ``hot`` rows, of which there are at most as many as ``rows`` over ``hot``, are
    sent to all tasks, so their rows stay where they are; the others meet by shuffle.
    """
    few = F.broadcast(one.filter(F.col(n) > hot))
    others = rows.join(F.broadcast(one.filter(F.col(n) > hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(others.join(one.filter(F.col(n) <= hot), keys))


def _with_least(edges: DataFrame, least: DataFrame, hot: int | None) -> DataFrame:
    return edges.join(least.drop("n"), "u") if hot is None else join_counted(edges, least, ["u"], hot).drop("n")


def _least(edges: DataFrame) -> DataFrame:
    """Each node with its least neighbour and number of edges; partial sums on the map side keep hot nodes small."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, hot: int | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("m", "u"))
    return _with_least(both.filter("v > u"), least, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _small_star(edges: DataFrame, hot: int | None) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    least = _least(down)
    moved = _with_least(down, least, hot).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges ``u, v`` (long) to rows ``node, component``, component being the least node reached.

    A node without an edge does not occur; self-loops, repeated and reversed edges are harmless;
    no edges give no rows. Each round is written to the shared folder, so lineage stays short and
    a lost executor costs one round. Edges of a node with very many don't meet in one task. Ends when every edge leads from a leaf to the centre of its star.
    """
    spark = edges.sparkSession
    now = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u != v").distinct()
    now = materialize(now, name)
    for _ in range(MAX_ROUNDS):
        settled, edges_now, hottest = _state(now)
        if settled:
            break
        hot = max(HOT_ROWS, 2 * edges_now // HOT_KEYS)
        hot = hot if hottest > hot else None
        starred = _large_star(now, hot)
        following = materialize(_small_star(starred, hot), name)
        drop_table(spark, now)
        now = following
    else:
        raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node")).distinct()
    return members.unionByName(centres.select("node", F.col("node").alias("component")))


def _state(edges: DataFrame) -> tuple[bool, int, int]:
    """Whether all edges lead from a leaf with no other edge to a smaller centre that is no leaf; number of edges; most edges of a node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("wrong"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), (F.col("v") > F.col("u")).cast("int").alias("wrong")))
    ends = ends.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.count("*").alias("all"), F.max("wrong").alias("wrong"))
    open_ = F.max(((F.col("wrong") == 1) | ((F.col("leaves") > 0) & (F.col("all") > 1))).cast("int"))
    row = ends.agg(open_.alias("open"), F.sum("leaves").alias("edges"), F.max("all").alias("most")).first()
    return not row["open"], row["edges"] or 0, row["most"] or 0
