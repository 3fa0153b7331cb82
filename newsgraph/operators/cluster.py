"""Greedy clustering in order of publication: a report joins the first cluster that holds a match.

The cluster of a report is the least of those of its earlier matches, theirs that of their earlier
matches, and so on: the earliest report that can be reached by going from match to earlier match. So
labels spread along the matches in rounds, each report taking the least label of its earlier matches,
and a label that is itself labelled is followed, which doubles the reach of a round. A component of
matches lies spread over all tasks, whatever its size. Plain components would fuse two clusters over a
late bridging report, which this does not.

Edge cases: reports without an id or a time come after those with one of the same kind, equal times go
by id; matches of a report with itself or with one that is no report don't count, repeated and reversed
ones count once; no matches make every report its own cluster; no reports give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.tables import drop_table, materialize


def greedy(order: list[int], links: dict[int, set[int]]) -> dict[int, int]:
    """The plain pass over all: cluster (its first member) of each node taken in order."""
    cluster: dict[int, int] = {}
    place = {n: i for i, n in enumerate(order)}
    for node in order:
        met = {cluster[m] for m in links.get(node, ()) if m in cluster}
        cluster[node] = min(met, key=place.__getitem__) if met else node
    return cluster


def greedy_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, cluster`` of ``nodes`` (id, published) under match ``edges`` (a, b); a node alone is its own cluster.

    Every round is written to the shared folder: labels that have not moved are not looked at again, and
    the rounds end when none has. They are as many as the longest way that labels go without a shortcut,
    not as the members of a component.
    """
    spark = nodes.sparkSession
    # The order of a node: its time and id; null times come last.
    at = F.coalesce(F.unix_micros(F.col("published").cast("timestamp")), F.lit((1 << 63) - 1))
    placed = materialize(nodes.select("id", F.struct(at.alias("at"), F.col("id")).alias("place")), "cluster-nodes")
    sides = edges.select("a", "b").join(placed.select(F.col("id").alias("a"), F.col("place").alias("_a")), "a").join(placed.select(F.col("id").alias("b"), F.col("place").alias("_b")), "b")
    down = sides.filter("a != b").select(F.greatest("_a", "_b").alias("late"), F.least("_a", "_b").alias("early")).distinct()
    down = materialize(down.select(F.col("late.id").alias("late"), F.col("early.id").alias("early")), "cluster-down")
    labels = materialize(placed.select("id", F.col("place").alias("label"), F.lit(True).alias("moved")), "cluster-labels")
    while True:
        fresh = labels.filter("moved").select(F.col("id").alias("early"), "label")
        heard = down.join(fresh, "early").groupBy(F.col("late").alias("id")).agg(F.min("label").alias("_heard"))
        told = labels.join(heard, "id", "left").select("id", F.col("label").alias("_old"), F.least("label", F.coalesce("_heard", "label")).alias("label"))
        told = materialize(told, "cluster-told")
        # A label that has a lesser one itself is followed.
        ahead = told.filter("label.id != id").select(F.col("id").alias("_to"), F.col("label").alias("_far"))
        jumped = told.join(ahead, F.col("label.id") == F.col("_to"), "left").select("id", "_old", F.coalesce("_far", "label").alias("label"))
        following = materialize(jumped.select("id", "label", (F.col("label") != F.col("_old")).alias("moved")), "cluster-labels")
        for gone in (labels, told):
            drop_table(spark, gone)
        labels = following
        if labels.filter("moved").isEmpty():
            return labels.select("id", F.col("label.id").alias("cluster"))


def folded_groups(clusters: DataFrame, reports: DataFrame) -> DataFrame:
    """``parent, id, size, shared`` of the members of clusters (id, cluster) of two and more.

    The oldest member is the parent, the least id on equal times. ``shared`` are the keys of entities
    (of ``reports``: id, published, features) that a member has in common with its parent, in the
    parent's order: why it is there. Empty means by text alone; the parent shares all with itself.
    """
    members = clusters.join(reports.select("id", "published", F.col("features.entities.key").alias("_keys")), "id")
    first = members.groupBy("cluster").agg(F.count("*").alias("size"), F.min_by(F.struct("id", "_keys"), F.struct("published", "id")).alias("_p")).filter("size > 1")
    both = members.join(first, "cluster")
    return both.select(F.col("_p.id").alias("parent"), "id", "size", F.array_intersect("_p._keys", "_keys").alias("shared"))
