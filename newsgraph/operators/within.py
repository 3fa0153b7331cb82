"""All pairs of reports that tell of one event and lie within some days of each other, without comparing all.

Two reports can tell of one event in four ways only (``match.same_event``): a rare entity that both name,
titles of which nearly all letter pairs are shared, equal vehicles and equal known deaths, or equal vehicles
and a shared region. Each way is a set of keys, an inverted index: pairs come from shared keys alone.

Time is cut into bins as wide as the window. A report looks for later ones in its own bin and the next,
so that a pair meets in the bin of the later report and nowhere else; the join is by (key, bin), an equality.
Reports of a bin that share a frequent key are dealt into cells, so none of them meets in one task.

Edge cases: reports without an id or a time have no pairs; null and empty features give no keys; equal
times and ids go by id; repeated reports are paired with others and not with one another; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.functions.text import bigrams
from newsgraph.operators import match
from newsgraph.tables import materialize

DAY = 86_400_000_000
# Reports of one key and bin in a cell.
CELL_ROWS = 500


def pairs_within(keyed: DataFrame, days: int) -> DataFrame:
    """``a_id, b_id``: pairs of rows (id, published, keys) with a shared key, at most ``days`` apart, the earlier one first, each once."""
    width = days * DAY
    at = F.unix_micros(F.col("published").cast("timestamp"))
    flat = keyed.select("id", at.alias("at"), F.explode(F.array_distinct("keys")).alias("key")).filter("id IS NOT NULL AND at IS NOT NULL AND key IS NOT NULL")
    flat = materialize(flat.withColumn("bin", F.floor(F.col("at") / width).cast("long")), "within-keys")
    cells = flat.groupBy("key", "bin").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("cells"))
    many = cells.filter("cells > 1")
    late = flat.join(many, ["key", "bin"], "left").select("key", "bin", F.pmod(F.xxhash64("id"), F.coalesce("cells", F.lit(1))).cast("int").alias("cell"), F.col("id").alias("b_id"), F.col("at").alias("b_at"))
    early = flat.select("key", F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"), F.col("id").alias("a_id"), F.col("at").alias("a_at"))
    early = early.join(many, ["key", "bin"], "left").select("key", "bin", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)).alias("cell"), "a_id", "a_at")
    apart = F.col("b_at") - F.col("a_at")
    met = early.join(late, ["key", "bin", "cell"]).filter(((apart > 0) | ((apart == 0) & (F.col("a_id") < F.col("b_id")))) & (apart <= width) & (F.col("a_id") != F.col("b_id")))
    return met.select("a_id", "b_id").distinct()


def _numbered(grams: Column) -> Column:
    """Letter pairs with the number of times that they stood before, so that repeats are members of a set."""
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i), lambda x: x == g)).cast("string")))


def _prefixes(titles: DataFrame) -> DataFrame:
    """``id, keys``: the rarest letter pairs of each title, of which two titles with STRONG in common share one."""
    share = match.STRONG / (2 - match.STRONG)  # of the union, where STRONG is the share of both titles' pairs
    each = titles.select("id", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("often"))
    order = each.join(often, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("order"))
    first = F.size("order") - F.ceil(F.size("order") * share - 1e-6) + 1
    return order.select("id", F.transform(F.slice("order", 1, first.cast("int")), lambda g: F.concat(F.lit("pair "), g["gram"])).alias("keys"))


def keys(features: Column) -> Column:
    """Keys of a report other than those of its title: rare entities, vehicles with deaths, vehicles with each region."""
    named = lambda word, c: F.concat(F.lit(word), c)
    rare = F.transform(F.filter(features["entities"], lambda e: e["rare"]), lambda e: named("rare ", e["key"]))
    vehicles = F.nullif(features["vehicles"], F.lit(""))
    deaths = F.array_compact(F.array(F.concat_ws(" ", F.when(vehicles.isNotNull() & features["deaths"].isNotNull(), F.lit("deaths")), vehicles, features["deaths"].cast("string"))))
    regions = F.transform(features["regions"], lambda r: F.concat(F.lit("region "), vehicles, F.lit(" "), r))
    none = F.array().cast("array<string>")
    return F.array_compact(F.concat(F.coalesce(rare, none), F.when(vehicles.isNotNull() & features["deaths"].isNotNull(), deaths).otherwise(none), F.coalesce(regions, none)))


def matches_within(reports: DataFrame, days: int = match.FOLLOW_UP_DAYS) -> DataFrame:
    """``a_id, b_id`` of reports (id, published, features) that tell of one event, at most ``days`` apart, the earlier one first."""
    reports = materialize(reports.select("id", "published", "features"), "within-reports")
    titled = _prefixes(reports.select("id", _numbered(bigrams(F.col("features.title"))).alias("grams")))
    keyed = reports.select("id", keys(F.col("features")).alias("keys")).unionByName(titled)
    keyed = keyed.join(reports.select("id", "published"), "id").select("id", "published", "keys")
    pairs = materialize(pairs_within(keyed, days).select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id")), "within-pairs")
    return match.matching(pairs, reports, reports).select(F.col("left_id").alias("a_id"), F.col("right_id").alias("b_id"))
