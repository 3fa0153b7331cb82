"""Runs over a folder of state: feed items in, stories and articles out, batch by batch.

The folder holds tables partitioned by batch: ``articles``, ``facts`` and ``stories`` (new and changed rows;
of an article, its facts or a story the row of the largest batch holds) and the claims of ``runs``. A batch
counts once its run has ended ``ok``, which is settled last and in one step (``claims``), so readers never
see half of one, a run that broke off is as if it had never been, and one that another run took over from
commits nothing. ``compact`` writes the tables whole, and readers start from there.

A delivery is known by its name, not by a number that may come again: a stream's is the name that lies in
its checkpoint and the epoch. One that was taken in changes nothing when it comes twice; after a lost
checkpoint all items come again under another name, and only new addresses add anything.

Edge cases: items without title, link or date are left out; an empty batch is a run with zeros; a
folder without state is an empty one; reprocessing without stale facts is a run with zeros.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsgraph.functions import text as X
from newsgraph.lexicon import THAI
from newsgraph.operators import attach, enrich, facts, ingest_batch, match, merge, reader, rows, similarity
from newsgraph.operators import entities as E
from newsgraph.operators.casualties import VERSION
from newsgraph.operators.classify import classify
from newsgraph.sources.outlets import outlet_identity
from newsgraph.streaming import claims
from newsgraph.streaming.claims import Fenced, RunInProgress  # noqa: F401  (raised by runs)
from newsgraph.tables import exists, materialize, spread

# Similarity and number of candidates, minutes after which a run counts as broken off, items that a dry run shows.
LEAST_SIMILAR, MOST_CANDIDATES, STALE_MINUTES, SHOWN = 0.35, 60, 20, 20
FACTS = f"url string, title string, summary string, {facts.FACTS}"


def read_runs(spark: SparkSession, state: str) -> DataFrame:
    return claims.runs(spark, f"{state}/runs")


def _committed(spark: SparkSession, state: str, name: str, schema: str, key: str) -> DataFrame:
    """Rows of the batches that count, from the last whole one on; of each key the latest."""
    columns, schema = ingest_batch.names(schema), f"{schema}, batch long"
    if not exists(spark, f"{state}/{name}"):
        return spark.createDataFrame([], schema).drop("batch")
    done = read_runs(spark, state).filter("status = 'ok'")
    base = done.filter("whole").agg(F.max("batch").alias("b")).first()["b"]  # one number
    log = spark.read.schema(schema).parquet(f"{state}/{name}").filter(F.col("batch") >= (base or 0)).join(done.select("batch"), "batch", "left_semi")
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("s.*")


def read_articles(spark: SparkSession, state: str) -> DataFrame:
    return _committed(spark, state, "articles", ingest_batch.ARTICLE, "id")


def read_stories(spark: SparkSession, state: str) -> DataFrame:
    return _committed(spark, state, "stories", ingest_batch.STORY, "story_id")


def read_facts(spark: SparkSession, state: str) -> DataFrame:
    """What was read of each article, with the version of the reader and the text that it read."""
    return _committed(spark, state, "facts", FACTS, "url")


def relevant(items: DataFrame) -> DataFrame:
    """Classified items (title, link, published, source, summary) that pass, the first of each link, then of each title, in order of link."""
    items = items.filter("title IS NOT NULL AND link IS NOT NULL AND published IS NOT NULL")
    unique = rows.first_wins(items, ["link"], F.col("published"), F.col("title"))
    passed = classify(unique, THAI).filter("passed").withColumn("title_key", X.squeeze_for_match(F.col("title")))
    return rows.first_wins(passed, ["title_key"], F.col("link"))


def _sides(titled: DataFrame, title: Column, provinces: Column, deaths: Column, injuries: Column, published: Column) -> DataFrame:
    own = match.features(title, provinces, deaths, injuries, published)
    return titled.select("id", published.alias("published"), provinces.alias("regions"), X.trigrams(X.search_key(title)).alias("grams"), own.alias("features"))


def resolved(reports: DataFrame, stories: DataFrame) -> DataFrame:
    """``place, story_id, joins`` of reports that tell of a stored story's event, or of an earlier report's.

    Stories whose last report is no older than the horizon before the first report stand for choice. A report founded
    in this batch is compared as it stands, without what later reports add to its story.
    """
    # Stories have even ids here, reports odd ones, so that both are one table to choose from.
    days = F.expr(f"INTERVAL {match.FOLLOW_UP_DAYS} DAYS")
    since = reports.agg((F.min("published") - days).alias("_since"))
    recent = stories.join(F.broadcast(since), F.col("last_published") >= F.col("_since"), "left_semi")  # one row
    col = F.col
    old = _sides(recent.withColumn("id", col("story_id") * 2), col("display_title"), E.regions(col("display_title")), col("deaths"), col("injuries"), col("last_published"))
    new = _sides(reports.withColumn("id", col("place") * 2 + 1), col("title"), col("provinces"), col("deaths"), col("injuries"), col("published"))
    new = materialize(new, "run-reports")
    both = materialize(old.unionByName(new), "run-choice")
    chosen = similarity.story_candidates(new, both, LEAST_SIMILAR, MOST_CANDIDATES, match.FOLLOW_UP_DAYS)
    same = match.matching(chosen, new, both).withColumn("stored", col("right_id") % 2 == 0)
    found = attach.attached(new.select("id", F.col("id").alias("place")), materialize(same.select("left_id", "right_id", "stored", "rank"), "run-matches"))
    place, target = ((F.col("id") - 1) / 2).cast("long"), (F.col("story") / 2).cast("long")
    stored = F.col("story") % 2 == 0
    return found.filter("NOT is_new").select(place.alias("place"), F.when(stored, target).alias("story_id"), F.when(~stored, target).alias("joins"))


def with_facts(items: DataFrame) -> DataFrame:
    """Items with their facts ``f`` and outlet ``o``, written."""
    read = enrich.article_facts(F.col("title"), F.col("summary"))
    return materialize(spread(items).withColumn("f", read).withColumn("o", outlet_identity(F.col("source"))), "run-items")


def as_reports(read: DataFrame) -> DataFrame:
    """Items with facts as reports; place is the rank by link."""
    # A batch is what the feeds brought since the last run: its links are ranked in one task, without their texts.
    order = read.select("link").withColumn("place", F.row_number().over(Window.orderBy("link")).cast("long"))
    return read.join(order, "link").select(
        "place", E.story_title(F.col("title")).alias("norm_title"), "title_key", F.col("link").alias("url"), "title", F.col("o.key").alias("source_key"), "o.aggregator", "confidence", "published",
        "f.deaths", "f.injuries", "f.deaths_confidence", "f.injuries_confidence", F.col("f.casualty_scope").alias("scope"), "f.content_type", "f.extract_confidence", F.col("f.article_provinces").alias("provinces"),
    )


def dry_run(items: DataFrame) -> DataFrame:
    """The newest relevant items with their counts; nothing is written."""
    shown = rows.newest(relevant(items), SHOWN, "published", "link").withColumn("f", enrich.article_facts(F.col("title"), F.col("summary")))
    return shown.select("title", "link", "published", "source", "confidence", "reason", "f.deaths", "f.injuries", F.col("f.casualty_scope").alias("scope"))


def _run(spark: SparkSession, state: str, delivery: str, work: Callable[[int], dict]) -> None:
    """``work`` under a claim: it writes the tables of its batch and returns what the end of the run says."""
    folder = f"{state}/runs"
    done = lambda: not read_runs(spark, state).filter((F.col("delivery") == delivery) & (F.col("status") == "ok")).isEmpty()
    if done():
        return
    batch = claims.begin(spark, folder, delivery, STALE_MINUTES)
    try:
        if done():  # in the moment before the claim
            return claims.end(spark, folder, batch, delivery, "repeated")
        said = work(batch)
    except Exception as error:
        claims.end(spark, folder, batch, delivery, "error", fenced_ok=True, detail=str(error)[:2000])
        raise
    claims.end(spark, folder, batch, delivery, "ok", **said)


def _write(state: str, batch: int, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{state}/{name}/batch={batch}")


def run_batch(items: DataFrame, state: str, delivery: int | str) -> None:
    """Feed items into the state under the name ``delivery``; one that is done is left as it is."""
    spark = items.sparkSession

    def work(batch: int) -> dict:
        stories, articles = read_stories(spark, state), read_articles(spark, state)
        fetched = materialize(items, "run-fetched")
        passed = materialize(relevant(fetched), "run-passed")
        fresh = with_facts(rows.new_rows(passed, articles.select(F.col("url").alias("link")), "link"))
        reports = materialize(as_reports(fresh), "run-facts")
        got = ingest_batch.ingest(reports.join(resolved(reports, stories), "place", "left"), stories, articles)
        read = fresh.join(got.articles.select(F.col("url").alias("link")), "link", "left_semi").select(F.col("link").alias("url"), "title", "summary", "f.*")
        _write(state, batch, articles=got.articles, stories=got.stories, facts=facts.typed(read, FACTS))
        tally = ingest_batch.tally(got.outcomes).first()
        n_passed = passed.count()
        return {"fetched": fetched.count(), "passed": n_passed, "new_stories": tally["new_stories"], "merged": tally["merged"], "skipped": n_passed - tally["new_stories"] - tally["merged"]}

    _run(spark, state, str(delivery), work)


def run_stream(items: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """A stream of feed items into the state, one batch an epoch; ends when what has landed is through."""
    spark, name = items.sparkSession, f"{checkpoint}/newsgraph-delivery/name.txt"
    claims.put_once(spark, name, uuid.uuid4().hex)
    token = spark.read.text(name).first()["value"]
    return items.writeStream.foreachBatch(lambda batch, epoch: run_batch(batch, state, f"{token}:{epoch}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reprocess(spark: SparkSession, state: str, version: int = VERSION, read: Callable[[Column, Column], Column] = enrich.article_facts) -> None:
    """Read the articles again that a reader older than ``version`` read, and write back their facts and the sums of their stories.

    What was settled by hand or locked stays. Run twice, the second run finds nothing to do.
    """

    def work(batch: int) -> dict:
        articles, stories = read_articles(spark, state), read_stories(spark, state)
        stale = materialize(read_facts(spark, state).filter(F.coalesce("extractor_version", F.lit(0)) < version), "stale-facts")
        again = spread(stale.select("url", "title", "summary")).withColumn("f", read(F.col("title"), F.col("summary")))
        again = materialize(facts.typed(again.select("url", "title", "summary", "f.*").withColumn("extractor_version", F.lit(version)), FACTS), "read-again")
        changed = materialize(facts.replaced(articles, again), "changed-articles")
        touched = changed.select("story_id").distinct()
        after = articles.join(changed.select("id"), "id", "left_anti").unionByName(changed)
        sums = merge.rebuilt(stories.join(touched, "story_id", "left_semi"), after)
        _write(state, batch, articles=changed, stories=sums, facts=again)
        return {"fetched": stale.count(), "passed": changed.count()}

    _run(spark, state, f"reprocess:{version}:{uuid.uuid4().hex}", work)


def compact(spark: SparkSession, state: str) -> None:
    """Write the tables whole, so that readers need no earlier batch; what these hold may then go."""

    def work(batch: int) -> dict:
        _write(state, batch, articles=read_articles(spark, state), stories=read_stories(spark, state), facts=read_facts(spark, state))
        return {"whole": True}

    _run(spark, state, f"compact:{uuid.uuid4().hex}", work)


def merge_duplicates(spark: SparkSession, state: str, commit: bool = False) -> DataFrame:
    """The groups of stories that tell of one event (``merge``); with ``commit`` they are folded, and the tables written whole."""
    found = merge.merged(read_stories(spark, state), read_articles(spark, state))
    groups = materialize(found.groups, "merge-groups")

    def work(batch: int) -> dict:
        kept = read_facts(spark, state).join(found.articles.select("url"), "url", "left_semi")
        _write(state, batch, articles=found.articles, stories=found.stories, facts=kept)
        return {"whole": True, "merged": groups.filter("id != parent").count()}

    if commit and not groups.isEmpty():
        _run(spark, state, f"merge:{uuid.uuid4().hex}", work)
    return groups


def open_reader(spark: SparkSession, state: str) -> reader.Reader:
    return reader.Reader(read_stories(spark, state), read_articles(spark, state), read_runs(spark, state))
