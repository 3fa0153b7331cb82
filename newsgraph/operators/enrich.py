"""Facts of an article, stored extractions held against the text they came from, and what is still to do.

Edge cases: a null or empty text states nothing; a malformed extraction is no extraction; an unknown
confidence scores between medium and low; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.functions import text as X
from newsgraph.lexicon import PROVINCES
from newsgraph.operators import entities as E
from newsgraph.operators import rows
from newsgraph.operators.casualties import VERSION, read_casualties

# Confidence below which a body is worth reading, scores of an extraction's confidence, largest plausible count.
SURE = 0.7
SCORES, OTHER_SCORE = {"high": 0.95, "medium": 0.75, "low": 0.4}, 0.5
MOST = 500
ROUNDUP = "statistics_roundup"
EXTRACTION = (
    "deaths struct<value:double,basis:string,quote:string>, injuries struct<value:double,basis:string,quote:string>,"
    "provinces array<string>, vehicles array<string>, content_type string, alcohol_involved string, confidence string"
)
# Words of the buckets in which an extractor's errors are looked for.
CASUALTY_WORDS = "ดับ|เสียชีวิต|ตาย|เจ็บ|สาหัส|ศพ|สังเวย"
FALSE_FRIENDS = "อันดับ|ระดับ|ไฟดับ|ดับเพลิง|ดับเครื่อง|ตายาย|สี่แยก|สองแถว"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is found once: a one-element array binds it."""
    return F.transform(F.array(value), use)[0]


def article_facts(title: Column, summary: Column | None = None, body: Column | None = None, words: E.Entities = E.THAI) -> Column:
    """The record of facts of one article; places come from title and summary alone, as bodies quote officials from elsewhere."""
    provinces = E.regions(F.concat_ws(" ", title, *([] if summary is None else [summary])), words)

    def record(r: Column) -> Column:
        d, i = r["deaths"], r["injuries"]
        sure = lambda f: F.when(f["value"].isNotNull(), f["confidence"]).cast("float")
        nothing = F.lit(None).cast("string")
        return F.struct(
            d["value"].alias("deaths"), i["value"].alias("injuries"), d["value"].alias("regex_deaths"), i["value"].alias("regex_injuries"),
            d["evidence"].alias("deaths_evidence"), i["evidence"].alias("injuries_evidence"), sure(d).alias("deaths_confidence"), sure(i).alias("injuries_confidence"),
            d["scope"].alias("casualty_scope"), F.coalesce(d["field"], i["field"]).alias("casualty_field"), F.coalesce(d["snippet"], i["snippet"]).alias("casualty_snippet"),
            nothing.alias("content_type"), nothing.alias("alcohol_involved"), provinces.alias("article_provinces"), F.lit("regex").alias("extractor"),
            nothing.alias("extractor_model"), nothing.alias("extract_confidence"), F.lit(VERSION).alias("extractor_version"), nothing.alias("payload"),
        )

    return _bound(read_casualties(title, summary, body), record)


def needs_body(deaths: Column, confidence: Column) -> Column:
    return deaths.isNull() | (F.coalesce(confidence, F.lit(0.0)) < SURE)


def checked_extraction(payload: Column, sent: Column, provinces: tuple[str, ...] = PROVINCES) -> Column:
    """The stored extraction (JSON), or null where it can't be true.

    A count that isn't mentioned has no value; a value is a whole number from 0 to MOST; a stated one
    quotes the text that was sent. Unknown provinces go.
    """

    def fits(count: Column) -> Column:
        basis, value = F.coalesce(count["basis"], F.lit("")), count["value"]
        plausible = (value == F.floor(value)) & value.between(0, MOST)
        quoted = (basis != "stated") | (F.coalesce(count["quote"] != "", F.lit(False)) & F.coalesce(F.contains(sent, count["quote"]), F.lit(False)))
        return count.isNotNull() & (value.isNull() | ((basis != "not_mentioned") & plausible & quoted))

    def record(x: Column) -> Column:
        count = lambda c: F.struct(c["value"].cast("int").alias("value"), c["basis"].alias("basis"), c["quote"].alias("quote"))
        kept = F.struct(
            count(x["deaths"]).alias("deaths"), count(x["injuries"]).alias("injuries"), F.filter(x["provinces"], lambda p: p.isin(*provinces)).alias("provinces"),
            F.coalesce(x["vehicles"], F.array().cast("array<string>")).alias("vehicles"), *(x[n].alias(n) for n in ("content_type", "alcohol_involved", "confidence")),
        )
        return F.when(fits(x["deaths"]) & fits(x["injuries"]) & x["provinces"].isNotNull(), kept)

    return _bound(F.from_json(payload, EXTRACTION), record)


def merged_facts(facts: Column, found: Column, payload: Column, live: bool, model: str) -> Column:
    """Facts with a checked extraction beside them; where it is live its counts, places and scope stand in for those read by rule."""
    given = F.struct(facts.alias("facts"), found.alias("found"), payload.alias("payload"))
    return _bound(given, lambda b: _merged(b["facts"], b["found"], b["payload"], live, model))


def _merged(facts: Column, found: Column, payload: Column, live: bool, model: str) -> Column:
    noted = {"content_type": found["content_type"], "alcohol_involved": found["alcohol_involved"], "extractor_model": F.lit(model), "extract_confidence": found["confidence"], "payload": payload}
    if live:
        score = F.lit(OTHER_SCORE)
        for name, value in SCORES.items():
            score = F.when(found["confidence"] == name, value).otherwise(score)
        for kind in ("deaths", "injuries"):
            value = found[kind]["value"]
            noted |= {kind: value.cast("long"), f"{kind}_evidence": found[kind]["basis"], f"{kind}_confidence": F.when(value.isNotNull(), score).cast("float")}
        noted |= {
            "casualty_scope": F.when(F.coalesce(found["content_type"] == ROUNDUP, F.lit(False)), "aggregate").otherwise(facts["casualty_scope"]),
            "casualty_snippet": F.coalesce(found["deaths"]["quote"], found["injuries"]["quote"], facts["casualty_snippet"]),
            "article_provinces": F.when(F.size(found["provinces"]) > 0, found["provinces"]).otherwise(facts["article_provinces"]),
            "extractor": F.lit("llm"),
        }
    merged = facts
    for name, value in noted.items():
        merged = merged.withField(name, value)
    return F.when(found.isNull(), facts).otherwise(merged)


def to_reprocess(articles: DataFrame, version: int = VERSION, story_id: int | None = None, since: Column | None = None, by_rule_only: bool = False) -> DataFrame:
    """Articles read by an older version, of one story, from a time on, or by rule only, as asked."""
    wanted = F.col("extractor_version") < version
    for asked, more in ((story_id is not None, F.col("story_id") == story_id), (since is not None, F.col("published") >= since), (by_rule_only, F.col("extractor") == "regex")):
        wanted = wanted & more if asked else wanted
    return articles.filter(wanted)


def pending(articles: DataFrame, size: int) -> DataFrame:
    """The newest articles that were read by rule only."""
    return rows.newest(articles.filter(F.col("extractor") == "regex"), size, "published", "id")


def to_refetch(articles: DataFrame, stories: DataFrame, size: int) -> DataFrame:
    """The newest articles of primary outlets whose story has no toll and isn't locked."""
    open_ = stories.filter(F.col("deaths").isNull() & ~F.coalesce("casualties_locked", F.lit(False))).select("story_id")
    return rows.newest(articles.filter(~F.coalesce("aggregator", F.lit(False))).join(open_, "story_id"), size, "published", "id")


def buckets(title: Column, summary: Column, deaths: Column, injuries: Column, casualty_words: str = CASUALTY_WORDS, false_friends: str = FALSE_FRIENDS) -> Column:
    """Buckets into which an article falls: missed, truncated, false-friend."""
    told = F.coalesce(title.rlike(casualty_words), F.lit(False)) | F.coalesce(summary.rlike(casualty_words), F.lit(False))
    names = (("missed", deaths.isNull() & injuries.isNull() & told), ("truncated", X.is_cut_short(title)), ("false-friend", title.rlike(false_friends)))
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in names)))


def story_with_articles(stories: DataFrame, articles: DataFrame, story_id: str) -> DataFrame:
    """One story with its articles in order of publication; no row for an id that isn't digits or isn't there."""
    if not (story_id.isascii() and story_id.isdigit()):
        return stories.limit(0).withColumn("articles", F.array().cast("array<bigint>"))
    own = articles.filter(F.col("story_id") == int(story_id)).groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("published", "id"))).alias("_a"))
    found = stories.filter(F.col("story_id") == int(story_id)).join(own, "story_id", "left")
    return found.withColumn("articles", F.coalesce("_a.id", F.array().cast("array<bigint>"))).drop("_a")


def category(title: Column, table: dict[str, tuple[str, ...]], other: str = "other") -> Column:
    """The first category of the table of which the title holds a word."""
    return F.coalesce(F.get(E.codes_in(F.lower(title), table), F.lit(0)), F.lit(other))
