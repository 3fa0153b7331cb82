"""Registered queries of the library's own operators, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgraph.functions import text as X
from newsgraph.lexicon import SAMPLE
from newsgraph.operators import classify as C
from newsgraph.operators import cluster, match, reader, rollup, rows, similarity, views
from newsgraph.operators.casualties import number_of_words, read_casualties
from newsgraph.sources import feeds, outlets
from newsgraph.tables import by_shuffle, materialize, shared_dir, spread, table, table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _n(column: Column) -> Column:
    return column.cast("long")


# Same class as text.IGNORED; both engines take \x{...}.
def _match(text: str) -> str:
    pattern = X.IGNORED.replace("'", "''")
    return f"lower(regexp_replace(replace({text}, 'เเ', 'แ'), '{pattern}', '', 'g'))"


def _hit_sql(text: str, terms: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{t}') THEN '{t}'" for t in terms) + " END"


# The first line of a text is the title, all that follows the summary.
_LINE = "split_part(text, chr(10), 1)"
_REST = f"substr(text, length({_LINE}) + 2)"


def _classify_sql(title: str = _LINE, summary: str = _REST) -> str:
    guard = lambda s: s if not SAMPLE.place_guard else "replace(" * len(SAMPLE.place_guard) + s + "".join(f", '{p}', '')" for p in SAMPLE.place_guard)
    names = ("decisive", "test_strong", "test_weak", "checkpoint_strong", "checkpoint_weak", "driving", "enforcement", "crash", "alcohol", "campaign", "negative", "evergreen")
    hits = ", ".join(f"{_hit_sql('body', getattr(SAMPLE, n))} AS {n}" for n in names)
    any_of = lambda terms: " OR ".join(f"contains(lower(source), '{t}')" for t in terms)
    return f"""
WITH t AS (SELECT doc_id, source, {guard(_match(title))} AS head, {guard(_match("concat_ws(' ', " + title + ", " + summary + ")"))} AS body FROM documents),
h AS (SELECT doc_id, source, {_hit_sql('head', SAMPLE.decisive)} AS in_title, {hits}, ({any_of(SAMPLE.soft_block)}) AS social, ({any_of(SAMPLE.hard_block)}) AS blocked FROM t),
l AS (SELECT *, CASE
  WHEN in_title IS NOT NULL THEN {{'level': 'high', 'why': 'dui-title: ' || in_title}}
  WHEN test_strong IS NOT NULL THEN {{'level': 'high', 'why': 'alcotest: ' || test_strong}}
  WHEN checkpoint_strong IS NOT NULL THEN {{'level': 'high', 'why': 'checkpoint: ' || checkpoint_strong}}
  WHEN decisive IS NOT NULL THEN {{'level': 'medium', 'why': 'dui-body: ' || decisive}}
  WHEN test_weak IS NOT NULL AND coalesce(driving, enforcement, checkpoint_weak) IS NOT NULL THEN {{'level': 'high', 'why': 'alcotest-weak: ' || test_weak}}
  WHEN checkpoint_weak IS NOT NULL AND alcohol IS NOT NULL AND coalesce(driving, enforcement) IS NOT NULL THEN {{'level': 'medium', 'why': 'checkpoint-weak: ' || checkpoint_weak}}
  WHEN alcohol IS NOT NULL AND driving IS NOT NULL AND coalesce(crash, enforcement) IS NOT NULL THEN {{'level': 'medium', 'why': 'alcohol+driving: ' || alcohol}}
  WHEN campaign IS NOT NULL AND driving IS NOT NULL THEN {{'level': 'medium', 'why': 'campaign: ' || campaign}} END AS v FROM h)
SELECT doc_id,
  CASE WHEN blocked OR (negative IS NOT NULL AND decisive IS NULL) OR v IS NULL THEN false ELSE true END AS passed,
  CASE WHEN blocked OR (negative IS NOT NULL AND decisive IS NULL) OR v IS NULL THEN 'none'
       WHEN v.level = 'high' AND (evergreen IS NOT NULL OR social) THEN 'medium' ELSE v.level END AS confidence,
  CASE WHEN blocked THEN 'blocked source: ' || source WHEN negative IS NOT NULL AND decisive IS NULL THEN 'negative: ' || negative
       WHEN v IS NULL THEN 'no matching criteria'
       ELSE v.why || CASE WHEN v.level = 'high' AND evergreen IS NOT NULL THEN ' +evergreen: ' || evergreen ELSE '' END || CASE WHEN v.level = 'high' AND social THEN ' +social' ELSE '' END END AS reason
FROM l"""


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    line = F.substring_index("text", "\n", 1)
    return docs.select("doc_id", "source", "text", line.alias("title"), F.substr("text", F.length(line) + 2).alias("summary"), X.squeeze_for_match(F.col("text")).alias("text_key"))


@query(f"SELECT doc_id, {_match('text')} AS text_key FROM documents")
def c1_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).select("doc_id", "text_key")


@query(f"""
WITH t AS (SELECT doc_id, source, sha256({_match('text')}) AS text_key FROM documents)
SELECT doc_id, source, text_key FROM (SELECT *, row_number() OVER (PARTITION BY text_key ORDER BY doc_id) AS r FROM t) WHERE r = 1""")
def c9_first_title_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.first_wins(_whole(spark, sf_dir).select("doc_id", "source", F.sha2("text_key", 256).alias("text_key")), ["text_key"], F.col("doc_id"))


@query(f"""
WITH t AS (SELECT doc_id, sha256({_match('text')}) AS text_key FROM documents)
SELECT doc_id, text_key FROM t WHERE doc_id % 2 = 1 AND text_key IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM t s WHERE s.doc_id % 2 = 0 AND s.text_key = t.text_key)""")
def w1_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _whole(spark, sf_dir).select("doc_id", F.sha2("text_key", 256).alias("text_key"))
    return rows.new_rows(t.filter("doc_id % 2 = 1"), t.filter("doc_id % 2 = 0"), "text_key").select("doc_id", "text_key")


@query(_classify_sql())
def c8_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(_whole(spark, sf_dir), SAMPLE).select("doc_id", "passed", "confidence", "reason")


@query(f"""
WITH t AS ({_classify_sql()}) SELECT count(*) AS fetched, count(*) FILTER (passed) AS passed,
  count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium FROM t""")
def a13_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c8_classify(spark, sf_dir).agg(F.count("*").alias("fetched"), views.count_if(F.col("passed"), "passed"), views.count_if(F.col("confidence") == "high", "high"), views.count_if(F.col("confidence") == "medium", "medium"))


@query("SELECT doc_id, regexp_replace(text, '[^\\x{0E01}-\\x{0E59}a-zA-Z0-9]', '', 'g') AS search_key FROM documents")
def x8_search_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).select("doc_id", X.search_key(F.col("text")).alias("search_key"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS host FROM pages")
def x21_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.host_of(F.col("url")).alias("host"))


@query("""SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) LIKE '%example.com' AND regexp_matches(url, '[?&]ref=')
  THEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) ELSE url END AS link FROM pages""")
def x20_unwrapped_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.unwrapped_link(F.col("url"), "example.com", "ref").alias("link"))


# The given hosts all lie under example.com, .net or .org; without that part their own label tells them apart.
_HOST = "lower(trim(coalesce(replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.example', ''), '')))"
_ALIASES = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in outlets.ALIASES.items()) + "}"
_LABEL = f"regexp_extract(regexp_replace({_HOST}, '^www\\.', ''), '([^.]+)(?:\\.+(?:{'|'.join(outlets.LABELS)}))*\\.*$', 1)"
_NAMED = f"CASE WHEN regexp_matches({_HOST}, '^[a-z0-9][a-z0-9.-]*\\.[a-z]{{2,}}$') THEN coalesce({_ALIASES}[{_LABEL}], {_LABEL}) ELSE regexp_replace({_HOST}, '[\\s.\\-_\\x27\\x22()]+', '', 'g') END"
_KEY = f"CASE WHEN {_HOST} = '' THEN 'unknown' ELSE coalesce({_ALIASES}[{_HOST}], {_NAMED}) END"


def _outlet(url: str) -> Column:
    return outlets.outlet_identity(F.replace(F.try_parse_url(url, F.lit("HOST")), F.lit(".example"), F.lit("")))["key"]


@query(f"SELECT page_id, {_KEY} AS outlet FROM pages")
def x18_outlet_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", _outlet("url").alias("outlet"))


@query(f"""SELECT page_id % 20 AS story_id, greatest(count(DISTINCT CASE WHEN page_id % 5 <> 0 THEN {_KEY} END), 1)::BIGINT AS source_count FROM pages GROUP BY 1""")
def a1_source_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    articles = pages.select((F.col("page_id") % 20).alias("story_id"), _outlet("url").alias("source_key"), (F.col("page_id") % 5 == 0).alias("aggregator"))
    return rollup.source_counts(articles)


def _strip(html: str) -> str:
    """The SQL of text.strip_html; back-references are spelled out, one expression per element."""
    out = html
    for element in ("script", "style"):
        out = f"regexp_replace({out}, '<{element}\\b.*?</{element}>', ' ', 'gis')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for entity in [*(e for e in X.ENTITIES if e != "&amp;"), "&amp;"]:
        plain = X.ENTITIES[entity].replace("'", "''")
        out = f"replace({out}, '{entity}', '{plain}')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r\\f\\x{{000B}}\\x{{00A0}}]+', ' ', 'g'))"


@query(f"SELECT page_id, substr({_strip('html')}, 1, 2500) AS text FROM pages")
def x19_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).select("page_id", X.strip_html(F.col("html"), 2500).alias("text"))


@query(f"""
WITH s AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '<article\\b[^>]*>(.*?)</article>', 1, 'is'), ''), html) AS scope FROM pages),
p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(scope, '<p\\b[^>]*>(.*?)</p>', 1, 'is'), lambda x: {_strip('x')}), lambda x: length(x) > 40) AS ps FROM s)
SELECT page_id, CASE WHEN length(array_to_string(ps, ' ')) > 160 THEN substr(array_to_string(ps, ' '), 1, 2500) END AS body,
  CASE WHEN length(array_to_string(ps, ' ')) > 160 THEN 'paragraphs' END AS via FROM p""")
def x25_article_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").withColumn("b", X.article_body(F.col("html")))
    return found.select("page_id", F.col("b.text").alias("body"), F.col("b.via").alias("via"))


def _grams(text: str) -> str:
    return f"[substr({text}, i, 2) FOR i IN range(1, length({text}))]"




@query(f"""
WITH t AS (SELECT p.page_id, lower(p.url) AS a, lower(n.url) AS b FROM pages p JOIN pages n ON n.page_id = p.page_id + 1),
g AS (SELECT page_id, a, b, {_grams('a')} AS ga, {_grams('b')} AS gb FROM t WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT page_id, round(CASE WHEN length(a) < 2 OR length(b) < 2 THEN 0.0 ELSE 2.0 * coalesce(list_sum([least(len(list_filter(ga, lambda x: x = u)), len(list_filter(gb, lambda x: x = u))) FOR u IN list_distinct(ga)]), 0) / (length(a) + length(b) - 2) END, 6) AS dice FROM g""")
def x27_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's whole address with that of the page with the next id."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("a"))
    near = pages.join(pages.select((F.col("page_id") - 1).alias("page_id"), F.col("a").alias("b")), "page_id").filter("a IS NOT NULL AND b IS NOT NULL")
    return near.select("page_id", F.round(X.dice(F.col("a"), F.col("b")), 6).alias("dice"))


def _triples(text: str) -> str:
    return f"list_distinct([substr('  ' || lower({text}) || ' ', i, 3) FOR i IN range(1, length({text}) + 2)])"




@query(f"""
WITH t AS (SELECT p_partkey AS id, p_brand, {_triples("regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')")} AS g FROM part),
p AS (SELECT a.id AS left_id, b.id AS right_id, (len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))))::FLOAT AS s FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.id <> b.id)
SELECT left_id, right_id, round(s::DOUBLE, 5) AS similarity, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY s DESC, right_id) AS r FROM p WHERE s >= 0.35::FLOAT) WHERE r <= 60""")
def j6_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole part names as headlines, brands as blocks."""
    key = F.regexp_replace("p_name", "[^a-zA-Z0-9]", "")
    sets = materialize(spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), X.trigrams(key).alias("grams")), "candidates")
    return similarity.candidates(sets, sets, 0.35, 60).select("left_id", "right_id", F.round(F.col("similarity").cast("double"), 5).alias("similarity"), _n(F.col("rank")).alias("rank"))


@query()
def x27_dice_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of neighbours within a source; held against plain Python in the tests, as the SQL is quadratic in the length."""
    docs = table(spark, sf_dir, "documents")
    pairs = rows.following(docs, "source", "doc_id", "_next").filter("_next IS NOT NULL").select("doc_id", "_next")
    second = docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("_next"), F.col("text").alias("b"))
    both = pairs.join(by_shuffle(docs.select("doc_id", F.col("text").alias("a"))), "doc_id").join(by_shuffle(second), "_next")
    return both.select("doc_id", F.round(similarity.dice_of_long(F.col("a"), F.col("b")), 6).alias("dice"))


@query()
def j6_candidates_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by whole texts across sources, or by region, within 14 days; held against brute force in the tests.

    Documents have neither region nor date: the source stands for the region, one document an hour for the date.
    """
    at = F.timestamp_seconds(F.col("doc_id") * 3600)
    sets = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), at.alias("published"), F.array_compact(F.array("source")).alias("regions"), similarity.latin_triples("text").alias("grams"))
    found = similarity.story_candidates(sets, sets, 0.35, 60, match.FOLLOW_UP_DAYS)
    return found.select("left_id", "right_id", F.round(F.col("similarity").cast("double"), 5).alias("similarity"), _n(F.col("rank")).alias("rank"))


@query("""
SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key, round(abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) / 86400000000.0, 6) AS days
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) <= 14 * 86400000000""")
def j8_within_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    a, b = o.alias("a"), o.alias("b")
    days = match.days_apart(F.col("a.at"), F.col("b.at"))
    pairs = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & (days <= match.FOLLOW_UP_DAYS))
    return pairs.select(F.col("a.o_orderkey").alias("a_key"), F.col("b.o_orderkey").alias("b_key"), F.round(days, 6).alias("days"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as articles: a user's events are one story."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("story_id"), F.when(F.col("event_type") != "error", F.floor("value").cast("int")).alias("deaths"), (k / 100.0).cast("float").alias("confidence"),
        F.col("event_type").alias("source_key"), (F.col("event_type") == "view").alias("aggregator"), F.col("ts").cast("timestamp").alias("published"),
        F.when(k % 7 == 0, "aggregate").otherwise("incident").alias("scope"), F.when(k % 11 == 0, "campaign").when(k % 2 == 0, "news").alias("content_type"), F.when(k % 13 == 0, "low").alias("extract_confidence"),
    )


_REPORTS = """r AS (SELECT event_id AS id, user_id AS story_id, CASE WHEN event_type <> 'error' THEN floor(value)::INT END AS deaths, (k / 100.0)::FLOAT AS confidence, event_type AS source_key, event_type = 'view' AS aggregator, ts AS published,
  CASE WHEN k % 7 = 0 THEN 'aggregate' ELSE 'incident' END AS scope, CASE WHEN k % 11 = 0 THEN 'campaign' WHEN k % 2 = 0 THEN 'news' END AS content_type, CASE WHEN k % 13 = 0 THEN 'low' END AS extract_confidence
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))"""


@query(f"""
WITH {_REPORTS},
e AS (SELECT * FROM r WHERE scope <> 'aggregate' AND coalesce(content_type, '') <> 'campaign' AND coalesce(extract_confidence, '') <> 'low'),
p AS (SELECT story_id, bool_or(NOT aggregator) AS has_primary FROM e GROUP BY 1),
g AS (SELECT story_id, deaths, max(confidence) AS c, count(DISTINCT source_key) AS outlets, max(published) AS latest FROM e JOIN p USING (story_id) WHERE deaths IS NOT NULL AND (NOT has_primary OR NOT aggregator) GROUP BY 1, 2)
SELECT story_id, deaths, round(c::DOUBLE, 6) AS deaths_confidence, outlets AS deaths_outlets FROM
  (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY c DESC NULLS LAST, outlets DESC, latest DESC, deaths DESC) AS n FROM g) WHERE n = 1""")
def a3_best_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rollup.best_value(rollup.eligible(_reports(spark, sf_dir)), "deaths", "confidence")
    return best.select("story_id", "deaths", F.round(F.col("deaths_confidence").cast("double"), 6).alias("deaths_confidence"), "deaths_outlets")


@query(f"""WITH {_REPORTS} SELECT story_id, min(published) AS first_published, max(published) AS last_published,
  CASE WHEN bool_or(source_key = 'purchase') THEN 'high' ELSE 'medium' END AS max_confidence FROM r GROUP BY 1""")
def a2_published_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir).drop("confidence").withColumn("confidence", F.when(F.col("source_key") == "purchase", "high").otherwise("medium"))
    return rollup.published_window(r).select("story_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_published", "last_published")], "max_confidence")


@query(f"""WITH {_REPORTS}, c AS (SELECT story_id, content_type, count(*) AS n FROM r WHERE content_type IS NOT NULL GROUP BY 1, 2)
SELECT story_id, content_type FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, content_type) AS k FROM c) WHERE k = 1""")
def a4_modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.modal_value(_reports(spark, sf_dir), "story_id", "content_type")


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT w)), ',') AS words FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1")
def a5_sorted_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_brand", F.split("p_type", " ").alias("words"))
    return rollup.sorted_union(parts, "p_brand", "words").select("p_brand", F.array_join("words", ",").alias("words"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 1 END, CASE WHEN o_orderkey % 2 = 0 THEN 2 END, o_custkey) END::BIGINT AS value,
  CASE WHEN o_orderstatus = 'F' THEN 'stored' WHEN o_orderkey % 3 = 0 THEN 'manual' WHEN o_orderkey % 2 = 0 THEN 'derived' ELSE 'stored' END AS origin FROM orders""")
def a6_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    locked, manual, derived = F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 3 == 0, 1), F.when(F.col("o_orderkey") % 2 == 0, 2)
    return o.select("o_orderkey", _n(rollup.precedence(locked, manual, derived, F.col("o_custkey"))).alias("value"), rollup.provenance(locked, manual, derived, F.lit("stored")).alias("origin"))


_LABELLED = "documents LEFT JOIN labels USING (doc_id)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query(f"""SELECT coalesce(sum(toxic) FILTER (lang <> 'es'), 0)::BIGINT AS deaths, coalesce(sum(quality) FILTER (lang <> 'es'), 0)::BIGINT AS injuries,
  count(*) FILTER (lang <> 'es' AND (toxic IS NOT NULL OR quality IS NOT NULL)) AS counted, count(*) FILTER (lang <> 'es' AND toxic IS NULL AND quality IS NULL) AS unknown, count(*) FILTER (lang = 'es') AS aggregate FROM {_LABELLED}""")
def a7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.totals(_labelled(spark, sf_dir), F.col("toxic"), F.col("quality"), F.col("lang") == "es")


@query(f"SELECT doc_id, CASE WHEN toxic > 0 THEN 'fatal' WHEN quality > 0 THEN 'injury' WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 'none' ELSE 'unknown' END AS state, coalesce(toxic::VARCHAR, 'ไม่ระบุ') AS label FROM {_LABELLED}")
def x30_state_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("doc_id", views.casualty_state(F.col("toxic"), F.col("quality")).alias("state"), views.count_label(F.col("toxic")).alias("label"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 5000 AND s_nationkey >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM supplier""")
def x29_story_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", views.story_confidence(F.when(F.col("s_acctbal") > 5000, "high").otherwise("medium"), F.col("s_nationkey")).alias("confidence"))


@query("""SELECT w AS region, count(*) AS stories, coalesce(sum(CASE WHEN p_size > 10 THEN p_size END), 0)::BIGINT AS deaths, count(*) FILTER (p_size <= 10) AS unknown
FROM (SELECT p_size, unnest(list_distinct(string_split(p_type, ' '))) AS w FROM part) GROUP BY 1 ORDER BY stories DESC, region LIMIT 10""")
def a9_region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.split("p_type", " ").alias("regions"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("deaths"))
    return views.region_stats(parts, "regions", F.col("deaths"))


@query("""WITH c AS (SELECT string_split(p_type, ' ')[1] AS region, count(*) AS stories FROM part GROUP BY 1)
SELECT region, stories, round(100.0 * stories / (SELECT sum(stories) FROM c))::BIGINT AS share FROM c ORDER BY stories DESC, region LIMIT 1""")
def a8_leading_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.leading_first(table(spark, sf_dir, "part").select(F.split("p_type", " ").alias("regions")), "regions")


@query(f"SELECT count(*) AS total, count(toxic) AS toxic_known, round(100.0 * count(toxic) / nullif(count(*), 0), 1) AS toxic_pct, count(quality) AS quality_known, round(100.0 * count(quality) / nullif(count(*), 0), 1) AS quality_pct FROM {_LABELLED}")
def a11_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.coverage(_labelled(spark, sf_dir), {"toxic": F.col("toxic"), "quality": F.col("quality")})


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def a12_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


_BEFORE, _AFTER = "CASE WHEN l_linenumber < 4 THEN l_linenumber END", "CASE WHEN l_quantity > 10 THEN (l_quantity::INT % 3) + 1 END"


def _readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    line = table(spark, sf_dir, "lineitem")
    return line, F.when(F.col("l_linenumber") < 4, F.col("l_linenumber")), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int") % 3 + 1)


@query(f"""WITH t AS (SELECT {_BEFORE} AS b, {_AFTER} AS a FROM lineitem)
SELECT CASE WHEN b IS NOT DISTINCT FROM a THEN 'same' WHEN b IS NULL THEN 'null->n' WHEN a IS NULL THEN 'n->null' ELSE 'n->n' END AS change, count(*) AS n FROM t GROUP BY 1""")
def a14_change_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, before, after = _readings(spark, sf_dir)
    return line.groupBy(views.change(before, after).alias("change")).agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT l_returnflag, {_BEFORE} AS e, {_AFTER} AS a FROM lineitem)
SELECT l_returnflag, CASE WHEN e IS NULL THEN 'unknown' WHEN e = 0 THEN 'zero' ELSE 'positive' END AS stratum, count(*) AS n, round(avg((e IS NOT DISTINCT FROM a)::INT), 6) AS exact,
  round(avg(abs(e - coalesce(a, 0))), 6) AS mae, count(*) FILTER (e IS NULL AND a IS NOT NULL) AS false_numbers FROM t GROUP BY 1, 2""")
def a15_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, expected, actual = _readings(spark, sf_dir)
    return views.accuracy(line, expected, actual, F.col("l_returnflag"))


@query(f"WITH t AS (SELECT {_BEFORE} AS b, {_AFTER} AS a FROM lineitem) SELECT count(*) AS n, count(*) FILTER (b IS DISTINCT FROM a) AS differ, round(100.0 * count(*) FILTER (b IS DISTINCT FROM a) / nullif(count(*), 0), 1) AS pct FROM t")
def a16_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, before, after = _readings(spark, sf_dir)
    differ = ~before.eqNullSafe(after)
    return line.agg(F.count("*").alias("n"), views.count_if(differ, "differ"), F.round(100.0 * F.count(F.when(differ, 1)) / F.nullif(F.count("*"), F.lit(0)), 1).alias("pct"))


@query("SELECT count(*) AS total, count(*) FILTER (c >= 2) AS corroborated FROM (SELECT user_id, count(DISTINCT lower(event_type)) AS c FROM events GROUP BY 1)")
def a10_corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct(F.lower("event_type")).alias("c"))
    return per.agg(F.count("*").alias("total"), views.count_if(F.col("c") >= 2, "corroborated"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def t1_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500")
def t3_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.page_after(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 500)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def t4_biggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS p, greatest(1, count(*) OVER () // 50) AS step FROM orders) WHERE p % step = 0 AND p < step * 50""")
def t6_systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return rows.systematic_sample(o, 50, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) = 1 AS featured FROM orders")
def t8_featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return rows.with_featured(o, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_orderkey", "featured")


@query("SELECT conv_id, arg_min(text, turn) FILTER (trim(text) <> '') AS snippet FROM conversations GROUP BY 1")
def t9_first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.min_by(F.when(F.trim("text") != "", F.col("text")), F.when(F.trim("text") != "", F.col("turn"))).alias("snippet"))


@query("""WITH u AS (SELECT o_custkey AS link, 0 AS priority, o_orderdate AS published, o_orderkey AS title FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 1, o_orderdate, o_orderkey FROM orders WHERE o_orderstatus <> 'O')
SELECT link::BIGINT AS link, priority, title AS o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY priority, published DESC NULLS LAST, title) AS r FROM u) WHERE r = 1""")
def s10_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as the first source, all others as the second; the customer is the link."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("link"), F.col("o_orderdate").alias("published"), F.col("o_orderkey").alias("title"), "o_orderstatus")
    both = feeds.united(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus != 'O'"))
    return both.select("link", "priority", F.col("title").alias("o_orderkey"))


@query("SELECT event_id FROM events WHERE (SELECT max(epoch_us(ts)) FROM events) - epoch_us(ts) <= 10 * 86400000000")
def s12_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("published"))
    now = e.agg(F.max("published").alias("m")).first()["m"]
    return feeds.recent(e, F.lit(now), 10).select("event_id")


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id, CASE WHEN (epoch_us(now) - epoch_us(ts)) / 60000000.0 <= 45 THEN 'fresh' WHEN (epoch_us(now) - epoch_us(ts)) / 60000000.0 <= 180 THEN 'late' ELSE 'stale' END AS state FROM events, m""")
def x33_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts").alias("m")).first()["m"]
    return e.select("event_id", views.freshness(F.col("ts"), F.lit(now)).alias("state"))


# Events as runs: purchases went well, every third has no end.
_RUNS = "r AS (SELECT event_id, ts, CASE WHEN event_id % 3 > 0 THEN ts END AS finished FROM events WHERE event_type = 'purchase')"


def _reader(spark: SparkSession, sf_dir: str) -> reader.Reader:
    """Customers as stories of their orders, events as runs."""
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    ts = F.col("ts").cast("timestamp")
    runs = e.select(F.col("event_id").alias("batch"), F.when(F.col("event_type") == "purchase", "ok").otherwise("error").alias("status"), ts.alias("started_at"), F.when(F.col("event_id") % 3 > 0, ts).alias("finished_at"), F.lit(0).alias("fetched"), F.lit(0).alias("new_stories"))
    articles = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("story_id"), F.col("o_orderdate").alias("published"))
    last = articles.groupBy("story_id").agg(F.max("published").alias("last_published"))
    stories = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("story_id"), F.col("c_name").alias("display_title")).join(last, "story_id", "left")
    return reader.Reader(stories, articles, runs)


@query(f"WITH {_RUNS} SELECT event_id, coalesce(finished, ts) AS finished_at FROM r ORDER BY finished DESC NULLS LAST, event_id DESC LIMIT 1")
def s16_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).last_run().select(F.col("batch").alias("event_id"), F.col("at").cast("timestamp_ntz").alias("finished_at"))


@query(f"""WITH {_RUNS}, l AS (SELECT coalesce(finished, ts) AS done FROM r ORDER BY finished DESC NULLS LAST, event_id DESC LIMIT 1), m AS (SELECT max(ts) AS now FROM events)
SELECT done AS finished_at, CASE WHEN (epoch_us(now) - epoch_us(done)) / 60000000.0 <= 45 THEN 'fresh' WHEN (epoch_us(now) - epoch_us(done)) / 60000000.0 <= 180 THEN 'late' ELSE 'stale' END AS state FROM l, m""")
def r8_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fresh the last run that went well is, at the time of the last event."""
    now = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("m")).first()["m"]
    return _reader(spark, sf_dir).freshness(F.lit(now)).select(F.col("at").cast("timestamp_ntz").alias("finished_at"), "state")


@query("""SELECT c_custkey AS story_id, c_name AS display_title, max(o_orderdate) AS last_published FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2
ORDER BY last_published DESC NULLS LAST, story_id DESC LIMIT 100""")
def s14_latest_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).latest()


@query(f"""
WITH t AS (SELECT doc_id, sha256(text) AS url, sha256({_match('text')}) AS title_key FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY doc_id) AS r FROM t),
s AS (SELECT doc_id AS id, url, title_key FROM n WHERE r = 1)
SELECT n.doc_id, coalesce((SELECT arg_min(id, id) FROM s WHERE s.url = n.url), (SELECT arg_min(id, id) FROM s WHERE s.title_key = n.title_key))::BIGINT AS owner FROM n WHERE r > 1""")
def w3_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document takes part: the first of each text key is stored, all others are rejected. The text as it is stands for the url."""
    keys = _whole(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("url"), F.sha2("text_key", 256).alias("title_key"))
    d = materialize(keys, "owner-keys")
    stored = d.groupBy("title_key").agg(F.min("doc_id").alias("id"), F.min_by("url", "doc_id").alias("url")).withColumn("story_id", F.col("id"))
    rejected = d.join(stored.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    return rows.owners(rejected, stored).select("doc_id", "owner")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def w4_not_orphaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("""SELECT event_id, try_cast(nullif(json_extract_string(props, '$.k'), '') AS INT) AS deaths, coalesce(nullif(json_extract_string(props, '$.scope'), ''), 'incident') AS scope FROM events""")
def w5_unpack_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.from_json("props", "k string, scope string")
    e = table(spark, sf_dir, "events").withColumn("f", facts)
    return e.select("event_id", F.nullif("f.k", F.lit("")).try_cast("int").alias("deaths"), F.coalesce(F.nullif("f.scope", F.lit("")), F.lit("incident")).alias("scope"))


@query("""WITH m AS (SELECT max(epoch_us(ts)) AS now FROM events) SELECT event_id, CASE WHEN event_type = 'view' AND now - epoch_us(ts) > 20 * 60000000 THEN 'timeout' WHEN event_type = 'view' THEN 'running' ELSE 'ok' END AS status FROM events, m""")
def w8_stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsgraph.streaming.ingest import swept

    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.when(F.col("event_type") == "view", "running").otherwise("ok").alias("status"))
    now = e.agg(F.max("started_at").alias("m")).first()["m"]
    return swept(e, F.lit(now)).select("event_id", "status")


@query("""WITH t AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN floor(value / 50)::INT END AS a, lag(CASE WHEN event_type <> 'error' THEN floor(value / 50)::INT END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN a = b THEN 'agree' ELSE 'conflict' END AS agreement FROM t""")
def g1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("a", F.when(F.col("event_type") != "error", F.floor(F.col("value") / 50).cast("int")))
    e = e.withColumn("b", F.lag("a").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("event_id", match.count_agreement(F.col("a"), F.col("b")).alias("agreement"))


@query("""WITH t AS (SELECT p_partkey, string_split(p_type, ' ') AS a, lead(string_split(p_type, ' ')) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
SELECT p_partkey, CASE WHEN b IS NULL THEN 'unknown' WHEN list_has_any(a, b) THEN 'agree' ELSE 'conflict' END AS agreement FROM t""")
def g2_region_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.split("p_type", " ").alias("a"))
    pairs = rows.following(p, "p_brand", "p_partkey").select("p_partkey", "following")
    p = pairs.join(p.select("p_partkey", "a"), "p_partkey").join(p.select(F.col("p_partkey").alias("following"), F.col("a").alias("b")), "following", "left")
    return p.select("p_partkey", match.region_agreement(F.col("a"), F.col("b")).alias("agreement"))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_custkey, o_orderdate AS at FROM orders),
e AS (SELECT l.id AS late, f.id AS early FROM o l JOIN o f ON l.o_custkey = f.o_custkey AND (f.at, f.id) < (l.at, l.id) AND epoch_us(l.at) - epoch_us(f.at) <= 14 * 86400000000),
r AS (SELECT late AS id, early AS met FROM e UNION SELECT r.id, e.early FROM r JOIN e ON e.late = r.met)
SELECT o.id, coalesce((SELECT arg_min(m.id, (m.at, m.id)) FROM r JOIN o m ON m.id = r.met WHERE r.id = o.id), o.id) AS cluster FROM o""")
def g7_greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer within the follow-up window are matches."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderdate").cast("timestamp").alias("published"))
    a, b = o.alias("a"), o.alias("b")
    near = match.days_apart(F.col("a.published"), F.col("b.published")) <= match.FOLLOW_UP_DAYS
    edges = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.id") < F.col("b.id")) & near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    return cluster.greedy_clusters(o.select("id", "published"), materialize(edges, "cluster-edges"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def r3_ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream through the ingestion sink, delivered twice; each counts once."""
    from newsgraph.streaming.ingest import ingest, stream_items

    events = table(spark, sf_dir, "events")
    landed, target = table_path(spark, "landed"), table_path(spark, "ingested")
    shared_dir(spark)
    schema = events.schema
    for run in range(2):
        events.write.mode("append").parquet(landed)
        ingest(stream_items(spark, landed, schema, "ts"), "event_id", "ts", "60 days", target, f"{target}-checkpoint").awaitTermination()
    stored = spark.read.parquet(target)
    return stored.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT event_id, floor(abs(value))::BIGINT AS deaths, CASE WHEN value IS NOT NULL THEN (event_id % 50)::BIGINT END AS injuries, CASE WHEN value IS NOT NULL THEN 'D1' END AS rule FROM events""")
def k15_casualties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the events written as headlines and read back."""
    count = lambda c: c.cast("long").cast("string")
    headline = F.concat(F.lit("เมาขับชนดับ "), count(F.floor(F.abs("value"))), F.lit(" ราย เจ็บ "), count(F.col("event_id") % 50), F.lit(" คน"))
    read = spread(table(spark, sf_dir, "events").select("event_id", headline.alias("title"))).select("event_id", read_casualties(F.col("title")).alias("r"))
    return read.select("event_id", F.col("r.deaths.value").alias("deaths"), F.col("r.injuries.value").alias("injuries"), F.col("r.deaths.rule").alias("rule"))


@query("SELECT rule, count(*) AS n FROM (SELECT unnest(['D1', 'I1']) AS rule FROM events WHERE value IS NOT NULL) GROUP BY 1")
def a14_rule_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by which the numbers of the events, written as headlines, were read."""
    count = lambda c: c.cast("long").cast("string")
    headline = F.concat(F.lit("เมาขับชนดับ "), count(F.floor(F.abs("value"))), F.lit(" ราย เจ็บ "), count(F.col("event_id") % 50), F.lit(" คน"))
    read = spread(table(spark, sf_dir, "events").select(headline.alias("title"))).select(read_casualties(F.col("title")).alias("r"))
    return views.rule_histogram(read, F.col("r.deaths.rule"), F.col("r.injuries.rule"))


@query("SELECT event_id, nullif(json_extract_string(props, '$.k')::BIGINT, 0) AS value FROM events")
def x3_number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the events written in words and read back; zero alone is no number."""
    k = F.get_json_object("props", "$.k").cast("int")
    digit = lambda n: F.element_at(F.array(*[F.lit(w) for w in ("", "หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า")]), n + 1)
    tens, ones = F.floor(k / 10).cast("int"), k % 10
    ten = F.when(tens == 0, "").when(tens == 1, "สิบ").when(tens == 2, "ยี่สิบ").otherwise(F.concat(digit(tens), F.lit("สิบ")))
    words = F.when(k == 0, "ศูนย์").otherwise(F.concat(ten, F.when((tens > 0) & (ones == 1), "เอ็ด").otherwise(digit(ones))))
    return table(spark, sf_dir, "events").select("event_id", number_of_words(words).alias("value"))
