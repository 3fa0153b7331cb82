"""Registered queries of entities, decisions over pairs, facts and reprocessing, each with its SQL.

The given tables hold no headlines: documents, part names and made-up texts of the events stand for
them, read with the sample word lists. The Thai lists are held against hand-made cases in the tests.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgraph.functions import text as X
from newsgraph.operators import attach, cluster, enrich, facts, ingest_batch, match, rows, similarity, views, within
from newsgraph.operators import entities as E
from newsgraph.operators.entities import SAMPLE
from newsgraph.plans.queries import ORACLE_SQL, query
from newsgraph.sources import feeds
from newsgraph.streaming import ingest
from newsgraph.tables import by_shuffle, materialize, spread, table, table_path

# SQL of the word-list functions, written out of the same lists.


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(t)})" for t in terms) + ")"


def _compact(items) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def _codes(text: str, codes: dict[str, tuple[str, ...]]) -> str:
    return _compact(f"CASE WHEN {_any(text, terms)} THEN {_q(code)} END" for code, terms in codes.items())


def _first_of_each(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def _replace(text: str, pairs) -> str:
    return reduce(lambda c, p: f"replace({c}, {_q(p[0])}, {_q(p[1])})", pairs, text)


def _title(text: str) -> str:
    return f"trim({_replace(_replace(text, E.title_symbols(SAMPLE)), [(f, '') for f in SAMPLE.filler])})"


def _regions(text: str) -> str:
    named = [*SAMPLE.areas.items(), *((p, SAMPLE.common_names.get(p, p)) for p in SAMPLE.provinces)]
    return _first_of_each(_compact(f"CASE WHEN contains({text}, {_q(t)}) THEN {_q(p)} END" for t, p in named))


def _vehicles(text: str) -> str:
    long, own = SAMPLE.blanked_vehicle
    codes = {c: (*t, E.BLANK) if c == own else t for c, t in SAMPLE.vehicles.items()}
    return f"list_sort({_codes(f'replace(lower({text}), {_q(long)}, {_q(E.BLANK)})', codes)})"


def _names(text: str) -> str:
    spans = []
    for a, b in SAMPLE.quotes:
        a, b = (f"\\{c}" if c in "()" else c for c in (a, b))
        spans.append(f"list_transform(regexp_extract_all({text}, {_q(f'{a}([^{a}{b}]{{2,25}}){b}')}, 1), lambda s: trim(s))")
    own = f"list_filter({' || '.join(spans)}, lambda s: NOT {_any('s', SAMPLE.quote_noise)} OR {_any('s', SAMPLE.honorifics)})"
    own = rf"list_transform({own}, lambda s: regexp_replace(s, '\s+', '', 'g'))"
    after = " || ".join(f"regexp_extract_all({text}, {_q(f'{h}([{SAMPLE.name_letters}]{{2,10}})')}, 1)" for h in sorted(SAMPLE.honorifics, key=len, reverse=True))
    starts = " OR ".join(f"starts_with(t, {_q(w)})" for w in SAMPLE.no_names)
    return _first_of_each(f"({own} || list_filter({after}, lambda t: NOT ({starts})))")


_LANDMARKS = {a: (a,) for a in SAMPLE.areas if a not in SAMPLE.hints}


def _nationalities(text: str) -> str:
    return _codes(_replace(text, [(t, E.BLANK) for t in SAMPLE.no_nationalities]), SAMPLE.nationalities)


def _entities(text: str, deaths: str) -> str:
    """List of structs (k, w, r), without ages and injuries, which the given texts don't hold."""
    kinds = [
        ("landmark", _codes(text, _LANDMARKS)), ("name", "names"), ("marque", _codes(f"lower({text})", SAMPLE.marques)), ("role", _codes(text, SAMPLE.roles)), ("nationality", _nationalities(text)),
        ("province", "provinces"), ("vehicle", _vehicles(text)), ("who", _codes(text, SAMPLE.generic_roles)), ("deaths", _compact([f"{deaths}::VARCHAR"])),
    ]
    return " || ".join(f"list_transform({values}, lambda v: {{'k': '{kind}:' || v, 'w': {E.WEIGHTS[kind][0]}::DOUBLE, 'r': {E.WEIGHTS[kind][1]}}})" for kind, values in kinds)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text"))


def _joined(items: Column) -> Column:
    return F.array_join(items, ",")


def _word_list_query(name: str, sql: str, column) -> None:
    """A query of one function over whole documents; lists are comma-joined."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _documents(spark, sf_dir).select("doc_id", column(F.col("text")).alias("found"))

    run.__name__, run.__doc__ = name, f"{name} of whole documents with the sample lists."
    query(f"SELECT doc_id, {sql} AS found FROM documents")(run)


def _sql_joined(items: str) -> str:
    return f"array_to_string({items}, ',')"


_word_list_query("x7_story_title", f"md5({_title('text')})", lambda t: F.md5(E.story_title(t, SAMPLE)))
_word_list_query("x9_regions", _sql_joined(_regions("text")), lambda t: _joined(E.regions(t, SAMPLE)))
_word_list_query("x10_vehicles", _sql_joined(_vehicles("text")), lambda t: E.vehicle_signature(t, SAMPLE))
_word_list_query("x11_marques", _sql_joined(_codes("lower(text)", SAMPLE.marques)), lambda t: _joined(E.marques(t, SAMPLE)))
_word_list_query("x13_landmarks", _sql_joined(_codes("text", _LANDMARKS)), lambda t: _joined(E.landmarks(t, SAMPLE)))
_word_list_query("x16_names", _sql_joined(_names("text")), lambda t: _joined(E.names(t, SAMPLE)))
_word_list_query("x17_roles", f"{_sql_joined(_codes('text', SAMPLE.roles))} || '/' || {_sql_joined(_nationalities('text'))}", lambda t: F.concat_ws("/", _joined(E.codes_in(t, SAMPLE.roles)), _joined(E.nationalities(t, SAMPLE))))
_CATEGORIES = {"car": ("ent", "ver"), "bike": ("qu",), "police": ("ish",)}
_word_list_query("x34_category", f"coalesce(({_codes('lower(text)', _CATEGORIES)})[1], 'other')", lambda t: enrich.category(t, _CATEGORIES))

_ENTITY_ROWS = f"""t AS (SELECT doc_id, source, text, doc_id % 3 AS deaths, {_regions('text')} AS provinces, {_names('text')} AS names FROM documents),
e AS (SELECT doc_id, source, {_entities('text', 'deaths')} AS entities FROM t)"""


def _with_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", (F.col("doc_id") % 3).alias("deaths"))
    found = E.entities(F.regexp_replace("text", "ปี", ""), E.regions(F.col("text"), SAMPLE), F.col("deaths"), F.lit(None).cast("long"), SAMPLE)
    return docs.select("doc_id", "source", found.alias("entities"))


@query(f"WITH {_ENTITY_ROWS} SELECT doc_id, array_to_string(list_transform(entities, lambda e: e.k), ',') AS keys, round(list_sum(list_transform(entities, lambda e: e.w)), 2) AS weight FROM e")
def g4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_entities(spark, sf_dir)
    return e.select("doc_id", _joined(F.transform("entities", lambda x: x["key"])).alias("keys"), F.round(F.aggregate("entities", F.lit(0.0), lambda s, x: s + x["weight"]), 2).alias("weight"))


@query(f"""WITH {_ENTITY_ROWS}, p AS (SELECT doc_id, entities AS a, lead(entities) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM e),
s AS (SELECT doc_id, list_filter(a, lambda x: list_contains(list_transform(b, lambda y: y.k), x.k)) AS shared FROM p WHERE b IS NOT NULL)
SELECT doc_id, round(coalesce(list_sum(list_transform(shared, lambda x: x.w)), 0.0), 2) AS score, len(list_filter(shared, lambda x: x.r))::BIGINT AS rare FROM s""")
def g5_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the next one of its source."""
    e = materialize(_with_entities(spark, sf_dir), "entities")
    pairs = rows.following(e, "source", "doc_id").filter("following IS NOT NULL").select("doc_id", "following")
    both = pairs.join(by_shuffle(e.select("doc_id", "entities")), "doc_id").join(by_shuffle(e.select(F.col("doc_id").alias("following"), F.col("entities").alias("next"))), "following")
    return both.withColumn("o", match.entity_overlap(F.col("entities"), F.col("next"))).select("doc_id", "o.score", F.col("o.rare").cast("long").alias("rare"))


# Part names as headlines; brands as sources, an hour a part.
_PART_ROWS = f"""r AS (SELECT p_partkey AS id, p_brand, p_name AS text, {_title('p_name')} AS title, {_regions('p_name')} AS provinces, {_names('p_name')} AS names, {_vehicles('p_name')} AS vehicles,
    CASE WHEN p_size % 4 > 0 THEN p_size % 4 END AS deaths FROM part),
f AS (SELECT *, {_entities('text', 'deaths')} AS entities, [substr(lower(title), i, 2) FOR i IN range(1, length(title))] AS grams FROM r),
n AS (SELECT a.id AS a_id, b.id AS b_id, b.place - a.place AS rank, {{cols}} FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY id) AS place FROM f) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY id) AS place FROM f) b ON a.p_brand = b.p_brand AND b.place BETWEEN a.place + 1 AND a.place + 3),
v AS (SELECT a_id, b_id, rank,
    CASE WHEN length(a_t) < 2 OR length(b_t) < 2 THEN 0.0 ELSE 2.0 * coalesce(list_sum([least(len(list_filter(a_g, lambda x: x = u)), len(list_filter(b_g, lambda x: x = u))) FOR u IN list_distinct(a_g)]), 0) / (length(a_t) + length(b_t) - 2) END AS sim,
    len(a_v) > 0 AND a_v = b_v AS same_vehicles, CASE WHEN len(a_p) = 0 OR len(b_p) = 0 THEN 'unknown' WHEN list_has_any(a_p, b_p) THEN 'agree' ELSE 'conflict' END AS regions,
    CASE WHEN a_d IS NULL OR b_d IS NULL THEN 'unknown' WHEN a_d = b_d THEN 'agree' ELSE 'conflict' END AS toll, a_d IS NOT NULL AS known, abs(a_id - b_id) / 24.0 AS days,
    round(coalesce(list_sum(list_transform(list_filter(a_e, lambda x: list_contains(list_transform(b_e, lambda y: y.k), x.k)), lambda x: x.w)), 0.0), 2) AS score,
    len(list_filter(a_e, lambda x: x.r AND list_contains(list_transform(b_e, lambda y: y.k), x.k))) AS rare FROM n),
d AS (SELECT a_id, b_id, rank, CASE WHEN regions = 'conflict' THEN false WHEN toll = 'conflict' THEN sim >= 0.85 AND same_vehicles AND days * 24 <= 24
    WHEN sim < 0.35 THEN rare >= 1 AND score >= 4 WHEN days > 3 THEN (toll = 'agree' AND known AND same_vehicles) OR (rare >= 1 AND score >= 4)
    WHEN regions = 'unknown' THEN (toll = 'agree' AND known AND same_vehicles) OR sim >= 0.85 OR (rare >= 1 AND score >= 4) OR (rare >= 1 AND score >= 2 AND sim >= 0.72)
    ELSE same_vehicles OR sim >= 0.85 OR (rare >= 1 AND score >= 4) OR (rare >= 1 AND score >= 2 AND sim >= 0.72) END AS same FROM v)""".replace(
    "{cols}", ", ".join(f"{s}.{c} AS {s}_{k}" for s in "ab" for c, k in (("title", "t"), ("grams", "g"), ("provinces", "p"), ("vehicles", "v"), ("deaths", "d"), ("entities", "e")))
)


def _part_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reports with features, candidates): each part with the next three of its brand."""
    part = table(spark, sf_dir, "part")
    toll = F.when(F.col("p_size") % 4 > 0, (F.col("p_size") % 4).cast("long"))
    own = match.features(F.col("p_name"), E.regions(F.col("p_name"), SAMPLE), toll, F.lit(None).cast("long"), F.timestamp_seconds(F.col("p_partkey") * 3600), SAMPLE)
    reports = materialize(part.select(F.col("p_partkey").alias("id"), own.alias("features")), "reports")
    by_brand = Window.partitionBy("p_brand").orderBy("p_partkey")
    ahead = part.select("p_partkey", F.array(*(F.lead("p_partkey", k).over(by_brand) for k in (1, 2, 3))).alias("ahead"))
    following = ahead.select(F.col("p_partkey").alias("left_id"), F.posexplode("ahead").alias("rank", "right_id"))
    return reports, following.filter("right_id IS NOT NULL").select("left_id", "right_id", (F.col("rank") + 1).alias("rank"))


@query(f"WITH {_PART_ROWS} SELECT a_id, b_id, same FROM d")
def g6_same_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, candidates = _part_pairs(spark, sf_dir)
    pairs = candidates.join(by_shuffle(reports.select(F.col("id").alias("left_id"), F.col("features").alias("a"))), "left_id")
    pairs = pairs.join(by_shuffle(reports.select(F.col("id").alias("right_id"), F.col("features").alias("b"))), "right_id")
    return pairs.select(F.col("left_id").alias("a_id"), F.col("right_id").alias("b_id"), match.tell_same_event(F.col("a"), F.col("b")).alias("same"))


@query(f"WITH {_PART_ROWS} SELECT a_id AS left_id, arg_min(b_id, rank) AS right_id FROM d WHERE same GROUP BY 1")
def j7_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, candidates = _part_pairs(spark, sf_dir)
    return match.first_match(candidates, reports, reports)


# The same decision over all parts within the follow-up window, six hours a part, whatever their brand.
_WINDOW_ROWS = re.sub(r"b\.place - a\.place AS rank, (.*?) FROM \(SELECT.*?a\.place \+ 3\)", r"0 AS rank, \1 FROM f a JOIN f b ON a.id < b.id AND b.id - a.id <= 56)", _PART_ROWS, flags=re.DOTALL).replace("/ 24.0 AS days", "/ 4.0 AS days")


@query(f"WITH {_WINDOW_ROWS} SELECT a_id, b_id FROM d WHERE same")
def j8_matches_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts that tell of one event within 14 days, without a key that they must share."""
    part = spread(table(spark, sf_dir, "part"))
    at = F.timestamp_seconds(F.col("p_partkey") * 21_600)
    toll = F.when(F.col("p_size") % 4 > 0, (F.col("p_size") % 4).cast("long"))
    own = match.features(F.col("p_name"), E.regions(F.col("p_name"), SAMPLE), toll, F.lit(None).cast("long"), at, SAMPLE)
    return within.matches_within(part.select(F.col("p_partkey").alias("id"), at.alias("published"), own.alias("features")))


# Events as articles: a user's events are one story; k is the number in props.
_K = "json_extract_string(props, '$.k')::INT"


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("story_id"), F.col("ts").cast("timestamp").alias("published"), (k % 3).alias("extractor_version"), k.alias("k"),
        F.when(k % 2 == 0, "regex").otherwise("llm").alias("extractor"), (F.col("event_type") == "view").alias("aggregator"), F.floor("value").cast("long").alias("value"),
    )


@query(f"SELECT event_id AS id FROM events WHERE {_K} % 3 < 2 AND {_K} % 2 = 0 AND ts >= TIMESTAMP '2024-01-02'")
def c10_to_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.to_reprocess(_articles(spark, sf_dir), 2, since=F.lit("2024-01-02").cast("timestamp"), by_rule_only=True).select("id")


@query(f"SELECT event_id AS id FROM events WHERE {_K} % 2 = 0 ORDER BY ts DESC, event_id LIMIT 40")
def c15_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.pending(_articles(spark, sf_dir), 40).select("id")


@query("""SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 3000 AND c_custkey % 7 <> 0 AND o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 30""")
def c11_to_refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("story_id"), F.when(F.col("c_acctbal") >= 3000, 1).alias("deaths"), (F.col("c_custkey") % 7 == 0).alias("casualties_locked"))
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("story_id"), F.col("o_orderdate").alias("published"), (F.col("o_orderstatus") == "P").alias("aggregator"))
    return enrich.to_refetch(articles, stories, 30).select("id")


@query(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 AND regexp_matches(text, 'ing|ung') THEN 'missed' END, CASE WHEN regexp_matches(rtrim(text), '(…|\.\.\.)$') THEN 'truncated' END,
    CASE WHEN regexp_matches(text, 'mente|ous') THEN 'false-friend' END], lambda x: x IS NOT NULL), ',') AS buckets FROM documents""")
def c12_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    toll = F.when(F.col("doc_id") % 2 == 1, 1)
    found = enrich.buckets(F.col("text"), F.lit(None).cast("string"), toll, toll, "ing|ung", "mente|ous")
    return table(spark, sf_dir, "documents").select("doc_id", _joined(found).alias("buckets"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, 'mente|ous') ORDER BY length(text) DESC, doc_id LIMIT 25")
def t7_newest_of_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length stands for the time of publication."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike("mente|ous")).withColumn("length", F.length("text"))
    return rows.newest(docs, 25, "length", "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 30")
def t5_random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.random_sample(table(spark, sf_dir, "documents").select("doc_id"), 30, 7, F.col("doc_id"))


@query(f"SELECT event_id AS id, CASE WHEN {_K} % 5 = 0 THEN true ELSE coalesce({_K} / 100.0, 0) < 0.7 END AS needed FROM events")
def c14_needs_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    return a.select("id", enrich.needs_body(F.when(F.col("k") % 5 != 0, 1), F.col("k") / 100.0).alias("needed"))


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a sent text and a stored extraction of it; some are wrong in one way or another."""
    a = _articles(spark, sf_dir)
    value = F.when(F.col("k") % 7 == 0, None).when(F.col("k") % 11 == 0, F.lit(900)).otherwise(F.col("k"))
    basis = F.when(F.col("k") % 3 == 0, "not_mentioned").when(F.col("k") % 3 == 1, "stated").otherwise("implied")
    quote = F.when(F.col("k") % 4 == 0, "absent").otherwise(F.concat(F.lit("k"), F.col("k").cast("string")))
    count = F.struct(value.cast("double").alias("value"), basis.alias("basis"), quote.alias("quote"))
    none = F.struct(F.lit(None).cast("double").alias("value"), F.lit("not_mentioned").alias("basis"), F.lit(None).cast("string").alias("quote"))
    body = F.struct(count.alias("deaths"), none.alias("injuries"), F.array(F.lit("p1"), F.lit("p9")).alias("provinces"), F.lit("statistics_roundup").alias("content_type"), F.when(F.col("k") % 2 == 0, "high").otherwise("low").alias("confidence"))
    return a.withColumn("sent", F.concat(F.lit("text k"), F.col("k").cast("string"))).withColumn("payload", F.when(F.col("k") % 13 == 0, "{broken").otherwise(F.to_json(body)))


_VALID = """p AS (SELECT event_id AS id, k, floor(value)::BIGINT AS own, k % 13 > 0 AND (k % 7 = 0 OR (k % 3 > 0 AND k % 11 > 0 AND (k % 3 <> 1 OR k % 4 <> 0))) AS valid,
    CASE WHEN k % 7 > 0 THEN k::BIGINT END AS found FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))"""


@query(f"WITH {_VALID} SELECT id, valid, CASE WHEN valid THEN found END AS deaths, CASE WHEN valid THEN 'p1' END AS provinces FROM p")
def l2_checked_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _payload(spark, sf_dir).withColumn("x", enrich.checked_extraction(F.col("payload"), F.col("sent"), ("p1", "p2")))
    return found.select("id", F.col("x").isNotNull().alias("valid"), F.col("x.deaths.value").cast("long").alias("deaths"), _joined(F.col("x.provinces")).alias("provinces"))


@query(f"""WITH {_VALID} SELECT id, CASE WHEN valid THEN found ELSE own END AS deaths, CASE WHEN valid AND found IS NULL THEN NULL WHEN valid THEN CASE WHEN k % 2 = 0 THEN 0.95 ELSE 0.4 END ELSE 0.9 END::DOUBLE AS confidence,
    CASE WHEN valid THEN 'aggregate' ELSE 'incident' END AS scope, CASE WHEN valid THEN 'llm' ELSE 'regex' END AS extractor FROM p WHERE own >= 0""")
def l5_merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines of the events' values, with extractions that count where they hold."""
    headline = F.concat(F.lit("เมาขับชนดับ "), F.col("value").cast("string"), F.lit(" ราย"))
    p = spread(_payload(spark, sf_dir)).filter("value >= 0").withColumn("x", enrich.checked_extraction(F.col("payload"), F.col("sent"), ("p1", "p2")))
    p = p.withColumn("f", enrich.merged_facts(enrich.article_facts(headline), F.col("x"), F.col("payload"), True, "stored"))
    return p.select("id", "f.deaths", F.round(F.col("f.deaths_confidence").cast("double"), 4).alias("confidence"), F.col("f.casualty_scope").alias("scope"), "f.extractor")


@query("""SELECT event_id AS id, floor(value)::BIGINT AS deaths, 0.9::DOUBLE AS confidence, 'title' AS field, 'ตาก' AS provinces, 1 AS extractor_version FROM events WHERE value >= 0""")
def k17_article_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    headline = F.concat(F.lit("เมาขับชนดับ "), F.col("value").cast("string"), F.lit(" ราย"))
    a = _articles(spark, sf_dir).filter("value >= 0").withColumn("f", enrich.article_facts(headline, F.lit("ตาก")))
    return a.select("id", "f.deaths", F.round(F.col("f.deaths_confidence").cast("double"), 4).alias("confidence"), F.col("f.casualty_field").alias("field"), _joined(F.col("f.article_provinces")).alias("provinces"), "f.extractor_version")


@query("SELECT c_custkey AS story_id, c_name, array_to_string((SELECT list(o_orderkey ORDER BY o_orderdate, o_orderkey) FROM orders WHERE o_custkey = c_custkey), ',') AS articles FROM customer WHERE c_custkey = 7")
def s15_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("story_id"), "c_name")
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("story_id"), F.col("o_orderdate").alias("published"))
    found = enrich.story_with_articles(stories, articles, "7")
    return found.select("story_id", "c_name", F.nullif(_joined(F.col("articles").cast("array<string>")), F.lit("")).alias("articles"))


@query(f"SELECT coalesce(via, 'none') AS via, count(*) AS n, count(*) FILTER (contains(body, 'the')) AS improved FROM ({ORACLE_SQL['x25_article_body']}) GROUP BY 1")
def a17_body_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsgraph.plans.queries import x25_article_body

    return views.body_sources(x25_article_body(spark, sf_dir), F.col("via"), F.contains("body", F.lit("the")))


@query("SELECT o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def j5_first_title_of_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.first_wins(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], F.col("o_orderkey")).select(F.col("o_orderkey").alias("id"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS story_id, o_custkey // 10 AS parent_id, o_orderpriority AS title_key FROM orders),
m AS (SELECT *, row_number() OVER (PARTITION BY parent_id, title_key ORDER BY id) AS r FROM o WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.story_id = o.parent_id AND p.title_key = o.title_key))
SELECT o.id, CASE WHEN m.r = 1 THEN m.parent_id ELSE o.story_id END AS story_id FROM o LEFT JOIN m USING (id)""")
def j9_reassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of ten customers fold into one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("story_id"), F.floor(F.col("o_custkey") / 10).alias("parent_id"), F.col("o_orderpriority").alias("title_key"))
    return rows.reassigned(o, o.select("story_id", "title_key"))


_URL_GRAMS = "list_distinct([substr('  ' || lower(regexp_replace(url, '[^a-zA-Z0-9]', '', 'g')) || ' ', i, 3) FOR i IN range(1, length(regexp_replace(url, '[^a-zA-Z0-9]', '', 'g')) + 2)])"


@query(f"""WITH t AS (SELECT page_id AS id, page_id * 3600 AS at, CASE WHEN page_id % 9 > 0 THEN page_id % 9 END AS region, {_URL_GRAMS} AS g FROM pages),
p AS (SELECT a.id AS left_id, b.id AS right_id, a.region = b.region AS near, (len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))))::FLOAT AS s FROM t a JOIN t b ON a.id <> b.id AND b.at >= a.at - 14 * 86400)
SELECT left_id, right_id, round(s::DOUBLE, 5) AS similarity, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY s DESC, right_id) AS r FROM p WHERE s >= 0.35::FLOAT OR near) WHERE r <= 60""")
def j6_story_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as titles, an hour a page, nine regions of which one is unknown."""
    region = F.when(F.col("page_id") % 9 > 0, (F.col("page_id") % 9).cast("string"))
    grams = X.trigrams(F.regexp_replace("url", "[^a-zA-Z0-9]", ""))
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url")).select(F.col("page_id").alias("id"), F.timestamp_seconds(F.col("page_id") * 3600).alias("published"), F.array_compact(F.array(region)).alias("regions"), grams.alias("grams"))
    pages = materialize(pages, "candidate-pages")
    found = similarity.story_candidates(pages, pages, 0.35, 60, match.FOLLOW_UP_DAYS)
    return found.select("left_id", "right_id", F.round(F.col("similarity").cast("double"), 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH RECURSIVE {_PART_ROWS}, m AS MATERIALIZED (SELECT b_id AS l, a_id AS e, rank AS k FROM d WHERE same),
s AS MATERIALIZED (SELECT p_brand, id, row_number() OVER (PARTITION BY p_brand ORDER BY id) AS place, (SELECT list(e ORDER BY k) FROM m WHERE l = id) AS near FROM r),
w(p_brand, place, id, founders, story) AS (
    SELECT p_brand, place, id, [id], id FROM s WHERE place = 1
    UNION ALL SELECT s.p_brand, s.place, s.id, CASE WHEN len(list_intersect(s.near, w.founders)) > 0 THEN w.founders ELSE list_append(w.founders, s.id) END,
        coalesce(list_filter(s.near, lambda x: list_contains(w.founders, x))[1], s.id) FROM w JOIN s ON s.p_brand = w.p_brand AND s.place = w.place + 1)
SELECT id, story, id = story AS is_new FROM w""")
def g9_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as reports in order of their keys, each with the three before it of its brand as matches."""
    reports, candidates = _part_pairs(spark, sf_dir)
    same = match.matching(candidates, reports, reports).select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), F.lit(False).alias("stored"), "rank")
    return attach.attached(reports.select("id", F.col("id").alias("place")), materialize(same, "matches"))


@query(f"""WITH {_PART_ROWS}, p AS (SELECT p_brand, min(id) AS parent, count(*) AS size, arg_min(entities, id) AS pe FROM f GROUP BY 1 HAVING count(*) > 1)
SELECT parent, id, size, array_to_string(list_filter(list_transform(pe, lambda x: x.k), lambda k: list_contains(list_transform(entities, lambda y: y.k), k)), ',') AS shared FROM f JOIN p USING (p_brand)""")
def g8_folded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as clusters of parts, an hour a part."""
    reports, _ = _part_pairs(spark, sf_dir)
    clusters = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster"))
    found = cluster.folded_groups(clusters, reports.withColumn("published", F.timestamp_seconds(F.col("id") * 3600)))
    return found.withColumn("shared", _joined(F.col("shared")))


@query("""WITH b AS (SELECT o_orderkey AS place, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS given, 'n' || (o_orderkey % 700) AS norm, 't' || (o_orderkey % 401) AS title_key, 'u' || (o_orderkey % 1201) AS url FROM orders WHERE o_orderkey % 4 = 0),
h AS (SELECT o_orderkey AS id, o_custkey AS story_id, 't' || (o_orderkey % 401) AS title_key, CASE WHEN o_orderkey < 1000 THEN 'u' || o_orderkey ELSE 's' || o_orderkey END AS url FROM orders WHERE o_orderkey % 4 > 0),
u AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY url ORDER BY place) = 1), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY place) = 1),
t AS (SELECT k.*, coalesce(given, c.c_custkey) AS told FROM k LEFT JOIN customer c ON 'n' || c.c_custkey = k.norm WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.url = k.url)),
f AS (SELECT *, coalesce(told, (SELECT max(c_custkey) FROM customer) + 1 + min(place) FILTER (WHERE told IS NULL) OVER (PARTITION BY norm)) AS story FROM t),
i AS (SELECT *, NOT EXISTS (SELECT 1 FROM h WHERE h.story_id = f.story AND h.title_key = f.title_key) AS inserted FROM f)
SELECT place, url, CASE WHEN inserted THEN story ELSE (SELECT arg_min(h.story_id, h.id) FROM h WHERE h.title_key = i.title_key) END AS story_id, inserted, inserted AND given IS NOT NULL AS matched FROM i""")
def w2_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stories, three quarters of the orders as their articles, the others as a batch of reports."""
    key, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    named = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    own = {"source_key": F.col("o_orderpriority"), "aggregator": F.col("o_orderstatus") == "P", "published": F.col("o_orderdate").cast("timestamp"), "deaths": key % 5, "deaths_confidence": F.lit(0.5), "title_key": named("t", key % 401)}
    typed = lambda df, schema: spark.createDataFrame([], schema).unionByName(df, allowMissingColumns=True)
    batch = o.filter(key % 4 == 0).select(key.alias("place"), F.when(key % 3 == 0, F.col("o_custkey")).alias("story_id"), named("n", key % 700).alias("norm_title"), named("u", key % 1201).alias("url"), *(c.alias(n) for n, c in own.items()))
    url = F.when(key < 1000, named("u", key)).otherwise(named("s", key))
    articles = o.filter(key % 4 > 0).select(key.alias("id"), F.col("o_custkey").alias("story_id"), url.alias("url"), *(c.alias(n) for n, c in own.items()))
    stories = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("story_id"), named("n", F.col("c_custkey")).alias("norm_title"))
    return ingest_batch.ingest(typed(batch, ingest_batch.REPORT), typed(stories, ingest_batch.STORY), typed(articles, ingest_batch.ARTICLE)).outcomes


def _sql_best(count: str, confidence: str) -> str:
    """Best value of a story over the told rows t."""
    return f"""(SELECT story_id, arg_max({{'v': {count}, 'c': c, 'llm': llm}}, (coalesce(c, -1), outlets, latest, {count})) AS b FROM (
        SELECT story_id, {count}, max({confidence}) AS c, count(DISTINCT event_type) AS outlets, max(ts) AS latest, bool_or(llm) AS llm FROM t WHERE {count} IS NOT NULL AND (event_type <> 'view' OR story_id NOT IN (SELECT story_id FROM t WHERE event_type <> 'view')) GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH e AS (SELECT user_id AS story_id, event_type, ts, {_K} AS k, CASE WHEN event_type <> 'error' THEN floor(abs(value))::BIGINT END + CASE WHEN {_K} % 3 = 1 THEN 1 ELSE 0 END AS deaths, {_K}::BIGINT % 5 AS injuries, ({_K} / 100.0)::FLOAT AS c, {_K} % 4 = 0 AS llm,
    CASE WHEN {_K} % 11 = 0 THEN 'campaign' WHEN {_K} % 2 = 0 THEN 'news' END AS content_type FROM events),
t AS (SELECT * FROM e WHERE k % 7 > 0 AND k % 13 > 0 AND coalesce(content_type, '') <> 'campaign'),
n AS (SELECT story_id, content_type FROM (SELECT story_id, content_type, row_number() OVER (PARTITION BY story_id ORDER BY count(*) DESC, content_type) AS r FROM e WHERE content_type IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
p AS (SELECT story_id, string_agg(DISTINCT 'p' || (k % 4), ',' ORDER BY 'p' || (k % 4)) AS provinces FROM e GROUP BY 1)
SELECT p.story_id, d.b.v AS deaths, round(d.b.c::DOUBLE, 6) AS deaths_confidence, CASE WHEN d.b.v IS NULL THEN NULL WHEN d.b.llm THEN 'llm' ELSE 'regex' END AS deaths_source, i.b.v AS injuries, n.content_type, p.provinces
FROM p LEFT JOIN {_sql_best('deaths', 'c')} d USING (story_id) LEFT JOIN {_sql_best('injuries', '0.5::FLOAT')} i USING (story_id) LEFT JOIN n USING (story_id) WHERE p.story_id % 10 > 0""")
def w5_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as articles of their users' stories: facts for all, then others for two thirds of them; stories summed up from what changed."""
    k, col = F.get_json_object("props", "$.k").cast("int"), F.col
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), col("event_id").cast("string")).alias("url"), col("user_id").alias("story_id"), col("event_type").alias("source_key"), (col("event_type") == "view").alias("aggregator"), col("ts").cast("timestamp").alias("published"),
        k.alias("k"), F.when(col("event_type") != "error", F.floor(F.abs("value"))).alias("value"),
    )
    e = materialize(e, "upsert-events")

    def told(place: int, more: int) -> DataFrame:
        text = lambda c: c.cast("string")
        found = F.struct(
            F.coalesce(text(col("value") + more), F.lit("")).alias("deaths"), text(col("k") % 5).alias("injuries"), text(col("k") / 100.0).alias("deaths_confidence"), F.lit("0.5").alias("injuries_confidence"),
            F.when(col("k") % 7 == 0, "aggregate").alias("casualty_scope"), F.when(col("k") % 11 == 0, "campaign").when(col("k") % 2 == 0, "news").alias("content_type"), F.when(col("k") % 13 == 0, "low").alias("extract_confidence"),
            F.array(F.concat(F.lit("p"), text(col("k") % 4))).alias("article_provinces"), F.when(col("k") % 4 == 0, "llm").alias("extractor"),
        )
        return e.select("url", F.lit(place).alias("place"), F.to_json(found).alias("facts"))

    articles = e.select("url", "story_id", "source_key", "aggregator", "published", *[F.lit(facts.DEFAULTS.get(n)).cast(t).alias(n) for n, t in facts.fields(facts.FACTS)])
    nothing = "deaths long, injuries long, deaths_manual long, injuries_manual long, deaths_confidence float, injuries_confidence float, deaths_source string, injuries_source string, content_type string, provinces array<string>"
    stories = e.select("story_id", (col("story_id") % 10 == 0).alias("casualties_locked")).distinct().select("*", *[F.lit(None).cast(t).alias(n) for n, t in facts.fields(nothing)])
    first = facts.upserted(articles, stories, facts.evidence(articles), told(0, 1))
    second = facts.upserted(first.articles, first.stories, first.evidence, told(1, 0).join(e.filter("k % 3 != 1").select("url"), "url"))
    whole = first.stories.join(second.stories.select("story_id"), "story_id", "left_anti").unionByName(second.stories)
    return whole.select("story_id", "deaths", F.round(col("deaths_confidence").cast("double"), 6).alias("deaths_confidence"), "deaths_source", "injuries", "content_type", _joined(col("provinces")).alias("provinces"))


@query("""WITH g AS (SELECT user_id AS story_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 86400000000, true) AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY story_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS span FROM g)
SELECT story_id, min(ts) AS first_published, max(ts) AS last_published, count(*) AS reports FROM s GROUP BY story_id, span""")
def r4_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of reports of their users' stories, with a horizon of a day; a report years later lets time pass."""
    landed, target = table_path(spark, "activity-landed"), table_path(spark, "activity")
    reports = table(spark, sf_dir, "events").select(F.col("user_id").alias("story_id"), F.col("ts").cast("timestamp").alias("published"))
    last = reports.agg(F.lit(-1).cast(dict(reports.dtypes)["story_id"]).alias("story_id"), (F.max("published") + F.expr("INTERVAL 1000 DAYS")).alias("published"))
    for part in (reports, last):
        part.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(reports.schema).parquet(landed)
        ingest.record(ingest.activity(stream, "1 day", "1 hour"), target, f"{target}-checkpoint").awaitTermination()
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_published", "last_published")]
    return ingest.recorded(spark, target).filter("story_id >= 0").select("story_id", *times, "reports")


@query("SELECT url AS link, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS source, 'page ' || page_id AS summary FROM pages")
def s1_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses written as RSS feeds and read back."""
    path = table_path(spark, "feeds")
    items = table(spark, sf_dir, "pages").select(F.col("url").alias("title"), F.col("url").alias("link"), F.concat(F.lit("<p>page "), F.col("page_id").cast("string"), F.lit("</p>")).alias("description"))
    items.write.format("xml").option("rootTag", "channel").option("rowTag", feeds.RSS).save(path)
    return feeds.direct_items(feeds.usable(feeds.read_feeds(spark, path))).select("link", "source", "summary")
