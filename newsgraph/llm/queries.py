"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.llm import alignment, bpe, clustering, exact_search, graph_search, licences, mixing, near_duplicates, pii, recursive_bpe, toxicity, training_order, warc
from newsgraph.tables import materialize, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's sequences, written to shards in training order and read back."""
    return training_order.read_from(training_order.write_shards(table(spark, sf_dir, "documents"), TOKENIZER)).drop("ids")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text, decode the ids again, and digest both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, TOKENIZER)
    kept = ids.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    return bpe.decode(kept, TOKENIZER).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence places and labels of every whole text."""
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every twentieth vector."""
    return graph_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best by integer inner product of every fiftieth vector."""
    return exact_search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text; a fifth of the labels is held out by a hash of doc_id."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels"), ~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the whole table at similarity 0.85."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole text, base kinds first."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to an archive and read all records back by the capture index."""
    pages = table(spark, sf_dir, "pages")
    archives = warc.write_archives(pages, min_bytes=0)
    captures = warc.lookup(pages.select("url"), *warc.write_index(archives))
    records = warc.read_records(captures, archives)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and the shards that take them: ``shards`` is shard:words, comma-joined in order of passes."""
    measured = mixing.measure(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    mixed = mixing.mix(materialize(measured, "mix-measured"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"])
    to_shards = F.array_join(F.transform(F.filter("draws", lambda d: d["words"] > 0), lambda d: F.concat_ws(":", d["shard"].cast("string"), d["words"].cast("string"))), ",")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), to_shards.alias("shards"))


def op11_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text by a rank file, decode the ids again, and digest both."""
    ids = recursive_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS)
    kept = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    return recursive_bpe.decode(kept, RANKS).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every whole text, with the corpus-wide counts of the linked pairs."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = alignment.aligned_table(table(spark, sf_dir, "documents"), TOKENIZER, PIECES, digest)
    return alignment.with_counts(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds from 16 first centroids."""
    return clustering.clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_training_order": op1_training_order,
    "op2_bpe": op2_bpe,
    "op3_licences": op3_licences,
    "op4_nearest": op4_nearest,
    "op5_toxicity": op5_toxicity,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
    "op11_recursive_bpe": op11_recursive_bpe,
    "op12_alignment": op12_alignment,
    "op13_clusters": op13_clusters,
}


def _clusters_sql(k: int = clustering.K, rounds: int = clustering.ROUNDS) -> str:
    """Centroids c0, c1, … and assignments a0, a1, … as tables."""
    parts = [
        f"""v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
            WHERE len(embedding) = {clustering.SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, w FROM (SELECT w, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS (
            SELECT vec_id, w, c, d FROM (
                SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS place
                FROM (SELECT vec_id, v.w, c, CAST(list_sum(list_transform(list_zip(v.w, m.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{n} m)
            ) WHERE place = 1)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS (
                SELECT m.c, coalesce(t.w, m.w) AS w FROM c{n} m LEFT JOIN (
                    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w
                    FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a{n}) GROUP BY c, i) GROUP BY c
                ) t ON t.c = m.c)""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.w, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} m ON m.c = a.c"""


# Where SQL says the same. Training, graphs, merges and draws have no SQL form; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op6_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5""",
    "op7_near_duplicates": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), u AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
        f AS (
            SELECT doc_id, n, i, concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d) AS shingle
            FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)
        ), e AS (SELECT DISTINCT doc_id, shingle FROM f WHERE i <= greatest(n - 4, 1)),
        n AS (SELECT w.doc_id, count(e.shingle) AS size FROM w LEFT JOIN e ON e.doc_id = w.doc_id GROUP BY w.doc_id),
        linked AS (
            SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.size, nb.size HAVING 100 * count(*) >= 85 * (na.size + nb.size - count(*))
        ), reach AS (SELECT u AS node, v AS other FROM linked UNION SELECT r.node, l.v FROM reach r JOIN linked l ON r.other = l.u)
        SELECT n.doc_id, CAST(n.size AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(min(r.other), n.doc_id)) AS component_id,
            least(n.doc_id, coalesce(min(r.other), n.doc_id)) = n.doc_id AS kept
        FROM n LEFT JOIN reach r ON r.node = n.doc_id GROUP BY n.doc_id, n.size""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS kept FROM p)
        SELECT page_id, payload_bytes,
            list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((
                (strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS INTEGER), 1)) - 1) * 16
                + strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS INTEGER), 1)) - 1) // CAST(pow(2, 3 - 5 * i % 4) AS INTEGER) % 32 + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
        FROM d""",
    "op13_clusters": _clusters_sql(),
}
