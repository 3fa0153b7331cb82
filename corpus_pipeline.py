"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before
the next. The first four return the columns of ``documents``:

* ``toxicity`` drops documents that the classifier marks; one without text, or with nothing in it that
  the classifier knows, stays.
* ``near_duplicates`` keeps one document of each class of near copies (the smallest doc_id).
* ``pii`` replaces personal data in the text by its kind in brackets.
* ``mixing`` returns one row per draw of the mix, so a document may stand up to three times or not at
  all; texts are whole, and documents without words, which count nothing, stand once.
* ``bpe`` adds ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``.

Texts may be null or empty in every stage and then pass unchanged. Columns beyond those of
``documents`` are dropped at the start.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.llm import bpe, mixing, near_duplicates, pii, toxicity
from newsgraph.tables import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SIMILARITY_PERCENT = 80


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels"), F.lit(True)))
    return toxicity.score(docs.select(*COLUMNS), model, out="toxicity").filter(F.col("toxicity") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = near_duplicates.near_duplicates(docs, percent=SIMILARITY_PERCENT)
    gone = classes.filter("NOT kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(pii.redacted(docs.select(*COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(mixing.shards(mixing.mix(mixing.measure(docs.select(*COLUMNS)))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = bpe.encode(docs.select(*COLUMNS).withColumn("_text", F.col("text")), TOKENIZER, text="_text")
    return ids.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]
# Training, Viterbi decoding and merges have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
