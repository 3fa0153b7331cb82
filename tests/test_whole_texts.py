"""Queries over whole texts: what stands late in a long text counts."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from newsgraph.functions import text as X
from newsgraph.lexicon import SAMPLE
from newsgraph.operators import rows
from newsgraph.plans.queries import QUERIES

FILL = "plain filling " * 60


def _documents(spark, tmp_path, texts):
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_late_terms_and_endings_count(spark, tmp_path):
    term = SAMPLE.decisive[0]
    sf = _documents(spark, tmp_path, [f"{FILL}\n{FILL}", f"{FILL}\n{FILL}{term}", f"{FILL}\n{FILL}", f"{FILL}\n{FILL}other end"])
    got = {r["doc_id"]: r["reason"] for r in QUERIES["c8_classify"](spark, sf).collect()}
    assert {i for i, reason in got.items() if reason.startswith("dui-body")} == {1}
    assert QUERIES["a13_tallies"](spark, sf).first()["passed"] == 1
    assert sorted(r["doc_id"] for r in QUERIES["c9_first_title_wins"](spark, sf).collect()) == [0, 1, 3]
    assert sorted(r["doc_id"] for r in QUERIES["w1_new_rows"](spark, sf).collect()) == [1, 3]
    assert {r["doc_id"] for r in QUERIES["c1_title_key"](spark, sf).filter(F.col("text_key").endswith("otherend")).collect()} == {3}
    assert {r["doc_id"] for r in QUERIES["x8_search_key"](spark, sf).filter(F.col("search_key").endswith("otherend")).collect()} == {3}


def test_every_document_has_an_owner_or_is_one(spark, tmp_path):
    long = FILL + FILL
    sf = _documents(spark, tmp_path, [long, long + "a", long, long + "b", long + " A", long + "b", long + "c"])
    got = {r["doc_id"]: r["owner"] for r in QUERIES["w3_owners"](spark, sf).collect()}
    assert got == {2: 0, 4: 1, 5: 3}


def test_dice_of_whole_texts(spark, tmp_path):
    texts = [FILL + "first end", FILL + "รายอื่น \U0001f600\U0001f600", "", "A", FILL.upper()]
    got = {r["doc_id"]: r["dice"] for r in QUERIES["x27_dice_whole"](spark, _documents(spark, tmp_path, texts)).collect()}

    def plain(a, b):
        grams = [Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a.lower(), b.lower())]
        return round(2 * sum((grams[0] & grams[1]).values()) / (len(a) + len(b) - 2), 6) if min(len(a), len(b)) > 1 else 0

    assert got == {i: plain(texts[i], texts[i + 1]) for i in range(4)} and 0 < got[0] < 1


def test_candidates_of_whole_texts_equal_brute_force(spark, tmp_path):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdef") for _ in range(3))
    same = " ".join(word() for _ in range(30))
    texts = [same + " " + " ".join(word() for _ in range(draw.choice((0, 40, 400)))) for _ in range(30)] + ["", "!"]
    rows_ = [(i * 20, t, "en", f"s{i % 9}" if i % 5 else None, len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    padded = ["  " + re.sub("[^a-zA-Z0-9]", "", t).lower() + " " for t in texts]
    grams = [{p[k : k + 3] for k in range(len(p) - 2)} for p in padded]
    expected, by_region, across = set(), 0, 0
    for i, (a, _, _, s, _) in enumerate(rows_):
        near = []
        for j, (b, _, _, z, _) in enumerate(rows_):
            like = np.float32(len(grams[i] & grams[j]) / len(grams[i] | grams[j]))
            if i != j and b >= a - 14 * 24 and (like >= np.float32(0.35) or (s is not None and s == z)):
                near.append((-like, b))
                by_region += like < 0.35
                across += s != z
        expected |= {(a, b, r + 1) for r, (_, b) in enumerate(sorted(near)[:60])}
    got = {(r["left_id"], r["right_id"], r["rank"]) for r in QUERIES["j6_candidates_whole"](spark, str(tmp_path)).collect()}
    assert got == expected and by_region and across


def test_long_trigrams_equal_short(spark):
    df = spark.createDataFrame([(t,) for t in ("", "a", "Abab", "ก\U0001f600x\U0001f600")], "t string")
    assert all(r["a"] == r["b"] for r in df.select(X.trigrams(F.col("t")).alias("a"), X.trigrams_of_long(F.col("t")).alias("b")).collect())


def test_sample_of_several_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        df = spark.range(0, 200_000, 1, 4).select((F.col("id") * 7919 % 200_003).alias("id"))
        plain = sorted(r["id"] for r in df.collect())
        for size in (1000, 777):
            step = len(plain) // size
            assert sorted(r["id"] for r in rows.systematic_sample(df, size, F.col("id")).collect()) == plain[::step][:size]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
