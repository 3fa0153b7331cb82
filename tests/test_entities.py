"""Entities and the decision over them, on hand-made headlines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsgraph.operators import entities as E
from newsgraph.operators import match

NOON = dt.datetime(2026, 8, 1, 12, tzinfo=dt.UTC)


def of(spark, function, *titles):
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    return [r["v"] for r in rows.select("id", function(F.col("title")).alias("v")).orderBy("id").collect()]


def test_vehicles(spark):
    titles = ["หนุ่มเมาขับ BMW ชนรถตุ๊กตุ๊ก", "เก๋งหรูพุ่งชนสามล้อเครื่อง", "เมาขับชนจักรยานยนต์", "เมาขับชนจักรยาน", "เก๋งชนจักรยานยนต์และจักรยาน", "เมาแล้วขับ โทษปรับสูงสุดเท่าไร", "จยย.ถูกกระบะชน", None]
    assert of(spark, E.vehicle_signature, *titles) == ["3W,4W-C", "3W,4W-C", "2W", "Bike", "2W,4W-C,Bike", "", "2W,4W-P", ""]
    assert of(spark, E.marques, "หนุ่มบีเอ็ม ชน HONDA", "เดิน") == [["bmw", "honda"], []]


def test_places_names_and_roles(spark):
    assert of(spark, E.regions, "สน.ทองหล่อ กทม. และโคราช", "ร้อยเอ็ด", "ไม่มี") == [["กรุงเทพมหานคร", "นครราชสีมา"], ["ร้อยเอ็ด"], []]
    assert of(spark, E.landmarks, "สน.ทองหล่อ", "สน.") == [["ทองหล่อ"], []]
    assert of(spark, E.nationalities, "แรงงานพม่า ปราจีนบุรี", "นักท่องเที่ยวจีน") == [["เมียนมา"], ["จีน"]]
    got = of(spark, E.names, "จับ “เสี่ยต้น” ซิ่งชนนายสมชาย", "“เมาแล้วขับ” โทษหนัก", "นายกรัฐมนตรี สั่ง", "ด.ช.วัย 14 ปี", 'ชื่อ "ก ข"', "", None)
    assert got[0] == ["เสี่ยต้น", "ต้น", "สมชาย"] and got[1:5] == [[], [], [], ["กข"]] and got[5] == []


def test_story_title(spark):
    assert of(spark, E.story_title, "เก๋งชนจักรยานยนต์ ดับ 2 ศพ ในที่เกิดเหตุ", "BMW ตายคาที่", " กระบะ ") == ["④ชน② ⑧ 2 ⑧ เกิดเหตุ", "④ ⑧", "⑤"]


TITLE = "เมาแล้วขับ ซิ่งกระบะพุ่งชน จยย."
PHRAM2 = TITLE + " กลางถนนพระราม 2"
CASES = [
    ((TITLE + " ดับ 2 ราย", ["กำแพงเพชร"], 2, 0), (TITLE + " ดับ 2 ราย ที่กำแพงเพชร", ["กำแพงเพชร"], 2, 0), True),
    (("เมาแล้วขับชนดับ 2 ราย", ["เชียงใหม่"], 2, 0), ("เมาแล้วขับชนดับ 2 ราย", ["ภูเก็ต"], 2, 0), False),
    ((TITLE + " ดับคาที่", ["ชลบุรี"], 1, 0), (TITLE + " ดับคาที่ กลางดึก", ["ชลบุรี"], None, 0), True),
    ((PHRAM2 + " ดับ 2 ราย", ["กรุงเทพมหานคร"], 2, 0), (PHRAM2 + " ดับ 3 ราย", ["กรุงเทพมหานคร"], 3, 6), True),
    ((PHRAM2 + " ดับ 2 ราย", ["กรุงเทพมหานคร"], 2, 0), (PHRAM2 + " ดับ 3 ราย", ["กรุงเทพมหานคร"], 3, 72), False),
    (("ตั้งด่านตรวจแอลกอฮอล์ รวบเมาแล้วขับ 120 ราย ดับ 1 ราย", ["ขอนแก่น"], 1, 0), ("ตั้งด่านตรวจแอลกอฮอล์ รวบเมาแล้วขับ 340 ราย ดับ 4 ราย", ["ขอนแก่น"], 4, 0), False),
    (("เมาแล้วขับชนเสาไฟ ดับ 1 ราย", ["ตาก"], 1, 0), ("เปิดกฎหมายเมาแล้วขับ โทษปรับสูงสุดเท่าไร", ["ตาก"], 1, 0), False),
    (("หนุ่มเมาขับ BMW ชนประสานงา รถตุ๊กตุ๊ก เสียชีวิตสลด 3 ราย", ["นนทบุรี"], 3, 0), ("หนุ่มเมาขับ BMW ชนรถตุ๊กตุ๊ก คดีถึงที่สุด", ["นนทบุรี"], None, 240), True),
    (("เมาแล้วขับ เก๋งชน จยย. ดับคาที่", ["ขอนแก่น"], None, 0), ("เมาแล้วขับ เก๋งเสยท้าย จยย. เจ็บหนัก", ["ขอนแก่น"], None, 240), False),
    (("เมาขับเก๋งชน จยย. ดับ 2 ราย", ["ขอนแก่น"], 2, 0), ("เมาขับเก๋งชน จยย. ดับ 2 ราย", ["ภูเก็ต"], 2, 216), False),
    (("เมาแล้วขับชนแล้วหลบหนี ตำรวจเร่งล่า", [], None, 0), ("เมาแล้วขับชนแล้วหนี ตำรวจตามล่าตัว", [], None, 0), False),
    ((PHRAM2 + " ดับ 2 ราย", ["กรุงเทพมหานคร"], 2, None), (PHRAM2 + " ดับ 3 ราย", ["กรุงเทพมหานคร"], 3, None), True),
]


def test_same_event(spark):
    at = lambda hours: None if hours is None else NOON + dt.timedelta(hours=hours)
    rows = [(i, *a[:3], at(a[3]), *b[:3], at(b[3])) for i, (a, b, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i long, t string, p array<string>, d int, w timestamp, t2 string, p2 array<string>, d2 int, w2 timestamp")
    none = F.lit(None).cast("int")
    sides = df.select("i", match.features(F.col("t"), F.col("p"), F.col("d"), none, F.col("w")).alias("a"), match.features(F.col("t2"), F.col("p2"), F.col("d2"), none, F.col("w2")).alias("b"))
    got = sides.select("i", match.tell_same_event(F.col("a"), F.col("b")).alias("same"), match.tell_same_event(F.col("b"), F.col("a")).alias("back")).orderBy("i").collect()
    assert [r["same"] for r in got] == [c[2] for c in CASES] and all(r["same"] == r["back"] for r in got)


def test_first_match(spark):
    story = lambda i, t, d: (i, t, ["ตาก"], d, NOON)
    rows = spark.createDataFrame([story(1, TITLE + " ดับ 2 ราย", 2), story(2, "เปิดกฎหมาย", None), story(3, TITLE + " ดับ 2 ราย", 2), story(4, "อื่น", 9)], "id long, t string, p array<string>, d int, w timestamp")
    rows = rows.select("id", match.features(F.col("t"), F.col("p"), F.col("d"), F.lit(None).cast("int"), F.col("w")).alias("features"))
    candidates = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 1, 3), (4, 2, 1)], "left_id long, right_id long, rank int")
    assert [tuple(r) for r in match.first_match(candidates, rows, rows).collect()] == [(1, 3)]
    assert match.first_match(candidates.limit(0), rows, rows).count() == 0


@pytest.mark.parametrize("words", [E.THAI, E.SAMPLE])
def test_entities_are_unique(spark, words):
    df = spark.createDataFrame([("เก๋ง BMW ชน จยย. ที่ทองหล่อ ด.ช.สมชาย อายุ 14 ปี ตำรวจ", ["ตาก", "ตาก"], 2, 0), (None, None, None, None)], "t string, p array<string>, d int, i int")
    got = [[e["key"] for e in r["e"]] for r in df.select(E.entities(F.col("t"), F.col("p"), F.col("d"), F.col("i"), words).alias("e")).collect()]
    assert all(len(set(g)) == len(g) for g in got) and got[1] == [] and {"age:14", "province:ตาก", "deaths:2", "injuries:0"} <= set(got[0])


def test_entities_and_features_are_not_sent_through_the_driver(spark):
    """Lists that repeat are a small file and large in memory, so their joins are by shuffle at any size."""
    from newsgraph.plans import story_queries

    for query, rows in ((story_queries.g5_overlap, "ENTITIES"), (story_queries.j7_first_match, "FEATURES"), (story_queries.g6_same_event, "FEATURES")):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plan, rows


def test_matching_numbers_letter_pairs_once_a_report(spark):
    from newsgraph.functions import text as X

    titles = ["aaaa aab", "AAaa", "a", "", None, "รถชนดับ ดับ", "a1a1a10", "banana bandana"]
    pairs = spark.createDataFrame([(a, b) for a in titles for b in titles], "a string, b string")
    new = X.dice_of_numbered(X.numbered_bigrams(F.col("a")), X.numbered_bigrams(F.col("b")), F.length("a"), F.length("b"))
    assert pairs.filter(~new.eqNullSafe(X.dice(F.col("a"), F.col("b")))).count() == 0
    reports = spark.range(2).select("id", match.features(F.lit("t"), F.array(F.lit("r")), F.lit(1).cast("long"), F.lit(1).cast("long"), F.lit("2024-01-01").cast("timestamp")).alias("features"))
    plan = match.matching(spark.createDataFrame([(0, 1, 1)], "left_id long, right_id long, rank int"), reports, reports)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert "array_intersect" in plan and not any("substring" in line for line in filters)
