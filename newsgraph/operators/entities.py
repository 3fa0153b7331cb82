"""Entities that a headline names, as column expressions: places, names, ages, vehicles, roles, counts.

Every function takes its word lists as a parameter, so the same plan runs on any language. An entity
is struct(key, weight, rare); keys are "kind:value" and unique in a headline.

Edge cases: a null or empty text names nothing; a null count gives no entity, as silence is no
agreement; a term that holds another one is blanked before the other is looked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsgraph.functions import text as X
from newsgraph.lexicon import AREAS, PROVINCES

# Weight of each kind of entity, and whether it is rare enough to speak for one event.
WEIGHTS = {
    "landmark": (3.0, True), "name": (3.0, True), "age": (2.0, True), "marque": (2.0, True), "role": (2.0, True), "nationality": (2.0, True),
    "province": (1.0, False), "vehicle": (1.0, False), "who": (1.0, False), "deaths": (1.5, False), "injuries": (1.0, False),
}
BLANK = "␀"


@dataclass(frozen=True)
class Entities:
    """Word lists: tables lead from a code to its terms."""

    areas: dict[str, str]
    hints: tuple[str, ...]
    provinces: tuple[str, ...]
    common_names: dict[str, str]
    marques: dict[str, tuple[str, ...]]
    vehicles: dict[str, tuple[str, ...]]
    blanked_vehicle: tuple[str, str]
    symbols: dict[str, str]
    outcomes: dict[str, str]
    filler: tuple[str, ...]
    honorifics: tuple[str, ...]
    no_names: tuple[str, ...]
    quotes: tuple[tuple[str, str], ...]
    quote_noise: tuple[str, ...]
    name_letters: str
    nationalities: dict[str, tuple[str, ...]]
    no_nationalities: tuple[str, ...]
    roles: dict[str, tuple[str, ...]]
    generic_roles: dict[str, tuple[str, ...]]


# The Thai lists.
_CAR_MARQUES = {
    "bmw": ("bmw", "บีเอ็ม", "บีเอ็มดับเบิลยู"), "benz": ("benz", "เบนซ์", "เมอร์เซเดส"), "porsche": ("porsche", "ปอร์เช่"),
    "ferrari": ("ferrari", "เฟอร์รารี"), "lamborghini": ("lamborghini", "ลัมโบร์กินี"), "tesla": ("tesla", "เทสลา"),
    "audi": ("audi", "อาวดี้"), "volvo": ("volvo", "วอลโว่"),
}
THAI = Entities(
    areas=AREAS,
    hints=("สน.",),
    provinces=PROVINCES,
    common_names={"กทม": "กรุงเทพมหานคร", "กทม.": "กรุงเทพมหานคร", "โคราช": "นครราชสีมา", "พัทยา": "ชลบุรี", "หาดใหญ่": "สงขลา"},
    marques={**_CAR_MARQUES, "toyota": ("toyota", "โตโยต้า"), "honda": ("honda", "ฮอนด้า"), "isuzu": ("isuzu", "อีซูซุ"), "yamaha": ("yamaha", "ยามาฮ่า")},
    vehicles={
        "2W": ("จยย.", "มอเตอร์ไซค์", "บิ๊กไบก์", "บิ๊กไบค์", "จักรยานยนต์"),
        "3W": ("ตุ๊กตุ๊ก", "สามล้อ", "สกายแล็บ", "ซาเล้ง"),
        "4W-C": ("เก๋ง", "รถหรู", *(t for terms in _CAR_MARQUES.values() for t in terms)),
        "4W-P": ("กระบะ", "ปิกอัพ"),
        "Truck": ("บรรทุก", "สิบล้อ", "หกล้อ", "พ่วง", "เทรลเลอร์", "คอนเทนเนอร์"),
        "Van": ("รถตู้",),
        "Bus": ("รถบัส", "รถทัวร์", "รถโดยสาร", "สองแถว"),
        "Bike": ("จักรยาน",),
    },
    blanked_vehicle=("จักรยานยนต์", "2W"),
    symbols={"2W": "②", "3W": "③", "4W-C": "④", "4W-P": "⑤", "Truck": "⑥", "Van": "⑦", "Bus": "⑩", "Bike": "⑪"},
    outcomes={"ดับ": "⑧", "เสียชีวิต": "⑧", "ตาย": "⑧", "ตายคาที่": "⑧", "ศพ": "⑧", "สาหัส": "⑨", "บาดเจ็บ": "⑨", "เจ็บ": "⑨"},
    filler=("ที่", "ใน", "และ", "หรือ", "ของ", "กับ", "มี", "การ", "ความ"),
    honorifics=("นางสาว", "ด.ช.", "ด.ญ.", "น.ส.", "เสี่ย", "น้อง", "ยาย", "ลุง", "ป้า", "นาย", "นาง"),
    no_names=(
        "กรัฐมนตรี", "กเทศมนตรี", "กอบต.", "กอำเภอ", "กสมาคม", "กสภา", "กเล็ก",
        "อำเภอ", "ตำรวจ", "แพทย์", "พยาบาล", "ทหาร", "ประกัน", "จ้าง", "ทุน",
        "สาว", "ชาย", "ฟ้า", "เอก", "ท้าย", "หน้า", "แบบ", "เรือ", "สนาม",
        "วัย", "อายุ", "ราย", "คน",
    ),
    quotes=(("“", "”"), ("‘", "’"), ("「", "」"), ("«", "»"), ('"', '"'), ("'", "'")),
    quote_noise=("เมา", "ดื่ม", "แอลกอฮอล์", "ด่าน", "ขับ", "ขี่", "ชน", "ดับ", "ตาย", "ศพ", "จับ", "ปี", "คดี", "กฎหมาย", "อันตราย"),
    name_letters=r"\x{0E01}-\x{0E59}",
    nationalities={
        "เมียนมา": ("เมียนมา", "พม่า"), "กัมพูชา": ("กัมพูชา", "เขมร"), "ลาว": ("ลาว",), "เวียดนาม": ("เวียดนาม",), "จีน": ("จีน", "ไต้หวัน"),
        "เกาหลี": ("เกาหลี",), "ญี่ปุ่น": ("ญี่ปุ่น",), "อินเดีย": ("อินเดีย",), "รัสเซีย": ("รัสเซีย",), "อังกฤษ": ("อังกฤษ",),
        "เยอรมัน": ("เยอรมัน", "เยอรมนี"), "ฝรั่งเศส": ("ฝรั่งเศส",), "อเมริกา": ("อเมริกา", "สหรัฐ"), "มาเลเซีย": ("มาเลเซีย",), "สิงคโปร์": ("สิงคโปร์",),
    },
    no_nationalities=("ปราจีน",),
    roles={
        "ผู้ใหญ่บ้าน": ("ผู้ใหญ่บ้าน", "ผญบ.", "ผญ.บ."), "กำนัน": ("กำนัน",), "นายอำเภอ": ("นายอำเภอ",),
        "ผอ.โรงเรียน": ("ผอ.โรงเรียน", "ผอ.ร.ร.", "ผู้อำนวยการโรงเรียน", "ครูใหญ่"), "ผอ.รพ.สต.": ("ผอ.รพ.สต.", "ผู้อำนวยการโรงพยาบาลส่งเสริม"),
        "อบต.": ("ส.อบต.", "นายกอบต.", "นายก อบต."), "เทศมนตรี": ("เทศมนตรี",), "สจ.": ("ส.จ.", "สจ."), "พระ": ("พระสงฆ์", "หลวงพ่อ", "หลวงพี่", "สามเณร"),
        "ผู้พิพากษา": ("ผู้พิพากษา", "อัยการ"), "คนดัง": ("ดารา", "นักร้อง", "อินฟลูเอนเซอร์", "ยูทูบเบอร์", "เน็ตไอดอล"),
    },
    generic_roles={
        "นักเรียน": ("นักเรียน", "นร."), "นักศึกษา": ("นักศึกษา", "นศ."), "ตำรวจ": ("ตำรวจ", "ตร."), "ทหาร": ("ทหาร",), "ครู": ("ครู",),
        "บุคลากรแพทย์": ("แพทย์", "พยาบาล", "คุณหมอ"), "วัยรุ่น": ("วัยรุ่น",), "ไรเดอร์": ("ไรเดอร์",),
    },
)
# Lists for the made-up documents, which hold no Thai.
SAMPLE = Entities(
    areas={"th": "north", "rn": "south", "und": "north"}, hints=("th",), provinces=("er", "en", "ou", "qu"), common_names={"qu": "er"},
    marques={"m1": ("abc", "ver"), "m2": ("que",)}, vehicles={"2W": ("andi", "bik"), "3W": ("ing",), "4W": ("ent", "ver"), "Bike": ("and",)}, blanked_vehicle=("andi", "2W"),
    symbols={"2W": "②", "3W": "③", "4W": "④", "Bike": "⑪"}, outcomes={"dead": "⑧", "ment": "⑨"}, filler=("of", "is"),
    honorifics=("Mrs", "Mr", "Dr"), no_names=("st", "co"), quotes=(("(", ")"), ('"', '"')), quote_noise=("ion",), name_letters="a-z",
    nationalities={"n1": ("ish", "ese"), "n2": ("lic",)}, no_nationalities=("publish",), roles={"r1": ("chief", "head"), "r2": ("son",)}, generic_roles={"g1": ("man",), "g2": ("wo", "wi")},
)


def _has_any(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms))


def codes_in(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Codes of the table of which the text holds a term, in the table's order."""
    return F.array_compact(F.array(*(F.when(_has_any(text, terms), F.lit(code)) for code, terms in table.items())))


def _replaced(text: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def title_symbols(words: Entities) -> list[tuple[str, str]]:
    """Vehicle and outcome words with their symbol, longest first; Latin ones also in capitals."""
    pairs = {}
    for code, terms in words.vehicles.items():
        for t in terms:
            cased = (t, t.upper(), t[0].upper() + t[1:]) if re.fullmatch("[a-z]+", t) else (t,)
            pairs |= dict.fromkeys(cased, words.symbols[code])
    return sorted((pairs | words.outcomes).items(), key=lambda p: -len(p[0]))


def story_title(title: Column, words: Entities = THAI) -> Column:
    """Title for comparison: one symbol for all words of a vehicle or outcome, filler gone."""
    return F.trim(_replaced(_replaced(title, title_symbols(words)), [(f, "") for f in words.filler]))


def regions(text: Column, words: Entities = THAI) -> Column:
    """Provinces that the text names, those of areas first, each once, under their full names."""
    named = [*words.areas.items(), *((p, words.common_names.get(p, p)) for p in words.provinces)]
    found = lambda bound: F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(bound, F.lit(t)), F.lit(p)) for t, p in named))))
    return F.transform(F.array(text), found)[0]


def vehicles(title: Column, words: Entities = THAI) -> Column:
    """Classes of vehicles named, sorted; the blanked word counts for its own class only."""
    long, own = words.blanked_vehicle
    low = F.replace(F.lower(title), F.lit(long), F.lit(BLANK))
    return F.array_sort(codes_in(low, {code: (*terms, BLANK) if code == own else terms for code, terms in words.vehicles.items()}))


def vehicle_signature(title: Column, words: Entities = THAI) -> Column:
    return F.array_join(vehicles(title, words), ",")


def marques(title: Column, words: Entities = THAI) -> Column:
    return codes_in(F.lower(title), words.marques)


def landmarks(title: Column, words: Entities = THAI) -> Column:
    return codes_in(title, {a: (a,) for a in words.areas if a not in words.hints})


def nationalities(title: Column, words: Entities = THAI) -> Column:
    return codes_in(_replaced(title, [(t, BLANK) for t in words.no_nationalities]), words.nationalities)


def quoted(title: Column, words: Entities = THAI) -> Column:
    """Quoted spans of 2 to 25 characters, pair of quotes by pair."""
    found = []
    for a, b in words.quotes:
        a, b = re.escape(a), re.escape(b)
        found.append(F.regexp_extract_all(title, F.lit(f"{a}([^{a}{b}]{{2,25}}){b}"), F.lit(1)))
    return F.transform(F.concat(*found), lambda s: F.trim(s))


def names(title: Column, words: Entities = THAI) -> Column:
    """Names: quoted spans that aren't just the subject, and what follows an honorific and opens no office."""
    own = F.filter(quoted(title, words), lambda s: ~_has_any(s, words.quote_noise) | _has_any(s, words.honorifics))
    own = F.transform(own, lambda s: F.regexp_replace(s, r"\s+", ""))
    longest = sorted(words.honorifics, key=len, reverse=True)
    after = F.concat(*(F.regexp_extract_all(title, F.lit(f"{re.escape(h)}(?=([{words.name_letters}]{{2,10}}))"), F.lit(1)) for h in longest))
    plain = F.filter(after, lambda t: ~reduce(lambda a, b: a | b, (F.startswith(t, F.lit(w)) for w in words.no_names)))
    return F.array_distinct(F.concat(own, plain))


def _of(kind: str, values: Column) -> Column:
    weight, rare = WEIGHTS[kind]
    return F.transform(values, lambda v: F.struct(F.concat(F.lit(f"{kind}:"), v.cast("string")).alias("key"), F.lit(weight).alias("weight"), F.lit(rare).alias("rare")))


def entities(title: Column, provinces: Column, deaths: Column, injuries: Column, words: Entities = THAI) -> Column:
    """All entities of a report, rare kinds first."""
    title = F.coalesce(title, F.lit(""))
    count = lambda c: F.array_compact(F.array(c))
    return F.concat(
        _of("landmark", landmarks(title, words)), _of("name", names(title, words)), _of("age", X.ages(title)), _of("marque", marques(title, words)),
        _of("role", codes_in(title, words.roles)), _of("nationality", nationalities(title, words)),
        _of("province", F.array_distinct(F.coalesce(provinces, F.array().cast("array<string>")))), _of("vehicle", vehicles(title, words)), _of("who", codes_in(title, words.generic_roles)),
        _of("deaths", count(deaths)), _of("injuries", count(injuries)),
    )
